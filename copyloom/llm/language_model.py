"""Scoring texts by context-tree weighting over bytes.

Each byte is eight binary decisions; each decision has a context tree over the bytes before it, up to DEPTH of them. Every node
holds a Krichevsky-Trofimov estimate, and its weighted probability is half its own and half its children's, from the deepest
up. The counts are sums over all training texts; a text's probability mixes the estimates of all depths along each path by
their posterior weights. Unigram counts of words give a base score beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom.llm.common import LOWER, batches_of, chunks, give_back, stored, text_bytes, word_hashes

DEPTH = 5
#: A chunk is scored with one table of the words and grams it has: so many rows of a partition at most, as a power of two, where
#: partitions of less than so many bytes are read together. Larger chunks repeat fewer words and grams.
CHUNK_BITS, CHUNK_BYTES = 15, 64_000_000
#: Bytes of text that a Python worker gets at once, about, and its rows: a row of questions or answers has some tens of kilobytes.
BATCH_BYTES, BATCH_ROWS = 256_000, (64, 10_000)
#: Raw keys that a task gathers before it counts them, and different keys that it holds before it gives them out.
GATHERED, HELD = 500_000, 2_500_000
#: Keys are dealt to buckets by hash: a power of two that follows the number of chunks, within these limits.
BUCKET_BITS = (7, 14)
_END = np.uint64(0x5BD1E9955BD1E995)
_SLOT_BITS = 22


def default_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 when divided by 5; rows without an id are learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def grams(buf: np.ndarray, offs: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Each byte (A-Z lower-cased) with the `depth` bytes before it, the byte itself lowest; zeros stand before a text and one
    ends it. Also where each text's start among them."""
    n = len(offs) - 1
    size = np.diff(offs)
    z = np.zeros(len(buf) + depth * (n + 1) + 1, np.uint8)
    z[np.arange(len(buf)) + np.repeat(depth * np.arange(1, n + 1), size)] = LOWER[buf]
    at = np.arange(len(buf) + n) + np.repeat(depth + (depth - 1) * np.arange(n), size + 1)
    g = np.zeros(len(at), np.uint64)
    for k in range(depth + 1):
        g |= z[at - k].astype(np.uint64) << np.uint64(8 * k)
    return g, offs + np.arange(n + 1)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with their sums."""
    key, n = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[start], np.add.reduceat(n, start)


def _keys(buf: np.ndarray, offs: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """(kind, keys) of texts: kind 0 words by hash and ends of texts, kind 1 grams."""
    h, _ = word_hashes(buf, offs)
    yield 0, np.concatenate([h, np.full(len(offs) - 1, _END)])
    yield 1, grams(buf, offs, depth)[0]


class _Gathered:
    """Keys with their counts; a key that is only met, not learnt from, counts 0."""

    def __init__(self):
        self.raw: list[list[np.ndarray]] = [[], []]
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = self.size = 0

    def add(self, keys: np.ndarray, learnt: bool) -> bool:
        """Whether there are so many that they should be given out."""
        self.raw[learnt].append(keys)
        self.waiting += len(keys)
        return self.waiting > GATHERED and self.hold(*self._settled())

    def hold(self, *counted: tuple[np.ndarray, np.ndarray]) -> bool:
        self.held += counted
        self.size += sum(len(k) for k, _ in counted)
        if self.size <= HELD:
            return False
        self.held = [_merged(self.held)]
        self.size = len(self.held[0][0])
        return self.size > HELD - GATHERED

    def _settled(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for learnt, some in enumerate(self.raw):
            if some:
                key, n = np.unique(np.concatenate(some), return_counts=True)
                some.clear()
                yield key, n.astype(np.uint32) * np.uint32(learnt)
        self.waiting = 0

    def out(self) -> tuple[np.ndarray, np.ndarray] | None:
        self.hold(*self._settled())
        self.size = 0
        return _merged(self.held) if self.held else None


def packed(x: np.ndarray) -> bytes:
    """Numbers in order as few bytes: byte planes, compressed."""
    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=n * size, codec="zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _unpacked_keys(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(raw, n, np.uint64), dtype=np.uint64)


def _bucket(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key ^ key >> np.uint64(23) ^ key >> np.uint64(41)) & np.uint64((1 << bits) - 1)).astype(np.int32)


def _bucket_of(key: str, bits: int) -> Column:
    """The same in SQL."""
    return F.expr(f"cast(({key} ^ shiftrightunsigned({key}, 23) ^ shiftrightunsigned({key}, 41)) & {(1 << bits) - 1} as int)")


def chunk_keys(texts: DataFrame, bits: int, depth: int = DEPTH) -> DataFrame:
    """(bucket, chunk, kind, n, keys, counts): the different words and grams of each chunk of texts (chunk, text, learnt), once or once a
    flush, packed by bucket, with how often they are learnt from."""
    names = ["bucket", "chunk", "kind", "n", "keys", "counts"]

    def dealt(chunk: int, kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        bucket = _bucket(key, bits)
        order = np.argsort(bucket, kind="stable")
        bucket, key, n = bucket[order], key[order], n[order]
        cuts = _cuts(bucket)
        size = len(cuts)
        keys = [packed(np.diff(key[s:e], prepend=np.uint64(0))) for s, e in cuts]
        cols = [pa.array([int(bucket[s]) for s, _ in cuts], pa.int32()), pa.array([chunk] * size, pa.int64()), pa.array([kind] * size, pa.int32()), pa.array([e - s for s, e in cuts], pa.int64())]
        return pa.RecordBatch.from_arrays([*cols, pa.array(keys, pa.binary()), pa.array([packed(n[s:e].astype(np.uint32)) for s, e in cuts], pa.binary())], names=names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, now = [_Gathered(), _Gathered()], -1

        def rest(kinds=(0, 1)) -> Iterator[pa.RecordBatch]:
            for kind in kinds:
                if found := got[kind].out():
                    yield dealt(now, kind, *found)

        for batch in batches:
            at = batch.column(0).to_numpy()
            for s, e in _cuts(at):
                if at[s] != now:
                    yield from rest()
                    now = int(at[s])
                    give_back()
                part = batch.slice(s, e - s)
                learnt = part.column(2)
                for weight, rows in ((True, part.filter(learnt)), (False, part.filter(pc.invert(learnt)))):
                    buf, offs = text_bytes(rows.column(1))
                    for i, j in chunks(offs):
                        for kind, keys in _keys(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], depth):
                            if got[kind].add(keys, weight):
                                yield from rest((kind,))
        yield from rest()
        give_back()

    return texts.select("chunk", "text", "learnt").mapInArrow(gather, "bucket int, chunk long, kind int, n long, keys binary, counts binary")


def corpus_counts(asked: DataFrame) -> DataFrame:
    """(kind, key, n): the sums over all chunks; n is 0 for what only texts not learnt from have. Tasks add up what they read first, which is
    most of it where the rows of a bucket stand together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_Gathered(), _Gathered()]

        def rest(kinds=(0, 1)) -> Iterator[pa.RecordBatch]:
            for kind in kinds:
                if found := got[kind].out():
                    key, n = found
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

        for batch in batches:
            for kind, n, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if got[kind].hold((_unpacked_keys(keys, n), unpacked(counts, n, np.uint32).astype(np.int64))):
                    yield from rest((kind,))
        yield from rest()
        give_back()

    return asked.select("kind", "n", "keys", "counts").mapInArrow(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def answered(asked: DataFrame, values: DataFrame, bits: int) -> DataFrame:
    """(chunk, kind, n, keys, x): what the keys of each row of asked are worth. values: (kind, key, x). A task holds the values of one bucket."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found = -1, [[], []], None
        for batch in batches:
            bucket, asks = batch.column("bucket").to_numpy(), batch.column("keys").is_valid().to_numpy(zero_copy_only=False)
            for s, e in _cuts(bucket * 2 + asks):
                if bucket[s] != now:
                    now, held, found = bucket[s], [[], []], None
                    give_back()
                part = batch.slice(s, e - s)
                if not asks[s]:
                    kind, key, x = (part.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "key", "x"))
                    for k in (0, 1):
                        held[k].append((key[kind == k].astype(np.int64).view(np.uint64), x[kind == k]))
                    continue
                if found is None:
                    found, held = [_Values(h) for h in held], [[], []]
                cols = [part.column(c) for c in ("chunk", "kind", "n", "keys")]
                out = [packed(found[k].of(_unpacked_keys(raw, n)).astype(_WORTH[k])) for k, n, raw in zip(*(c.to_pylist() for c in cols[1:]), strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.binary())], names=["chunk", "kind", "n", "keys", "x"])
        found = None
        give_back()

    worth = values.select(_bucket_of("key", bits).alias("bucket"), "kind", "key", "x")
    both = worth.unionByName(asked.drop("counts"), allowMissingColumns=True).select("bucket", "kind", "key", "x", "chunk", "n", "keys")
    return both.repartition("bucket").sortWithinPartitions("bucket", F.col("keys").isNotNull()).mapInArrow(answer, "chunk long, kind int, n long, keys binary, x binary")


#: How the worth of a word (its count) and of a gram (a logarithm) are sent.
_WORTH = (np.float64, np.float32)


def _cuts(tag: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal tags start and end."""
    if not len(tag):
        return []
    cuts = [0, *(np.flatnonzero(tag[1:] != tag[:-1]) + 1).tolist(), len(tag)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 1/2 by Stirling's series, after eight steps of the recurrence where x is small."""
    low = x < 8
    y = np.where(low, x + 8, x)
    shift = np.zeros_like(y)
    for k in range(8):
        shift += np.where(low, np.log(np.where(low, x + k, 1.0)), 0.0)
    i = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + i * (1 / 12 - i * i * (1 / 360 - i * i * (1 / 1260 - i * i / 1680))) - shift


def level_nodes(ctx: np.ndarray, byte: np.ndarray, n: np.ndarray, child: tuple[np.ndarray, np.ndarray] | None):
    """The binary nodes of one depth, from grams that may repeat: key (ctx << 8 | bits so far with a leading 1), p of a 1, weight
    of the node's own estimate, and the log of the weighted probability; then for each gram's eight decisions, bit by bit, the
    node's place and whether a 1 follows. child: sums of the children's logs by key, None at the deepest level."""
    keys = np.concatenate([ctx << 8 | (1 << s) | (byte >> (8 - s)) for s in range(8)])
    ones = np.concatenate([(byte >> (7 - s)) & 1 for s in range(8)]).astype(bool)
    w = np.tile(n.astype(np.float64), 8)
    key, at = np.unique(keys, return_inverse=True)
    b = np.bincount(at, w * ones, len(key)).astype(np.float64)  # without grams it is of integers
    a = np.bincount(at, w * ~ones, len(key)).astype(np.float64)
    kt = _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - 1.1447298858494002
    p = (b + 0.5) / (a + b + 1)
    if child is None:
        return key, p, np.ones(len(key)), kt, at, ones
    below = np.zeros(len(key))
    below[np.searchsorted(key, child[0])] = child[1]
    both = np.logaddexp(kt, below) - np.log(2)
    return key, p, np.exp(kt - np.log(2) - both), both, at, ones


def _summed(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(key, return_inverse=True)
    return u, np.bincount(at, x, len(u))


def _up(key: np.ndarray, depth: int) -> np.ndarray:
    """The key of the same decision one byte of context shorter."""
    return ((key >> 8) & ((1 << (8 * depth - 8)) - 1)) << 8 | (key & 255)


def gram_logs(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, x) for all grams of counts: x is log10 of the probability of the gram's byte after its context.

    Contexts that share their last two bytes are worked on together, from the deepest up (at most 256 ** (depth - 1) grams, far
    fewer in text). The two top levels have at most 131,072 rows whatever the corpus; these are broadcast.
    """
    spark, deep = counts.sparkSession, min(2, depth)

    def lower(rows: pd.DataFrame) -> pd.DataFrame:
        g, n = rows.key.to_numpy(), rows.n.to_numpy()
        q, child = np.full(8 * len(g), 0.5), None
        for d in range(depth, deep - 1, -1):
            k = g & ((1 << (8 * d + 8)) - 1)
            key, p, own, log, at, one = level_nodes(k >> 8, k & 255, n, child)
            q = own[at] * np.where(one, p[at], 1 - p[at]) + (1 - own[at]) * q
            child = _summed(_up(key, d), log)
        raw = [x.tobytes() for x in np.ascontiguousarray(q.reshape(8, -1).T, np.float32)]
        return pd.concat([pd.DataFrame({"key": g, "q": raw, "log": np.nan}), pd.DataFrame({"key": child[0], "q": None, "log": child[1]})])

    g = counts.where("kind = 1").select("key", "n")
    low = stored(g.groupBy(F.expr("(key >> 8) & 65535").alias("pair")).applyInPandas(lower, "key long, q binary, log double"), "lower")
    top = g.groupBy(F.expr(f"key & {(1 << (8 * deep)) - 1}").alias("key")).agg(F.sum("n").alias("n")).toPandas()
    below = low.where("q is null").groupBy("key").agg(F.sum("log").alias("log")).orderBy("key").toPandas()
    child, shared = (below.key.to_numpy(np.int64), below["log"].to_numpy(np.float64)), []
    for d in range(deep - 1, -1, -1):
        k = top.key.to_numpy(np.int64) & ((1 << (8 * d + 8)) - 1)
        key, p, own, log, _, _ = level_nodes(k >> 8, k & 255, top.n.to_numpy(np.float64), child)
        child = _summed(_up(key, d), log) if d else None
        dense = np.full((2, 1 << (8 * d + 8)), 0.5)
        dense[:, key] = p, own
        shared.append(dense)
    levels = spark.sparkContext.broadcast(shared)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, out = batch.column(0).to_numpy(), np.zeros(batch.num_rows)
            q = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, 8).astype(np.float64)
            byte = g & 255
            for s in range(8):
                x, bits, one = q[:, s], (1 << s) | (byte >> (8 - s)), ((byte >> (7 - s)) & 1).astype(bool)
                for d, (p, own) in zip(range(deep - 1, -1, -1), levels.value, strict=True):
                    key = (((g >> 8) & ((1 << (8 * d)) - 1)) << 8) | bits
                    x = own[key] * np.where(one, p[key], 1 - p[key]) + (1 - own[key]) * x
                out += np.log10(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["key", "x"])

    return low.where("q is not null").select("key", "q").mapInArrow(finish, "key long, x double")


class _Values:
    """Looks up what a chunk's keys are worth: first by a slot of the key's hash, then where slots clash by its sorted place."""

    def __init__(self, held: list[tuple[np.ndarray, np.ndarray]]):
        key, x = (np.concatenate(c) for c in zip(*held, strict=True)) if held else (np.zeros(1, np.uint64), np.full(1, np.nan))
        held.clear()
        order = np.argsort(key)
        self.key, self.x = key[order], x[order]
        bits = min(_SLOT_BITS, max(8, int(2 * len(key)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.place = np.zeros(1 << bits, np.int32)
        self.place[self.slot(self.key)] = np.arange(len(key), dtype=np.int32)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, key: np.ndarray) -> np.ndarray:
        at = self.place[self.slot(key)]
        miss = np.flatnonzero(self.key[at] != key)
        if len(miss):
            want = key[miss]
            at[miss] = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            if (self.key[at[miss]] != want).any():
                raise ValueError("a chunk's text has a word or gram without an answer")
        return self.x[at]


def lm_scores(docs: DataFrame, held_out: Column | None = None, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the
    model's probability of the text's bytes with A-Z lower-cased and its end), bits_per_byte (its code length).

    Learns from rows that held_out leaves out. Null texts count as empty: they have the end alone. Repeated rows count each. With
    nothing to learn from every node predicts 1/2 and every base count is 0. An empty table gives an empty one.

    The model stays a table: each chunk of documents asks for the words and grams it has, with its counts of them; their sums are the
    corpus's counts, a second pass over the questions answers them, and the answers meet the chunk's texts in one task, which holds the
    answers and streams the texts. Questions and answers are packed arrays, dealt by the hash of the key, so no key or context is a
    hot group. The chunks are written first, as docs may come in another order when read again. Tasks get texts in small batches, whatever
    the session's setting; the scores are written, so that it can be put back.
    """
    doc = F.col(id_col)
    held_out = default_held_out(doc) if held_out is None else held_out
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    few = min(max(BATCH_BYTES * size.rows // max(size.n, 1), BATCH_ROWS[0]), BATCH_ROWS[1])
    with batches_of(docs.sparkSession, few):
        return stored(_scores(docs, doc, held_out, F.col(text_col).cast("string"), size.n, depth, chunk_bits), "scores")


def _scores(docs: DataFrame, doc: Column, held_out: Column, text: Column, n_bytes: int, depth: int, chunk_bits: int) -> DataFrame:
    slim = docs.coalesce(n_bytes // CHUNK_BYTES + 1).select(F.shiftright(F.monotonically_increasing_id(), chunk_bits).alias("chunk"), doc.alias("doc_id"), held_out.alias("held_out"), text.alias("text"))
    slim = stored(slim, "chunked")
    bits = min(max(int(n_bytes // CHUNK_BYTES).bit_length(), BUCKET_BITS[0]), BUCKET_BITS[1])
    asked = chunk_keys(slim.select("chunk", "text", (~F.col("held_out")).alias("learnt")), bits, depth)
    asked = stored(asked.repartition("bucket").sortWithinPartitions("bucket"), "asked")
    counts = stored(corpus_counts(asked), "counts")
    total = counts.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    base_of = float(np.log10(total.n + 0.5 * (total.v + 1)))
    words = counts.where("kind = 0").select("kind", "key", F.col("n").cast("double").alias("x"))
    values = words.unionByName(gram_logs(counts, depth).select(F.lit(1).alias("kind"), "key", "x"))
    rows = answered(asked, values, bits).unionByName(slim.withColumn("kind", F.lit(2)), allowMissingColumns=True).select("chunk", "kind", "n", "keys", "x", "doc_id", "held_out", "text")
    met = rows.repartition("chunk").sortWithinPartitions("chunk", "kind")
    schema = slim.select("doc_id", "held_out").schema.add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double").add("n_bytes", "long")
    out = met.mapInArrow(_scorer(base_of, depth), schema)
    bits = -F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total.n).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))


def _scorer(base_of: float, depth: int):
    def texts(rows: pa.RecordBatch, words: _Values, tree: _Values) -> Iterator[pa.RecordBatch]:
        buf, offs = text_bytes(rows.column("text"))
        for i, j in chunks(offs):
            b, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            h, at = word_hashes(b, o)
            h = np.insert(h, at[1:], _END)
            at = at + np.arange(len(at))
            c = words.of(h)
            g, ga = grams(b, o, depth)
            sums = [np.add.reduceat(x, at[:-1]) for x in ((c > 0).astype(np.int64), np.log10(c + 0.5) - base_of)]
            cols = [np.diff(at), *sums, np.add.reduceat(tree.of(g).astype(np.float64), ga[:-1]), np.diff(o) + 1]
            ids = [rows.column(x).slice(i, j - i) for x in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, cols)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found = -1, [[], []], None
        for batch in batches:
            chunk, kind = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
            for s, e in _cuts(chunk * 4 + kind):
                if chunk[s] != now:
                    now, held, found = chunk[s], [[], []], None
                    give_back()
                part = batch.slice(s, e - s)
                if kind[s] < 2:
                    for n, raw, x in zip(*(part.column(c).to_pylist() for c in ("n", "keys", "x")), strict=True):
                        held[kind[s]].append((_unpacked_keys(raw, n), unpacked(x, n, _WORTH[kind[s]])))
                    continue
                if found is None:
                    found, held = [_Values(h) for h in held], [[], []]
                yield from texts(part, *found)
        found = None
        give_back()

    return score
