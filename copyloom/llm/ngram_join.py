"""N-gram Jaccard join: size-banded tiles, hashed bitmaps whose bit counts bound the overlap, exact sorted-array intersection.

Two sets with Jaccard similarity of t or more share a shingle among the first n - ceil(t n) + 1 of each in any common order;
here rare shingles come first, by how many different sets have them. Half of all shingles, by hash, are counted for that, exactly and
in buckets; the others follow in order of their hashes. A set whose first shingles no other set has links with nothing and is done.
Documents that share a first shingle, directly or by others, form a group, and no link leaves a group. Groups are dealt to tiles by
size band, where the bit counts of the bitmaps rule out most pairs; what is left falls into smaller groups, whose tiles carry the
sets and decide by exact intersection. Documents with equal sets stand for one another.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copyloom.llm.common import Forest, by_tile, chunks, components, give_back, giving_back, mixed, runs, small, stored, text_bytes, tiles, word_hashes
from copyloom.llm.language_model import packed, unpacked

WORDS, PERCENT = 5, 75
#: A chunk of documents has so many counted shingles, about, and rows at most; a bucket about as many as the second number. The number of
#: buckets, a power of two within these limits, follows the bytes of text, of which there are some KEY_BYTES to a counted shingle.
CHUNK, CHUNK_ROWS, BUCKET, BUCKET_BITS, KEY_BYTES = 1 << 21, 1 << 16, 1 << 22, (7, 16), 14
#: Documents up to which those that need their sets are picked from the texts by a broadcast of their ids alone.
PICKED = 1_000_000
#: Bits of a bitmap: the power of two from twice the set's size, within these limits.
BITMAP = (256, 1 << 15)
#: Documents in a block of a tile of sets, of bitmaps.
BLOCK, MAP_BLOCK = 512, 4096
_FACTORS = [np.uint64(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingle_sets(col: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; one for the whole sequence if it has fewer words."""
    buf, offs = text_bytes(col)
    for i, j in chunks(offs):
        h, at = word_hashes(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        full = np.zeros(0, np.uint64)
        if len(h) >= words:
            full = np.zeros(len(h) - words + 1, np.uint64)
            for k in range(words):
                full += h[k : k + len(full)] * _FACTORS[k % len(_FACTORS)] * np.uint64(2 * (k // len(_FACTORS)) + 1)
            full = mixed(full)
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if e - s >= words:
                yield np.unique(full[s : e - words + 1])
            elif e > s:
                yield np.frombuffer(hashlib.blake2b(h[s:e].tobytes(), digest_size=8).digest(), np.uint64).copy()
            else:
                yield np.zeros(0, np.uint64)


def _first(n: np.ndarray | int, percent: int):
    return n - (n * percent + 99) // 100 + 1


def bitmap(x: np.ndarray) -> bytes:
    bits = min(BITMAP[1], max(BITMAP[0], 1 << int(2 * len(x) - 1).bit_length()))
    row = np.zeros(bits, bool)
    row[(x & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(row).tobytes()


def bucket_bits(docs: DataFrame, text_col: str = "text") -> int:
    """The buckets, as a power of two, that the counted shingles of docs are dealt to."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    return min(max((size // (KEY_BYTES * BUCKET)).bit_length(), BUCKET_BITS[0]), BUCKET_BITS[1])


def set_table(docs: DataFrame, words: int, percent: int, bits: int) -> DataFrame:
    """Rows (doc_id, n, fp, bits, chunk, ord, counted, rest) of all documents, and rows (chunk, bucket, ords, keys) of each chunk's counted
    shingles: those whose hash has no highest bit. counted is their number, rest the first of the others where counted ones are too
    few. A key is the hash's next 32 bits after those of the bucket."""
    shape = "doc_id long, n long, fp binary, bits binary, chunk long, ord int, counted long, rest binary, bucket int, ords binary, keys binary"
    kinds = dict(doc_id=pa.int64(), n=pa.int64(), fp=pa.binary(), bits=pa.binary(), chunk=pa.int64(), ord=pa.int32(), counted=pa.int64(), rest=pa.binary(), bucket=pa.int32(), ords=pa.binary(), keys=pa.binary())

    def rows(k: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[name], kind) if name in cols else pa.nulls(k, kind) for name, kind in kinds.items()], names=list(kinds))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        held: dict[str, list] = {name: [] for name in ("doc_id", "n", "fp", "bits", "counted", "rest")}
        some: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            k, counted = len(some), np.array(held["counted"])
            yield rows(k, **held, chunk=np.full(k, chunk), ord=np.arange(k))
            x, d = np.concatenate(some), np.repeat(np.arange(k, dtype=np.uint16), counted)
            bucket = (x >> np.uint64(63 - bits)).astype(np.uint16)
            order = np.argsort(bucket, kind="stable")
            bucket, d, key = bucket[order], d[order], (x[order] >> np.uint64(31 - bits)).astype(np.uint32)
            cuts = _cuts(bucket)
            if cuts:
                yield rows(len(cuts), chunk=np.full(len(cuts), chunk), bucket=[int(bucket[s]) for s, _ in cuts], ords=[_ords(d[s:e]) for s, e in cuts], keys=[key[s:e].tobytes() for s, e in cuts])
            some.clear()
            for c in held.values():
                c.clear()

        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), words), strict=True):
                n, counted = len(x), int(np.searchsorted(x, np.uint64(1 << 63)))
                first = int(_first(n, percent)) if n else 0
                fp = hashlib.blake2b(x.tobytes(), digest_size=16).digest() if n else None
                rest = x[counted:first].tobytes() if first > counted else None
                for c, v in zip(held.values(), (doc, n, fp, bitmap(x) if n else None, counted, rest), strict=True):
                    c.append(v)
                some.append(x[:counted])
                size += counted
                if size >= CHUNK or len(some) == CHUNK_ROWS:
                    yield from out()
                    chunk, size = chunk + 1, 0
        if some:
            yield from out()

    return docs.mapInArrow(giving_back(measure), shape)


def _cuts(tag: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal tags start and end."""
    at = np.flatnonzero(np.diff(tag)) + 1
    return list(zip([0, *at.tolist()], [*at.tolist(), len(tag)], strict=True)) if len(tag) else []


def _ords(d: np.ndarray) -> bytes:
    return packed(np.diff(d, prepend=d.dtype.type(0)))


def _unpacked_ords(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(raw, n, np.uint16), dtype=np.int64)


def _alive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bit for each row of a chunk: whether it stands for its set."""
    for batch in batches:
        out = []
        for ords in batch.column(1):
            bit = np.zeros(CHUNK_ROWS, bool)
            bit[ords.values.to_numpy()] = True
            out.append(np.packbits(bit[: len(bit) - int(bit[::-1].argmax())]).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["chunk", "alive"])


def _met(t: pa.Table) -> pa.Table:
    """Of a bucket's keys those that two sets or more have, with how many have them (255 at most)."""
    ds, ks = [], []
    for ords, keys, alive in zip(*(t.column(c).to_pylist() for c in ("ords", "keys", "alive")), strict=True):
        d, k = _unpacked_ords(ords, len(keys) // 4), np.frombuffer(keys, np.uint32)
        bit = np.zeros(CHUNK_ROWS, bool)
        bit[: 8 * len(alive)] = np.unpackbits(np.frombuffer(alive, np.uint8))
        ds.append(d[bit[d]])
        ks.append(k[bit[d]])
    at = np.cumsum([0, *map(len, ks)])
    key = np.concatenate(ks)
    order = np.sort(key.astype(np.uint64) << np.uint64(32) | np.arange(len(key), dtype=np.uint64))
    start = np.flatnonzero(np.r_[True, np.diff(order >> np.uint64(32)) != 0]) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.r_[start, len(key)])
    sets = np.zeros(len(key), np.uint8)
    sets[(order & np.uint64(0xFFFFFFFF)).astype(np.int64)] = np.repeat(np.minimum(n, 255), n)
    out: list[tuple] = []
    for chunk, s, d, k in zip(t.column("chunk").to_pylist(), at[:-1].tolist(), ds, ks, strict=True):
        c = sets[s : s + len(k)]
        if (use := c > 1).any():
            out.append((chunk, _ords(d[use].astype(np.uint16)), k[use].tobytes(), c[use].tobytes()))
    cols = list(zip(*out, strict=True)) if out else [[]] * 4
    give_back()
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
    made = dict(zip(("chunk", "ords", "keys", "sets"), map(pa.array, cols, kinds), strict=True))
    return pa.table(made | {"bucket": pa.array([t.column("bucket")[0].as_py()] * len(out), pa.int32())})


def _tied(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(h, a) that tie together what (h, d) does: one document for each shingle, and the others tied to that one by an h of their own, so
    that even a shingle of all documents has no more rows than there are chunks."""
    order = np.argsort(h, kind="stable")
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    start = np.flatnonzero(new)
    low = np.minimum.reduceat(d, start)
    mine = low[np.cumsum(new) - 1]
    pairs = np.unique(np.stack([d, mine], 1)[d != mine], axis=0)
    tie = mixed(mixed(pairs[:, 0].view(np.uint64) + np.uint64(1)) ^ pairs[:, 1].view(np.uint64)).view(np.int64)
    return np.concatenate([h[start], tie, tie]), np.concatenate([low, pairs[:, 0], pairs[:, 1]])


def _first_met(percent: int):
    """Of a chunk's sets and of their keys that others have too: (h, a) for those among each set's first."""

    def first(sets: pa.Table, met: pa.Table) -> pa.Table:
        sets = sets.sort_by("ord")
        ord_, node, n, counted = (sets.column(c).to_numpy() for c in ("ord", "node", "n", "counted"))
        cols = [(_unpacked_ords(o, len(c)), np.frombuffer(k, np.uint32).astype(np.int64) + (b << 32), np.frombuffer(c, np.uint8)) for b, o, k, c in zip(*(met.column(c).to_pylist() for c in ("bucket", "ords", "keys", "sets")), strict=True)]
        at, key, many = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in zip(zip(*cols, strict=True) if cols else ([], [], []), (np.int64, np.int64, np.uint8), strict=True))
        at = np.searchsorted(ord_, at)
        want = _first(n, percent) - (counted - np.bincount(at, minlength=len(n)))  # the keys that no other set has come first
        use = want[at] > 0
        at, key, many = at[use], key[use], many[use]
        order = np.lexsort((key, many, at))
        at, key = at[order], key[order]
        use = np.arange(len(at)) - np.searchsorted(at, at) < want[at]
        rest = [(np.frombuffer(x, np.int64), d) for x, d in zip(sets.column("rest").to_pylist(), node.tolist(), strict=True) if x]
        h = np.concatenate([key[use], *(x for x, _ in rest)])
        d = np.concatenate([node[at[use]], *(np.full(len(x), d) for x, d in rest)])
        h, d = _tied(h, d) if len(h) else (h, d)
        give_back()
        return pa.table({"h": pa.array(h, pa.int64()), "a": pa.array(d, pa.int64())})

    return first


def _forest_rows(forest: Forest, node: np.ndarray) -> Iterator[pa.RecordBatch]:
    roots = forest.roots()
    away = np.flatnonzero(roots != np.arange(len(node)))
    if len(away):
        yield pa.RecordBatch.from_arrays([pa.array(node[away]), pa.array(node[roots[away]])], names=["a", "b"])


def _tile_bounds(percent: int):
    """Joins documents within each tile whose bitmaps don't rule out a link: each bit that differs is a shingle that only one
    has, so n + m - 2 * overlap is at least their number. Gives a forest."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches):
            itself = bool(t.column("tile")[0].as_py() & 1)
            n = t.column("n").to_numpy()
            order = np.argsort(n, kind="stable")
            n, node, side = n[order], t.column("node").to_numpy()[order], t.column("side").to_numpy()[order]
            raw = t.column("bits").to_pylist()
            raw = [raw[i] for i in order]
            size = np.array([len(x) // 8 for x in raw])  # words; they grow with n
            starts = np.flatnonzero(np.r_[True, size[1:] != size[:-1]])
            own = {int(size[s]): (s, np.frombuffer(b"".join(raw[s:e]), np.uint64).reshape(e - s, -1)) for s, e in zip(starts, np.r_[starts[1:], len(n)], strict=True)}
            half = {w: (s, m[:, : w // 2] | m[:, w // 2 :]) for w, (s, m) in own.items()}
            forest, ends = Forest(len(n)), np.searchsorted(n, (n * 100) // percent, "right")
            for i in range(len(n)):
                w = int(size[i])
                mine = own[w][1][i - own[w][0]]
                for s, m in (own[w], half.get(2 * w, (len(n), None))):
                    lo, hi = max(i + 1, s), min(int(ends[i]), s + (0 if m is None else len(m)))
                    if lo >= hi:
                        continue
                    js = np.arange(lo, hi)
                    use = forest.up[lo:hi] != forest.up[i]
                    if not itself:
                        use &= side[lo:hi] != side[i]
                    if not use.all():
                        js = js[use]
                        rows = m[js - s]
                    else:
                        rows = m[lo - s : hi - s]
                    if not len(js):
                        continue
                    apart = np.bitwise_count(rows ^ mine).sum(1, dtype=np.int64)
                    most = (n[i] + n[js] - apart) // 2
                    for j in js[100 * most >= percent * (n[i] + n[js] - most)].tolist():
                        forest.join(i, j)
            yield from _forest_rows(forest, node)

    return bounded


def _tile_links(percent: int):
    """Joins linked documents within each tile: a forest of its links, not all pairs."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches):
            if t.num_rows < 2:
                continue
            itself = bool(t.column("tile")[0].as_py() & 1)
            n = t.column("n").to_numpy()
            order = np.argsort(n, kind="stable")
            n, node, side = n[order], t.column("node").to_numpy()[order], t.column("side").to_numpy()[order]
            raw = t.column("shingles").to_pylist()
            sets = [np.frombuffer(raw[i], np.uint64) for i in order]
            forest, ends = Forest(len(n)), np.searchsorted(n, (n * 100) // percent, "right")
            for i in range(len(n)):
                js = np.arange(i + 1, ends[i])
                if not itself:
                    js = js[side[js] != side[i]]
                if not len(js):
                    continue
                mine = forest.root(i)
                js = [j for j in js.tolist() if forest.root(j) != mine]
                for lo in range(0, len(js), 256):
                    some = js[lo : lo + 256]
                    flat = np.concatenate([sets[j] for j in some])
                    size = np.array([len(sets[j]) for j in some])
                    at = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
                    both = np.add.reduceat(sets[i][at] == flat, np.concatenate([[0], np.cumsum(size)[:-1]]))
                    for j in np.asarray(some)[100 * both >= percent * (n[i] + size - both)].tolist():
                        forest.join(i, j)
            yield from _forest_rows(forest, node)

    return linked


def ngram_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sets, links): a row (doc_id, n, fp) for each row of docs, and edges (a, b) between documents whose components
    are those of all links. Each edge is a link of similarity percent / 100 or more, or joins equal sets."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = stored(set_table(slim, words, percent, bucket_bits(slim)), "sets")
    every = table.where("ord is not null")
    sets = every.select("doc_id", "n", "fp")
    known = every.where("fp is not null and doc_id is not null")
    stands = known.groupBy("fp", "n").agg(F.min(F.struct("doc_id", "chunk", "ord", "counted", "rest")).alias("one"))
    stands = stored(stands.select("fp", "n", F.col("one.doc_id").alias("node"), "one.chunk", "one.ord", "one.counted", "one.rest"), "classes")
    equal = stored(known.join(stands.select("fp", "n", "node"), ["fp", "n"]).where("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct(), "equal")
    alive = stored(stands.groupBy("chunk").agg(F.collect_list("ord").alias("ords")).mapInArrow(_alive, "chunk long, alive binary"), "alive")
    keys = table.where("bucket is not null").select("chunk", "bucket", "ords", "keys").join(small(alive), "chunk")
    met = keys.groupBy("bucket").applyInArrow(_met, "chunk long, ords binary, keys binary, sets binary, bucket int")
    first = stands.select("chunk", "ord", "node", "n", "counted", "rest").groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(_first_met(percent), "h long, a long")
    low = F.min("a").over(Window.partitionBy("h"))  # a window has a row for each chunk at most
    shared = first.select("a", low.alias("b")).where("a != b")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")

    def grouped(edges: DataFrame) -> DataFrame:
        """Of groups with two sets or more, one document of each set."""
        many = stored(components(edges).join(stands.select("node", "n", "fp"), "node").withColumnRenamed("component", "group"), "many")
        some = many.groupBy("group").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("group")
        return stored(many.join(some, "group").select("node", "group", "n", "fp", band.alias("band")), "grouped")

    maps = every.select(F.col("doc_id").alias("node"), "fp", "bits").join(grouped(shared), ["node", "fp"]).dropDuplicates(["node", "fp"])
    maps = tiles(maps.select("group", "band", "node", "n", "bits"), MAP_BLOCK).select("tiles", "node", "n", "bits")
    close = stored(by_tile(maps).mapInArrow(_tile_bounds(percent), "a long, b long"), "close")
    dealt = stored(tiles(grouped(close), BLOCK).drop("band"), "tiles")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                raw = [x.tobytes() for x in shingle_sets(part.column("text"), words)]
                fps = [hashlib.blake2b(x, digest_size=16).digest() if x else None for x in raw]
                same = [f == g for f, g in zip(fps, part.column("fp").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("tiles"), part.column("node"), part.column("n"), pa.array(raw, pa.binary())], names=["tiles", "node", "n", "shingles"]).filter(pa.array(same))

    texts = slim.withColumnRenamed("doc_id", "node").join(small(dealt.select("node"), PICKED), "node", "left_semi").join(small(dealt), "node")
    nodes = texts.mapInArrow(giving_back(with_sets), "tiles array<struct<tile:long,side:int>>, node long, n long, shingles binary")
    near = by_tile(nodes).mapInArrow(giving_back(_tile_links(percent)), "a long, b long")
    return sets, stored(near.unionByName(equal), "links")


def ngram_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Texts without words, and null texts, link with nothing. Rows with one doc_id are one vertex; a null doc_id stays alone with a
    null component_id. Shingles are compared by 64-bit hashes of their words. An empty table gives an empty one; other columns are ignored.
    """
    sets, links = ngram_links(docs, words, percent, id_col, text_col)
    comp = stored(components(links), "components")
    at = sets.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return at.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, q.b FROM r JOIN both_ways q ON r.b = q.a) SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(low, s.doc_id)) AS component_id FROM s LEFT JOIN reach ON s.doc_id = reach.a
"""
