"""Spelling variants: words one edit apart, found by integer keys of their deletions, and the commonest form that each leads to.

All deletions of a batch of words are hashed at once: the polynomial hash of what stands before a place and of what follows it are differences of
running sums. Two words that differ by a replaced code point share the key of (place, deletion); a word with one code point more has the other's
key among its deletions. Rows are dealt out by the leading bits of their keys and sorted by key, and words that meet under a key are compared as
strings. The words under one true key differ in a single code point, so there are at most as many as the alphabet has letters, or as a word has
places for them; each then gets its count of near words and the best of them, so that pairs are never written out.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.llm.common import _powers, mixed, small, stored

#: Code points and occurrences that a word needs; how many times as common its form is; one of so many runs of a document loses a code point.
LEAST_LENGTH, LEAST_N, TIMES, NOISE = 6, 5, 5, 199
#: Different words that a task counts before it passes them on; leading bits of a key by which rows are dealt out.
HELD, RADIX = 1 << 19, 16
#: What a key is of: a place and the deletion there, a deletion anywhere, a whole word.
REPLACED, SHORTENED, WHOLE = 0, 1, 2

#: Words hold code points up to U+00FF only, so they are bytes of Latin-1 here.
_LETTER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_VALUE = np.random.Generator(np.random.PCG64(20250712)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64(0xD6E8FEB86659FD93)


def typed(run: bytes, salt: int, noise: int) -> bytes:
    """The run without one of its code points, if its hash says so; salt is the crc32 of what precedes it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), salt)
    return run if h % noise else run[: h % len(run)] + run[h % len(run) + 1 :]


def _counter(least: int, noise: int | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, n) of columns doc_id, as text, and text; in parts."""
        seen: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words = list(seen)
            n = np.fromiter(seen.values(), np.int64, len(seen))
            for lo in range(0, len(words), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words[part]], pa.string()), pa.array(n[part])], names=["word", "n"])
            seen.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = text.as_py().encode("latin-1", "replace").translate(_LETTER).split()
                own = Counter(w for w in words if len(w) >= least)
                if noise:
                    salt = zlib.crc32(f"{doc_id}:".encode())
                    for w, k in own.items():
                        if len(w := typed(w, salt, noise)) >= least:
                            seen[w] += k
                else:
                    seen.update(own)
                if len(seen) >= HELD:
                    yield from out()
        yield from out()

    return count


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_n: int = LEAST_N, noise: int | None = NOISE) -> DataFrame:
    """(word, n) of the words that are long and common enough, with the planted noise or without (None)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = docs.select(text(id_col).alias("doc_id"), text(text_col).alias("text")).mapInArrow(_counter(least_length, noise), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def deletion_keys(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word's number, kind, place, key) of all keys of some words, which are not empty."""
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    buf = np.frombuffer(b"".join(raw), np.uint8)
    end = np.cumsum(size)
    start, word = end - size, np.repeat(np.arange(len(raw)), size)
    power, inverse = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUE[buf] * power[: len(buf)], out=sums[1:])
    s, e, k = start[word], end[word], np.arange(len(buf))
    gone = (sums[k] - sums[s]) * inverse[s] + (sums[e] - sums[k + 1]) * inverse[s + 1]
    place = k - s
    new = (place == 0) | (buf != np.concatenate([buf[:1], buf[:-1]]))  # of equal neighbours, one deletion stands for all
    whole = mixed((sums[end] - sums[start]) * inverse[start])
    at_place = mixed(gone + _PLACE * (place + 1).astype(np.uint64))
    kind = np.repeat([REPLACED, SHORTENED, WHOLE], [len(buf), int(new.sum()), len(raw)])
    return np.concatenate([word, word[new], np.arange(len(raw))]), kind, np.concatenate([place, place[new], np.full(len(raw), -1)]), np.concatenate([at_place, mixed(gone[new]), whole])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            at, kind, place, key = deletion_keys([w.encode("latin-1") for w in part.column(0).to_pylist()])
            cols = [pa.array(key.view(np.int64)), pa.array(kind.astype(np.int8)), pa.array(place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*cols, *(c.take(pa.array(at)) for c in part.columns)], names=["key", "kind", "place", "word", "n"])


def _met(rows: list[tuple[int, int, str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, n of the best, the best) for words under one key; those whose strings differ are told apart."""
    same: dict[tuple[int, str], list[tuple[int, str, int]]] = defaultdict(list)
    for kind, place, word, n in rows:
        same[place if kind == REPLACED else -1, word if kind == WHOLE else word[:place] + word[place + 1 :]].append((-n, word, kind))
    for (place, _), found in same.items():
        if place >= 0:
            best = sorted(found)[:2]
            if len(found) > 1:
                for x in found:
                    other = best[x == best[0]]
                    yield x[1], len(found) - 1, -other[0], other[1]
        else:
            longer = [x for x in found if x[2] == SHORTENED]
            for whole in (x for x in found if x[2] == WHOLE and longer):
                first = min(longer)
                yield whole[1], len(longer), -first[0], first[1]
                for x in longer:
                    yield x[1], 1, -whole[0], whole[1]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What _met says, of batches sorted by key; a key may go on in the next batch."""
    names = ["word", "n_near", "best_n", "best"]
    last, held = None, []
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        end = np.append(cut[1:], len(key))
        out: list[tuple[str, int, int, str]] = []
        many = (end - cut > 1) | (cut == 0) | (end == len(key))
        for s, e in zip(cut[many].tolist(), end[many].tolist(), strict=True):
            rows = list(zip(*(c.slice(s, e - s).to_pylist() for c in batch.columns[1:]), strict=True))
            if key[s] != last:
                out += _met(held)
                held = []
            if s and e < len(key):
                out += _met(rows)
            else:
                last, held = key[s], held + rows
        if out:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out, strict=True))), names=names)
    if out := list(_met(held)):
        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out, strict=True))), names=names)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best, best_n) for each of the words (word, n), which are distinct: how many words are one edit away, and the one of
    largest n among them, the first in code-point order of several."""
    keys = words.select("word", "n").mapInArrow(_keyed, "key long, kind byte, place int, word string, n long")
    dealt = keys.repartition(F.shiftrightunsigned("key", 64 - RADIX)).sortWithinPartitions("key")
    found = dealt.mapInArrow(_near, "word string, n_near long, best_n long, best string")
    all_ = words.select("word", F.col("n"), F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    rows = all_.unionByName(found.withColumn("n", F.lit(None).cast("long")))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("k"), "best")))
    at = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    return at.select("word", "n", "n_near", F.col("b.best").alias("best"), (-F.col("b.k")).alias("best_n"))


def variants(docs: DataFrame, times: int = TIMES, **how) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row per word of word_counts(docs, **how). Its form is its near word of largest n, if that is at
    least `times` the word's own; its root is where its forms lead (the word itself without one).

    A null text has no words; a null doc_id counts as empty in the planted noise. Repeated rows count each. A form is always more frequent than the
    word, so forms end after few steps; each round of the search for roots doubles the steps taken. An empty table gives an empty one; other
    columns are ignored.
    """
    words = stored(word_counts(docs, **how), "words")
    has = F.col("best_n") >= F.col("n") * F.lit(times)
    pick = lambda c: F.when(has, F.col(c))
    at = stored(near_words(words).select("word", "n", "n_near", pick("best").alias("form"), pick("best_n").alias("form_n")), "near")
    root = stored(at.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if root.join(small(on), "root", "left_semi").isEmpty():
            break
        root = stored(root.join(small(on), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return at.join(small(root), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
o AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
p AS (SELECT doc_id, r, count(*) AS k FROM o WHERE length(r) >= 6 GROUP BY ALL),
u AS (SELECT r, k, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || r, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)]::BIGINT[] END)) AS bytes FROM p),
h AS (SELECT r, k, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS h FROM u, crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, k FROM h),
words AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
dels AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS gone FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT d.word, d.n, w.word AS short, w.n AS short_n FROM dels d JOIN words w ON d.gone = w.word),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM dels a JOIN dels b ON a.i = b.i AND a.gone = b.gone AND a.word != b.word
  UNION ALL SELECT word, short, short_n FROM shorter UNION ALL SELECT short, word, n FROM shorter),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
f AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.at = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN f ON walk.at = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
"""
