"""A quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of its features. The weights come from pairs of a document labelled 1 and one
labelled 0, by logistic loss on the difference of their features; a quantile of the strengths is the threshold.

Every labelled row is learnt from. Rows meet in groups by hash, about GROUP each, and each row of a group is paired with PARTNERS of the
other label in it; tasks send sums over their pairs, which Spark adds up, so the driver gets a table of one size whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from copyloom.llm.common import chunks, giving_back, numbered, stored, text_bytes

#: Labelled rows of a group, partners of a row, ridge, and steps of the fit at most.
GROUP, PARTNERS, RIDGE, STEPS = 4096, 10, 1e-3, 30
#: Cells that strengths are counted in at once, to find one by its rank; rows that the driver orders itself.
CELLS, FEW = 1 << 12, 1 << 12
ACCEPT = 0.3
_CLASS = np.zeros(256, np.int64)
_CLASS[128:] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("A") : ord("Z") + 1] = 3
_CLASS[ord("0") : ord("9") + 1] = 4
_CLASS[ord(" ")] = 5
_CLASS[ord("\n")] = 6
for _k, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASS[_c] = 7 + _k
_N = 7 + 32
#: Shares of byte classes, of bytes equal to the one before, of letters that begin a word, of marks right after a letter, and the log of the size.
FEATURES = _N + 4


def features(col: pa.Array) -> np.ndarray:
    """A row of FEATURES numbers for each whole text; zeros for an empty one."""
    buf, offs = text_bytes(col)
    out = np.zeros((len(offs) - 1, FEATURES))
    for i, j in chunks(offs):
        b, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        size = np.diff(o)
        if not len(b):
            continue
        doc = np.repeat(np.arange(j - i), size)
        kind = _CLASS[b]
        counts = np.bincount(doc * _N + kind, minlength=(j - i) * _N).reshape(-1, _N)
        same = np.zeros(len(b), bool)
        same[1:] = (b[1:] == b[:-1]) & (doc[1:] == doc[:-1]) & (kind[1:] >= 7)
        letter = (kind >= 1) & (kind <= 3)
        starts = letter.copy()
        starts[1:] &= ~letter[:-1] | (doc[1:] != doc[:-1])
        glued = np.zeros(len(b), bool)  # marks at the end of a word
        glued[1:] = (kind[1:] >= 7) & letter[:-1] & (doc[1:] == doc[:-1])
        n = np.maximum(size, 1)
        out[i:j, :_N] = np.sqrt(counts / n[:, None])
        for k, x in enumerate((same, starts, glued)):
            out[i:j, _N + k] = np.sqrt(np.bincount(doc, x, j - i) / n)
        out[i:j, _N + 3] = np.log1p(size)
    return out


def _matrix(x: pa.Array) -> np.ndarray:
    return x.to_numpy().reshape(-1, FEATURES)


def pairs(y: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows labelled 1 and 0 that meet: each row of a group with PARTNERS of the other label, at evenly spread places from one that is drawn."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return good[:0], bad[:0]
    rng = np.random.Generator(np.random.PCG64(seed))

    def others(n: int, among: np.ndarray) -> np.ndarray:
        return among[(rng.integers(len(among), size=(n, 1)) + np.arange(PARTNERS) * len(among) // PARTNERS) % len(among)].reshape(-1)

    return np.r_[np.repeat(good, PARTNERS), others(len(bad), good)], np.r_[others(len(good), bad), np.repeat(bad, PARTNERS)]


def _sums(w: np.ndarray, scale: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of whole groups (group, x, y) to (at, v): the number of their pairs, and the gradient and the upper half of the information at weights w."""
    upper = np.triu_indices(FEATURES)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + FEATURES + len(upper[0]))
        for group, x, y in (row for batch in batches for row in zip(*batch.columns, strict=True)):
            x, y = _matrix(x.values), y.values.to_numpy()
            i, j = pairs(y, group.as_py())
            for k in range(0, len(i), 8192):
                diff = (x[i[k : k + 8192]] - x[j[k : k + 8192]]) / scale
                p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
                total += np.r_[len(diff), diff.T @ (1 - p), ((diff * (p * (1 - p))[:, None]).T @ diff)[upper]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "v"])

    return step


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, x, y) of each group of rows (group, x, y) that come in order of their groups."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    now = None
    for batch in batches:
        group, x, y = batch.column(0).to_numpy(), _matrix(batch.column(1).flatten()), batch.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(group)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                if held and group[lo] != now:
                    yield now, *map(np.concatenate, zip(*held, strict=True))
                    held = []
                now = int(group[lo])
                held.append((x[lo:hi], y[lo:hi]))
    if held:
        yield now, *map(np.concatenate, zip(*held, strict=True))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each group, its numbers end to end."""
    for group, x, y in _groups(batches):
        lists = (pa.ListArray.from_arrays([0, v.size], v.reshape(-1)) for v in (x, y))
        yield pa.RecordBatch.from_arrays([pa.array([group]), *lists], names=["group", "x", "y"])


def fit(labelled: DataFrame) -> tuple[np.ndarray, float]:
    """Weights, and the threshold: the quantile of all strengths at the share of rows labelled 0, from all rows (doc_id, x, y), which are stored and read a dozen times.

    Zero weights and threshold without rows of both labels, so that every document scores the same and is kept.
    """
    sides = {r.y: r.n for r in labelled.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, good, bad = sum(sides.values()), sides.get(1.0, 0), sides.get(0.0, 0)
    if not good or not bad:
        return np.zeros(FEATURES), 0.0
    each = labelled.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.stddev_pop("v").alias("sd")).collect()
    scale = np.full(FEATURES, np.inf)
    for r in each:
        scale[r.at] = r.sd if r.sd > 1e-9 else np.inf
    groups = -(-n // GROUP)
    met = labelled.select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("group"), "x", "y", "doc_id")
    met = met.repartition("group").sortWithinPartitions("group", "doc_id", "x").drop("doc_id")
    met = stored(met.mapInArrow(_whole, "group long, x array<double>, y array<double>"), "groups")  # each step reads it, without a shuffle
    upper, w = np.triu_indices(FEATURES), np.zeros(FEATURES)
    for _ in range(STEPS):
        sums = np.zeros(1 + FEATURES + len(upper[0]))
        for r in met.mapInArrow(_sums(w, scale), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            sums[r.at] = r.v
        count = max(sums[0], 1.0)
        half = np.zeros((FEATURES, FEATURES))
        half[upper] = sums[1 + FEATURES :] / count
        hess = half + half.T - np.diag(half.diagonal()) + RIDGE * np.eye(FEATURES)
        step = np.linalg.solve(hess, sums[1 : 1 + FEATURES] / count - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    w = w / scale
    strengths = stored(labelled.select(strength(w).alias("s")), "strengths")
    cut = min(n - 1, max(1, round(n * bad / n)))
    return w, (ranked(strengths, cut) + ranked(strengths, cut + 1)) / 2


def strength(w: np.ndarray) -> Column:
    return F.aggregate(F.zip_with("x", F.array(*map(F.lit, w.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def ranked(strengths: DataFrame, rank: int) -> float:
    """The strength (s) of a rank (from 1): cells are counted, and the one that holds it is cut again, until few rows are left or all are equal."""
    at = strengths
    while True:
        lo, hi, n = at.agg(F.min("s"), F.max("s"), F.count("s")).first()
        if lo == hi or n <= FEW:
            return lo if lo == hi else sorted(r.s for r in at.collect())[rank - 1]
        cell = F.least(F.floor((F.col("s") - lo) / (hi - lo) * CELLS), F.lit(CELLS - 1))
        for k, m in sorted((r.cell, r.m) for r in at.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("m")).collect()):
            if rank <= m:
                break
            rank -= m
        at = at.where(cell == k)


def default_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 5; rows without an id count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, held_out, the columns to carry, score (0 to 1; ACCEPT at the threshold), predicted.

    labels: (doc_id, quality); rows with a null are left out, and of several for a doc_id the largest counts. Null texts count
    as empty and are scored like any other. Repeated rows score alike. An empty table gives an empty one; other columns are ignored.
    """
    doc = F.col(id_col)
    held_out = default_held_out(doc) if held_out is None else held_out
    slim = docs.select(F.col(text_col).cast("string").alias("text"), doc.alias("doc_id"), held_out.alias("held_out"), *carry)
    kept = ["doc_id", "held_out", *carry]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.FixedSizeListArray.from_arrays(pa.array(features(batch.column(0)).reshape(-1)), FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], rows], names=[*kept, "x"])

    table = stored(slim.mapInArrow(giving_back(measure), slim.select(*kept).schema.add("x", ArrayType(DoubleType()))), "features")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    w, at = fit(stored(table.where("not held_out").join(known, "doc_id").select("doc_id", "x", F.col("quality").cast("double").alias("y")), "labelled"))
    shift = at + float(np.log((1 - ACCEPT) / ACCEPT))
    score = 1 / (1 + F.exp(-(strength(w) - F.lit(shift))))
    out = table.select(*kept, F.when(F.lit(bool(w.any())), score).otherwise(F.lit(0.5)).alias("score"))
    return out.select("*", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that the classifier keeps, with their columns as they are; each row is judged by itself, whatever its id."""
    rows = numbered(docs)
    judged = stored(quality_scores(rows, labels, carry=("row_",), **how).select("row_", "predicted"), "judged")
    return rows.join(judged.where("predicted = 1").select("row_"), "row_", "left_semi").select(*docs.columns)
