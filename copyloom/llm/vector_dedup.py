"""Near-duplicate vectors by PCA-ordered tiled comparison.

Unit vectors are turned to the principal axes of all of them. Products are accumulated from the leading axes on; what the
remaining axes can add is bounded by the norms of what is left of each vector, and a tile drops rows, columns, and
itself as soon as no pair can reach the threshold. The pairs that are left are decided by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.llm.common import Forest, by_tile, components, runs, stored, tiles

THRESHOLD = 0.95
BLOCK, STRIP = 4096, 512
STEPS = (8, 16, 32)


def _vectors(col: pa.Array) -> list[np.ndarray | None]:
    out = []
    for x in col:
        v = None if not x.is_valid else x.values.to_numpy(zero_copy_only=False).astype(np.float64)
        ok = v is not None and len(v) and x.values.null_count == 0 and np.isfinite(v).all() and v.any()
        out.append(v if ok else None)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, dim, v): v the double components as bytes, null where the vector links with nothing."""
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs = _vectors(batch.column(1))
            raw = [None if v is None else (v + 0.0).tobytes() for v in vs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([0 if v is None else len(v) for v in vs], pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "dim", "v"])

    return slim.mapInArrow(read, "vec_id long, dim long, v binary")


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """The principal axes by dimension, leading first, from the second moments of all vectors: a row of the matrix a group."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            raw = np.array(batch.column("v").to_pylist(), object)
            for d in np.unique(dims).tolist():
                x = _unit(np.frombuffer(b"".join(raw[dims == d]), np.float64).reshape(-1, d))
                sums[d] = sums.get(d, 0) + x.T @ x
        rows = [(d, i, r) for d, m in sums.items() for i, r in enumerate(m)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2].tolist() for x in rows], pa.list_(pa.float64()))], names=["dim", "i", "row"])

    made = classes.select("dim", "v").mapInArrow(moments, "dim long, i long, row array<double>")
    made = made.select("dim", "i", F.posexplode("row").alias("j", "x")).groupBy("dim", "i", "j").agg(F.sum("x").alias("x"))
    out: dict[int, np.ndarray] = {}
    for r in made.collect():  # dim * dim numbers
        out.setdefault(r.dim, np.zeros((r.dim, r.dim)))[r.i, r.j] = r.x
    return {d: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1] for d, m in out.items()}


def _tile_links(axes, threshold: float):
    """Counts each vector's links in the tile (weighted by how many rows a vector stands for) and joins linked ones by a forest."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches):
            itself = bool(t.column("tile")[0].as_py() & 1)
            node, side, weight, dims = (t.column(c).to_numpy() for c in ("node", "side", "weight", "dim"))
            if t.num_rows < 2:
                continue
            d = int(dims[0])
            x = _unit(np.frombuffer(b"".join(t.column("v").to_pylist()), np.float64).reshape(-1, d))
            y = x @ axes.value[d]
            order = np.argsort(y[:, 0], kind="stable")
            node, side, weight, x, y = node[order], side[order], weight[order], x[order], y[order]
            y32 = y.astype(np.float32)
            steps = [s for s in STEPS if s < d] + [d]
            rest = {s: np.sqrt(np.maximum((y32[:, s:] ** 2).sum(1), 0)) for s in steps}
            reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
            rows, cols = (np.arange(len(node)),) * 2 if itself else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            links, forest, slack = np.zeros(len(node), np.int64), Forest(len(node)), np.float32(threshold - 1e-4)
            for lo in range(0, len(rows), STRIP):
                r = rows[lo : lo + STRIP]
                a, b = np.searchsorted(y[cols, 0], [y[r[0], 0] - reach, y[r[-1], 0] + reach])
                c = cols[a:b]
                c = c[c > r[0]] if itself else c
                done, sums = 0, None
                for s in steps:
                    if not len(r) or not len(c):
                        break
                    part = y32[r, done:s] @ y32[c, done:s].T
                    sums = part if sums is None else sums + part
                    can = sums + rest[s][r][:, None] * rest[s][c][None, :] >= slack
                    ri, ci = can.any(1), can.any(0)
                    if s < d:
                        r, c, sums = r[ri], c[ci], sums[np.ix_(ri, ci)]
                    done = s
                if not len(r) or not len(c):
                    continue
                i, j = np.nonzero(can)
                i, j = r[i], c[j]
                if itself:
                    i, j = i[i < j], j[i < j]
                for k in range(0, len(i), 65536):
                    p, q = i[k : k + 65536], j[k : k + 65536]
                    ok = (x[p] * x[q]).sum(1) >= threshold
                    p, q = p[ok], q[ok]
                    links += np.bincount(p, weight[q], len(node)).astype(np.int64) + np.bincount(q, weight[p], len(node)).astype(np.int64)
                    for u, v in zip(p.tolist(), q.tolist(), strict=True):
                        forest.join(u, v)
            some = np.flatnonzero(links)
            if len(some):
                up = forest.roots()
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[up[some]])], names=["a", "links", "b"])

    return linked


def vector_dedup(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links (other rows with cosine >= threshold), component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different lengths.
    Equal vectors are compared once and stand for one another. Rows that repeat a vec_id are rows of their own for n_links and one
    vertex for component_id; a null vec_id has a null component_id and isn't kept. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    at = stored(usable(vectors, id_col, vec_col), "vectors")
    classes = stored(at.where("v is not null and vec_id is not null").groupBy("dim", "v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight")), "classes")
    axes = principal_axes(classes)
    if axes:
        axes = spark.sparkContext.broadcast(axes)
        width = max(1e-6, float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6)

        def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims, raw = batch.column("dim").to_numpy(), batch.column("v").to_pylist()
                y = [float(_unit(np.frombuffer(v, np.float64)[None, :])[0] @ axes.value[d][:, 0]) for d, v in zip(dims.tolist(), raw, strict=True)]
                band = np.floor(np.array(y) / width).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("dim"), pa.array(band), *(batch.column(c) for c in ("node", "weight", "dim", "v"))], names=["group", "band", "node", "weight", "dim", "v"])

        nodes = classes.mapInArrow(lead, "group long, band int, node long, weight long, dim long, v binary")
        near = stored(by_tile(tiles(stored(nodes, "banded"), BLOCK)).mapInArrow(_tile_links(axes, threshold), "a long, links long, b long"), "near")
    else:
        near = spark.createDataFrame([], "a long, links long, b long")
    other = near.groupBy("a").agg(F.sum("links").alias("links"))
    comp = components(near.select("a", "b"))
    c = classes.join(other, classes["node"] == other["a"], "left").select("dim", "v", "node", "weight", F.coalesce("links", F.lit(0)).alias("links"))
    c = c.join(comp, "node", "left").select("dim", "v", (F.col("links") + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("low"))
    c = stored(c, "class-links")
    out = at.join(c, ["dim", "v"], "left").select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("n_links")).alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("low", "vec_id")).alias("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
      WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
k AS (SELECT a, count(*) AS n FROM p GROUP BY a),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, q.b FROM r JOIN p q ON r.b = q.a) SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM v LEFT JOIN k ON v.vec_id = k.a LEFT JOIN reach ON v.vec_id = reach.a
"""
