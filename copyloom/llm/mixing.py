"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents are cut into blocks of words, and the blocks of each source are put into an order drawn by hash. A source's
quota is the number of its blocks, in that order, that brings its words nearest to its target. A binary tree then
splits the quotas of all sources among the output shards: each node deals its left half a multivariate hypergeometric draw.
Each shard takes its share as a run of the source's order, so that no two shards draw the same block, and is shuffled by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copyloom.llm.common import small, stored

WEIGHTS, SHARE, CEILING = (5.0, 2.0, 1.0), 1.5, 2.0
BLOCK_WORDS, SHARDS, SEED = 256, 16, 17
#: Blocks per window when the order within a source is drawn.
PER_BUCKET = 4096


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size, weight, target) from (source, size): weights repeat over the sources by code point, null last.

    The sources share `share` of all sizes by weight; a target stops at `ceiling` times its source's size and the excess goes to the
    others by weight. Sorted by the ratio at which they stop, sources are full as long as the rest could not take the remainder otherwise.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    total = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    full = F.col("source_size") * F.lit(float(ceiling))
    order = Window.orderBy(full / F.col("weight"), "source").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(full / F.col("weight"), "source").rowsBetween(0, Window.unboundedFollowing)
    at = total.withColumn("used", F.coalesce(F.sum(full).over(order), F.lit(0.0))).withColumn("left_weight", F.sum("weight").over(rest))
    want = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    at = at.withColumn("level", (want - F.col("used")) / F.col("left_weight"))
    # The level rises as long as sources are full; from the first that isn't, it is the common one.
    open_ = F.min(F.when(full > F.col("level") * F.col("weight"), F.struct((full / F.col("weight")).alias("r"), "source", "level"))).over(Window.partitionBy())
    return at.select("source", "source_size", "weight", F.least(full, F.coalesce(open_["level"] * F.col("weight"), full)).alias("target"))


def _draw(rng: np.random.Generator, colors: np.ndarray, n: int) -> np.ndarray:
    """A multivariate hypergeometric draw; counts beyond NumPy's range are drawn in lots of equal size and a remainder."""
    total = int(colors.sum())
    lot = total // 900_000_000 + 1
    lots, rest = colors // lot, colors % lot
    if lot == 1:
        return rng.multivariate_hypergeometric(colors, n, method="marginals")
    share = lambda x: int(x.sum()) * n // total
    return lot * rng.multivariate_hypergeometric(lots, share(lots), method="marginals") + rng.multivariate_hypergeometric(rest, share(rest), method="marginals")


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Quotas of each source (rows) for each shard (columns); rows sum to the quotas and columns differ by little."""
    out = np.zeros((len(quotas), shards), np.int64)

    def split(left: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = left
            return
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        part = _draw(rng, left, int(left.sum()) * (mid - lo) // (hi - lo))
        split(part, lo, mid)
        split(left - part, mid, hi)

    split(np.asarray(quotas, np.int64), 0, shards)
    return out


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING, block_words: int | None = BLOCK_WORDS,
    shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized, targets, draws): a row per document (uid, doc_id, source, size), a row per source, and a row per draw of a
    block (uid, block, words, shard, position). block_words None: a document is one block. uid is row_col, which must tell rows
    apart, where it is given.

    A null source is a source of its own, last in order; null texts have size 0 and are never drawn. Repeated rows are
    drawn as rows of their own. A block is drawn once per epoch, so at most `ceiling` times, rounded up to whole draws. Draws
    depend on doc_id and seed, not on partitions, but for rows that repeat a doc_id. Empty tables give empty ones.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    uid = F.col(row_col) if row_col else F.monotonically_increasing_id()
    sized = stored(docs.select(uid.alias("uid"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size")), "sized")
    targets = stored(source_targets(sized, weights, share, ceiling), "targets")
    unit = F.lit(2**62) if block_words is None else F.lit(block_words)
    blocks = sized.where("size > 0").select("uid", "doc_id", "source", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / unit).cast("long") - 1)).alias("block"))
    blocks = blocks.select("uid", "source", "block", F.least(unit, F.col("size") - F.col("block") * unit).cast("long").alias("words"), F.xxhash64("doc_id", "block", F.lit(seed)).alias("key"))
    buckets = sized.where("size > 0").agg(F.sum(F.ceil(F.col("size") / unit))).first()[0] or 1
    blocks = blocks.withColumn("bucket", F.pmod("key", F.lit(int(buckets) // PER_BUCKET + 1)))
    # Places within a source: totals of its buckets first, then places within a bucket; no window holds a whole source.
    total = blocks.groupBy("source", "bucket").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select("source", "bucket", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "uid", "block").rowsBetween(Window.unboundedPreceding, 0)
    at = blocks.select("*", F.sum("words").over(inside).alias("w1"), F.row_number().over(Window.partitionBy("source", "bucket").orderBy("key", "uid", "block")).alias("n1"))
    b = base.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), "w0", "n0")
    at = at.join(b, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")))
    ranked = stored(at.select("uid", "source", "block", "words", (F.col("w0") + F.col("w1") - F.col("words")).alias("before"), (F.col("n0") + F.col("n1") - 1).alias("rank")), "ranked")
    t = targets.select(F.col("source").alias("s2"), F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).alias("epochs"), "source_size", "target")
    t = t.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).where("source_size > 0")
    quota = ranked.join(small(t), F.col("source").eqNullSafe(F.col("s2"))).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.first("epochs").alias("epochs"), F.count_if(F.col("before") + F.col("words") / 2 <= F.col("rest")).alias("extra")
    )
    quota = quota.withColumn("quota", F.col("n") * F.col("epochs") + F.col("extra"))

    def deal(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source", na_position="last", ignore_index=True)
        dealt = split_tree(rows.quota.to_numpy(), shards, seed)
        return pd.DataFrame({"s2": rows.source, "n": rows.n, "quota": rows.quota, "bounds": list(np.cumsum(dealt, axis=1))})

    dealt = quota.groupBy(F.lit(0).alias("all")).applyInPandas(lambda key, rows: deal(key, rows), "s2 string, n long, quota long, bounds array<long>")
    dealt = stored(dealt, "shards")  # a row per source
    draws = ranked.join(small(dealt), F.col("source").eqNullSafe(F.col("s2")))
    draws = draws.where("rank < quota").withColumn("draw", F.explode(F.expr("sequence(rank, quota - 1, n)")))
    draws = draws.withColumn("shard", F.expr("size(filter(bounds, x -> x <= draw))"))
    return sized, targets, draws.select("uid", "block", "words", "shard", F.xxhash64("draw", "source", F.lit(seed + 1)).alias("position"))


def shuffled(draws: DataFrame) -> DataFrame:
    """The draws with each shard's rows together, in its own shuffled order; partitions are ranges of it, as many as Spark's setting says."""
    return draws.repartitionByRange("shard", "position").sortWithinPartitions("shard", "position")


def mixed_counts(docs: DataFrame, **how) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target (its source's), taken (words drawn, repeats counted)."""
    sized, targets, draws = mix(docs, **how)
    taken = draws.groupBy("uid").agg(F.sum("words").alias("taken"))
    t = targets.select(F.col("source").alias("s2"), "source_size", "target")
    at = sized.join(small(t), F.col("source").eqNullSafe(F.col("s2"))).join(taken, "uid", "left")
    return at.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
