"""Screens of panel k-mers: repeats, sequence shared with other classes, neighbours in the background, and recall over a class's own reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom.functions import sequences as S
from copyloom.session import kept

#: A k-mer is periodic if shifting it by at most PERIOD bases leaves at most MISMATCHES unlike.
PERIOD, MISMATCHES = 6, 2
TILE, STEP, HITS = 150, 10, 4


def periodic(kmer: Column, k: int, most: int = PERIOD, unlike: int = MISMATCHES) -> Column:
    def off(p: int) -> Column:
        a, b = F.split(F.substring(kmer, 1, k - p), ""), F.split(F.substring(kmer, p + 1, k - p), "")
        return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x))

    out = off(1) <= unlike
    for p in range(2, most + 1):
        out = out | (off(p) <= unlike)
    return out


def not_shared(panel: DataFrame, loci: DataFrame, k: int) -> DataFrame:
    """The panel without k-mers that the locus of another class holds. loci: (class, seq)."""
    coded = panel.withColumn("code", S.code(F.col("canon")))
    other = S.packed_kmers(loci.select(F.col("class").alias("other_"), "seq"), "seq", k, coded).select("code", "other_").distinct()
    bad = coded.join(other, "code").where("class != other_").select("canon", "class").distinct()
    return panel.join(bad, ["canon", "class"], "left_anti")


def neighbours(codes: DataFrame, k: int) -> DataFrame:
    """(code, near): the k-mers one substitution away, in canonical form, as numbers. codes: (code), canonical."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(0).to_numpy().astype(np.uint64)
            back = np.zeros_like(c)  # the reverse complement; a changed base changes the mirrored pair of bits in the same way
            for j in range(k):
                back = back << np.uint64(2) | (np.uint64(3) - (c >> np.uint64(2 * j) & np.uint64(3)))
            for i in range(k):
                for d in (1, 2, 3):
                    x, y = c ^ np.uint64(d << (2 * i)), back ^ np.uint64(d << (2 * (k - 1 - i)))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.minimum(x, y).astype(np.int64))], names=["code", "near"])

    return codes.select("code").mapInArrow(step, "code long, near long")


def near_background(panel: DataFrame, background: DataFrame, k: int, most: int = 100_000) -> DataFrame:
    """(canon, class, near_hits): occurrences in the background of what is one substitution from a panel k-mer. background: (seq).
    Up to `most` neighbours are looked up as the background is rolled, so that only they become rows; of more, the background's k-mers are counted first and met once.
    Counts are summed in twice as many parts as the background has, so those should be of bounded size (S.spread_out with a column)."""
    coded = kept(panel.select("canon", "class", S.code(F.col("canon")).alias("code")), "coded-panel")
    codes = coded.select("code").repartition(coded.sparkSession.sparkContext.defaultParallelism, "code").distinct()  # a small panel would be one task
    near = kept(neighbours(codes, k), "neighbours")
    if near.count() <= most:
        met = S.packed_kmers(background.select("seq"), "seq", k, near.select(F.col("near").alias("code"))).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    else:
        met = S.counted_kmers(background, "seq", k, 2 * background.rdd.getNumPartitions())
    met = met.withColumnRenamed("code", "near")
    hits = near.join(met, "near").groupBy("code").agg(F.sum("n").alias("near_hits"))
    return coded.join(hits, "code").select("canon", "class", "near_hits")


def recall(units: DataFrame, panel: DataFrame, k: int, tile: int = TILE, step: int = STEP, hits: int = HITS) -> DataFrame:
    """(class, tiles, found, crossed): of a class's tiles, how many hold at least `hits` of its k-mers, and how many as many of another's.

    units: (class, off, canon), a row for each k-mer."""
    inside = tile - k
    first = F.greatest(F.lit(0), F.ceil((F.col("off") - inside) / step)).cast("long")
    size = units.groupBy("class").agg((F.floor((F.max("off") - inside) / step) + 1).alias("tiles")).where("tiles > 0")
    own = panel.select("canon", F.col("class").alias("of"))
    met = units.join(own, "canon").withColumn("tile", F.explode(F.when(F.floor(F.col("off") / step) >= first, F.sequence(first, F.floor(F.col("off") / step)))))
    got = met.groupBy("class", "tile", "of").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hits).join(size, "class").where("tile < tiles")
    sums = got.groupBy("class", "tile").agg(F.max((F.col("of") == F.col("class")).cast("int")).alias("own"), F.max((F.col("of") != F.col("class")).cast("int")).alias("cross"))
    sums = sums.groupBy("class").agg(F.sum("own").alias("found"), F.sum("cross").alias("crossed"))
    zero = F.lit(0).cast("long")
    return size.join(sums, "class", "left").select("class", "tiles", F.coalesce("found", zero).alias("found"), F.coalesce("crossed", zero).alias("crossed"))
