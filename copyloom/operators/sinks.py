"""Where a class's reads lie: intervals learned from placements, what they hold, and what reading them costs.

Placements are (sample, class, contig, start, reads), bins of `width`; reads without a place have contig '*'. A bin is inside a class's intervals if all of
it is, up to the contig's end (contigs: contig, length).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copyloom.operators import intervals
from copyloom.session import kept

UNPLACED = "*"


def learned(placements: DataFrame, contigs: DataFrame, width: int, decision: int, min_frac: float = 1e-5, min_reads: int = 25, pad: int = 1000) -> DataFrame:
    """(class, contig, start, end): bins in neighbourhoods of `decision` that hold min_frac of a class's reads, and min_reads, in any sample, joined where at most
    pad apart, padded, and cut at the contig's ends."""
    total = placements.groupBy("sample", "class").agg(F.sum("reads").alias("total_"))
    at = placements.where(F.col("contig") != UNPLACED).withColumn("near_", F.floor(F.col("start") / decision))
    held = at.groupBy("sample", "class", "contig", "near_").agg(F.sum("reads").alias("held_")).join(total, ["sample", "class"])
    good = held.where(F.col("held_") >= F.greatest(F.lit(float(min_reads)), min_frac * F.col("total_"))).select("sample", "class", "contig", "near_")
    bins = at.join(good, ["sample", "class", "contig", "near_"]).select("class", "contig", "start", (F.col("start") + width).alias("end")).distinct()
    runs = intervals.merge(bins, ["class", "contig"], pad).join(contigs, "contig", "left")
    end = F.col("end") + pad
    return runs.select("class", "contig", F.greatest(F.lit(0), F.col("start") - pad).alias("start"), F.least(end, F.coalesce("length", end)).alias("end"))


def inside(placements: DataFrame, bed: DataFrame, contigs: DataFrame, width: int, span: int = 1 << 14) -> DataFrame:
    """The placements whose bin lies inside the class's intervals, with from_ and to_, the ends of the joined interval. bed: (class, contig, start, end)."""
    joined = intervals.merge(bed, ["class", "contig"]).select("class", "contig", F.col("start").alias("from_"), F.col("end").alias("to_"))
    end = F.col("start") + width
    at = placements.where(F.col("contig") != UNPLACED).join(contigs, "contig", "left").withColumn("end_", F.least(end, F.coalesce("length", end))).drop("length")
    at = at.withColumn("part_", F.floor(F.col("start") / span))
    parts = joined.withColumn("part_", F.explode(F.sequence(F.floor(F.col("from_") / span), F.floor((F.col("to_") - 1) / span))))
    return at.join(parts, ["class", "contig", "part_"]).where("from_ <= start and end_ <= to_").drop("part_", "end_")


def capture(placements: DataFrame, bed: DataFrame, contigs: DataFrame, width: int) -> DataFrame:
    """(sample, class, total, inside): a class's reads, and those in bins inside its intervals; reads without a place count against it."""
    total = placements.groupBy("sample", "class").agg(F.sum("reads").alias("total"))
    held = inside(placements, bed, contigs, width).groupBy("sample", "class").agg(F.sum("reads").alias("inside"))
    return total.join(held, ["sample", "class"], "left").withColumn("inside", F.coalesce("inside", F.lit(0)))


def interval_statistics(placements: DataFrame, bed: DataFrame, contigs: DataFrame, width: int, span: int = 1 << 14) -> DataFrame:
    """(class, rank, contig, start, end, scans, share_median, share_p10, share_max, reads_median, share_per_read, cum_capture_median, cum_capture_p10).

    placements with all, the reads of any class in the bin. An interval has the bins inside the class's intervals that start in it; samples without reads of a
    class say nothing of it. Intervals rank by the median share over the median of all reads, then share, contig and start."""
    placements, bed = kept(placements, "placements"), kept(bed, "bed")
    total = placements.groupBy("sample", "class").agg(F.sum("reads").alias("total_")).where("total_ > 0")
    rows = bed.select("class", "contig", F.col("start").alias("s_"), F.col("end").alias("e_")).distinct()
    parts = rows.withColumn("part_", F.explode(F.sequence(F.floor(F.col("s_") / span), F.floor((F.col("e_") - 1) / span))))
    at = inside(placements, bed, contigs, width).withColumn("part_", F.floor(F.col("start") / span)).join(parts, ["class", "contig", "part_"]).where("s_ <= start and start < e_")
    at = at.groupBy("sample", "class", "contig", "start", "reads", "all").agg(F.max(F.struct("s_", "e_")).alias("i_")).select("*", "i_.*")  # the last that starts before it
    held = at.groupBy("sample", "class", "contig", "s_", "e_").agg(F.sum("reads").alias("reads_"), F.sum("all").alias("all_"))
    every = rows.join(total, "class").join(held, ["sample", "class", "contig", "s_", "e_"], "left")
    every = every.select("sample", "class", "contig", "s_", "e_", (F.coalesce("reads_", F.lit(0)) / F.col("total_")).alias("share"), F.coalesce("all_", F.lit(0)).alias("all_"))
    every = kept(every, "shares")
    each = every.groupBy("class", "contig", "s_", "e_").agg(
        F.count(F.lit(1)).alias("scans"), F.percentile("share", 0.5).alias("share_median"), F.percentile("share", 0.1).alias("share_p10"), F.max("share").alias("share_max"), F.percentile("all_", 0.5).alias("reads_median")
    )
    each = each.withColumn("share_per_read", F.col("share_median") / F.greatest("reads_median", F.lit(1)))
    each = each.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("share_per_read"), F.desc("share_median"), "contig", "s_", "e_")))  # a class has a few thousand intervals
    order = Window.partitionBy("sample", "class").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    cum = every.join(each.select("class", "contig", "s_", "e_", "rank"), ["class", "contig", "s_", "e_"]).withColumn("cum_", F.sum("share").over(order))
    cum = cum.groupBy("class", "rank").agg(F.percentile("cum_", 0.5).alias("cum_capture_median"), F.percentile("cum_", 0.1).alias("cum_capture_p10"))
    return each.join(cum, ["class", "rank"]).withColumnsRenamed({"s_": "start", "e_": "end"})


def union_price(ranked: DataFrame, slices: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(rank, added, bytes): what reading the intervals (keys, rank, start, end) up to each rank costs; a slice is paid for by the first rank that needs it."""
    met = intervals.overlaps(ranked, slices, keys, width).groupBy("slice", "size").agg(F.min("rank").alias("rank"))
    by = ranked.select("rank").distinct().join(met.groupBy("rank").agg(F.sum("size").alias("added")), "rank", "left").withColumn("added", F.coalesce("added", F.lit(0)))
    return by.withColumn("bytes", F.sum("added").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))  # a row for each rank of a menu
