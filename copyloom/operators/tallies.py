"""What is counted over reads, and what the counts say of control regions and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copyloom.operators.cohort import robust
from copyloom.operators.intervals import points_in
from copyloom.session import kept

#: Flags of a read, and caps of the histograms of insert sizes and read lengths.
PROPER, UNMAPPED, REVERSE, DUPLICATE = 0x2, 0x4, 0x10, 0x400
INSERT_CAP, INSERT_BIN, LENGTH_CAP = 1500, 10, 400


def has(flag: int) -> Column:
    return F.col("flags").bitwiseAND(flag) != 0


def library_stats(reads: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reads, dup, mapq0, mapq_lt20) of reads (keys, flags, mapq)."""
    return reads.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("reads"), F.count_if(has(DUPLICATE)).alias("dup"), F.count_if(F.col("mapq") == 0).alias("mapq0"), F.count_if(F.col("mapq") < 20).alias("mapq_lt20")
    )


def insert_histogram(reads: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bin, n): sizes of proper pairs in bins of INSERT_BIN; what exceeds the cap is in the last bin."""
    at = reads.where(has(PROPER) & (F.col("tlen") > 0))
    return at.groupBy(*keys, F.floor(F.least("tlen", F.lit(INSERT_CAP)) / INSERT_BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_median(hist: DataFrame, keys: list[str], value: str, count: str) -> DataFrame:
    """The first value at which the counts so far reach half of all."""
    order = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    at = hist.withColumn("so_far_", F.sum(count).over(order)).withColumn("all_", F.sum(count).over(Window.partitionBy(*keys)))
    return at.where("so_far_ * 2 >= all_").groupBy(*keys).agg(F.min(value).alias("median"))


def unit_positions(hits: DataFrame, length: int, width: int, circular: bool = True) -> DataFrame:
    """(class, reverse, bin, n): where reads begin along a unit; bin is null for those beyond a linear one. hits: (class, reverse, pos)."""
    pos = F.pmod(F.col("pos"), F.lit(length)) if circular else F.when((F.col("pos") >= 0) & (F.col("pos") < length), F.col("pos"))
    return hits.groupBy("class", "reverse", F.floor(pos / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def placements(reads: DataFrame, width: int, wider: int = 10) -> DataFrame:
    """(class, contig, start, reads, all, dup): where a class's reads lie, in bins of width (times wider for compositional
    classes), and how many reads of any class lie there. reads: (class or null, kind, contig, pos, flags)."""
    fine = reads.groupBy("contig", F.floor(F.col("pos") / width).alias("part")).agg(F.count(F.lit(1)).alias("all"), F.count_if(has(DUPLICATE)).alias("dup"))
    own = F.when(F.col("kind") == "compositional", width * wider).otherwise(width).cast("long")
    mine = reads.where("class is not null").groupBy("class", "contig", own.alias("width"), F.floor(F.col("pos") / own).alias("bin")).agg(F.count(F.lit(1)).alias("reads"))
    parts = mine.withColumn("part", F.explode(F.sequence(F.floor(F.col("bin") * F.col("width") / width), F.floor(F.col("bin") * F.col("width") / width) + F.floor(F.col("width") / width) - 1)))
    met = parts.join(fine, ["contig", "part"], "left")
    return met.groupBy("class", "contig", (F.col("bin") * F.col("width")).alias("start")).agg(F.first("reads").alias("reads"), F.sum("all").alias("all"), F.sum("dup").alias("dup"))


def log_ratio(obs: str, exp: str) -> Column:
    """ln of what was seen over what was expected, for a region; a region without reads counts as half a read."""
    return F.log(F.greatest(F.col(obs).cast("double"), F.lit(0.5)) / F.greatest(F.col(exp).cast("double"), F.lit(1e-9)))


def truth_copies(regions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, regions, copies, median, mad_sd): copies per diploid genome over all regions of a key, and of the regions one by one."""
    one = kept(regions.where("exp > 0").withColumn("cn_", 2 * F.col("obs") / F.col("exp")), "copies")
    at = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("regions"), (2 * F.sum("obs") / F.sum("exp")).alias("copies"))
    return at.join(robust(one, keys, "cn_").select(*keys, "median", "mad_sd"), keys)


def mass(reads: DataFrame, curve: DataFrame, keys: list[str], covered: float) -> DataFrame:
    """(keys, mass): reads by GC over the rate of their GC, over the share covered. 0 without reads; null if a GC with reads has no rate.

    reads: (keys, gc, n); curve: (gc, rate)."""
    at = reads.join(curve, "gc", "left").withColumn("part_", F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("n") / F.col("rate")))
    return at.groupBy(*keys).agg(F.when(F.count_if(F.col("part_").isNull()) == 0, F.sum("part_") / covered).alias("mass"))


def nearest_table(lengths: DataFrame, keys: list[str], target: str) -> DataFrame:
    """(keys, l): the table whose length is nearest to the target; the shorter on a tie."""
    return lengths.groupBy(*keys).agg(F.min_by("l", F.struct(F.abs(F.col("l") - F.col(target)), F.col("l"))).alias("l"))


def callable_starts(unit: DataFrame, read: int, k: int, least: int) -> DataFrame:
    """(class, pos, ahead, back): whether a read of so many bases that begins at pos holds at least so many of the panel's k-mers, on
    either strand. unit: (class, pos, kept), a row for each position at which a k-mer begins, gapless, and where known circular: such a unit goes on at its start, as often as a read goes round it."""
    at = unit if "circular" in unit.columns else unit.withColumn("circular", F.lit(False))
    size = at.groupBy("class").agg(F.count(F.lit(1)).alias("size_"))
    turns = F.when(F.col("circular"), F.ceil(F.lit(read) / F.col("size_"))).otherwise(0)
    at = at.join(size, "class").withColumn("turn_", F.explode(F.sequence(-turns, turns))).withColumn("at_", F.col("pos") + F.col("turn_") * F.col("size_")).where(f"at_ > -{read} and at_ < size_ + {read}")
    w = Window.partitionBy("class").orderBy("at_")
    has_kmer = F.col("kept").cast("int")
    ahead, back = w.rowsBetween(0, read - k), w.rowsBetween(1 - read, 1 - k)
    full = lambda f: F.count(F.lit(1)).over(f) == read - k + 1
    got = at.select("class", "pos", "turn_", (full(ahead) & (F.sum(has_kmer).over(ahead) >= least)).alias("ahead"), (full(back) & (F.coalesce(F.sum(has_kmer).over(back), F.lit(0)) >= least)).alias("back"))
    return got.where("turn_ = 0").drop("turn_")


def wide(rows: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """One row for each key with a column for each name, for export only; what is missing is null and NA in the file."""
    return rows.groupBy(key).pivot(name, names).agg(F.first(value))


def write_wide(table: DataFrame, path: str) -> None:
    table.write.csv(path, sep="\t", header=True, nullValue="NA", emptyValue="")


def placed(reads: DataFrame) -> DataFrame:
    """Reads with a place: those without are counted and classified, but in no contig, bin or region."""
    return reads.where(~has(UNMAPPED))


def bin_tally(reads: DataFrame, width: int) -> DataFrame:
    """(contig, bin, reads, dup) of reads (contig, pos, flags)."""
    return placed(reads).groupBy("contig", F.floor(F.col("pos") / width).alias("bin")).agg(F.count(F.lit(1)).alias("reads"), F.count_if(has(DUPLICATE)).alias("dup"))


def contig_reads(reads: DataFrame) -> DataFrame:
    """(contig, reads, dup)."""
    return placed(reads).groupBy("contig").agg(F.count(F.lit(1)).alias("reads"), F.count_if(has(DUPLICATE)).alias("dup"))


def read_lengths(reads: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, length, n): lengths beyond LENGTH_CAP count as that."""
    return reads.groupBy(*keys, F.least(F.col("length"), F.lit(LENGTH_CAP)).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def control_stats(reads: DataFrame, regions: DataFrame, keys: list[str], width: int = 1 << 12) -> DataFrame:
    """(keys, ctrl, ctrl_dup, ctrl_mapq0): reads whose place lies in control regions (contig, start, end), which don't overlap."""
    at = points_in(placed(reads), regions, ["contig"], width)
    return at.groupBy(*keys).agg(F.count(F.lit(1)).alias("ctrl"), F.count_if(has(DUPLICATE)).alias("ctrl_dup"), F.count_if(F.col("mapq") == 0).alias("ctrl_mapq0"))


def gc_observed(positions: DataFrame, ends: DataFrame) -> DataFrame:
    """(gc, n, o): position-strands by the GC of their window (class, pos, reverse, gc; those without one are left out), and the ends seen at them. ends: (class, pos, reverse, n)."""
    at = positions.where("gc >= 0").join(ends.select("class", "pos", "reverse", F.col("n").alias("seen_")), ["class", "pos", "reverse"], "left")
    return at.groupBy("gc").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("seen_"), F.lit(0)).alias("o"))


def region_totals(tables: DataFrame) -> DataFrame:
    """(region, positions, mean_gc) of the positions of regions by GC (region, gc, n)."""
    return tables.groupBy("region").agg(F.sum("n").alias("positions"), (F.sum(F.col("n") * F.col("gc")) / F.sum("n") / 100).alias("mean_gc"))


def sequenced_end(pos: Column, length: Column, against: Column, stored: Column) -> tuple[Column, Column]:
    """(end, reverse): where the end that was sequenced first lies on a unit, and its strand. pos: the place of the stored sequence's first base, on the strand that `against`
    tells; stored: whether the record holds the reverse complement of what was sequenced."""
    span = length - 1
    return F.when(~stored, pos).when(against, pos - span).otherwise(pos + span), against != stored


def stored_reversed(flags: Column) -> Column:
    """Whether a record holds the reverse complement; that flag means nothing for reads without a place."""
    return (flags.bitwiseAND(REVERSE) != 0) & (flags.bitwiseAND(UNMAPPED) == 0)


def placement_order(placements: DataFrame) -> DataFrame:
    """Placements (class, contig, start, reads) with their place in the order of a class: most reads first, then contig and start."""
    return placements.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("reads"), "contig", "start")))


def control_ends(reads: DataFrame, regions: DataFrame, roles: list[str] | None = None, width: int = 1 << 12) -> DataFrame:
    """(region, offset, reverse, n): the 5' ends of placed reads (contig, pos, flags) in regions (region, role, contig, start, end) of those roles (all, unless told), by place in the region and strand."""
    some = regions if roles is None else regions.where(F.col("role").isin(roles))
    at = points_in(placed(reads), some, ["contig"], width)
    return at.groupBy("region", (F.col("pos") - F.col("start")).alias("offset"), has(REVERSE).alias("reverse")).agg(F.count(F.lit(1)).alias("n"))
