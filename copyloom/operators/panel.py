"""Panels: which k-mers tell a class, and what a read's k-mers say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copyloom.functions import sequences as S

MIN_HITS, AMBIGUOUS = 4, 5


def candidates(units: DataFrame, background: DataFrame | None = None, keep: DataFrame | None = None) -> DataFrame:
    """(canon, class, kind, n, at, shared, background, outside): k-mers by class with how often they occur in it, whether another class holds them, their count in the
    background, and whether they begin outside the class's keep intervals, if it has any; what is shared is told from all of a class's k-mers,
    kept or not. units: (class, kind, off, canon, fwd); background: (canon); keep: (class, start, end)."""
    own = units.groupBy("canon", "class", "kind").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("off", "fwd"), "off").alias("at"))
    classes = own.groupBy("canon").agg((F.count(F.lit(1)) > 1).alias("shared"))
    own = own.join(classes, "canon").withColumn("outside", F.lit(False))
    if keep is not None:
        lists = keep.groupBy("class").agg(F.collect_list(F.struct("start", "end")).alias("keep_"))  # a unit's intervals
        held = F.exists("keep_", lambda x: (F.col("at.off") >= x["start"]) & (F.col("at.off") < x["end"]))
        own = own.join(lists, "class", "left").withColumn("outside", F.col("keep_").isNotNull() & ~held).drop("keep_")
    if background is None:
        return own.withColumn("background", F.lit(0).cast("long"))
    met = background.join(own.select("canon").distinct(), "canon", "left_semi").groupBy("canon").agg(F.count(F.lit(1)).alias("background"))
    return own.join(met, "canon", "left").withColumn("background", F.coalesce("background", F.lit(0).cast("long")))


def reason(min_count: int = 1, max_background: int = 0) -> Column:
    """Why a candidate is dropped, in the order of the tests; 'kept' if it isn't."""
    return (
        F.when(F.col("shared"), "shared").when(F.col("outside"), "outside").when((F.col("kind") == "positional") & (F.col("n") > 1), "repeated")
        .when((F.col("kind") == "compositional") & (F.col("n") < min_count), "rare").when(F.col("background") > max_background, "background").otherwise("kept")
    )


def build(units: DataFrame, background: DataFrame | None = None, min_count: int = 1, max_background: int = 0, keep: DataFrame | None = None) -> DataFrame:
    """The panel: (canon, class, kind, pos, fwd)."""
    kept = candidates(units, background, keep).where(reason(min_count, max_background) == "kept")
    return kept.select("canon", "class", "kind", F.col("at.off").alias("pos"), F.col("at.fwd").alias("fwd"))


def merge(*panels: DataFrame) -> DataFrame:
    """All panels as one; a k-mer of two of them is dropped from both."""
    every = panels[0].withColumn("panel_", F.lit(0))
    for k, p in enumerate(panels[1:], 1):
        every = every.unionByName(p.withColumn("panel_", F.lit(k)))
    once = every.groupBy("canon").agg(F.count_distinct("panel_").alias("n")).where("n = 1").select("canon")
    return every.join(once, "canon", "left_semi").drop("panel_")


def selected(panel: DataFrame, names: list[str]) -> DataFrame:
    """The panel's k-mers of the named classes, with asked; if one of them is compositional, all compositional classes stay, as they compete for reads."""
    at = panel.withColumn("asked", F.col("class").isin(*names))
    family = F.max((F.col("asked") & (F.col("kind") == "compositional")).cast("int"))
    at = at.crossJoin(F.broadcast(at.agg((family == 1).alias("contest_"))))  # one row
    return at.where(F.col("asked") | F.col("contest_") & (F.col("kind") == "compositional")).drop("contest_")


def hits(reads: DataFrame, panel: DataFrame, k: int) -> DataFrame:
    """(read, valid, off, class, pos, same): the panel's k-mers in reads, and whether they lie on the unit's strand. reads: (read, seq);
    valid counts a read's k-mers. The reads' k-mers are looked up as they are rolled, so that only those of the panel become rows."""
    coded = panel.withColumn("code", S.code(F.col("canon")))
    at = reads.select("read", S.valid_kmers(F.col("seq"), k).alias("valid"), "seq")
    found = S.packed_kmers(at, "seq", k, coded).withColumnRenamed("fwd", "fwd_")
    return found.join(coded.select("code", "class", "pos", "fwd"), "code").select("read", "valid", "off", "class", "pos", (F.col("fwd_") == F.col("fwd")).alias("same"))


def classify(hit: DataFrame, min_hits: int = MIN_HITS) -> DataFrame:
    """Families compete for a read: (read, class, hits, second, valid, hit_frac_bin, state). The most hits win, ties go to the lower
    class; ambiguous if AMBIGUOUS * second > hits; below if fewer than min_hits. hit: (read, valid, class)."""
    n = hit.groupBy("read", "class").agg(F.count(F.lit(1)).alias("hits"), F.first("valid").alias("valid"))
    order = Window.partitionBy("read").orderBy(F.desc("hits"), "class")
    best = n.withColumn("place", F.row_number().over(order)).withColumn("second", F.lead("hits", 1, 0).over(order)).where("place = 1").drop("place")
    state = F.when(F.col("hits") < min_hits, "below").when(AMBIGUOUS * F.col("second") > F.col("hits"), "ambiguous").otherwise("assigned")
    return best.select("read", "class", "hits", "second", "valid", S.hit_bin(F.col("hits"), F.col("valid")).alias("hit_frac_bin"), state.alias("state"))


def locate(hit: DataFrame, k: int, min_hits: int = MIN_HITS) -> DataFrame:
    """Positional classes, each by itself: (read, class, hits, reverse, diagonal). A read is reverse if more hits disagree than agree with
    the unit's strand; the diagonal is the upper median of pos - off, or of pos + k - 1 + off, over the hits that agree."""
    sums = hit.groupBy("read", "class").agg(
        F.count(F.lit(1)).alias("hits"), (F.count_if(~F.col("same")) > F.count_if("same")).alias("reverse"),
        F.array_sort(F.collect_list(F.when(F.col("same"), F.col("pos") - F.col("off")))).alias("ahead"),
        F.array_sort(F.collect_list(F.when(~F.col("same"), F.col("pos") + (k - 1) + F.col("off")))).alias("back"),
    )
    d = F.when(F.col("reverse"), F.col("back")).otherwise(F.col("ahead"))
    return sums.where(F.col("hits") >= min_hits).select("read", "class", "hits", "reverse", F.get(d, F.floor(F.size(d) / 2).cast("int")).cast("long").alias("diagonal"))
