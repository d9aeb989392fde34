"""Interval algebra and range joins. Intervals are half-open, with columns start and end."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Starts that a window of merge() orders at once; further ones meet by a row for each such range.
RANGE = 1 << 14


def merge(df: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """Intervals of a key joined while the next start is at most `gap` beyond the running end: keys, start, end, members."""
    at = _islands(df, keys, gap, max(RANGE, 64 * gap))
    return at.groupBy(*keys, "island_").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("members")).drop("island_")


def complement(merged: DataFrame, keys: list[str]) -> DataFrame:
    """The gaps between merged intervals of a key."""
    at = _carried(merged.select(*keys, "start", "end", F.floor(F.col("start") / RANGE).alias("bucket_")), keys, F.col("end"), "reach_")
    before = Window.partitionBy(*keys, "bucket_").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest("reach_", F.max("end").over(before))
    return at.select(*keys, reach.alias("start"), F.col("start").alias("end")).where("start < end")


def _binned(df: DataFrame, width: int) -> DataFrame:
    return df.withColumn("bin_", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))


def points_in(points: DataFrame, intervals: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Each point (column pos) with each interval that holds it, over an equality on keys and bins of `width`, so that
    a long contig is not one key; choose the width near the intervals' median length."""
    at = points.withColumn("bin_", F.floor(F.col("pos") / width))
    return at.join(_binned(intervals, width), [*keys, "bin_"]).where("pos >= start and pos < end").drop("bin_")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of intervals a and b (its bounds named start_b, end_b) that overlap; each pair once, from the bin where it begins."""
    left = _binned(a, width)
    right = _binned(b, width).withColumnsRenamed({"start": "start_b", "end": "end_b"})
    at = left.join(right, [*keys, "bin_"]).where("start < end_b and start_b < end")
    return at.where(F.col("bin_") == F.floor(F.greatest("start", "start_b") / width)).drop("bin_")


def reached(a: DataFrame, b: DataFrame, keys: list[str], name: str, width: int = RANGE) -> DataFrame:
    """a with the largest end of the intervals of b that start before a row's end (null if none does): one of b overlaps it if that lies beyond its start.
    Both are put in order by ranges of places, so no pair is made, however many of b overlap one of a."""
    none = F.lit(None).cast("long")
    known = b.where(" and ".join(f"`{c}` is not null" for c in (*keys, "start", "end")))
    starts = known.groupBy(*keys, F.col("start").alias("pos_")).agg(F.max("end").cast("long").alias("end_"))  # of equal starts the longest says all
    asked = a.select(*keys, F.col("end").alias("pos_"), none.alias("end_"), F.struct(*a.columns).alias("row_"))
    at = asked.unionByName(starts, allowMissingColumns=True).withColumn("bucket_", F.floor(F.col("pos_") / width))
    at = _carried(at, keys, F.col("end_"), "reach_")
    upto = Window.partitionBy(*keys, "bucket_").orderBy("pos_", F.col("end_").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("reach_", F.greatest("reach_", F.max("end_").over(upto))).where("row_ is not null")
    return at.select("row_.*", F.col("reach_").alias(name))


def within(a: DataFrame, merged: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Intervals of a that lie wholly inside one merged interval."""
    return overlaps(a, merged, keys, width).where("start_b <= start and end <= end_b").drop("start_b", "end_b")


def last_holding(points: DataFrame, intervals: DataFrame, keys: list[str], width: int, by: list[str]) -> DataFrame:
    """Each point with the interval that starts last of those that hold it. Places are asked once, however many points lie there, and of
    intervals with one start only the longest, so a place meets no more of them than the longest has bases."""
    longest = intervals.groupBy(*keys, "start").agg(F.max("end").alias("end"))
    asked = points.select(*keys, "pos").distinct()
    found = points_in(asked, longest, keys, width).groupBy(*keys, "pos").agg(F.max("start").alias("start"))
    return points.select(*keys, *by, "pos").distinct().join(found, [*keys, "pos"]).select(*keys, *by, "pos", "start")


def price(queries: DataFrame, slices: DataFrame, keys: list[str], width: int) -> DataFrame:
    """What reading costs: the bytes of the slices that each query overlaps, summed over queries, and each slice counted once.

    queries: (keys, query, start, end); slices: (keys, slice, start, end, size)."""
    met = overlaps(queries, slices, keys, width).select("query", "slice", "size").distinct()
    once = met.select("slice", "size").distinct().agg(F.coalesce(F.sum("size"), F.lit(0)).alias("floor_bytes"), F.count(F.lit(1)).alias("slices"))
    return met.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).crossJoin(once)


def _carried(at: DataFrame, keys: list[str], what: Column, name: str) -> DataFrame:
    """Adds what is largest in the earlier ranges (bucket_) of a row's key, from a row for each range."""
    on = [*keys, "bucket_"]
    earlier = Window.partitionBy(*keys).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    top = at.groupBy(*on).agg(F.max(what).alias("top_")).select(*(F.col(c).alias(f"{c}k_") for c in on), "top_", F.col("bucket_"), *keys)
    base = top.withColumn(name, F.max("top_").over(earlier)).drop("top_", *on)
    same = F.lit(True)
    for c in on:
        same = same & at[c].eqNullSafe(base[f"{c}k_"])
    return at.join(base, same).drop(*(f"{c}k_" for c in on))


def _islands(df: DataFrame, keys: list[str], gap: int, width: int) -> DataFrame:
    """df with island_, the start of the stretch that a row lies in; stretches of a key are more than `gap` apart. Windows hold the
    starts of `width`, or a row for each such range of a key."""
    at = df.withColumn("bucket_", F.floor(F.col("start") / width))
    order = Window.partitionBy(*keys, "bucket_").orderBy("start", "end")
    at = _carried(at, keys, F.col("end"), "reach_")
    reach = F.greatest("reach_", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    at = at.withColumn("new_", F.when(reach.isNull() | (F.col("start") - reach > gap), F.col("start")))
    at = _carried(at, keys, F.col("new_"), "last_")
    return at.withColumn("island_", F.greatest("last_", F.max("new_").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("bucket_", "reach_", "new_", "last_")


def places(df: DataFrame, keys: list[str], gap: int, span: int) -> DataFrame:
    """(keys, start, end, members): intervals, in order, that follow the one before within `gap` and end within `span` of their place's first start.
    What begins a place depends on where the last one began, so rows are folded in order, but no further than to the next gap that no place crosses."""
    slim = df.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    at = _islands(slim, keys, gap, 64 * max(gap, span, 1)).select(*keys, "island_", "start", "end")
    at = at.repartition(*keys, "island_").sortWithinPartitions(*keys, "island_", "start", "end")
    schema = slim.select(*keys, "start", "end").withColumn("members", F.lit(0).cast("long")).schema
    names = schema.names

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, island, now, out = [], None, None, []

        def made() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            kinds = [*batch.schema.types[: len(keys)], pa.int64(), pa.int64(), pa.int64()]
            for *at, s, e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at == island and None not in (s, e, now[1]) and s - now[1] <= gap and e - now[0] <= span:
                    now = (now[0], max(now[1], e), now[2] + 1)
                    continue
                if now:
                    out.append((*island[:-1], *now))
                island, now = at, (s, e, 1)
            if out:
                yield made()
        if now:
            out.append((*island[:-1], *now))
            yield made()

    return at.mapInArrow(fold, schema)


def subtract(a: DataFrame, merged: DataFrame, keys: list[str], width: int) -> DataFrame:
    """What of the intervals of a (with a column id) merged intervals don't cover: keys, id, start, end."""
    met = overlaps(a, merged, keys, width).groupBy(*keys, "id", "start", "end").agg(F.array_sort(F.collect_list(F.struct(F.col("start_b").alias("s"), F.col("end_b").alias("e")))).alias("cut"))
    rest = a.select(*keys, "id", "start", "end").join(met, [*keys, "id", "start", "end"], "left")
    lows = F.concat(F.array(F.col("start")), F.transform(F.coalesce("cut", F.array().cast("array<struct<s:long,e:long>>")), lambda x: x["e"]))
    highs = F.concat(F.transform(F.coalesce("cut", F.array().cast("array<struct<s:long,e:long>>")), lambda x: x["s"]), F.array(F.col("end")))
    at = rest.select(*keys, "id", F.explode(F.arrays_zip(lows.alias("start"), highs.alias("end"))).alias("p"))
    return at.select(*keys, "id", F.col("p.start").alias("start"), F.col("p.end").alias("end")).where("start < end")
