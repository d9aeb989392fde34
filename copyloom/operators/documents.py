"""Counts documents: put together from tallies, written one a sample, and estimated from.

A document (sources.tables.COUNTS) has a sample's GC tables, and for each class the read ends in each bin of its unit by strand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom.operators import estimate as E
from copyloom.operators import models, tallies
from copyloom.session import kept

FORMAT = "copyloom-counts/1"


def _dense(pairs: Column, size: Column) -> Column:
    """An array of `size` counts from (at, n); 0 where none is given."""
    held = F.map_from_entries(pairs)
    return F.transform(F.when(size > 0, F.sequence(F.lit(0), (size - 1).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.coalesce(F.try_element_at(held, i), F.lit(0).cast("long")))


def assembled(samples: DataFrame, gc: DataFrame, classes: DataFrame, ends: DataFrame, placements: DataFrame) -> DataFrame:
    """A row per sample with the columns of a document. samples: (sample, mode, records, primary, insert_median, read_length_mode); gc: (sample, l, gc, n, o); classes: (sample, class, kind, bin, bins, reads, dup_flagged), bin the
    width of a class's bins and bins how many its unit has; ends: (sample, class, bin, reverse, n); placements: (sample, class, contig, start, reads). What a sample lacks is an empty list; lists are in order."""
    tables = gc.groupBy("sample", "l").agg(*(_dense(F.collect_list(F.struct(F.col("gc").cast("int"), F.col(c).cast("long"))), F.lit(models.STRATA)).alias(c) for c in ("n", "o")))
    tables = tables.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct(F.col("l").cast("long").alias("l"), "n", "o"))).alias("gc_tables"))
    # A class's ends of a sample: as many as its unit has bins.
    strand = lambda r: F.collect_list(F.when(F.col("reverse") == r, F.struct(F.col("bin").cast("int").alias("bin"), F.col("n").cast("long").alias("n"))))
    seen = ends.groupBy("sample", "class").agg(strand(False).alias("f_"), strand(True).alias("r_"))
    none = F.array().cast("array<struct<bin:int,n:bigint>>")
    made = classes.join(seen, ["sample", "class"], "left").select(
        "sample", F.struct(F.col("class").cast("string").alias("name"), "kind", F.col("bin").cast("long").alias("bin"), *(_dense(F.coalesce(c, none), F.col("bins")).alias(name) for c, name in (("f_", "fwd"), ("r_", "rev"))), F.col("reads").cast("long").alias("reads"), F.col("dup_flagged").cast("long").alias("dup_flagged")).alias("c_"),
    )
    made = made.groupBy("sample").agg(F.array_sort(F.collect_list("c_")).alias("classes"))
    put = placements.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct(F.col("class").cast("string").alias("class"), F.col("contig").cast("string").alias("contig"), F.col("start").cast("long").alias("start"), F.col("reads").cast("long").alias("reads")))).alias("placements"))
    at = samples
    for part in (tables, made, put):
        at = at.join(part, "sample", "left")
    lists = [F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in (("gc_tables", tables.schema["gc_tables"].dataType), ("classes", made.schema["classes"].dataType), ("placements", put.schema["placements"].dataType))]
    return at.select(F.lit(FORMAT).alias("format"), F.col("sample").cast("string").alias("sample"), "mode", *(F.col(c).cast("long").alias(c) for c in ("records", "primary", "insert_median", "read_length_mode")), *lists)


def write(documents: DataFrame, path: str) -> None:
    """A folder per sample with one JSON document; Spark's committer shows a file only when all of it is written."""
    columns = [c for c in documents.columns if c != "sample"]
    rows = documents.select(F.col("sample").alias("of"), F.to_json(F.struct("sample", *columns)).alias("value"))
    rows.repartition("of").write.option("maxRecordsPerFile", 1).partitionBy("of").text(path)


def gc_rows(documents: DataFrame) -> DataFrame:
    """(sample, l, gc, n, o) of documents, from the table whose length is nearest to the sample's insert."""
    at = documents.select("sample", "insert_median", F.inline("gc_tables"))
    best = tallies.nearest_table(at.select("sample", "l", F.col("insert_median").alias("t_")), ["sample"], "t_")
    at = at.join(best, ["sample", "l"]).select("sample", "l", F.posexplode(F.arrays_zip("n", "o")).alias("gc", "x"))
    return at.select("sample", "l", F.col("gc").cast("long").alias("gc"), "x.n", "x.o")


def end_bins(documents: DataFrame) -> DataFrame:
    """(sample, class, bin, reverse, n) of the positional classes of documents."""
    at = documents.select("sample", F.inline("classes")).where("kind = 'positional'").select("sample", F.col("name").alias("class"), "fwd", "rev")
    parts = [at.select("sample", "class", F.lit(r).alias("reverse"), F.posexplode(c).alias("bin", "n")) for c, r in (("fwd", False), ("rev", True))]
    both = parts[0].unionByName(parts[1])
    return both.select("sample", "class", F.col("bin").cast("long").alias("bin"), "reverse", "n")


def estimated(documents: DataFrame, units: DataFrame, kmers: DataFrame, anchors: DataFrame, k: int, width: int, per: int = 10, least: int = 1, min_positions: int = 2000, min_ends: int = 10_000, anchor_ends: int = E.ANCHOR_ENDS) -> tuple[DataFrame, DataFrame]:
    """(estimates, windows) of the positional classes of documents: rates by GC from each sample's nearest table, what its reads can be called by the panel's k-mers, expected ends, copies.

    units: (class, seq, circular); kmers: (class, pos), where the panel's k-mers of a class begin; anchors: (class, start, end); width: bases of a bin; per: bins of a window. Samples whose rates can't be fitted, and classes without a unit,
    have no estimate. Samples are taken together by the few pairs of table and read length that there are."""
    rows = kept(gc_rows(documents), "gc-rows")
    curves = kept(models.gc_curves(rows.drop("l"), ["sample"], min_positions, min_ends), "curves")
    how = kept(rows.select("sample", "l").distinct().join(documents.select("sample", "read_length_mode"), "sample").join(curves.where("status = 'ok'").select("sample").distinct(), "sample"), "how")
    seen = kept(end_bins(documents), "end-bins")
    size = F.length("seq")
    begun = kmers.select("class", "pos").distinct().withColumn("kept_", F.lit(True))
    every = units.select("class", "circular", F.explode(F.sequence(F.lit(0), size - 1)).alias("pos")).withColumn("pos", F.col("pos").cast("long")).join(begun, ["class", "pos"], "left")
    every = kept(every.select("class", "pos", "circular", F.coalesce("kept_", F.lit(False)).alias("kept")), "unit-kmers")
    lengths = units.select("class", size.alias("length"))
    estimates, windows = [], []
    for l, read in [tuple(r) for r in how.select("l", "read_length_mode").distinct().orderBy("l", "read_length_mode").collect()]:  # tables and read lengths, not samples
        some = how.where((F.col("l") == l) & (F.col("read_length_mode") == read)).select("sample")
        positions = E.position_gc(units, l)
        starts = tallies.callable_starts(every, read, k, least)
        ok = starts.select("class", "pos", F.inline(F.array(F.struct(F.lit(False).alias("reverse"), F.col("ahead").alias("ok")), F.struct(F.lit(True).alias("reverse"), F.col("back").alias("ok")))))
        curve = E.whole_curve(curves.join(some, "sample").where("status = 'ok'").select("sample", "gc", "rate"))
        bins = kept(E.strand_bins(positions, ok, curve, seen.join(some, "sample"), width), "strand-bins")
        estimates.append(E.positional(bins, anchors, per, width, ends=anchor_ends))
        windows.append(E.windows(bins, per, width, lengths))
    if not estimates:
        spark = documents.sparkSession
        return spark.createDataFrame([], "sample string, class string, cn double"), spark.createDataFrame([], "sample string, class string, start long, end long, gc double, cn double")
    for more in estimates[1:]:
        estimates[0] = estimates[0].unionByName(more)
    for more in windows[1:]:
        windows[0] = windows[0].unionByName(more)
    return estimates[0], windows[0]
