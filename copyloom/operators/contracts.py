"""What must hold between counts, panels, sinks and controls before they are used together, as rows (sample, level, code, message)."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _issue(rows: DataFrame, level: str, code: str, what: str) -> DataFrame:
    return rows.groupBy("sample").agg(F.array_join(F.array_sort(F.collect_set(F.col(what).cast("string"))), ",").alias("message")).select("sample", F.lit(level).alias("level"), F.lit(code).alias("code"), "message")


def missing_classes(wanted: DataFrame, counted: DataFrame) -> DataFrame:
    """(sample, class) of the wanted classes that a sample's counts lack. wanted: (class); counted: (sample, class)."""
    every = counted.select("sample").distinct().crossJoin(F.broadcast(wanted.select("class").distinct()))  # classes are at most 255
    return every.join(counted.select("sample", "class").distinct(), ["sample", "class"], "left_anti")


def unknown_classes(wanted: DataFrame, counted: DataFrame) -> DataFrame:
    """(sample, class) of counted classes that nobody knows."""
    return counted.select("sample", "class").distinct().join(wanted.select("class"), "class", "left_anti").select("sample", "class")


def mixed_resources(counts: DataFrame, what: str) -> DataFrame:
    """(sample, what) of samples whose resource isn't that of most samples; of resources with equal counts the smallest name stands."""
    n = counts.groupBy(what).agg(F.count_distinct("sample").alias("n_"))
    best = n.join(F.broadcast(n.agg(F.max("n_").alias("n_"))), "n_").agg(F.min(what).alias("common_"))
    return counts.crossJoin(F.broadcast(best)).where(~F.col(what).eqNullSafe(F.col("common_"))).select("sample", what)  # one row


def region_match(bundle: DataFrame, counted: DataFrame) -> DataFrame:
    """(sample, region, role, state): state is both, missing (in the bundle alone) or extra (in the counts alone).

    What a sample has, a join with the bundle tells; what it lacks is the bundle's set less its own, a row for each sample first."""
    here = counted.select("sample", "region").distinct()
    roles = bundle.select("region", F.col("role").alias("role_"), F.lit(True).alias("known_"))
    met = here.join(roles, "region", "left").select("sample", "region", F.col("role_").alias("role"), F.when(F.col("known_"), "both").otherwise("extra").alias("state"))
    every = bundle.agg(F.collect_set("region").alias("every_"))  # one row of a bundle's few thousand regions
    lack = here.groupBy("sample").agg(F.collect_set("region").alias("own_")).crossJoin(F.broadcast(every))
    lack = lack.select("sample", F.explode(F.array_except("every_", "own_")).alias("region")).join(roles, "region")
    return met.unionByName(lack.select("sample", "region", F.col("role_").alias("role"), F.lit("missing").alias("state")))


def looks_cut(counts: DataFrame, share: float = 0.05) -> DataFrame:
    """Samples whose reads in control regions are more than `share` of all: files that hold chosen regions only."""
    return counts.where((F.col("primary") > 0) & (F.col("ctrl_reads") > share * F.col("primary"))).select("sample", (F.col("ctrl_reads") / F.col("primary")).alias("share"))


def scan_state(counts: DataFrame, share: float = 0.05) -> DataFrame:
    """(sample, state): whole for counts of a whole file, from which alone sinks are learned and their capture measured; cut for those whose reads are mostly of chosen regions; not a scan for any other mode, a missing one included."""
    cut = looks_cut(counts, share).select("sample").distinct().withColumn("cut_", F.lit(True))
    state = F.when(~F.col("mode").eqNullSafe("scan"), "not a scan").when(F.col("cut_"), "cut").otherwise("whole")
    return counts.select("sample", "mode").join(cut, "sample", "left").select("sample", state.alias("state"))


def issues(wanted: DataFrame, counted: DataFrame, resources: DataFrame, what: str) -> DataFrame:
    """All of it."""
    parts = [
        _issue(missing_classes(wanted, counted), "error", "missing_classes", "class"),
        _issue(unknown_classes(wanted, counted), "warning", "unknown_classes", "class"),
        _issue(mixed_resources(resources, what), "error", f"mixed_{what}", what),
    ]
    return reduce(DataFrame.unionByName, parts)


def panel_mismatch(counted: DataFrame, panel: DataFrame) -> DataFrame:
    """(sample, class, message): positional classes counted with k-mers other than the panel's. counted: (sample, class, kind, k, length, kmers); panel: (class, kind,
    k, length, kmers). What counts lack isn't checked."""
    at = counted.where("kind = 'positional'").join(panel.select("class", *(F.col(c).alias(f"{c}_") for c in ("kind", "k", "length", "kmers"))), "class")
    parts = [F.when(F.col("kind_") != "positional", F.concat(F.lit("kind "), "kind_"))]
    parts += [F.when(F.col(c) != F.col(f"{c}_"), F.concat(F.lit(f"{c} "), F.col(c).cast("string"), F.lit(" for "), F.col(f"{c}_").cast("string"))) for c in ("k", "length", "kmers")]
    return at.select("sample", "class", F.concat_ws("; ", *parts).alias("message")).where("message <> ''")


def incomplete_sinks(counted: DataFrame, skipped: DataFrame, missing: DataFrame) -> DataFrame:
    """(sample, class, status, intervals, bp): classes that a fetch didn't read in full. counted: (sample, class); skipped: (sample, class, intervals, bp), rows of the
    sinks on contigs that the input lacks, where an empty class serves all; missing: (sample, class), classes without any sink."""
    all_ = skipped.where("class = ''").select("sample", "intervals", "bp").join(counted, "sample")
    own = skipped.where("class <> ''").join(counted, ["sample", "class"]).select("sample", "class", "intervals", "bp")
    cut = own.unionByName(all_.select("sample", "class", "intervals", "bp")).groupBy("sample", "class").agg(F.sum("intervals").alias("intervals"), F.sum("bp").alias("bp"))
    none = missing.join(counted, ["sample", "class"], "left_semi").distinct().withColumn("none_", F.lit(True))
    at = cut.join(none, ["sample", "class"], "full")
    return at.select("sample", "class", F.when(F.col("none_"), "no_sinks_in_fetch").otherwise("sinks_skipped").alias("status"), "intervals", "bp")


def subset_only(placements: DataFrame, options: DataFrame, width: int) -> DataFrame:
    """(sample, class, bins): classes whose every placed bin overlaps an interval of one of the class's options, so that the fetch read those alone. placements: (sample, class,
    contig, start); options: (class, contig, start, end)."""
    placed = placements.where("contig <> '*'")
    parts = options.select("class", "contig", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("bin_")).distinct()
    at = placed.join(options.select("class").distinct(), "class").withColumn("bin_", F.floor(F.col("start") / width)).join(parts.withColumn("in_", F.lit(1)), ["class", "contig", "bin_"], "left")
    got = at.groupBy("sample", "class").agg(F.count(F.lit(1)).alias("bins"), F.count("in_").alias("n_"))
    return got.where("bins = n_").drop("n_")


def unverified(counted: DataFrame, options: DataFrame, fetches: DataFrame, known: DataFrame, only: DataFrame) -> DataFrame:
    """(sample, class): classes with options, counted by a fetch (sample, sinks) whose sinks nobody knows (known: sinks), unless only names them."""
    odd = fetches.join(known.select("sinks").distinct(), "sinks", "left_anti").select("sample")
    return counted.join(odd, "sample", "left_semi").join(options.select("class"), "class", "left_semi").join(only, ["sample", "class"], "left_anti").select("sample", "class").distinct()


def other_build(contigs: DataFrame, expected: DataFrame) -> DataFrame:
    """(sample, contig, length, expected, contigs): samples whose header disagrees with the build, by their first such contig and how many there are."""
    at = contigs.join(expected.select("contig", F.col("length").alias("expected")), "contig").where("length <> expected")
    return at.groupBy("sample").agg(F.min_by(F.struct("contig", "length", "expected"), "contig").alias("f"), F.count(F.lit(1)).alias("contigs")).select("sample", "f.*", "contigs")


def mixed_signatures(counted: DataFrame, fields: list[str]) -> DataFrame:
    """(class, field, values): fields of a class that aren't the same in all samples."""
    at = counted.select("class", F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.col(f).cast("string") for f in fields)))).alias("field", "value")).where("value is not null")
    return at.groupBy("class", "field").agg(F.array_join(F.array_sort(F.collect_set("value")), " / ").alias("values"), F.count_distinct("value").alias("n_")).where("n_ > 1").drop("n_")


def clashing_panels(used: DataFrame) -> DataFrame:
    """(sample, other): pairs of panel sets (sample, hash) of which neither holds the other, each set by its first sample. There are few different sets."""
    sets = used.groupBy("sample").agg(F.array_sort(F.collect_set("hash")).alias("set")).groupBy("set").agg(F.min("sample").alias("sample"))
    a, b = sets, sets.toDF("other_set", "other")
    within = lambda x, y: F.size(F.array_except(x, y)) == 0
    at = a.join(F.broadcast(b), F.col("sample") < F.col("other"))
    return at.where(~within("set", "other_set") & ~within("other_set", "set")).select("sample", "other")


def with_covariates(samples: DataFrame, components: DataFrame) -> DataFrame:
    """Samples with their components (sample, ...); names of component files may carry .by1000. and what follows a last dot. Those without any keep nulls."""
    named = components.withColumn("sample", F.regexp_replace("sample", r"(\.by1000)?\.[^.]*$", ""))
    return samples.join(named, "sample", "left")


def missing_from_bed(counted: DataFrame, fetches: DataFrame, beds: DataFrame) -> DataFrame:
    """(sample, class): classes that a fetch counted though its intervals, where they are known, name other classes alone. counted: (sample, class); fetches: (sample, sinks); beds: (sinks, class), an empty class where a row
    names none. Intervals that name no class serve all."""
    named = beds.where("class is not null and class <> ''").select("sinks", "class").distinct()
    asked = fetches.join(named.select("sinks").distinct(), "sinks", "left_semi")
    return counted.select("sample", "class").distinct().join(asked, "sample").join(named, ["sinks", "class"], "left_anti").select("sample", "class")


def pipeline_check(fetches: DataFrame, learned: DataFrame) -> DataFrame:
    """(sample, status) of fetches (sample, programs, sq_sha256, sq_n), whether they come from the pipeline that the intervals were learned under, learned (aligner, sq_sha256, sq_n), one row: ok, or what differs, or null where nothing
    can be told. programs are the names of what wrote a header; the hashes of references are told apart only between headers of as many contigs."""
    at = fetches.crossJoin(F.broadcast(learned.toDF("want_", "hash_", "n_")))  # one row
    names = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("programs", F.array().cast("array<string>")), F.lower), lambda x: x != "")))
    told = (F.coalesce("want_", F.lit("")) != "") & (F.size(names) > 0)
    other = told & ~F.exists(names, lambda x: x.contains(F.lower("want_")))
    comparable = F.col("hash_").isNotNull() & F.col("sq_sha256").isNotNull() & (F.col("n_").isNull() | F.col("n_").eqNullSafe(F.col("sq_n")))
    away = comparable & (F.col("sq_sha256") != F.col("hash_"))
    what = F.concat_ws("; ", F.when(other, F.concat(F.lit("aligned by "), F.array_join(names, ", "), F.lit(", not "), "want_")), F.when(away, "other reference"))
    return at.select("sample", F.when(told | comparable, F.when(what == "", "ok").otherwise(what)).alias("status"))


def panel_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of panel files: of a file as stored, and of what it holds if it is packed, as that stays when it is packed anew. A panel has some megabytes."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, hashes = [], []
            for name, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for data in (raw, *([gzip.decompress(raw)] if raw[:2] == b"\x1f\x8b" else [])):
                    paths.append(name)
                    hashes.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(hashes, pa.string())], names=["path", "sha256"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpacked, "path string, sha256 string").distinct()


def panel_faults(rows: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(canon, class, pos, fault): rows that no panel may have, with the first of their faults: a k-mer of another length, one that isn't canonical, a class that isn't declared, a position outside its class (a
    compositional one has position 0 alone), a k-mer that comes twice. rows: (canon, class, pos, ...); classes: (class, kind, length), one row each; what is null is a fault."""
    told = classes.select(F.col("class").alias("class_"), F.col("kind").alias("kind_"), F.col("length").alias("length_"))
    at = rows.join(told, F.col("class") == F.col("class_"), "left")
    often = rows.groupBy("canon").agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1")
    at = at.join(often, "canon", "left")
    good = F.when(F.col("kind_") == "compositional", F.col("pos") == 0).otherwise((F.col("pos") >= 0) & (F.col("pos") < F.col("length_")))
    canonical = F.col("canon").rlike("^[ACGT]+$") & (F.col("canon") <= F.translate(F.reverse("canon"), "ACGT", "TGCA"))
    tests = {"length": F.length("canon") == k, "not canonical": canonical, "undeclared class": F.col("class_").isNotNull(), "outside": good, "twice": F.col("n_").isNull()}
    fault = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in tests.items()))
    return at.select("canon", "class", "pos", fault.alias("fault")).where("fault is not null")


def control_faults(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """(contig, start, end, role, fault): control regions on contigs that the alignments lack (absent), and regions of any role that begin before an earlier one of their contig ends (overlap); regions of other roles may be
    absent, and aren't compared there. regions: (contig, start, end, role); contigs: (contig)."""
    at = regions.join(contigs.select("contig").distinct().withColumn("there_", F.lit(True)), "contig", "left")
    order = Window.partitionBy("contig").orderBy("start", "end", "role").rowsBetween(Window.unboundedPreceding, -1)  # a contig's regions, some hundreds
    at = at.withColumn("reach_", F.max("end").over(order))
    fault = F.when(F.col("there_").isNull() & (F.col("role") == "control"), "absent").when(F.col("there_") & (F.col("start") < F.col("reach_")), "overlap")
    return at.select("contig", "start", "end", "role", fault.alias("fault")).where("fault is not null")


def refuse(faults: DataFrame, what: str) -> None:
    """An error that names the first of the faults, if there is one."""
    first = faults.orderBy(*faults.columns).first()
    if first is not None:
        raise ValueError(f"{what}: {first.fault}: " + ", ".join(f"{k} {v}" for k, v in first.asDict().items() if k != "fault"))
