"""What annotated assemblies hold of each class: sequence, gaps by the classes they touch, and stretches that gaps break.

Annotation is (sample, haplotype, contig, start, end, parts), as the reader of annotation gives it, parts the pieces of a record's label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copyloom.operators.intervals import reached
from copyloom.session import kept

# The class of each label, and of labels that begin so; the label of a catch-all, of a gap, and the span of a gap of unknown size.
CLASS_OF = {
    "HSat1A": "HSat1A", "HSat1B": "HSat1B", "HSat2": "HSat2", "HSat3": "HSat3", "bSat": "bSat", "hor": "aSatHOR", "active": "aSatHOR", "ACRO1": "ACRO", "SST1": "SST1", "CER": "CER", "SATR1": "SATR", "SATR2": "SATR",
}
PREFIXES = {"ACRO": "ACRO", "SST1": "SST1", "SATR": "SATR"}
ANY, GAP, UNSIZED = "cenSat", "GAP", 100
#: Bases between records of one stretch at most, and of a range whose records are put in order at once.
NEAR, BIN = 1000, 1 << 20


def labels(parts: Column) -> Column:
    """The labels of a record's parts: what stands before ( or _, and within a catch-all the family named first."""
    head = lambda x: F.regexp_extract(x, r"^([^(_]*)", 1)
    return F.transform(parts, lambda x: F.when((head(x) == ANY) & x.contains("("), F.regexp_extract(x, r"\(([^,)]*)", 1)).otherwise(head(x)))


def class_of(names: Column) -> Column:
    """The class of the first label that has one, or null."""

    def one(x: Column) -> Column:
        told = F.element_at(F.create_map(*(F.lit(v) for kv in CLASS_OF.items() for v in kv)), x)
        return F.coalesce(told, *(F.when(F.startswith(x, F.lit(p)), F.lit(c)) for p, c in PREFIXES.items()))

    return F.try_element_at(F.filter(F.transform(names, one), lambda c: c.isNotNull()), F.lit(1))


def mass(annotation: DataFrame) -> DataFrame:
    """(sample, class, mass, gapped, unsized): bases of records of a class; bases of gaps, those named with the class whole, and those that stand alone shared among the classes of the records that they touch;
    and how many of the latter are of unknown size."""
    at = annotation.select("sample", "haplotype", "contig", "start", "end", labels(F.col("parts")).alias("labels")).withColumn("class", class_of(F.col("labels")))
    at = kept(at.withColumn("alone", F.expr(f"size(labels) = 1 and labels[0] = '{GAP}'")).withColumn("gap", F.array_contains("labels", GAP)), "annotation")
    on = ["sample", "haplotype", "contig"]
    size = F.col("end") - F.col("start")
    own = at.where("class is not null").groupBy("sample", "class").agg(F.sum(F.when(~F.col("gap"), size).otherwise(0)).alias("mass"), F.sum(F.when(F.col("gap"), size).otherwise(0)).cast("double").alias("gapped"), F.lit(0).cast("long").alias("unsized"))
    # A gap's ends are moved out by one base, so that what touches it overlaps it.
    gaps = at.where("alone").select(*on, F.monotonically_increasing_id().alias("gap_"), size.alias("size_"), (F.col("start") - 1).alias("start"), (F.col("end") + 1).alias("end"))
    named = at.where("class is not null and not alone").select(*on, "class", "start", "end")
    # A row for each gap and each class of its contig, which is asked whether one of its records reaches the gap.
    asked = kept(gaps, "gaps").join(named.select(*on, "class").distinct(), on)
    near = reached(asked, named, [*on, "class"], "reach_", BIN).where("reach_ > start").select("sample", "gap_", "size_", "class")
    share = near.withColumn("n_", F.count(F.lit(1)).over(Window.partitionBy("gap_")))  # classes of one gap
    shared = share.groupBy("sample", "class").agg(F.lit(0).cast("long").alias("mass"), F.sum(F.col("size_") / F.col("n_")).alias("gapped"), F.count_if(F.col("size_") == UNSIZED).alias("unsized"))
    return own.unionByName(shared).groupBy("sample", "class").agg(F.sum("mass").alias("mass"), F.sum("gapped").alias("gapped"), F.sum("unsized").alias("unsized"))


def stretches(annotation: DataFrame, label: str = "rDNA", near: int = NEAR) -> DataFrame:
    """(sample, haplotype, contig, start, end, bases) of the stretches of records with a label that lie less than `near` apart, in order of their starts; a record with a gap isn't sequence and ends a stretch, however close the
    next one is. bases are those of the records themselves."""
    at = annotation.select("sample", "haplotype", "contig", "start", "end", labels(F.col("parts")).alias("l")).withColumn("gap", F.array_contains("l", GAP)).where(F.col("gap") | F.array_contains("l", label))
    order = Window.partitionBy("sample", "haplotype", "contig").orderBy("start", "end", "gap")  # a contig's records of one label and its gaps
    at = at.withColumn("part", F.count_if("gap").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("not gap")
    inside = Window.partitionBy("sample", "haplotype", "contig", "part").orderBy("start", "end")
    at = at.withColumn("reach", F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.col("reach").isNull() | (F.col("start") - F.col("reach") >= near)
    at = at.withColumn("new", new).withColumn("run", F.count_if("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    fresh = F.when(F.col("new"), F.col("end") - F.col("start")).otherwise(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reach")))
    return at.groupBy("sample", "haplotype", "contig", "part", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum(fresh).alias("bases")).drop("part", "run")


def longest(found: DataFrame) -> DataFrame:
    """(sample, total, longest, haplotypes) of stretches."""
    return found.groupBy("sample").agg(F.sum("bases").alias("total"), F.max(F.col("end") - F.col("start")).alias("longest"), F.count_distinct("haplotype").alias("haplotypes"))
