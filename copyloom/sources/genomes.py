"""Sequences in chunks: FASTA read line by line, whatever the length of a chromosome, and pieces of it fetched by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copyloom.session import kept

#: Bases of a chunk, and bytes of a file whose lines are put in order together.
CHUNK, PART = 1 << 16, 1 << 20
_TEXT, _OFFSET, _VALUE = "org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text"


def _before(df: DataFrame, keys: list[str], part: str, order: str, size: str, name: str) -> DataFrame:
    """Adds the sum of `size` over the rows of the keys before each: sums of parts first, so that no window holds more than a part's rows."""
    sums = df.groupBy(*keys, part).agg(F.sum(size).alias("sum_"))
    upto = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, part, F.coalesce(F.sum("sum_").over(upto), F.lit(0)).alias("base_"))
    inside = Window.partitionBy(*keys, part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(sums, [*keys, part]).withColumn(name, F.col("base_") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("base_")


def read_chunks(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(contig, length, chunk, bases) of a FASTA file: upper-case bases [chunk * size, (chunk + 1) * size) of each contig, whose name ends at the first space.

    Lines may have any lengths, and may end in CR LF. Anything but IUPAC letters, bases before the first name, and a name that comes twice are refused. A contig without bases has no chunks. Lines come with their
    places in the file, so that they are read in parts; a compressed file is one part."""
    rows = spark.sparkContext.newAPIHadoopFile(path, _TEXT, _OFFSET, _VALUE)
    lines = kept(spark.createDataFrame(rows, "at long, line string").select("at", F.regexp_replace("line", r"\s+$", "").alias("line")).where("line <> ''"), "lines")
    names = lines.where("startswith(line, '>')").select(F.col("at").alias("from_"), F.regexp_extract("line", r"^>\s*(\S*)", 1).alias("contig"))
    names = kept(names.withColumn("to_", F.coalesce(F.lead("from_").over(Window.orderBy("from_")), F.lit(2**62))), "names")  # a row for each contig
    twice = names.groupBy("contig").count().where(F.col("count") > 1).first()
    if twice is not None:
        raise ValueError(f"{twice[0]} comes twice")
    bases = lines.where("not startswith(line, '>')").withColumn("part_", F.floor(F.col("at") / PART))
    spans = names.withColumn("part_", F.explode(F.sequence(F.floor(F.col("from_") / PART), F.least(F.floor(F.col("to_") / PART), F.lit(lines.agg(F.max("at")).first()[0] or 0) / PART).cast("long"))))
    at = bases.join(spans, "part_", "left").where("contig is null or (from_ < at and at < to_)")
    found = bases.join(names.agg(F.min("from_").alias("first_")).hint("broadcast"), F.col("at") < F.coalesce("first_", F.lit(2**62)))  # one row
    if not found.isEmpty():
        raise ValueError("bases before the first name")
    seq = F.upper(F.regexp_replace("line", r"\s", ""))
    at = at.select("contig", "part_", "at", F.when(seq.rlike("^[ACGTUNRYSWKMBDHV]*$"), seq).otherwise(F.raise_error(F.concat(F.lit("not a sequence: "), "line"))).alias("seq")).withColumn("size_", F.length("seq"))
    at = kept(_before(at, ["contig"], "part_", "at", "size_", "pos"), "placed-lines")
    pieces = at.where("size_ > 0").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("pos") / chunk), F.floor((F.col("pos") + F.col("size_") - 1) / chunk))))
    lo = F.greatest(F.col("pos"), F.col("chunk") * chunk)
    hi = F.least(F.col("pos") + F.col("size_"), (F.col("chunk") + 1) * chunk)
    pieces = pieces.select("contig", "chunk", lo.alias("at"), F.substring(F.col("seq"), (lo - F.col("pos") + 1).cast("int"), (hi - lo).cast("int")).alias("seq"))
    whole = pieces.groupBy("contig", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "seq"))), lambda x: x["seq"]), "").alias("bases"))
    length = at.groupBy("contig").agg(F.sum("size_").alias("length"))
    return whole.join(F.broadcast(length), "contig").select("contig", "length", "chunk", "bases")  # a row for each contig


def fetched(chunks: DataFrame, regions: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """regions (contig, start, end, ...) with seq: the bases of [start, end), cut at the contig's ends; empty for regions without any, null for contigs that aren't there. A region meets each of its chunks in a join, and its
    pieces are put together."""
    keyed = regions.withColumn("row_", F.monotonically_increasing_id())
    keyed = kept(keyed, "regions")
    length = chunks.groupBy("contig").agg(F.max("length").alias("length_"))
    at = keyed.join(F.broadcast(length), "contig").withColumn("s_", F.greatest(F.lit(0), F.col("start"))).withColumn("e_", F.least("end", "length_"))
    parts = at.where("s_ < e_").select("row_", "contig", "s_", "e_", F.explode(F.sequence(F.floor(F.col("s_") / chunk), F.floor((F.col("e_") - 1) / chunk))).alias("chunk"))
    lo = F.greatest(F.col("s_") - F.col("chunk") * chunk, F.lit(0))
    hi = F.least(F.col("e_") - F.col("chunk") * chunk, F.lit(chunk))
    met = parts.join(chunks.select("contig", "chunk", "bases"), ["contig", "chunk"]).select("row_", "chunk", F.substring(F.col("bases"), (lo + 1).cast("int"), (hi - lo).cast("int")).alias("piece_"))
    seq = met.groupBy("row_").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "piece_"))), lambda x: x["piece_"]), "").alias("seq"))
    there = at.select("row_", F.lit("").alias("none_"))
    return keyed.join(seq, "row_", "left").join(there, "row_", "left").withColumn("seq", F.coalesce("seq", "none_")).drop("row_", "none_")


def tiled(chunks: DataFrame, ahead: int, chunk: int = CHUNK) -> DataFrame:
    """(contig, off, seq): each chunk with the first `ahead` bases of the next, so that windows of ahead + 1 bases that begin in a chunk are whole; off is where it begins."""
    head = chunks.select("contig", (F.col("chunk") - 1).alias("chunk"), F.substring("bases", 1, ahead).alias("next_"))
    return chunks.join(head, ["contig", "chunk"], "left").select("contig", (F.col("chunk") * chunk).alias("off"), F.concat("bases", F.coalesce("next_", F.lit(""))).alias("seq"))
