"""Loci of a class in genomes, from alignments of its unit; its core k-mers, by how often each genome holds them; and where its copies differ from the unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom.functions import sequences as S
from copyloom.operators.intervals import merge, points_in
from copyloom.session import kept

#: Bases and identity of an alignment that counts, bases added on either side, and bases of a bin in which points meet loci.
LEAST, IDENTITY, PAD, BIN = 500, 0.90, 2000, 1 << 16
#: The marks of a difference string: matches by length or letters, a changed base, letters of the unit alone, letters of the genome alone.
_OPS = r"(:[0-9]+|=[A-Za-z]+|\*[a-zA-Z][a-zA-Z]|\+[a-zA-Z]+|-[a-zA-Z]+)"


def pieces(units: DataFrame, size: int, step: int) -> DataFrame:
    """(class, start, seq): whole pieces of `size` bases of units (class, seq), one each `step` bases; none of units that are shorter."""
    at = units.where(F.length("seq") >= size).select("class", "seq", F.explode(F.expr(f"sequence(0, length(seq) - {size}, {step})")).alias("start"))
    return at.select("class", F.col("start").cast("long").alias("start"), F.expr(f"substring(seq, start + 1, {size})").alias("seq"))


def class_loci(hits: DataFrame, keys: list[str], least: int = LEAST, identity: float = IDENTITY, pad: int = PAD) -> DataFrame:
    """(keys, contig, start, end, members): where pieces of a class align with at least `least` of their bases and `identity` of the alignment's columns, with `pad` bases on either side within the contig; those that
    overlap or touch are one. hits: (keys, contig, length, start, end, from, to, matches, columns), from and to being the piece's aligned bases."""
    good = hits.where((F.col("to") - F.col("from") >= least) & (F.col("columns") > 0) & (F.col("matches") >= identity * F.col("columns")))
    wide = good.select(*keys, "contig", F.greatest(F.lit(0), F.col("start") - pad).alias("start"), F.least("length", F.col("end") + pad).alias("end"))
    return merge(wide, [*keys, "contig"])


def counted(genomes: DataFrame, units: DataFrame, k: int, loci: DataFrame | None = None) -> DataFrame:
    """(genome, code, inside, outside): how often a genome holds a k-mer of the units, beginning in loci (genome, contig, start, end, merged) and beyond them; all are outside without loci.

    genomes: (genome, contig, off, seq), stretches that share k - 1 bases with the next; units: (code). Only k-mers of the units leave the tasks that roll a genome's."""
    at = S.packed_kmers(genomes.withColumnRenamed("off", "base_"), "seq", k, units.select("code")).select("genome", "contig", (F.col("base_") + F.col("off")).alias("pos"), "code")
    if loci is None:
        return at.groupBy("genome", "code").agg(F.lit(0).cast("long").alias("inside"), F.count(F.lit(1)).alias("outside"))
    at = kept(at, "unit-kmers")
    held = points_in(at, loci.select("genome", "contig", "start", "end"), ["genome", "contig"], BIN).groupBy("genome", "code").agg(F.count(F.lit(1)).alias("inside"))
    every = at.groupBy("genome", "code").agg(F.count(F.lit(1)).alias("n_"))
    inside = F.coalesce("inside", F.lit(0).cast("long"))
    return every.join(held, ["genome", "code"], "left").select("genome", "code", inside.alias("inside"), (F.col("n_") - inside).alias("outside"))


def core(units: DataFrame, counts: DataFrame, genomes: int, times: int = 1, each: bool = True) -> DataFrame:
    """(class, pos, code, even): k-mers that a unit holds once, no other unit holds, no genome holds outside the class's loci, and all `genomes` hold `times` each within them. With each false it is their sum alone that must be
    times * genomes; even tells whether each has its share. units: (class, off, code); counts as counted() gives them."""
    once = units.groupBy("code").agg(F.count(F.lit(1)).alias("n_"), F.first("class").alias("class"), F.first("off").alias("pos")).where("n_ = 1")
    met = counts.groupBy("code").agg(F.sum("inside").alias("inside_"), F.sum("outside").alias("outside_"), F.count_if(F.col("inside") == times).alias("whole_"))
    even = F.col("whole_") == genomes
    good = even & (F.col("inside_") == times * genomes) if each else F.col("inside_") == times * genomes
    return once.join(met.where((F.col("outside_") == 0) & good), "code").select("class", F.col("pos").cast("long").alias("pos"), "code", even.alias("even"))


def core_intervals(found: DataFrame) -> DataFrame:
    """(class, start, end, members): stretches of a unit at which core k-mers begin, base after base."""
    return merge(found.select("class", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end")), ["class"])


def _turned(bases: Column, back: Column) -> Column:
    return F.upper(F.when(back, S.reverse_complement(bases)).otherwise(bases))


def difference_sites(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, contig, kind, pos, place, unit, genome): where an aligned genome differs from the unit: sub, ins (bases of the unit alone) and del (of the genome alone), at the unit's base pos (of a del, the one that
    follows) and the genome's base place; bases are those of the unit's strand.

    hits: (keys, contig, start, end, from, to, back, cs): what is aligned of the genome and of the unit, whether against its strand, and the differences as a cs string, short or long. Strings that
    don't add up to the bases aligned, or that hold anything else, are refused. An alignment's differences are put in order together."""
    def of_unit(x: Column) -> Column:
        return F.when(x.startswith(":"), F.substring(x, 2, 20).cast("long")).when(x.startswith("*"), 1).when(x.startswith("-"), 0).otherwise(F.length(x) - 1).cast("long")

    def of_genome(x: Column) -> Column:
        return F.when(x.startswith("+"), F.lit(0).cast("long")).when(x.startswith("-"), (F.length(x) - 1).cast("long")).otherwise(of_unit(x))

    ops = F.regexp_extract_all("cs", F.lit(_OPS), F.lit(1))
    at = hits.select(*keys, "contig", "start", "end", "from", "to", "back", "cs", ops.alias("ops_")).withColumn("hit_", F.monotonically_increasing_id())
    unit_bases = F.aggregate("ops_", F.lit(0).cast("long"), lambda n, x: n + of_unit(x))
    genome_bases = F.aggregate("ops_", F.lit(0).cast("long"), lambda n, x: n + of_genome(x))
    right = (F.array_join("ops_", "") == F.col("cs")) & (unit_bases == F.col("to") - F.col("from")) & (genome_bases == F.col("end") - F.col("start"))
    at = at.where(F.when(F.coalesce(right, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("not the differences of an alignment: "), F.coalesce("cs", F.lit("null"))))))
    at = kept(at.drop("cs"), "alignments")  # so that each has one number
    one = at.select("hit_", F.posexplode("ops_").alias("k_", "op_"))
    order = "PARTITION BY hit_ ORDER BY k_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"  # the marks of one alignment
    one = one.withColumn("u_", of_unit(F.col("op_"))).withColumn("g_", of_genome(F.col("op_")))
    one = one.withColumn("u0_", F.coalesce(F.expr(f"sum(u_) OVER ({order})"), F.lit(0))).withColumn("g0_", F.coalesce(F.expr(f"sum(g_) OVER ({order})"), F.lit(0)))
    got = one.where("op_ rlike '^[*+-]'").join(at.drop("ops_"), "hit_")
    op, back = F.col("op_"), F.col("back")
    kind = F.when(op.startswith("*"), "sub").when(op.startswith("+"), "ins").otherwise("del")
    pos = F.when(back, F.col("to") - F.col("u0_") - F.col("u_")).otherwise(F.col("from") + F.col("u0_"))
    unit = F.when(kind == "sub", F.substring(op, 3, 1)).when(kind == "ins", F.expr("substring(op_, 2)")).otherwise("")
    genome = F.when(kind == "sub", F.substring(op, 2, 1)).when(kind == "del", F.expr("substring(op_, 2)")).otherwise("")
    return got.select(*keys, "contig", kind.alias("kind"), pos.alias("pos"), (F.col("start") + F.col("g0_")).alias("place"), _turned(unit, back).alias("unit"), _turned(genome, back).alias("genome"))


def differing(hits: DataFrame, sites: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """(keys, pos, differing, covering, share): bases of the unit that are changed in some alignment, in how many, and how many alignments cover them."""
    subs = sites.where("kind = 'sub'").groupBy(*keys, "pos").agg(F.count(F.lit(1)).alias("differing"))
    spans = hits.groupBy(*keys, F.col("from").alias("start"), F.col("to").alias("end")).agg(F.count(F.lit(1)).alias("n_"))
    met = points_in(subs, spans, keys, width).groupBy(*keys, "pos", "differing").agg(F.sum("n_").alias("covering"))
    return met.withColumn("share", F.col("differing") / F.col("covering"))
