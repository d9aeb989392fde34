"""Text tables of the field: BED, FASTA, SAM, panels, counts JSON, class manifests, pedigrees."""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copyloom.operators.contracts import control_faults, panel_faults, refuse

BED = "contig string, start long, end long, name string"
READS = "name string, flags int, contig string, pos long, mapq int, cigar string, tlen int, seq string"
COUNTS = "format string, sample string, mode string, records long, `primary` long, insert_median long, read_length_mode long, gc_tables array<struct<l:long,n:array<long>,o:array<long>>>, classes array<struct<name:string,kind:string,bin:long,fwd:array<long>,rev:array<long>,reads:long,dup_flagged:long>>, placements array<struct<class:string,contig:string,start:long,reads:long>>"
#: What the format key of counts documents ends with.
COUNTS_FORMAT = "-counts/[0-9]+$"
ROLES = ("control", "test", "dosage")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumn("value", F.regexp_replace("value", "\r$", ""))


def _checked(df: DataFrame, good, why: str) -> DataFrame:
    """Rows as they are; the first that isn't good ends the job."""
    return df.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit(f"{why}: "), F.coalesce(F.to_json(F.struct(*df.columns)), F.lit("null"))))))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED rows; empty lines, comments and track lines are skipped, and rows that end before they begin are refused."""
    at = _lines(spark, path).where("value <> '' and not startswith(value, '#') and not startswith(value, 'track')")
    c = F.split("value", "\t")
    at = at.select(F.get(c, F.lit(0)).alias("contig"), F.get(c, F.lit(1)).try_cast("long").alias("start"), F.get(c, F.lit(2)).try_cast("long").alias("end"), F.get(c, F.lit(3)).alias("name"))
    return _checked(at, F.col("start").isNotNull() & (F.col("start") >= 0) & (F.col("end") > F.col("start")), "not a BED interval")


def write_bed(df: DataFrame, path: str) -> None:
    df.orderBy("contig", "start", "end").select(F.concat_ws("\t", "contig", "start", "end", "name").alias("value")).write.text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, seq), upper case; anything that isn't an IUPAC letter is refused. Gzip is known by the file's ending."""
    at = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", ""))
    at = at.select(F.regexp_extract(head, r"^(\S+)", 1).alias("name"), F.trim(F.regexp_replace(head, r"^\S+", "")).alias("description"), seq.alias("seq"))
    return _checked(at, F.col("seq").rlike("^[ACGTUNRYSWKMBDHV]*$"), "not a sequence")


def write_fasta(df: DataFrame, path: str) -> None:
    """(name, description, seq) with lines of 80 bases."""
    lines = F.regexp_replace(F.upper("seq"), "(.{80})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), F.concat_ws(" ", "name", F.nullif("description", F.lit(""))), F.lit("\n"), lines).alias("value")).write.text(path)


def read_controls(spark: SparkSession, path: str) -> DataFrame:
    """Control regions from FASTA names contig:start-end and descriptions flank=, role=, label=."""
    f = read_fasta(spark, path)
    part = lambda p, k: F.regexp_extract("name", r"^(.*):(\d+)-(\d+)$", k) if p == "name" else F.regexp_extract("description", rf"(?:^|\s){p}=(\S+)", 1)
    at = f.select(
        part("name", 1).alias("contig"), part("name", 2).try_cast("long").alias("start"), part("name", 3).try_cast("long").alias("end"),
        F.coalesce(part("flank", 1).try_cast("long"), F.lit(0).cast("long")).alias("flank"), F.coalesce(F.nullif(part("role", 1), F.lit("")), F.lit("control")).alias("role"), F.nullif(part("label", 1), F.lit("")).alias("label"), "seq",
    )
    return _checked(at, F.col("role").isin(*ROLES) & (F.length("seq") == F.col("end") - F.col("start") + 2 * F.col("flank")), "not a control region")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment records of SAM text; positions are 0-based and contig is null for reads without a place."""
    c = F.split("value", "\t")
    at = _lines(spark, path).where("value <> '' and not startswith(value, '@')")
    g = lambda k: F.get(c, F.lit(k))
    return at.select(g(0).alias("name"), g(1).cast("int").alias("flags"), F.nullif(g(2), F.lit("*")).alias("contig"), (g(3).cast("long") - 1).alias("pos"), g(4).cast("int").alias("mapq"), g(5).alias("cigar"), g(8).cast("int").alias("tlen"), F.nullif(g(9), F.lit("*")).alias("seq"))


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """(canon, class, pos, fwd) from rows kmer, class, position, strand; header lines start with ##. K-mers must be canonical."""
    c = F.split("value", "\t")
    at = _lines(spark, path).where("value <> '' and not startswith(value, '##')").select(F.get(c, F.lit(0)).alias("canon"), F.get(c, F.lit(1)).alias("class"), F.get(c, F.lit(2)).try_cast("int").alias("pos"), (F.get(c, F.lit(3)) == "+").alias("fwd"))
    return _checked(at, F.col("canon").rlike("^[ACGT]+$") & (F.col("canon") <= F.translate(F.reverse("canon"), "ACGT", "TGCA")), "not a canonical k-mer")


def write_panel(panel: DataFrame, k: int, path: str) -> None:
    """Sorted by class, position and k-mer, after a header row."""
    rows = panel.select("class", "pos", F.concat_ws("\t", "canon", "class", "pos", F.when(F.col("fwd"), "+").otherwise("-")).alias("value"))
    head = panel.sparkSession.createDataFrame([("", -1, f"##k={k}")], "class string, pos int, value string")
    head.unionByName(rows.select(F.col("class").cast("string"), F.col("pos").cast("int"), "value")).orderBy("class", "pos", "value").select("value").write.text(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts documents, one per file, plain or gzip by their first bytes; keys that are missing are null. error holds why a document is of no use."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for raw in batch.column(1).to_pylist():
                try:
                    texts.append((gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode())
                except (OSError, EOFError, UnicodeDecodeError, zlib.error):
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["path", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")  # a document has a few hundred kB
    at = files.mapInArrow(opened, "path string, value string").select("path", F.from_json("value", COUNTS).alias("c"))
    wrong = F.when(F.col("c.format").isNull(), "not a counts document").when(~F.col("c.format").rlike(COUNTS_FORMAT), "another format")
    return at.select("path", "c.*", wrong.alias("error"))


#: Names of columns in headers, in lower case without marks; and what stands for a missing parent or label.
_CHILD, _FATHER, _MOTHER = ("child", "kid", "sampleid", "sample", "iid", "individualid", "id"), ("father", "fatherid", "dad", "pat", "paternalid"), ("mother", "motherid", "mom", "mat", "maternalid")
_GROUP = ("population", "pop", "group", "cluster", "ancestry", "superpop", "superpopulation")
_NO_PARENT, _NO_LABEL = ("0", "-9", "NA", "."), ("NA", ".", "-9", "")


def _norm(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def _place(head: list[str], names: tuple[str, ...]) -> int | None:
    low = [_norm(x) for x in head]
    return next((low.index(n) for n in names if n in low), None)


def _table(spark: SparkSession, path: str) -> tuple[list[str] | None, DataFrame]:
    """The words of the first line if they name a child or sample, and the rows below as arrays c of words; further lines that start with # are comments."""
    lines = _lines(spark, path).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("c"), "value")
    first = lines.first()
    head = first.value.lstrip("#").split() if first else []
    named = _place(head, _CHILD) is not None
    body = lines.where(~F.startswith("value", F.lit("#"))).select("c")
    return (head if named else None), body.where(F.concat_ws(" ", "c") != " ".join(first.value.split())) if named else body


def read_pedigree(spark: SparkSession, path: str) -> DataFrame:
    """(child, father, mother, population) of complete trios from a table of white-space columns, with a header or without: then child father mother where the commonest
    number of columns is three, with a population where it is four, and family child father mother where it is more. Parents 0, -9, NA and . are absent; rows too short
    for the layout are left out."""
    head, body = _table(spark, path)
    group = None
    if head:
        at = [_place(head, names) for names in (_CHILD, _FATHER, _MOTHER)]
        if None in at:
            raise ValueError(f"{path}: the header names a child but no father or mother")
        group = _place(head, _GROUP)
    else:
        common = body.groupBy(F.size("c").alias("n")).count().orderBy(F.desc("count"), "n").first()
        wide = common.n if common else 3
        at, group = ([0, 1, 2], 3 if wide == 4 else None) if wide <= 4 else ([1, 2, 3], None)
    g = lambda k: F.get("c", F.lit(k))
    label = F.lit(None).cast("string") if group is None else F.when(~g(group).isin(*_NO_LABEL), g(group))
    rows = body.where(F.size("c") > max(at)).select(g(at[0]).alias("child"), g(at[1]).alias("father"), g(at[2]).alias("mother"), label.alias("population"))
    return rows.where(~F.col("father").isin(*_NO_PARENT) & ~F.col("mother").isin(*_NO_PARENT))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(sample, population) from a table that names both in a header, or has them as its first two columns; labels NA, . and -9 are missing."""
    head, body = _table(spark, path)
    at = (_place(head, _CHILD), _place(head, _GROUP)) if head else (0, 1)
    if None in at:
        raise ValueError(f"{path}: the header names samples but no population")
    got = body.select(F.get("c", F.lit(at[0])).alias("sample"), F.get("c", F.lit(at[1])).alias("population"))
    return got.where(F.col("population").isNotNull() & ~F.col("population").isin(*_NO_LABEL))


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with a column sample and numbers; .by1000. and what follows a last dot is cut from the names."""
    at = spark.read.csv(path, sep="\t", header=True, inferSchema=True)
    first = at.columns[0]
    return at.select(F.regexp_replace(F.col(f"`{first}`").cast("string"), r"(\.by1000)?\.[^.]*$", "").alias("sample"), *(F.col(f"`{c}`") for c in at.columns[1:]))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, fasta, circular, min_count, keep) of a manifest of at most 255 classes: tab-separated name, kind, fasta, circular, and where needed min_count
    (compositional classes) and keep, a BED of unit intervals (positional classes). Anything else is refused, and so are names that repeat."""
    c = F.transform(F.split("value", "\t"), lambda x: F.trim(x))
    at = _lines(spark, path).where("trim(value) <> '' and not startswith(value, '#')").select(c.alias("c"))
    g = lambda k: F.coalesce(F.get("c", F.lit(k)), F.lit(""))
    unset = lambda k: g(k).isin("", ".")
    circular = F.when(F.lower(g(3)).isin("1", "true"), True).when(F.lower(g(3)).isin("0", "false"), False)
    count = F.when(unset(4), 1).otherwise(g(4).try_cast("int"))
    rows = at.select(F.size("c").alias("n_"), F.size(F.filter(F.slice("c", 7, 1000), lambda x: x != "")).alias("more_"), g(0).alias("name"), g(1).alias("kind"), g(2).alias("fasta"), circular.alias("circular"), count.alias("min_count"), F.when(~unset(5), g(5)).alias("keep"))
    rows = _checked(rows, (F.col("n_") >= 4) & (F.col("more_") == 0) & (F.col("name") != "") & (F.col("fasta") != "") & F.col("kind").isin("positional", "compositional"), "not a class")
    rows = _checked(rows, F.col("circular").isNotNull() & F.coalesce(F.col("min_count") >= 1, F.lit(False)), "circular is 0, 1, true or false, and min_count a number of 1 or more")
    rows = _checked(rows, F.when(F.col("kind") == "positional", F.col("min_count") == 1).otherwise(F.col("keep").isNull()), "min_count is for compositional classes, keep for positional ones")
    rows = _checked(rows.withColumn("same_", F.count(F.lit(1)).over(Window.partitionBy("name"))), F.col("same_") == 1, "a class is defined twice").drop("n_", "more_", "same_")
    n = rows.limit(256).count()
    if not 1 <= n <= 255:
        raise ValueError(f"{path}: a manifest has 1 to 255 classes")
    return rows


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(contig, length) from an index of a FASTA file, the @SQ lines of a header, or names (length null); a mixture is refused."""
    at = _lines(spark, path).where("trim(value) <> '' and (not startswith(value, '@') or startswith(value, '@SQ\t'))")
    c = F.split("value", "\t")
    sq, fai = F.startswith("value", F.lit("@SQ")), F.coalesce(F.get(c, F.lit(1)).rlike("^[0-9]+$"), F.lit(False))
    kind = F.when(sq, "sq").when(fai, "fai").otherwise("name")
    name = F.when(sq, F.regexp_extract("value", r"\tSN:([^\t]+)", 1)).when(fai, F.get(c, F.lit(0))).otherwise(F.regexp_extract("value", r"^(\S+)", 1))
    length = F.when(sq, F.nullif(F.regexp_extract("value", r"\tLN:([0-9]+)(?:\t|$)", 1), F.lit(""))).when(fai, F.get(c, F.lit(1))).cast("long")
    got = _checked(at.select(name.alias("contig"), length.alias("length"), kind.alias("kind")), F.col("contig") != "", "a sequence without a name")
    kinds = [r.kind for r in got.select("kind").distinct().collect()]
    if len(kinds) != 1:
        raise ValueError(f"{path}: not a FASTA index, a header or a list of names")
    return got.drop("kind")


def read_slices(spark: SparkSession, path: str) -> DataFrame:
    """(ref, start, span, container, offset, size) of a CRAM index, gzip by its name's ending: six whole numbers a line."""
    c = F.split("value", "\t")
    names = ("ref", "start", "span", "container", "offset", "size")
    at = _lines(spark, path).where("trim(value) <> ''").select(F.size(c).alias("n_"), *(F.get(c, F.lit(k)).try_cast("long").alias(n) for k, n in enumerate(names)))
    good = F.col("n_") == 6
    for n in names:
        good = good & F.col(n).isNotNull()
    return _checked(at, good, "not a line of six numbers").drop("n_")


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """(sample, haplotype, contig, start, end, label, parts) of assembly annotation, one BED a haplotype named <sample>_hap1_... or _hap2_...; parts are the label's pieces between commas
    outside parentheses."""
    c = F.split("value", "\t")
    file = F.element_at(F.split(F.input_file_name(), "/"), -1)
    at = _lines(spark, path).where("trim(value) <> '' and not startswith(value, '#') and not startswith(value, 'track')").select(
        F.regexp_extract(file, r"^(.+?)_hap[12]", 1).alias("sample"), F.regexp_extract(file, r"_hap([12])", 1).try_cast("int").alias("haplotype"), F.get(c, F.lit(0)).alias("contig"),
        F.get(c, F.lit(1)).try_cast("long").alias("start"), F.get(c, F.lit(2)).try_cast("long").alias("end"), F.get(c, F.lit(3)).alias("label"),
    )
    at = _checked(at, F.col("start").isNotNull() & (F.col("end") > F.col("start")) & F.col("label").isNotNull(), "not an annotation")
    return at.withColumn("parts", F.transform(F.regexp_extract_all("label", F.lit(r"((?:[^,(]|\([^)]*\))+)"), 1), lambda x: F.trim(x)))


def read_panel_classes(spark: SparkSession, path: str) -> DataFrame:
    """(k, id, name, kind, length, circular, kmers_input, kmers_kept) of a panel's header lines; k is that of all classes."""
    at = _lines(spark, path)
    head = at.where("startswith(value, '##class\t')").select(F.str_to_map(F.expr("substring(value, 9)"), F.lit("\t"), F.lit("=")).alias("m"))
    k = at.where("startswith(value, '##k=')").select(F.regexp_extract("value", r"^##k=(\d+)", 1).cast("int").alias("k")).first()
    if k is None or not 1 <= k.k <= 31:
        raise ValueError(f"{path}: no k of 1 to 31 in the header")
    m = lambda x, t: F.col("m")[x].cast(t).alias(x)
    return head.select(F.lit(k.k).alias("k"), m("id", "int"), m("name", "string"), m("kind", "string"), m("length", "long"), (F.col("m")["circular"] == "1").alias("circular"), m("kmers_input", "long"), m("kmers_kept", "long"))


def open_panel(spark: SparkSession, path: str) -> DataFrame:
    """read_panel()'s rows with name and kind, after the checks of contracts.panel_faults() against the file's own classes; ids of classes must be 0, 1, 2... and names differ, and there must be rows."""
    classes = read_panel_classes(spark, path)
    ids = classes.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.count_distinct("id").alias("ids"), F.count_distinct(F.nullif("name", F.lit(""))).alias("names"), F.max("k").alias("k")).first()
    if not ids.n or (ids.low, ids.high, ids.ids, ids.names) != (0, ids.n - 1, ids.n, ids.n):
        raise ValueError(f"{path}: classes are not numbered from 0 or not named apart")
    rows = read_panel(spark, path).withColumn("class", F.col("class").try_cast("int"))
    refuse(panel_faults(rows, classes.select(F.col("id").alias("class"), "kind", "length"), ids.k), path)
    if rows.isEmpty():
        raise ValueError(f"{path}: no k-mers")
    return rows.join(F.broadcast(classes.select(F.col("id").alias("class"), "name", "kind")), "class").select("canon", "class", "pos", "fwd", "name", "kind")  # at most some hundred classes


def open_controls(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """read_controls()'s regions with absent, after the checks of contracts.control_faults() against the contigs (contig) of the alignments; one of them at least must be a control."""
    regions = read_controls(spark, path)
    if regions.where("role = 'control'").isEmpty():
        raise ValueError(f"{path}: no region with role=control")
    refuse(control_faults(regions, contigs), path)
    there = contigs.select("contig").distinct().withColumn("there_", F.lit(True))
    return regions.join(there, "contig", "left").withColumn("absent", F.col("there_").isNull()).drop("there_")


def write_report(candidates: DataFrame, path: str) -> None:
    """Every candidate k-mer of a panel in order: class, position, count in its class, shared, background. candidates as operators.panel gives them."""
    rows = candidates.where(~F.col("outside")).select("class", F.col("at.off").alias("pos"), "n", F.col("shared").cast("int").alias("shared"), "background")
    rows.orderBy("class", "pos", "n").write.csv(path, sep="\t", header=True)


def write_sinks(rows: DataFrame, path: str) -> None:
    """(class, contig, start, end) as BED with the class as name, in order."""
    rows.orderBy("contig", "start", "end", "class").select(F.concat_ws("\t", "contig", "start", "end", "class").alias("value")).write.text(path)


def write_statistics(rows: DataFrame, path: str, held_out: str | None = None) -> None:
    """Interval statistics by class and rank; held_out says which samples learned the intervals, in a column, as a table's parts have no header of their own."""
    at = rows if held_out is None else rows.withColumn("held_out", F.lit(held_out))
    at.orderBy("class", "rank").write.csv(path, sep="\t", header=True, nullValue="NA")


def write_estimates(rows: DataFrame, path: str) -> None:
    """One JSON document a sample, with its classes nested."""
    values = [c for c in rows.columns if c not in ("sample", "class")]
    rows.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("class", *values))).alias("classes")).write.json(path)


def write_segments(rows: DataFrame, path: str) -> None:
    """Stretches of copy states in order."""
    rows.orderBy(*[c for c in ("sample", "class", "first") if c in rows.columns]).write.csv(path, sep="\t", header=True, nullValue="NA")


def write_region_subset(fasta: DataFrame, regions: DataFrame, path: str) -> None:
    """The records (name, description, seq) of a controls FASTA whose name is among regions (name)."""
    write_fasta(fasta.join(regions.select("name").distinct(), "name", "left_semi").orderBy("name"), path)


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """(name, name_length, from, to, back, contig, length, start, end, matches, columns, mapq, cs) of PAF lines; cs is null without that tag. Lines with fewer than twelve columns, or with other than numbers where these belong, are refused."""
    c = F.split("value", "\t")
    n = lambda k: F.get(c, F.lit(k)).try_cast("long")
    tag = F.get(F.filter(F.slice(c, 13, 1 << 20), lambda x: x.startswith("cs:Z:")), F.lit(0))
    at = _lines(spark, path).where("value <> ''").select(
        F.get(c, F.lit(0)).alias("name"), n(1).alias("name_length"), n(2).alias("from"), n(3).alias("to"), (F.get(c, F.lit(4)) == "-").alias("back"), F.get(c, F.lit(5)).alias("contig"),
        n(6).alias("length"), n(7).alias("start"), n(8).alias("end"), n(9).alias("matches"), n(10).alias("columns"), n(11).cast("int").alias("mapq"), F.substring(tag, 6, 1 << 30).alias("cs"),
    )
    whole = [c for c in at.columns if c != "cs"]
    return _checked(at, F.forall(F.array(*(F.col(c).isNotNull() for c in whole)), lambda x: x), "not a PAF line")


#: Endings of files of one unit, in the order in which they are taken.
UNIT_ENDINGS = (".fa", ".fa.gz", ".fasta", ".fasta.gz")


def find_units(spark: SparkSession, folders: list[str], classes: DataFrame) -> DataFrame:
    """(class, path): the file named after each class (class) in the first of the folders that has one, by UNIT_ENDINGS within a folder; null where none has. Folders must exist; files are listed, not read."""
    found = None
    for k, folder in enumerate(folders):
        at = spark.read.format("binaryFile").option("pathGlobFilter", "*.{fa,fa.gz,fasta,fasta.gz}").load(folder).select("path", F.lit(k).alias("k_"))
        found = at if found is None else found.unionByName(at)
    name = F.regexp_extract("path", r"([^/]+?)(\.fa|\.fa\.gz|\.fasta|\.fasta\.gz)$", 1)
    ending = F.regexp_extract("path", r"[^/]+?(\.fa|\.fa\.gz|\.fasta|\.fasta\.gz)$", 1)
    place = F.array_position(F.array(*map(F.lit, UNIT_ENDINGS)), ending)
    first = found.select(name.alias("class"), F.struct("k_", place.alias("e_"), "path").alias("f_")).groupBy("class").agg(F.min("f_").alias("f_"))
    return classes.select("class").distinct().join(first, "class", "left").select("class", F.col("f_.path").alias("path"))
