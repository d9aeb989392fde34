import pytest

from copyloom.operators import intervals
from copyloom.sources import tables

HEAD = "##k=5\n##class\tid=0\tname=a\tkind=positional\tlength=9\tcircular=0\n##class\tid=1\tname=b\tkind=compositional\tlength=4\tcircular=0\n"


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_panels(spark, tmp_path):
    path = tmp_path / "p.tsv"
    path.write_text(HEAD + "AAAAC\t0\t8\t+\nAACGA\t1\t0\t-\n")
    assert rows(tables.open_panel(spark, str(path)), "canon", "name", "pos", "fwd") == [("AAAAC", "a", 8, True), ("AACGA", "b", 0, False)]
    for bad, why in (("AAAAC\t0\t9\t+", "outside"), ("AAAAC\t1\t1\t+", "outside"), ("AAAAC\t2\t0\t+", "undeclared"), ("AAAA\t0\t0\t+", "length"), ("AAAAC\t0\t1\t+\nAAAAC\t1\t0\t+", "twice"), ("AAAAC\tx\t0\t+", "undeclared")):
        path.write_text(HEAD + bad + "\n")
        with pytest.raises(ValueError, match=why):
            tables.open_panel(spark, str(path))
    path.write_text(HEAD)
    with pytest.raises(ValueError, match="no k-mers"):
        tables.open_panel(spark, str(path))
    path.write_text(HEAD.replace("id=1", "id=2") + "AAAAC\t0\t1\t+\n")
    with pytest.raises(ValueError, match="numbered"):
        tables.open_panel(spark, str(path))


def test_controls(spark, tmp_path):
    path = tmp_path / "c.fa"
    contigs = spark.createDataFrame([("c1",), ("c2",)], "contig string")

    def write(*regions):
        path.write_text("".join(f">{n} {d}\nACGTA\n" for n, d in regions))
        return tables.open_controls(spark, str(path), contigs)

    got = write(("c1:0-5", ""), ("c1:5-10", "role=test label=t"), ("c9:0-5", "role=dosage label=d"))
    assert rows(got, "contig", "start", "role", "absent") == [("c1", 0, "control", False), ("c1", 5, "test", False), ("c9", 0, "dosage", True)]
    for regions, why in ((("c1:0-5", ""), ("c1:4-9", "role=test label=t")), "overlap"), ((("c1:0-5", ""), ("c9:0-5", "")), "absent"), ((("c1:0-5", "role=test label=t"),), "no region"):
        with pytest.raises(ValueError, match=why):
            write(*regions)


def test_gaps_cross_ranges(spark):
    w = intervals.RANGE
    df = spark.createDataFrame([("a", 5, 9), ("a", 10 * w, 10 * w + 3), ("a", 10 * w + 4, 40 * w), ("a", 40 * w + 1, 40 * w + 2), (None, 3, 4), (None, 7, 8)], "contig string, start long, end long")
    got = intervals.complement(df, ["contig"])
    assert sorted((str(c), s, e) for c, s, e in rows(got.where("contig is null or true").fillna("None"))) == [("None", 4, 7), ("a", 9, 10 * w), ("a", 10 * w + 3, 10 * w + 4), ("a", 40 * w, 40 * w + 1)]


def test_units_are_looked_for_in_order(spark, tmp_path):
    for d, names in (("one", ["a.fasta", "a.fa.gz", "x.txt"]), ("two", ["a.fa", "b.v2.fa", "c.tsv"])):
        (tmp_path / d).mkdir()
        for n in names:
            (tmp_path / d / n).write_text(">u\nACGT\n")
    classes = spark.createDataFrame([("a",), ("b.v2",), ("b",), ("c",), ("a",)], "class string")
    got = tables.find_units(spark, [str(tmp_path / "one"), str(tmp_path / "two")], classes)
    assert [(c, p and p.split("/")[-2:]) for c, p in sorted(map(tuple, got.collect()))] == [("a", ["one", "a.fa.gz"]), ("b", None), ("b.v2", ["two", "b.v2.fa"]), ("c", None)]
