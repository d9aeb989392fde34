import gzip

import pytest

from copyloom.operators import panel
from copyloom.sources import tables


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_manifest(spark, tmp_path):
    f = tmp_path / "m.tsv"
    f.write_text("# name kind\nrDNA\tpositional\tu.fa\t1\t\tkeep.bed\n\nHS1\tcompositional\th.fa\tFALSE\t3\n5S\tpositional\ts.fa\t0\t.\t.\n")
    assert rows(tables.read_manifest(spark, str(f))) == [("5S", "positional", "s.fa", False, 1, None), ("HS1", "compositional", "h.fa", False, 3, None), ("rDNA", "positional", "u.fa", True, 1, "keep.bed")]
    for bad, why in (("a\tpositional\tx", "class"), ("a\tother\tx\t1", "class"), ("a\tpositional\tx\tyes", "circular"), ("a\tpositional\tx\t1\t2", "min_count"), ("a\tcompositional\tx\t1\t2\tk.bed", "keep"), ("a\tcompositional\tx\t1\t0", "min_count"), ("a\tpositional\tx\t1\na\tpositional\ty\t1", "twice"), ("", "classes"), ("a\tpositional\tx\t1\t\t\textra", "class")):
        f.write_text(bad + "\n")
        with pytest.raises(Exception, match=why):
            tables.read_manifest(spark, str(f)).collect()


def test_counts_gzip_by_content(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(gzip.compress(b'{"format": "x-counts/2", "sample": "a"}'))
    (tmp_path / "b.json.gz").write_text('{"format": "x-counts/2", "sample": "b"}')
    (tmp_path / "c.json").write_bytes(b"\x1f\x8bnot gzip")
    (tmp_path / "d.json").write_text('{"format": "other/1"}')
    assert rows(tables.read_counts(spark, str(tmp_path)), "sample", "error") == [("a", None), ("b", None), (None, "another format"), (None, "not a counts document")]


@pytest.mark.parametrize(
    "text, want",
    [
        ("FamilyID SampleID FatherID MotherID Sex Population\nf k d m 1 GBR\nf d 0 0 1 GBR\n", [("k", "d", "m", "GBR")]), ("#FID IID PAT MAT SEX PHENO\nf k d m 1 -9\nf x . m 1 -9\n", [("k", "d", "m", None)]),
        ("f k d m 1 1\nf2 k2 d2 m2 2 1\nshort row\n", [("k", "d", "m", None), ("k2", "d2", "m2", None)]), ("k d m YRI\nk2 -9 m2 YRI\n", [("k", "d", "m", "YRI")]), ("k d m\n# note\n", [("k", "d", "m", None)]), ("#kid dad mom\nk d m\n", [("k", "d", "m", None)]),
    ],
)
def test_pedigree_layouts(spark, tmp_path, text, want):
    (tmp_path / "p").write_text(text)
    assert rows(tables.read_pedigree(spark, str(tmp_path / "p"))) == want


def test_pedigree_header_without_parents(spark, tmp_path):
    (tmp_path / "p").write_text("sample value\na 1\n")
    with pytest.raises(ValueError, match="father"):
        tables.read_pedigree(spark, str(tmp_path / "p"))


def test_groups_contigs_slices(spark, tmp_path):
    f = tmp_path / "t"
    f.write_text("#IID SEX SuperPop Population\na 1 EUR GBR\nb 2 AFR NA\n")
    assert rows(tables.read_groups(spark, str(f))) == [("a", "GBR")]
    f.write_text("a one\nb two\n# c\n")
    assert rows(tables.read_groups(spark, str(f))) == [("a", "one"), ("b", "two")]
    f.write_text("IID SEX\na 1\n")
    with pytest.raises(ValueError, match="population"):
        tables.read_groups(spark, str(f))
    for text, want in (("chr1\t100\t5\t60\t61\n", [("chr1", 100)]), ("@HD\tVN:1\n@SQ\tSN:c 1\tLN:7\tM5:x\n@PG\tID:y\n", [("c 1", 7)]), ("c1 x\nc2\n", [("c1", None), ("c2", None)])):
        f.write_text(text)
        assert rows(tables.read_contigs(spark, str(f))) == want
    f.write_text("@SQ\tSN:c1\tLN:7\nc2\n")
    with pytest.raises(ValueError, match="header"):
        tables.read_contigs(spark, str(f))
    f.write_text("0\t1\t50\t1000\t20\t300\n\n-1\t0\t0\t2000\t20\t40\n")
    assert rows(tables.read_slices(spark, str(f)), "ref", "size") == [(-1, 40), (0, 300)]
    f.write_text("0\t1\t50\t1000\t20\n")
    with pytest.raises(Exception, match="six"):
        tables.read_slices(spark, str(f)).collect()


def test_components_and_annotation(spark, tmp_path):
    (tmp_path / "pcs.tsv").write_text("SAMPLE\tPC1\nNA1.by1000.x\t0.5\nNA2.cram\t-1\nNA3\t2\n")
    assert rows(tables.read_components(spark, str(tmp_path / "pcs.tsv"))) == [("NA1", 0.5), ("NA2", -1.0), ("NA3", 2.0)]
    (tmp_path / "HG1_hap2_x.bed").write_text("track a\nc1\t0\t9\trDNA\t0\t.\nc1\t9\t20\tGAP,hsat(a,b),ct\t0\t.\n")
    assert rows(tables.read_annotation(spark, str(tmp_path / "HG1_hap2_x.bed")), "sample", "haplotype", "start", "parts") == [("HG1", 2, 0, ["rDNA"]), ("HG1", 2, 9, ["GAP", "hsat(a,b)", "ct"])]


def test_panel_header_and_writers(spark, tmp_path):
    (tmp_path / "p").write_text("##panel v1\n##k=15\n##class\tid=0\tname=a\tkind=positional\tlength=70\tcircular=1\tsource=x\tkmers_input=70\tkmers_kept=60\n#kmer\tclass\tpos\tstrand\n")
    assert rows(tables.read_panel_classes(spark, str(tmp_path / "p"))) == [(15, 0, "a", "positional", 70, True, 70, 60)]
    u = spark.createDataFrame([("a", "positional", 0, "AAC", True), ("a", "positional", 1, "ACC", True), ("b", "positional", 0, "ACC", True)], "class string, kind string, off int, canon string, fwd boolean")
    keep = spark.createDataFrame([("a", 1, 9)], "class string, start int, end int")
    c = panel.candidates(u, None, keep)
    assert rows(c.select("class", "canon", panel.reason().alias("r"))) == [("a", "AAC", "outside"), ("a", "ACC", "shared"), ("b", "ACC", "shared")]
    tables.write_report(c, str(tmp_path / "report"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "report")).collect() if not r.value.startswith("class")) == ["a\t1\t1\t1\t0", "b\t0\t1\t1\t0"]
    tables.write_sinks(spark.createDataFrame([("x", "c2", 5, 9), ("y", "c1", 0, 3)], "class string, contig string, start long, end long"), str(tmp_path / "sinks"))
    assert rows(tables.read_bed(spark, str(tmp_path / "sinks"))) == [("c1", 0, 3, "y"), ("c2", 5, 9, "x")]
    tables.write_estimates(spark.createDataFrame([("s", "b", 2.0), ("s", "a", None)], "sample string, class string, cn double"), str(tmp_path / "est"))
    assert [c["class"] for c in spark.read.json(str(tmp_path / "est")).first().classes] == ["a", "b"]
    f = spark.createDataFrame([("c:0-4", "role=control", "ACGT"), ("c:9-13", "role=test", "AAAA")], "name string, description string, seq string")
    tables.write_region_subset(f, spark.createDataFrame([("c:9-13",)], "name string"), str(tmp_path / "sub"))
    assert rows(tables.read_controls(spark, str(tmp_path / "sub")), "contig", "start", "role") == [("c", 9, "test")]


def test_sam(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@HD\tVN:1\nr1\t99\tc1\t11\t60\t2S8M\t=\t50\t49\tACGTACGTAC\tIIII\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*\n")
    assert rows(tables.read_sam(spark, str(tmp_path / "x.sam")), "name", "flags", "contig", "pos", "tlen") == [("r1", 99, "c1", 10, 49), ("r2", 4, None, -1, 0)]
