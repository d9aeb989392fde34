import numpy as np
import pytest
from pyspark.sql import functions as F

from copyloom.functions import sequences as S
from copyloom.operators import cohort, intervals, models, panel
from copyloom.sources import tables


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_kmers_skip_other_letters(spark):
    df = spark.createDataFrame([(1, "TTGCANNCAGGTCAxA"), (2, "TG"), (3, ""), (4, None)], "id int, seq string")
    assert [r.off for r in S.kmers(df, "seq", 3).orderBy("off").collect()] == [0, 1, 2, 7, 8, 9, 10, 11]
    assert [r.n for r in df.select("id", S.valid_kmers(F.col("seq"), 3).alias("n")).orderBy("id").collect()] == [8, 0, 0, None]


@pytest.mark.parametrize("k", [1, 3, 15, 31])
def test_packed_kmers_agree(spark, k):
    rng = np.random.default_rng(k)
    seqs = [(i, "".join(rng.choice(list("ACGTacgtN"), rng.integers(0, 120), p=[0.12] * 8 + [0.04]))) for i in range(60)] + [(60, None), (61, "N" * 50)]
    df = spark.createDataFrame(seqs, "id int, seq string")
    want = rows(S.kmers(df, "seq", k).select("id", "off", S.code(F.col("canon")).alias("code"), "fwd"))
    got = S.packed_kmers(df, "seq", k)
    assert rows(got, "id", "off", "code", "fwd") == want
    chosen = set(sorted({r[2] for r in want})[::3])
    some = spark.createDataFrame([(c,) for c in chosen], "code long")
    for most in (10, 1_000_000):  # joined, and looked up
        assert rows(S.packed_kmers(df, "seq", k, some, most), "id", "off", "code", "fwd") == [r for r in want if r[2] in chosen]


def test_kmers_tiles_agree(spark):
    seq = "".join(np.random.default_rng(1).choice(list("ACGT"), 700))
    got = rows(S.kmers(spark.createDataFrame([(seq,)], "seq string"), "seq", 31), "off", "kmer")
    assert got == [(i, seq[i : i + 31]) for i in range(670)]


def test_merge_and_gap(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 50010, 50020), ("a", 100021, 100030)], "contig string, start long, end long")
    assert rows(intervals.merge(df, ["contig"], 50_000), "start", "end") == [(0, 50020), (100021, 100030)]


def test_price(spark):
    q = spark.createDataFrame([("c", "A", 0, 10), ("c", "B", 5, 30)], "contig string, query string, start long, end long")
    s = spark.createDataFrame([("c", 1, 0, 6, 100), ("c", 2, 8, 40, 10)], "contig string, slice int, start long, end long, size long")
    assert rows(intervals.price(q, s, ["contig"], 4)) == [(220, 110, 2)]


def test_mode_takes_the_longer(spark):
    df = spark.createDataFrame([("s", 151, 9), ("s", 100, 9)], "s string, len int, n int")
    assert rows(cohort.histogram_mode(df, ["s"], "len", "n")) == [("s", 151)]


def test_panel_merge_drops_conflicts(spark):
    a = spark.createDataFrame([("AAA", 1), ("AAC", 1)], "canon string, class int")
    b = spark.createDataFrame([("AAC", 2), ("ACC", 2)], "canon string, class int")
    assert rows(panel.merge(a, b)) == [("AAA", 1), ("ACC", 2)]


def test_rate_recovers_a_curve():
    gc = np.arange(101)
    n = np.where((gc > 25) & (gc < 70), 20_000, 0)
    true = 0.02 * np.exp(-(((gc - 45) / 20.0) ** 2))
    o = np.random.default_rng(2).poisson(n * true)
    rate, _ = models.fit_rate(n.astype(float), o.astype(float))
    ok = ~np.isnan(rate)
    assert np.abs(rate[ok] / true[ok] - 1).max() < 0.2 and ok.sum() == 44
    assert models.fit_rate(n.astype(float), o / 1e6) == "too few ends"


def test_polish_and_states():
    rng = np.random.default_rng(3)
    c, a = rng.normal(0, 1, 40), rng.normal(0, 0.3, 60)
    got, _ = models.polish(c[:, None] + a + rng.normal(0, 0.01, (40, 60)))
    assert np.std(got - c) < 0.01
    cn = np.r_[np.full(50, 10.0), np.full(40, 9.0), np.full(50, 10.0)] + rng.normal(0, 0.3, 140)
    assert models.best_states(cn, 0.3).tolist() == [10] * 50 + [9] * 40 + [10] * 50


def test_text_tables(spark, tmp_path):
    (tmp_path / "a.bed").write_text("# x\ntrack y\nc1\t0\t5\tz\n\nc2\t7\t9\n")
    assert rows(tables.read_bed(spark, str(tmp_path / "a.bed")).fillna("")) == [("c1", 0, 5, "z"), ("c2", 7, 9, "")]
    (tmp_path / "b.bed").write_text("c1\t9\t5\n")
    with pytest.raises(Exception, match="BED"):
        tables.read_bed(spark, str(tmp_path / "b.bed")).collect()
    (tmp_path / "a.fa").write_text(">c:2-6 flank=1 role=test label=q\nacg\nTNN\n")
    assert rows(tables.read_controls(spark, str(tmp_path / "a.fa"))) == [("c", 2, 6, 1, "test", "q", "ACGTNN")]
    tables.write_fasta(tables.read_fasta(spark, str(tmp_path / "a.fa")), str(tmp_path / "out"))
    assert rows(tables.read_fasta(spark, str(tmp_path / "out")), "seq") == [("ACGTNN",)]
    p = spark.createDataFrame([("AAC", "x", 3, True)], "canon string, class string, pos int, fwd boolean")
    tables.write_panel(p, 3, str(tmp_path / "p"))
    assert rows(tables.read_panel(spark, str(tmp_path / "p"))) == [("AAC", "x", 3, True)]
    (tmp_path / "c.json").write_text('{"format": "x-counts/1", "sample": "s", "records": 5}')
    assert rows(tables.read_counts(spark, str(tmp_path / "c.json")), "sample", "records", "error") == [("s", 5, None)]
    (tmp_path / "ped").write_text("FamilyID SampleID FatherID MotherID Sex\nf k d m 1\nf d 0 0 1\n")
    assert rows(tables.read_pedigree(spark, str(tmp_path / "ped")), "child", "father", "mother") == [("k", "d", "m")]


def test_stream_takes_in_what_lands(spark, tmp_path):
    from copyloom.streaming.counts import bin_counts, stream_bins

    land, at = tmp_path / "land", str(tmp_path / "state")
    one = spark.createDataFrame([("a", 5.0), ("a", 15.0), ("b", 7.0)], "event_type string, value double")
    two = spark.createDataFrame([("a", 6.0), ("c", 99.0)], "event_type string, value double")
    one.coalesce(1).write.parquet(str(land))
    assert rows(stream_bins(spark, str(land), "*.parquet", at)) == rows(bin_counts(one))
    two.coalesce(1).write.mode("append").parquet(str(land))
    assert rows(stream_bins(spark, str(land), "*.parquet", at)) == rows(bin_counts(one.unionByName(two)))
    assert rows(stream_bins(spark, str(land), "*.parquet", at)) == rows(bin_counts(one.unionByName(two)))
