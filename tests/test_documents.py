import numpy as np
import pytest

from copyloom.operators import contracts, documents
from copyloom.sources import tables


def rate(gc):
    return 0.02 * np.exp(-(((gc - 48) / 25.0) ** 2))


def window_gc(seq, length):
    """GC percentages of the windows of a circular unit that begin, and that end, at each position."""
    two = np.frombuffer((seq + seq[: length - 1]).encode(), np.uint8)
    sums = np.r_[0, np.cumsum(np.isin(two, list(b"GC")))]
    ahead = (100 * (sums[length:] - sums[:-length]) + length // 2) // length
    return ahead, np.roll(ahead, length - 1)


@pytest.fixture(scope="module")
def simulated(spark):
    """Two samples with inserts near two tables, a ring of 4,000 bases in 60 and 30 copies, ends drawn by the GC of what they begin."""
    rng = np.random.default_rng(5)
    seq = "".join(rng.choice(list("ACGT"), 4000, p=[0.3, 0.2, 0.2, 0.3]))
    gc = np.arange(101)
    n = np.where((gc >= 20) & (gc <= 75), 400_000, 0)
    samples, tables_, classes, ends = [], [], [], []
    for name, insert, length, copies in (("s1", 290, 300, 60), ("s2", 180, 200, 30)):
        samples.append((name, "scan", 1000, 900, insert, 100))
        tables_ += [(name, size, int(g), int(n[g]), int(rng.poisson(n[g] * rate(g)))) for size in (200, 300) for g in gc]
        classes.append((name, "ring", "positional", 50, 80, 7, 0))
        for reverse, at in zip((False, True), window_gc(seq, length), strict=True):
            seen = rng.poisson(rate(at) * copies / 2).reshape(80, 50).sum(1)
            ends += [(name, "ring", b, reverse, int(x)) for b, x in enumerate(seen) if x]
    schema = ("sample string, mode string, records long, primary long, insert_median long, read_length_mode long", "sample string, l long, gc long, n long, o long", "sample string, class string, kind string, bin long, bins long, reads long, dup_flagged long", "sample string, class string, bin long, reverse boolean, n long", "sample string, class string, contig string, start long, reads long")
    parts = [spark.createDataFrame(x, s) for x, s in zip((samples, tables_, classes, ends, [("s1", "ring", "c1", 1000, 5), ("s1", "ring", "c1", 0, 4)]), schema, strict=True)]
    return seq, documents.assembled(*parts), ends


def test_documents_go_to_files_and_back(spark, simulated, tmp_path):
    _, made, ends = simulated
    documents.write(made, str(tmp_path / "out"))
    got = tables.read_counts(spark, str(tmp_path / "out" / "*" / "*")).where("error is null")
    back = {r.sample: r for r in got.collect()}
    for r in made.collect():
        assert all(back[r.sample][c] == r[c] for c in made.columns) and len(r.gc_tables) == 2 and len(r.gc_tables[0].n) == 101
    assert [p.start for p in back["s1"].placements] == [0, 1000] and back["s2"].placements == []
    assert {(r.sample, r["class"], r.bin, r.reverse): r.n for r in documents.end_bins(got).where("n > 0").collect()} == {x[:4]: x[4] for x in ends}


def test_copies_from_documents(spark, simulated):
    seq, made, _ = simulated
    units = spark.createDataFrame([("ring", seq, True)], "class string, seq string, circular boolean")
    kmers = spark.createDataFrame([("ring", p) for p in range(4000)], "class string, pos long")
    anchors = spark.createDataFrame([("ring", 0, 2000)], "class string, start long, end long")
    got, windows = documents.estimated(made, units, kmers, anchors, 31, 50, 10)
    at = {r.sample: r for r in got.collect()}
    assert abs(at["s1"].cn_all / 60 - 1) < 0.04 and abs(at["s2"].cn_all / 30 - 1) < 0.04
    rows = windows.collect()
    assert len(rows) == 16 and max(r.end for r in rows) == 4000 and abs(np.median([r.cn for r in rows if r.sample == "s1"]) / 60 - 1) < 0.06
    few = documents.estimated(made.where("false"), units, kmers, anchors, 31, 50)
    assert not few[0].count() and not few[1].count()


def test_classes_missing_from_a_bed(spark):
    counted = spark.createDataFrame([(s, c) for s in ("a", "b", "c", "d") for c in ("X", "Y")], "sample string, class string")
    fetches = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h9")], "sample string, sinks string")
    beds = spark.createDataFrame([("h1", "X"), ("h1", ""), ("h2", "")], "sinks string, class string")
    assert [tuple(r) for r in contracts.missing_from_bed(counted, fetches, beds).collect()] == [("a", "Y")]


def test_pipelines(spark):
    rows = [("same", ["bwa-mem2 x", "samtools"], "h", 3), ("other", ["dragen"], "h", 3), ("both", ["dragen"], "g", 3), ("cut", ["BWA"], "g", 2), ("bare", [], None, None), ("half", [], "h", 3)]
    df = spark.createDataFrame(rows, "sample string, programs array<string>, sq_sha256 string, sq_n long")
    learned = spark.createDataFrame([("bwa", "h", 3)], "aligner string, sq_sha256 string, sq_n long")
    got = {r.sample: r.status for r in contracts.pipeline_check(df, learned).collect()}
    assert got == {"same": "ok", "other": "aligned by dragen, not bwa", "both": "aligned by dragen, not bwa; other reference", "cut": "ok", "bare": None, "half": "ok"}


def test_hashes_of_panels(spark, tmp_path):
    import gzip
    import hashlib

    (tmp_path / "a.tsv").write_bytes(b"##k=31\n")
    (tmp_path / "b.tsv.gz").write_bytes(gzip.compress(b"##k=31\n"))
    got = {r.path.rsplit("/", 1)[-1]: set() for r in contracts.panel_hashes(spark, str(tmp_path)).collect()}
    for r in contracts.panel_hashes(spark, str(tmp_path)).collect():
        got[r.path.rsplit("/", 1)[-1]].add(r.sha256)
    plain = hashlib.sha256(b"##k=31\n").hexdigest()
    assert got == {"a.tsv": {plain}, "b.tsv.gz": {plain, hashlib.sha256((tmp_path / "b.tsv.gz").read_bytes()).hexdigest()}}
