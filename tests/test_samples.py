import numpy as np

from copyloom.functions import sequences as S
from copyloom.operators import cohort, contracts, intervals, screens, tallies
from copyloom.plans import samples


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_places_span_counts_from_the_first(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 50, 90), ("a", 95, 130), ("a", 400, 410)], "contig string, start long, end long")
    assert rows(intervals.places(df, ["contig"], 60, 100), "start", "end", "members") == [(0, 90, 2), (95, 130, 1), (400, 410, 1)]
    assert rows(intervals.places(df.where("false"), ["contig"], 60, 100)) == []


def test_subtract(spark):
    a = spark.createDataFrame([("c", 1, 0, 100), ("c", 2, 200, 210), ("d", 3, 0, 5)], "contig string, id long, start long, end long")
    m = spark.createDataFrame([("c", 10, 20), ("c", 90, 300)], "contig string, start long, end long")
    assert rows(intervals.subtract(a, m, ["contig"], 16), "id", "start", "end") == [(1, 0, 10), (1, 20, 90), (3, 0, 5)]


def test_families(spark, tmp_path):
    links = spark.createDataFrame([(1, 2, 3), (4, 5, 3), (9, 8, None), (7, 7, 7)], "child long, father long, mother long")
    assert rows(cohort.families(links, f"file://{tmp_path}/a")) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)]
    assert rows(cohort.families(links.where("false"), f"file://{tmp_path}/b")) == []


def test_families_of_a_long_chain(spark, tmp_path):
    links = spark.range(60).selectExpr("id as child", "id + 1 as father", "id + 1 as mother")
    assert {r.family for r in cohort.families(links, f"file://{tmp_path}/c").collect()} == {0}


def test_adjust_recovers_planted_covariates(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = 5 + x @ [2.0, -1.0]
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    got = cohort.adjust(df, "y", ["a", "b"]).toPandas()
    assert np.allclose(got.adjusted, y.mean()) and np.allclose(got.r2, 1)
    assert cohort.adjust(df.where("false"), "y", ["a"]).count() == 0


def test_screens(spark):
    df = spark.createDataFrame([("ACACACACACACACA",), ("ACGTTGCATCCGATA",), ("AAAAAAAACCCCCCC",)], "canon string")
    got = rows(df.select("canon", screens.periodic(df.canon, 15).alias("p"), S.low_complexity(df.canon).alias("l")))
    assert got == [("AAAAAAAACCCCCCC", True, True), ("ACACACACACACACA", True, True), ("ACGTTGCATCCGATA", False, False)]


def test_neighbours(spark):
    pack = lambda x: int(x.translate(str.maketrans("ACGT", "0123")), 4)
    got = {r.near for r in screens.neighbours(spark.createDataFrame([(pack("AAC"),)], "code long"), 3).collect()}
    want = {min(x, x[::-1].translate(str.maketrans("ACGT", "TGCA"))) for i in range(3) for b in "ACGT" if (x := "AAC"[:i] + b + "AAC"[i + 1 :]) != "AAC"}
    assert got == set(map(pack, want))


def test_background_comes_in_parts_that_a_task_can_count(spark, tmp_path, monkeypatch):
    parts, real = [], screens.near_background
    monkeypatch.setattr(screens, "near_background", lambda panel, background, k: parts.append(background.rdd.getNumPartitions()) or real(panel, background, k, 0 if len(parts) > 1 else 100_000))
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = [("the quick brown fix jumps over the lazy dog " * 3,), (None,), ("",)] * 20
    spark.createDataFrame(seen, "text string").write.parquet(f"{tmp_path}/conversations.parquet")
    few = rows(samples.near_background(spark, str(tmp_path)))
    monkeypatch.setattr(S, "PART_BYTES", 100)
    many = rows(samples.near_background(spark, str(tmp_path)))
    assert parts[1] >= 27 > parts[0]  # 20 times 132 bytes
    assert few == many and few


def test_mass_of_unsupported_gc_is_null(spark):
    reads = spark.createDataFrame([("a", 40, 10), ("b", 40, 10), ("b", 90, 1), ("c", 90, 0)], "sample string, gc long, n long")
    curve = spark.createDataFrame([(40, 2.0)], "gc long, rate double")
    assert {r.sample: r.mass for r in tallies.mass(reads, curve, ["sample"], 0.5).collect()} == {"a": 10.0, "b": None, "c": 0.0}


def test_wide_writes_na(spark, tmp_path):
    df = spark.createDataFrame([("s1", "a", 1.5), ("s2", "b", 2.0)], "sample string, name string, v double")
    tallies.write_wide(tallies.wide(df, "sample", "name", "v", ["a", "b"]).coalesce(1), f"{tmp_path}/t")
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("part-*"))
    assert set(text.split("\n")) - {""} == {"sample\ta\tb", "s1\t1.5\tNA", "s2\tNA\t2.0"}


def test_no_issues_where_all_agree(spark):
    c = spark.createDataFrame([("s", "x", "p"), ("t", "x", "p")], "sample string, class string, panel string")
    assert contracts.issues(c.select("class").distinct(), c, c, "panel").count() == 0
    assert rows(contracts.missing_classes(spark.createDataFrame([("x",), ("y",)], "class string"), c)) == [("s", "y"), ("t", "y")]


def test_places_of_one_key_in_islands(spark):
    """A key with all rows is cut where no place crosses, equals the fold over the whole key, and isn't gathered in one array."""
    rng = np.random.default_rng(8)
    data = sorted((int(s), int(s + n)) for s, n in zip(rng.integers(-50_000, 50_000, 2000), rng.integers(1, 90, 2000), strict=True))
    df = spark.createDataFrame([("a", s, e) for s, e in data] + [(None, 5, 6)], "contig string, start long, end long").repartition(3)
    want = []
    for s, e in data:
        if want and s - want[-1][1] <= 20 and e - want[-1][0] <= 150:
            want[-1] = (want[-1][0], max(want[-1][1], e), want[-1][2] + 1)
        else:
            want.append((s, e, 1))
    got = intervals.places(df, ["contig"], 20, 150)
    assert rows(got.where("contig = 'a'"), "start", "end", "members") == sorted(want) and got.where("contig is null").count() == 1
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert intervals._islands(df, ["contig"], 20, 4096).select("contig", "island_").distinct().count() > 100
    merged = []
    for s, e in data:
        if merged and s - merged[-1][1] <= 3:
            merged[-1] = (merged[-1][0], max(merged[-1][1], e), merged[-1][2] + 1)
        else:
            merged.append((s, e, 1))
    assert rows(intervals.merge(df.where("contig = 'a'"), ["contig"], 3), "start", "end", "members") == sorted(merged)


def test_medians_are_exact(spark):
    """Even and odd numbers of values, ties, one key that holds most rows, nulls and NaNs."""
    import numpy as np

    from copyloom.operators import cohort

    rng = np.random.default_rng(6)
    data = {"one": [3.0], "two": [1.0, 2.0], "ties": [5.0] * 7 + [1.0, 9.0], "many": rng.normal(size=5000).round(2).tolist(), "even": rng.normal(size=500).tolist(), "int": list(map(float, range(10)))}
    rows = [(k, v) for k, x in data.items() for v in x] + [("one", None), ("two", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "key string, v double").repartition(4)
    got = {r.key: (r.n, r.median) for r in cohort.medians(df, ["key"], "v", 8).collect()}
    assert got == {k: (len(x), float(np.median(x))) for k, x in data.items()}
    both = {r.key: r for r in cohort.robust(df, ["key"], "v").collect()}
    assert set(both) == set(data) and all(abs(both[k].mad_sd - 1.4826 * np.median(np.abs(np.array(x) - np.median(x)))) < 1e-12 for k, x in data.items())
