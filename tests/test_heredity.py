import math

import numpy as np
import pytest

from copyloom.operators import heredity

SCHEMA = "family long, child_value double, father_value double, mother_value double"


def families(rng, n, error=0.0, spouse=0.0):
    f = rng.normal(size=n)
    m = spouse * f + np.sqrt(1 - spouse**2) * rng.normal(size=n)
    c = (f + m) / 2 + rng.normal(0, np.sqrt(0.5), n)
    return [x * 80 + 400 + rng.normal(0, 80 * error, n) for x in (c, f, m)]


def brute(c, f, m):
    mid = (f + m) / 2
    slope = lambda x: np.cov(x, c)[0, 1] / x.var(ddof=1)
    rho, b, v, d = np.corrcoef(f, m)[0, 1], slope(mid), np.r_[f, m].var(ddof=1), (c - mid).var(ddof=1)
    s = c.std(ddof=1) / np.sqrt(v)
    return {"spousal_r": rho, "slope_mid": b, "slope_father": slope(f), "slope_mother": slope(m), "r_mid": np.corrcoef(mid, c)[0, 1], "reliability_mid": b - rho * (1 - b), "reliability_single": slope(f) + slope(m) - rho, "reliability_mendel": 1.5 - d / v, "sd_ratio": s, "reliability_rescaled": b / s * (1 + rho) - rho, "mean_ratio": c.mean() / np.r_[f, m].mean()}


def table(spark, *values, per=1):
    return spark.createDataFrame([(i // per, *map(float, x)) for i, x in enumerate(zip(*values, strict=True))], SCHEMA)


def test_reliabilities_equal_their_definitions(spark):
    c, f, m = families(np.random.default_rng(1), 150, 0.4, 0.3)
    df = table(spark, c, f, m).unionByName(spark.createDataFrame([(999, None, 1.0, 2.0), (999, float("nan"), 1.0, 2.0)], SCHEMA))
    got, want = heredity.reliabilities(df).first(), brute(c, f, m)
    assert got.n == 150 and all(got[k] == pytest.approx(want[k], rel=1e-8) for k in heredity.MEASURES)
    flat = heredity.reliabilities(table(spark, np.arange(5.0), np.ones(5), np.ones(5))).first()
    assert flat.reliability_mid is None and flat.reliability_mendel is None and flat.n == 5


def test_intervals_cover_the_truth(spark):
    """Error of half a deviation leaves a reliability of 1 / 1.25; the resampled interval should hold it in most worlds."""
    rng, rows = np.random.default_rng(2), []
    for world in range(40):
        c, f, m = families(rng, 120, 0.5)
        rows += [(world, i // 2, *map(float, x)) for i, x in enumerate(zip(c, f, m, strict=True))]
    df = spark.createDataFrame(rows, "world long, " + SCHEMA)
    got = heredity.intervals_of(df, ["world"], 200).where("measure = 'reliability_mid'").collect()
    assert len(got) == 40 and sum(r.low <= 0.8 <= r.high for r in got) >= 33
    assert all(0.15 < r.high - r.low < 0.9 for r in got)


def test_comparison_is_finer_than_two_intervals(spark):
    rng = np.random.default_rng(3)
    c, f, m = families(rng, 300, 0.3)
    worse = [x + rng.normal(0, 40, 300) for x in (c, f, m)]
    rows = [(i // 2, *map(float, x)) for i, x in enumerate(zip(c, f, m, *worse, strict=True))]
    df = spark.createDataFrame(rows, "family long, " + ", ".join(f"{w}_{k} double" for k in "ab" for w in ("child", "father", "mother")))
    got = heredity.compared(df).first()
    a, b = brute(c, f, m)["reliability_mid"], brute(*worse)["reliability_mid"]
    assert got.n == 300 and got.families == 150 and got.delta == pytest.approx(a - b) and got.low < got.delta < got.high and got.p_better > 0.95
    wide = heredity.intervals_of(df.selectExpr("family", *(f"{w}_a as {w}_value" for w in ("child", "father", "mother")))).where("measure = 'reliability_mid'").first()
    assert got.high - got.low < wide.high - wide.low
    same = heredity.compared(df.selectExpr("family", *(f"{w}_a as {w}_{k}" for k in "ab" for w in ("child", "father", "mother")))).first()
    assert same.delta == 0 and same.low == 0 and same.high == 0 and same.p_better == 0
    assert heredity.compared(df.limit(19)).first() is None


def test_places_are_a_permutation(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "id")
    got = heredity.placed(df, ["k"], heredity.F.xxhash64("id"), ["id"], "place").toPandas()
    for _, rows in got.groupby("k"):
        assert sorted(rows.place) == list(range(1, len(rows) + 1))
    hashes = dict(spark.range(1000).selectExpr("id", "xxhash64(id) as h").toPandas().to_numpy().tolist())
    assert [hashes[i] for i in got[got.k == 0].sort_values("place").id] == sorted(h for i, h in hashes.items() if i % 3 == 0)


def test_permuted_slopes(spark):
    rng = np.random.default_rng(4)
    c, f, m = families(rng, 120, 0.5)
    got = heredity.permuted_slope(table(spark, c, f, m), times=99).first()
    assert got.p == pytest.approx(0.01) and abs(got.null_mean) < 0.1 and got.slope == pytest.approx(brute(c, f, m)["slope_mid"])
    mid = (f + m) / 2
    brute_sd = np.std([np.cov(mid, rng.permutation(c))[0, 1] / mid.var(ddof=1) for _ in range(400)])
    assert abs(got.null_sd / brute_sd - 1) < 0.3
    # Two populations that differ and inherit nothing: within them there is nothing left.
    shift = np.repeat([0.0, 300.0], 60)
    rows = [(int(i >= 60), *map(float, x)) for i, x in enumerate(zip(rng.normal(size=120) + shift, rng.normal(size=120) + shift, rng.normal(size=120) + shift, strict=True))]
    df = spark.createDataFrame(rows, "population long, child_value double, father_value double, mother_value double")
    assert heredity.permuted_slope(df, times=99).first().p <= 0.02 and heredity.permuted_slope(df, ["population"], 99).first().p > 0.02


def test_heterogeneity_by_sex(spark):
    rng = np.random.default_rng(5)
    c, f, m = families(rng, 240)
    son = rng.random(240) < 0.5
    rows = lambda child: [(i, bool(son[i]), float(child[i]), float(f[i]), float(m[i])) for i in range(240)]
    schema = "family long, son boolean, child_value double, father_value double, mother_value double"
    even = heredity.heterogeneity(spark.createDataFrame(rows(c), schema), 99).first()
    linked = heredity.heterogeneity(spark.createDataFrame(rows(np.where(son, f, m) + rng.normal(0, 20, 240)), schema), 99).first()
    assert even.p > 0.02 and linked.p == pytest.approx(0.01) and linked.q > even.q and linked.p_normal < 1e-6
    z = [(np.arctanh(np.corrcoef(p[s], c[s])[0, 1]), s.sum() - 3) for p in (f, m) for s in (son, ~son)]
    mid = sum(a * w for a, w in z) / sum(w for _, w in z)
    assert even.q == pytest.approx(sum(w * (a - mid) ** 2 for a, w in z))
    assert even.p_normal == pytest.approx(math.erfc(math.sqrt(even.q / 2)) + math.sqrt(2 * even.q / math.pi) * math.exp(-even.q / 2))
