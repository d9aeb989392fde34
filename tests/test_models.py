import numpy as np

from copyloom.operators import cohort, heredity, models


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def world(rng, n=60, m=80):
    """Levels of samples, effects of windows, and what is seen; a fifth of the windows differ from person to person."""
    c, a = rng.normal(2, 0.2, n), rng.normal(0, 0.3, m)
    odd = np.arange(m) % 5 == 3
    y = c[:, None] + a + rng.normal(0, 0.01, (n, m)) + odd * rng.normal(0, 0.6, (n, m))
    return c, a, odd, y


def test_calibration_with_anchors_and_unstable_windows(spark):
    c, a, odd, y = world(np.random.default_rng(5))
    anchor = (np.arange(80) < 20) & ~odd
    y[3, :10] = np.nan
    data = [(1, i, w, float(y[i, w]), bool(anchor[w]), bool(w % 2)) for i in range(60) for w in range(80) if not np.isnan(y[i, w])]
    df = spark.createDataFrame(data, "class int, sample long, window long, y double, anchor boolean, level boolean")
    got = {r.sample: r for r in models.calibrate(df, ["class"], unstable=0.2).collect()}
    use = anchor & (np.arange(80) % 2 == 1)
    assert max(abs(got[i].level - (c[i] + np.median(a[use]))) for i in range(60)) < 0.02
    table = models.efficiencies(df, ["class"], unstable=0.2)
    kept = {r.window: r.effect for r in table.collect()}
    assert not set(kept) & set(np.flatnonzero(odd).tolist()) and max(abs(kept[w] - (a[w] - np.median(a[use]))) for w in kept) < 0.02
    single = {r.sample: r.level for r in models.levels_by_table(df.where("sample < 3"), table, ["class"]).collect()}
    assert all(abs(single[i] - got[i].level) < 0.02 for i in range(3))


def test_mode_pin(spark):
    rng = np.random.default_rng(2)
    cn = np.r_[10 + rng.normal(0, 0.1, 80), 9 + rng.normal(0, 0.1, 30)] * 1.05
    got = models.mode_pin(spark.createDataFrame([("a", float(np.log(x))) for x in cn], "class string, level double"), ["class"], 10.0).first()
    assert abs(got.mode - np.median(cn[np.abs(cn - np.median(cn)) < np.median(cn) / 20])) < 1e-9 and abs(got.delta - np.log(1.05)) < 0.01


def test_segments_with_scale_lean_and_short_runs(spark):
    rng = np.random.default_rng(4)
    place = np.linspace(-0.5, 0.5, 300)
    true = np.r_[np.full(120, 10), np.full(5, 14), np.full(75, 10), np.full(100, 11)]
    cn = true * 1.03 * np.exp(0.06 * place) + rng.normal(0, 0.25, 300)
    f, g = models.levelled(cn, place, 0.25)
    assert abs(f - 1.03) < 0.011 and abs(g - 0.06) < 0.021
    df = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(cn)], "sample string, window long, cn double")
    got = models.segment(df, ["sample"], least=16, level=True)
    found = rows(got, "first", "last", "state")
    assert [x[2] for x in found] == [10, 11] and abs(found[1][0] - 200) < 4
    assert rows(models.events(got, ["sample"], 50), "copies", "delta", "kind") == [(10, 1, "partial copy")]
    assert models.segment(df.where("window < 2"), ["sample"]).count() == 0


def test_short_runs_go_where_they_fit():
    s = np.array([5] * 20 + [9] * 3 + [6] * 20)
    cn = np.array([5.0] * 20 + [6.4] * 3 + [6.0] * 20)
    assert models.without_short_runs(s, cn, 0.5, 4).tolist() == [5] * 20 + [6] * 23


def test_family_bootstrap_and_permutations(spark):
    rng = np.random.default_rng(8)
    fam = np.repeat(np.arange(150), 3)
    x = rng.normal(size=450) + np.repeat(rng.normal(size=150), 3)
    y = 0.5 * x + np.repeat(rng.normal(size=150), 3) + rng.normal(size=450)
    df = spark.createDataFrame(list(zip(fam.tolist(), x.tolist(), y.tolist(), rng.normal(size=450).tolist())), "family long, x double, y double, other double")
    got = cohort.family_bootstrap(df, "x", "y", "family").first()
    slopes = [np.polyfit(np.concatenate([x[fam == f] for f in some]), np.concatenate([y[fam == f] for f in some]), 1)[0] for some in rng.integers(0, 150, (300, 150))]
    assert abs(got.slope - np.polyfit(x, y, 1)[0]) < 1e-9 and 0.8 < got.se / np.std(slopes) < 1.25 and got.low < got.slope < got.high
    far, none = heredity.permutation_p(df, "x", "y", 99).first(), heredity.permutation_p(df, "x", "other", 99).first()
    assert abs(far.r - np.corrcoef(x, y)[0, 1]) < 1e-9 and far.p == 0.01 and none.p > 0.01


def test_rates_span_thin_strata_and_refuse_dropout(spark):
    gc = np.arange(101)
    n = np.where((gc >= 25) & (gc <= 70), 30_000, 0)
    n[40] = 100  # thin, between others
    rate = 0.02 * np.exp(-(((gc - 48) / 25.0) ** 2))
    o = np.random.default_rng(3).poisson(n * rate)
    got, se = models.fit_rate(n.astype(float), o.astype(float))
    have = np.flatnonzero(~np.isnan(got))
    assert have[0] == 25 and have[-1] == 70 and np.abs(got[have] / rate[have] - 1).max() < 0.2 and np.isfinite(se[have]).all()
    o[50:53] = 0
    strata = lambda key, o: [(key, int(g), int(n[g]), int(o[g])) for g in gc]
    low = np.where(gc == 30, 0, np.minimum(o, 2))  # nothing where little is expected
    df = spark.createDataFrame([*strata("gone", o), *strata("low", low), *strata("none", o * 0)], "key string, gc long, n long, o long")
    assert rows(models.dropouts(df.where("n >= 2000"), ["key"])) == [("gone", True), ("low", False), ("none", False)]
    assert {r.key: r.status for r in models.gc_curves(df, ["key"]).collect()} == {"gone": "dropout", "low": "too few ends", "none": "too few ends"}
    assert models.fit_rate(np.full(101, 10.0), np.full(101, 200.0)) == "too few positions"
    assert models.fit_rate(np.where((gc > 40) & (gc < 45), 5e4, 0), np.where((gc > 40) & (gc < 45), 5e3, 0)) == "too few knots"


def test_samples_that_look_cut(spark):
    from copyloom.operators import contracts

    df = spark.createDataFrame([("a", 4, 100), ("b", 6, 100), ("c", 0, 0)], "sample string, ctrl_reads long, primary long")
    assert rows(contracts.looks_cut(df), "sample") == [("b",)]


def test_rates_are_of_greatest_likelihood():
    rng = np.random.default_rng(12)
    m, off = np.column_stack([np.ones(60), rng.normal(size=(60, 3))]), rng.normal(3, 1, 60)
    y = rng.poisson(np.exp(off + m @ [0.3, 0.5, -0.4, 0.1]))
    beta, mu, settled = models._poisson(m, y.astype(float), off)
    assert settled and np.abs(m.T @ (y - mu)).max() < 1e-4 * y.sum() and np.allclose(mu, np.exp(off + m @ beta))
