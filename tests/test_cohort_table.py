import numpy as np
import pytest

from copyloom.operators import cohort_table as T
from copyloom.operators import estimate, tallies


def test_comb_finds_the_offset(spark):
    """Four in ten lack the interval in one copy, so the cohort's median puts its windows too low by 0.05."""
    rng = np.random.default_rng(2)
    level = np.r_[np.full(60, 10.0), np.full(60, 9.0)] + rng.normal(0, 0.03, 120)
    copies = np.round(level) - (rng.random(120) < 0.4)
    ratio = copies / np.round(level) * np.exp(0.05) + rng.normal(0, 0.001, 120)
    df = spark.createDataFrame([("a", float(r), float(x)) for r, x in zip(ratio, level)] + [("few", 1.0, 10.0)] * 10 + [("a", None, 10.0), ("a", 1.0, 9.5)], "key string, ratio double, level double")
    got = {r.key: r for r in T.comb(df, ["key"]).collect()}
    assert abs(got["a"].offset - 0.05) < 0.006 and got["a"].n == 120 and got["few"].offset == 0.0


def world(n=70, seed=3):
    """Two classes of 60 windows, levels, effects, an interval that a third of the samples lack in one copy, control regions with two factors."""
    rng = np.random.default_rng(seed)
    w, effect = np.arange(60), {"dj": rng.normal(0, 0.2, 60), "tel": rng.normal(0, 0.2, 60)}
    levels = {"dj": np.where(np.arange(n) % 5 == 0, 9, 10) * 1.08, "tel": rng.uniform(3, 6, n)}
    lost = rng.random(n) < 0.4
    windows, controls = [], []
    f = rng.normal(size=(n, 2))
    load = rng.normal(size=(2, 200)) * 0.03
    for i in range(n):
        for c in ("dj", "tel"):
            cn = np.full(60, levels[c][i])
            if c == "dj" and lost[i]:
                cn[40:50] *= 1 - 1 / round(levels[c][i] / 1.08)
            cn = cn * np.exp(effect[c] + rng.normal(0, 0.01, 60))
            windows += [(f"s{i}", c, int(k) * 100, int(k) * 100 + 100, 0.5 if k < 30 else 0.7, None if c == "tel" and i == 4 or rng.random() < 0.02 else float(x)) for k, x in zip(w, cn)]
        controls += [(f"s{i}", f"r{k}", float(x)) for k, x in enumerate(f[i] @ load + rng.normal(0, 0.02, 200)) if i != 6 or k]
    return windows, controls, effect, levels, lost


W = "sample string, class string, start long, end long, gc double, cn double"


@pytest.fixture(scope="module")
def table(spark):
    windows, controls, effect, levels, lost = world()
    windows = [r for r in windows if not (r[0] == "s5" and r[1] == "tel")]
    rules = {"dj": T.Rule(excluded=[(4000, 5000)], expected=10.0, polymorphic=[("loss", 4000, 5000, 0.03, 0.15)])}
    anchors = spark.createDataFrame([("dj", 0, 2500)], "class string, start long, end long")
    status = spark.createDataFrame([("s7", "tel", "panel_mismatch")], "sample string, class string, status string")
    w, c = spark.createDataFrame(windows, W).repartition(4), spark.createDataFrame(controls, "sample string, region string, log_ratio double")
    return w, anchors, T.cohort_table(w, c, anchors, rules, status=status), effect, levels, lost


def test_copies_are_on_the_cohorts_scale(table):
    """The anchors read 8 % high; the pin to the mode of ten copies takes that out of the one class and leaves the other as it is."""
    _, _, got, effect, levels, _ = table
    v = {(r.sample, r.column): r.value for r in got.values.collect()}
    assert all(abs(v[f"s{i}", "dj.cn"] / (9 if i % 5 == 0 else 10) - 1) < 0.01 for i in range(70))
    shift = np.median([v[f"s{i}", "tel.cn"] / levels["tel"][i] for i in range(70) if ("s%d" % i, "tel.cn") in v])
    assert all(abs(v[f"s{i}", "tel.cn"] / levels["tel"][i] / shift - 1) < 0.01 for i in range(70) if i not in (4, 5, 7))
    assert all(0 < v[f"s{i}", "dj.cn_se_rel"] < 0.01 and abs(v[f"s{i}", "dj.cn_unit"] / v[f"s{i}", "dj.cn"] - 1) < 0.02 for i in range(70))


def test_what_is_lacking_is_told(table):
    _, _, got, *_ = table
    assert {(r.sample, r["class"]): r.why for r in got.lacking.collect()} == {("s4", "tel"): "no usable window", ("s5", "tel"): "absent", ("s7", "tel"): "status panel_mismatch"}
    v = {(r.sample, r.column) for r in got.values.collect()}
    assert not {(s, "tel.cn") for s in ("s4", "s5", "s7")} & v and ("s6", "ctrlPC1") not in v and ("s5", "ctrlPC1") in v


def test_polymorphic_interval_reads_whole_copies(table):
    _, _, got, effect, _, lost = table
    moved = {(r["class"], r.name): r for r in got.offsets.collect()}
    assert set(moved) == {("dj", "scale"), ("dj", "loss")} and abs(moved["dj", "scale"].offset - np.log(1.08)) < 0.06
    table_ = {r.window: r.effect for r in got.effects.where("class = 'dj'").collect()}
    # relative to the core, the interval's windows have their true effects, whatever the median sample lacks
    inside, core = [table_[k * 100] - effect["dj"][k] for k in range(40, 50)], [table_[k * 100] - effect["dj"][k] for k in range(40)]
    assert abs(np.median(inside) - np.median(core)) < 0.012


def test_components_and_the_wide_table(table):
    _, _, got, *_ = table
    edge = got.controls.first()
    assert edge.components in (2, 3) and edge.written == 13  # the rows' medians follow the two factors and can stand out as a third
    wide = got.wide().toPandas().set_index("sample")
    assert wide.shape == (70, len(got.columns)) and {"dj.profilePC3", "tel.profilePC1", "ctrlPC13"} <= set(wide.columns) and (wide.ctrlPC_mp.dropna() == edge.components).all() and np.isnan(wide.loc["s4", "tel.cn"])


def test_a_saved_table_of_effects_gives_the_same_levels(spark, table):
    w, anchors, got, *_ = table
    effects = got.effects.select("class", F_start(), "effect").where("class = 'dj'")
    cells, moved = T.calibrated(w.where("class = 'dj' and sample in ('s1', 's2')"), anchors, {"dj": T.Rule(excluded=[(4000, 5000)])}, effects)
    v = {(r.sample, r.column): r.value for r in got.values.where("column = 'dj.cn'").collect()}
    assert all(r.cn == pytest.approx(v[r.sample, "dj.cn"], rel=1e-6) for r in T.measured(cells).collect()) and not moved.count()
    with pytest.raises(ValueError, match="other windows: dj from 6000 on"):
        T.fixed_effects(effects.unionByName(spark.createDataFrame([("dj", 6000, 0.1)], effects.schema)), w)


def F_start():
    from pyspark.sql import functions as F

    return F.col("window").alias("start")


def test_refusals(spark):
    row = ("a", "c", 0, 100, 0.5, 1.0)
    with pytest.raises(ValueError, match="given twice: a"):
        T.checked(spark.createDataFrame([row, row], W))
    with pytest.raises(ValueError, match="different windows of c"):
        T.checked(spark.createDataFrame([row, ("b", "c", 0, 90, 0.5, 1.0)], W))


def test_sub_options_end_with_their_contig(spark):
    placed = spark.createDataFrame([("s", "S", "cA", 100_000, 1000), ("s", "S", "cA", 110_000, 500), ("s", "S", "cA", 120_000, 77), ("s", "S", "cB", 50_000, 300), ("s", "S", "*", 0, 9)], "sample string, class string, contig string, start long, reads long")
    options = spark.createDataFrame([("X", "S", "cA", 100_000, 120_000), ("Y", "S", "cB", 49_000, 60_000), ("Z", "S", "cA", 105_000, 115_000)], "option string, class string, contig string, start long, end long")
    worth, contigs = spark.createDataFrame([("s", "S", 2.0)], "sample string, class string, worth double"), spark.createDataFrame([("cA", 1_000_000), ("cB", 55_000)], "contig string, length long")
    got = estimate.sub_options(placed, options, worth, 10_000, contigs)
    assert {r.option: (r.reads, r.mass) for r in got.collect()} == {"X": (1500, 3000.0), "Y": (300, 600.0), "Z": (0, 0.0)}
    short = estimate.sub_options(placed, options.where("option = 'Y'").withColumn("end", T.F.lit(55_000)), worth, 10_000, contigs).first()
    assert short.reads == 300  # the last bin is as long as the contig lets it be
    assert estimate.sub_options(placed, options.where("option = 'Y'").withColumn("end", T.F.lit(55_000)), worth, 10_000).first().reads == 0


def test_status_of_options(spark):
    options = spark.createDataFrame([("X", "S", "c", 10, 20), ("X", "S", "c", 40, 50), ("Y", "S", "d", 0, 5)], "option string, class string, contig string, start long, end long")
    samples = spark.createDataFrame([("scan", "scan", None), ("whole", "fetch", "h1"), ("part", "fetch", "h2"), ("odd", "fetch", "h9")], "sample string, mode string, sinks string")
    beds = spark.createDataFrame([("h1", "S", "c", 0, 45), ("h1", "S", "c", 45, 60), ("h1", "S", "d", 0, 5), ("h2", "S", "c", 0, 30), ("h2", "T", "d", 0, 9)], "sinks string, class string, contig string, start long, end long")
    got = estimate.option_status(options, samples, beds)
    assert {(r.sample, r.option): r.status for r in got.collect()} == {
        ("scan", "X"): "ok", ("scan", "Y"): "ok", ("whole", "X"): "ok", ("whole", "Y"): "ok", ("part", "X"): "not_fetched", ("part", "Y"): "not_fetched", ("odd", "X"): "unverified", ("odd", "Y"): "unverified",
    }
    placed = spark.createDataFrame([("odd", "S", "d", 0, 8)], "sample string, class string, contig string, start long, reads long")
    worth = spark.createDataFrame([("odd", "S", 2.0), ("part", "S", 2.0), ("scan", "S", 2.0)], "sample string, class string, worth double")
    rows = {(r.sample, r.option): (r.reads, r.mass) for r in estimate.sub_options(placed, options, worth, 5, None, got).collect()}
    assert rows["odd", "Y"] == (8, None) and rows["part", "Y"] == (None, None) and rows["scan", "Y"] == (0, 0.0)


def test_the_last_window_ends_with_its_unit(spark):
    bins = spark.createDataFrame([("s", "c", b, r, True, 0.5, 2.0, 1) for b in range(5) for r in (False, True)], "sample string, class string, bin long, reverse boolean, usable boolean, gc double, exp double, obs long")
    got = estimate.windows(bins, 2, 50, spark.createDataFrame([("c", 230)], "class string, length long"))
    assert sorted((r.start, r.end) for r in got.collect()) == [(0, 100), (100, 200), (200, 230)]


def circular_starts(kept, read, k, least):
    n = len(kept)
    return [(sum(kept[(p + j) % n] for j in range(read - k + 1)) >= least, sum(kept[(p - j) % n] for j in range(k - 1, read)) >= least) for p in range(n)]


@pytest.mark.parametrize("size,read", [(40, 12), (7, 20)])
def test_reads_go_round_circular_units(spark, size, read):
    rng = np.random.default_rng(size)
    kept = (rng.random(size) < 0.6).tolist()
    df = spark.createDataFrame([("u", p, x, True) for p, x in enumerate(kept)] + [("l", p, x, False) for p, x in enumerate(kept)], "class string, pos long, kept boolean, circular boolean")
    got = {(r["class"], r.pos): (r.ahead, r.back) for r in tallies.callable_starts(df, read, 5, 5).collect()}
    assert [got["u", p] for p in range(size)] == circular_starts(kept, read, 5, 5)
    line = {(r["class"], r.pos): (r.ahead, r.back) for r in tallies.callable_starts(df.where("class = 'l'").drop("circular"), read, 5, 5).collect()}
    assert all(got[k] == v for k, v in line.items()) and len(line) == size and not line["l", size - 1][0]
