"""Places that very many intervals share: what a step makes must not be pairs of them. Each of these made 10^9 pairs or more."""

import random

import numpy as np
import pandas as pd
import pytest

from copyloom.operators import assembly, cohort, heredity, intervals

MANY = 60_000


def test_reached_equals_brute_force(spark):
    rng = random.Random(3)
    some = lambda n: [(rng.choice("ab"), s, s + rng.choice([0, 1, 7, 40])) for s in (rng.randrange(200) for _ in range(n))]
    a, b = [*some(150), (None, 5, 9), ("c", 1, 2), ("a", None, 9), ("a", 3, None)], [*some(40), (None, 0, 99), ("a", None, 9)]
    schema = "k string, start long, end long"
    got = intervals.reached(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], "far", 32).collect()
    want = [(k, s, e, max((y for c, x, y in b if c == k is not None and None not in (x, e) and x < e), default=None)) for k, s, e in a]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sorted(map(repr, map(tuple, cohort.level_windows(*(spark.createDataFrame(x, schema) for x in (a, b)), ["k"], 32).collect()))) == sorted(
        repr((k, s, e)) for k, s, e in a if not any(c == k is not None and None not in (x, s, e) and x < e and s < y for c, x, y in b)
    )


def test_level_windows_where_all_overlap(spark):
    x = spark.range(MANY).selectExpr("'a' as k", "id % 5 as start", "id % 5 + 30 as end")
    assert cohort.level_windows(x, x, ["k"], 64).count() == 0


@pytest.mark.parametrize("width", [8, 64])
def test_last_holding_where_all_hold(spark, width):
    x = spark.range(MANY).selectExpr("'a' as k", "id % 5 as start", "id % 7 + 20 as end")
    points = spark.range(MANY).selectExpr("'a' as k", "id", "id % 3 + 23 as pos")
    got = intervals.last_holding(points, x, ["k"], width, ["id"])
    assert {(r.pos, r.start, r.n) for r in got.groupBy("pos", "start").agg({"id": "count"}).toDF("pos", "start", "n").collect()} == {(23, 4, MANY // 3), (24, 4, MANY // 3), (25, 4, MANY // 3)}


def test_mass_of_gaps_that_touch_very_many_records(spark):
    kinds = "element_at(array(array('GAP'), array('HSat2'), array('ACRO1')), cast(id % 3 + 1 as int))"
    x = spark.range(2 * MANY).selectExpr("'s' as sample", "1 as haplotype", "'c' as contig", "id % 4 as start", "id % 4 + 100 as end", f"{kinds} as parts")
    n = 2 * MANY // 3
    assert {r["class"]: (r.mass, r.gapped, r.unsized) for r in assembly.mass(x).collect()} == {c: (100 * n, 50.0 * n, n) for c in ("HSat2", "ACRO")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_permuted_rows_are_never_broadcast(spark):
    """A table small enough to broadcast isn't so once each row has been dealt anew 99 times."""
    at = spark.range(300).selectExpr("id as family", "id % 3 as g", "id % 2 = 0 as son", "rand(1) as child_value", "rand(2) as father_value", "rand(3) as mother_value")
    assert "BroadcastHashJoin" not in plan(heredity.permuted_slope(at, ["g"], 9)) + plan(heredity.permutation_p(at, "child_value", "father_value", 9)) + plan(heredity.heterogeneity(at, 9))


def test_karyotypes_read_their_lines_once(spark):
    from copyloom.plans import cohorts

    assert not [f for f in cohorts.karyotypes(spark, "/root/testdata/sf0.001").inputFiles() if "lineitem" in f or "orders" in f]


def test_agreement_of_pairs_that_repeat(spark):
    """Three values of x and of y, whose orders are joined a row for each of nine pairs, not for each of 9000."""
    rng = random.Random(8)
    rows = [(k, x, float(rng.choice([1, 2, 5]) * x)) for k in "ab" for x in (rng.choice([1.0, 2.0, 4.0]) for _ in range(4500))]
    got = {r.k: r for r in cohort.agreement(spark.createDataFrame(rows, "k string, x double, y double"), ["k"]).collect()}
    for k in "ab":
        x, y = (pd.Series([r[i] for r in rows if r[0] == k]) for i in (1, 2))
        log = np.log(y / x)
        want = (len(x), log.median(), log.std(), x.corr(y), x.rank().corr(y.rank()))
        assert tuple(got[k])[1:] == pytest.approx(want, rel=1e-9)
    counted = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("a", 9.0, 2)], "k string, v double, n long")
    assert [tuple(r) for r in cohort.medians(counted, ["k"], "v", count="n").collect()] == [("a", 6, 1.5)]
    assert {r.v: r.r for r in cohort.mean_ranks(counted, ["k"], "v", "r", count="n").collect()} == {1.0: 2.0, 2.0: 4.0, 9.0: 5.5}
