import itertools

import numpy as np
import pytest

from copyloom.operators import fractions


def exhaustive(y, w, x, sd, copies, apart, every, tau, height):
    """Steps by refitting all designs with a general solver."""
    def loglik(cuts):
        ends = [0, *cuts, len(y)]
        a = np.column_stack([*(((np.arange(len(y)) >= s) & (np.arange(len(y)) < e)).astype(float) for s, e in zip(ends[:-1], ends[1:], strict=True)), x])
        p = np.diag([0.0] * (len(ends) - 1) + [1 / s**2 for s in sd])
        b = np.linalg.solve((a * w[:, None]).T @ a + p, a.T @ (w * y))
        r = y - a @ b
        return -0.5 * (w * r * r).sum() - 0.5 * b @ p @ b, b[: len(ends) - 1]

    places = list(range(apart, len(y) - apart + 1, every))
    cuts, now = [], loglik([])[0]
    free = lambda c: all(b - a >= apart for a, b in itertools.pairwise(c))
    tall = lambda c, new, lv: all(copies * abs(np.exp(lv[c.index(p) + 1]) - np.exp(lv[c.index(p)])) >= height for p in new)
    while True:
        tried = [(*loglik(sorted([*cuts, p])), sorted([*cuts, p]), [p]) for p in places if p not in cuts and free(sorted([*cuts, p]))]
        best = max(tried, key=lambda t: t[0], default=None)
        if best and best[0] - now >= tau and tall(best[2], best[3], best[1]):
            now, cuts = best[0], best[2]
            continue
        pairs = [(*loglik(sorted([*cuts, *p])), sorted([*cuts, *p]), list(p)) for p in itertools.combinations(places[::2], 2) if not set(p) & set(cuts) and free(sorted([*cuts, *p]))]
        best = max(pairs, key=lambda t: t[0], default=None)
        if not best or best[0] - now < 2 * tau or not tall(best[2], best[3], best[1]):
            return cuts
        now, cuts = best[0], best[2]


@pytest.mark.parametrize("seed", range(8))
def test_steps_equal_exhaustive_search(seed):
    rng = np.random.default_rng(seed)
    n = 120
    t = np.linspace(-0.5, 0.5, n)
    gc = rng.normal(0, 0.05, n)
    y = rng.normal(0, 0.03, n) + 0.02 * t + 0.1 * gc
    if seed % 4:
        lo, hi = sorted(rng.integers(15, 105, 2))
        y[lo : hi if seed % 2 else n] += np.log(1 + 0.05 * (1 + seed % 3))
    w = np.where(rng.random(n) < 0.1, 0, 1 / 0.03**2)
    x = np.column_stack([t, gc])
    got = fractions.steps(fractions.Sums(y, w, x, np.array([0.03, 0.2])), 10.0, (), 8.0, 0.25, 12, 4)
    assert got == exhaustive(y, w, x, [0.03, 0.2], 10.0, 12, 4, 8.0, 0.25)


def test_fits_equal_a_general_solver():
    rng = np.random.default_rng(9)
    y, w, x = rng.normal(size=50), rng.uniform(0.5, 2, 50), rng.normal(size=(50, 2))
    levels, beta, _ = fractions.Sums(y, w, x, np.array([0.5, 2.0])).fit([[10, 30]])
    a = np.column_stack([np.repeat(np.eye(3), [10, 20, 20], 0), x])
    want = np.linalg.solve((a * w[:, None]).T @ a + np.diag([0, 0, 0, 4, 0.25]), a.T @ (w * y))
    assert np.allclose(np.r_[levels[0], beta[0]], want, atol=1e-6)


def cohort(spark, n, seed, planted, windows=240):
    rng = np.random.default_rng(seed)
    place = (np.arange(windows) + 0.5) / windows - 0.5
    gc = rng.uniform(0.4, 0.6, windows)
    rows, calls = [], []
    for i in range(n):
        state = np.full(windows, 10)
        level = state * np.exp(rng.normal(0, 0.01) + rng.normal(0, 0.02) * place + rng.normal(0, 0.05) * (gc - 0.5))
        for sample, lo, hi, copies in planted:
            if sample == i:
                level[lo:hi] *= 1 + copies / 10
        value = level + rng.normal(0, 0.5, windows)
        value[rng.random(windows) < 0.1] = np.nan
        rows += [(i, k, float(v), int(s)) for k, (v, s) in enumerate(zip(value, state, strict=True))]
        calls.append((i, 10, False, 0.5, 1.0, 0.0))
    return (
        spark.createDataFrame(rows, "sample long, window long, value double, state long").repartition(4), spark.createDataFrame(calls, "sample long, copies long, uncertain boolean, sigma double, scale double, tilt double"),
        spark.createDataFrame([(k, float(place[k]), 1.0, float(gc[k])) for k in range(windows)], "window long, place double, rel double, gc double"),
    )


def test_planted_fractions_are_found(spark):
    planted = [(3, 100, 240, 1.2), (11, 60, 130, -0.6), (20, 0, 240, 0.9)]
    args = cohort(spark, 70, 1, planted)
    levels, found = fractions.find(*args, apart=30, every=5)
    steps = {(r.sample, r.first, r.last): r for r in found.collect()}
    assert {s for s, _, _ in steps} == {3, 11}
    (a,), (b,) = ([r for r in steps.values() if r.sample == s] for s in (3, 11))
    edge = {a.first, a.last + 1} - {0, 240}
    assert abs(abs(a.offset) - 1.2) < 0.3 and abs(edge.pop() - 100) <= 15 and abs(a.z) >= 4
    assert abs(b.first - 60) <= 15 and abs(b.last - 129) <= 15 and abs(b.offset + 0.6) < 0.2
    by = {r.sample: r for r in levels.collect()}
    assert len(by) == 70 and by[20].off_z > 5 and abs(by[20].off - 0.9) < 0.3 and sum(abs(r.off_z) >= 5 for r in by.values()) == 1
    got = {r.sample: r.status for r in fractions.statuses(levels, found, args[1]).collect()}
    assert {s for s, v in got.items() if v == "fractional"} == {3, 11, 20}


def test_no_steps_without_a_cohort(spark):
    levels, found = fractions.find(*cohort(spark, 20, 2, [(3, 100, 240, 0.9)]), apart=30, every=5)
    assert not found.count() and levels.count() == 20 and levels.first().spread == fractions.SCALE_SD
    nothing = [x.limit(0) for x in cohort(spark, 1, 3, [])]
    levels, found = fractions.find(*nothing)
    assert not levels.count() and not found.count()
