"""Reliabilities from trios: point estimates, resampled families, two measures compared under the same resamples, and permutation tests.

Every estimate follows from sums of values and products over trios, so Spark adds these up once a family; a resample weights the families' sums, and
two measures of the same trios are weighted alike. Permutations give each row a place by hash, in ranges, so that no window holds all rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from copyloom.operators.cohort import _uniform, poisson
from copyloom.session import kept

#: What is estimated, in the order of columns.
MEASURES = ("spousal_r", "slope_mid", "slope_father", "slope_mother", "r_mid", "reliability_mid", "reliability_single", "reliability_mendel", "sd_ratio", "reliability_rescaled", "mean_ratio")
#: Ranges of hashes that rows are dealt to when they are placed in a random order.
RANGES = 256
_WHO = ("child", "father", "mother")


def _sums(suffix: str = "_value", name: str = "") -> list[Column]:
    """Sums of the three values and their six products, of trios whose values are child_value and so on."""
    v = {w[0]: F.col(f"{w}{suffix}").cast("double") for w in _WHO}
    return [F.sum(v[a] * v[b] if b else v[a]).alias(f"{name}{a}{b}_") for a, b in (("c", ""), ("f", ""), ("m", ""), ("c", "c"), ("f", "f"), ("m", "m"), ("c", "f"), ("c", "m"), ("f", "m"))]


_SUMS = ("c_", "f_", "m_", "cc_", "ff_", "mm_", "cf_", "cm_", "fm_")


def _measures(name: str = "") -> dict[str, Column]:
    """The estimates from n_ and the sums; null where a spread is 0."""
    n = F.col("n_").cast("double")
    s = {k: F.col(name + k) for k in _SUMS}
    cov = lambda a, b: s[f"{a}{b}_"] / n - s[f"{a}_"] / n * (s[f"{b}_"] / n)
    positive = lambda x: F.when(x > 0, x)
    cc, ff, mm, fm = positive(cov("c", "c")), positive(cov("f", "f")), positive(cov("m", "m")), cov("f", "m")
    mid, with_mid = positive((cov("f", "f") + cov("m", "m") + 2 * fm) / 4), (cov("c", "f") + cov("c", "m")) / 2
    parents = (s["f_"] + s["m_"]) / (2 * n)
    v = positive((s["ff_"] + s["mm_"]) / (2 * n) - parents * parents) * (2 * n) / (2 * n - 1)
    d = (cov("c", "c") + (cov("f", "f") + cov("m", "m") + 2 * fm) / 4 - 2 * with_mid) * n / (n - 1)
    rho, b, bf, bm = fm / F.sqrt(ff * mm), with_mid / mid, cov("c", "f") / ff, cov("c", "m") / mm
    ratio = F.sqrt(cc * n / (n - 1) / v)
    return {
        "spousal_r": rho, "slope_mid": b, "slope_father": bf, "slope_mother": bm, "r_mid": with_mid / F.sqrt(mid * cc), "reliability_mid": b - rho * (1 - b), "reliability_single": bf + bm - rho,
        "reliability_mendel": 1.5 - d / v, "sd_ratio": ratio, "reliability_rescaled": b / ratio * (1 + rho) - rho, "mean_ratio": s["c_"] / n / positive(parents),
    }


def _whole(at: DataFrame, suffixes: tuple[str, ...] = ("_value",)) -> DataFrame:
    return at.where(" and ".join(f"{w}{s} is not null and not isnan({w}{s})" for s in suffixes for w in _WHO))


def reliabilities(at: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, MEASURES) of complete trios (keys, child_value, father_value, mother_value): from the midparent slope corrected for the parents'
    correlation, from the slopes on single parents, and from the children's spread about the midparent against the parents' (Mendel)."""
    keys = keys or []
    return _whole(at).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"), *_sums()).select(*keys, F.col("n_").alias("n"), *(x.alias(k) for k, x in _measures().items()))


def _resampled(families: DataFrame, keys: list[str], names: list[str], times: int, seed: int) -> DataFrame:
    """(keys, r_, n_, sums): the families' sums added up, each family weighted by a Poisson draw of its own in each resample."""
    drawn = families.withColumn("r_", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("w_", poisson(_uniform("family", "r_", F.lit(seed)))).where("w_ > 0")
    return drawn.groupBy(*keys, "r_").agg(*(F.sum(F.col("w_") * F.col(c)).alias(c) for c in ("n_", *names)))


def intervals_of(at: DataFrame, keys: list[str] | None = None, times: int = 300, seed: int = 1) -> DataFrame:
    """(keys, measure, low, high): percentile intervals of MEASURES over resamples of whole families. at: (keys, family, the three values)."""
    keys = keys or []
    families = kept(_whole(at).groupBy(*keys, "family").agg(F.count(F.lit(1)).alias("n_"), *_sums()), "families")
    draws = _resampled(families, keys, list(_SUMS), times, seed).where("n_ > 2").select(*keys, F.inline(F.array(*(F.struct(F.lit(k).alias("measure"), x.alias("x")) for k, x in _measures().items()))))
    return draws.groupBy(*keys, "measure").agg(F.percentile("x", 0.025).alias("low"), F.percentile("x", 0.975).alias("high"))


def compared(at: DataFrame, keys: list[str] | None = None, times: int = 300, seed: int = 1, least: int = 20) -> DataFrame:
    """(keys, n, families, delta, low, high, p_better): how much more reliable (by midparent) measure a is than measure b, from trios with whole values of
    both (child_a, ..., mother_b), and its interval over resamples in which both have the same families. Null with fewer than `least` trios, and
    p_better where a resample has no reliability."""
    keys = keys or []
    names = [f"{x}{k}" for x in "ab" for k in _SUMS]
    families = kept(_whole(at, ("_a", "_b")).groupBy(*keys, "family").agg(F.count(F.lit(1)).alias("n_"), *_sums("_a", "a"), *_sums("_b", "b")), "families")
    delta = _measures("a")["reliability_mid"] - _measures("b")["reliability_mid"]
    seen = families.groupBy(*keys).agg(F.count(F.lit(1)).alias("families"), *(F.sum(c).alias(c) for c in ("n_", *names))).select(*keys, F.col("n_").alias("n"), "families", delta.alias("delta")).where(F.col("n") >= least)
    draws = _resampled(families, keys, names, times, seed).select(*keys, delta.alias("d")).groupBy(*keys).agg(
        F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"), F.when(F.count("d") == F.count(F.lit(1)), F.avg((F.col("d") > 0).cast("double"))).alias("p_better")
    )
    return seen.join(draws, keys) if keys else seen.crossJoin(F.broadcast(draws))  # one row each


def placed(rows: DataFrame, keys: list[str], order: Column, ties: list[str], name: str) -> DataFrame:
    """Adds each row's place (from 1) among those of its keys by `order`, a long that is spread over all its range: places before a range of it come from
    counts, those within from a window of the range."""
    at = rows.withColumn("o_", order).withColumn("range_", F.expr(f"cast(floor((o_ / 18446744073709551616D + 0.5D) * {RANGES}) as int)"))
    count = at.groupBy(*keys, "range_").agg(F.count(F.lit(1)).alias("k_"))
    before = Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    count = count.select(*keys, "range_", F.coalesce(F.sum("k_").over(before), F.lit(0)).alias("before_"))
    inside = Window.partitionBy(*keys, "range_").orderBy("o_", *ties)
    # Sizes are told from tables before explode() makes a row of each for each permutation, so the sides are never to be broadcast.
    return at.join(count.hint("merge"), [*keys, "range_"]).withColumn(name, F.col("before_") + F.row_number().over(inside)).drop("o_", "range_", "before_")


def permutation_p(at: DataFrame, x: str, y: str, times: int = 199, seed: int = 1) -> DataFrame:
    """(r, p): the correlation of x and y, and how often it is as far from 0 when y is dealt anew: the k-th row by one hash gets the y of the k-th by another."""
    both = kept(at.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.monotonically_increasing_id().alias("i_"), F.col(x).cast("double").alias("x_"), F.col(y).cast("double").alias("y_")), "pairs")
    every = both.withColumn("r_", F.explode(F.sequence(F.lit(1), F.lit(times))))
    side = lambda c, s: placed(every.select("r_", "i_", c), ["r_"], F.xxhash64("i_", "r_", F.lit(s)), ["i_"], "k_").drop("i_")
    dealt = side("x_", seed).join(side("y_", seed + 1).hint("merge"), ["r_", "k_"]).groupBy("r_").agg(F.corr("x_", "y_").alias("c_"))
    seen = both.agg(F.corr("x_", "y_").alias("r"))
    return dealt.crossJoin(F.broadcast(seen)).groupBy("r").agg(((F.count_if(F.abs("c_") >= F.abs("r")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))  # seen is one row


def permuted_slope(at: DataFrame, strata: list[str] | None = None, times: int = 199, seed: int = 1) -> DataFrame:
    """(n, slope, null_mean, null_sd, p): the slope of children on midparents, and how often one as large arises when children are dealt anew to the
    families of their stratum. at: (strata, the three values); rows are told apart by a number of their own."""
    strata = strata or []
    both = kept(_whole(at).select(F.monotonically_increasing_id().alias("i_"), *strata, F.col("child_value").cast("double").alias("y_"), ((F.col("father_value") + F.col("mother_value")) / 2).alias("x_")), "dealt")
    every = both.withColumn("r_", F.explode(F.sequence(F.lit(1), F.lit(times))))
    side = lambda c, s: placed(every.select("r_", "i_", *strata, c), ["r_", *strata], F.xxhash64("i_", "r_", F.lit(s)), ["i_"], "k_").drop("i_")
    null = side("x_", seed).join(side("y_", seed + 1).hint("merge"), ["r_", *strata, "k_"]).groupBy("r_").agg(F.regr_slope("y_", "x_").alias("s_"))
    seen = both.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y_", "x_").alias("slope"))
    got = null.crossJoin(F.broadcast(seen)).groupBy("n", "slope")  # seen is one row
    return got.agg(F.avg("s_").alias("null_mean"), F.stddev_pop("s_").alias("null_sd"), ((F.count_if(F.col("s_") >= F.col("slope")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


@F.pandas_udf(DoubleType())
def chi2_tail3(x: pd.Series) -> pd.Series:
    """The upper tail of chi-square with 3 degrees of freedom."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)) + math.sqrt(2 * v / math.pi) * math.exp(-v / 2) if v == v else None)


def _spread_of_pairings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, q): Cochran's Q of the Fisher z of the correlations of sons and daughters with fathers and mothers, each weighted by its pairs less 3."""
    sides = [(F.when(F.col("son") == s, F.col(f"{p}_value")), F.when(F.col("son") == s, F.col("child_value"))) for p in ("father", "mother") for s in (True, False)]
    got = rows.groupBy(*keys).agg(*(F.atanh(F.least(F.greatest(F.coalesce(F.corr(x, y), F.lit(0.0)), F.lit(-0.999999)), F.lit(0.999999))).alias(f"z{k}") for k, (x, y) in enumerate(sides)), *(F.count(y).alias(f"n{k}") for k, (_, y) in enumerate(sides)))
    w = [F.col(f"n{k}") - 3 for k in range(4)]
    mid = sum((w[k] * F.col(f"z{k}") for k in range(4)), F.lit(0.0)) / sum(w, F.lit(0))
    return got.select(*keys, sum((w[k] * (F.col(f"z{k}") - mid) * (F.col(f"z{k}") - mid) for k in range(4)), F.lit(0.0)).alias("q"))


def heterogeneity(at: DataFrame, times: int = 199, seed: int = 1) -> DataFrame:
    """(n, q, p, p_normal): whether the four pairings of children and parents by sex correlate alike. In each permutation the children's sexes are dealt anew and
    the parents of a family swap roles or not. at: (family, son, the three values); p_normal takes Q for chi-square with 3 degrees of freedom."""
    rows = kept(_whole(at).where("son is not null").select(F.monotonically_increasing_id().alias("i_"), "family", F.col("son").cast("boolean").alias("son"), *(f"{w}_value" for w in _WHO)), "pairings")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("son").alias("sons_"))
    dealt = placed(rows.withColumn("r_", F.explode(F.sequence(F.lit(1), F.lit(times)))), ["r_"], F.xxhash64("i_", "r_", F.lit(seed)), ["i_"], "k_").crossJoin(F.broadcast(total))  # one row
    swap = _uniform("i_", "r_", F.lit(seed + 1)) < 0.5
    pick = lambda a, b: F.when(swap, F.col(a)).otherwise(F.col(b))
    dealt = dealt.select("r_", (F.col("k_") <= F.col("sons_")).alias("son"), "child_value", pick("mother_value", "father_value").alias("father_value"), pick("father_value", "mother_value").alias("mother_value"))
    null = _spread_of_pairings(dealt, ["r_"]).select(F.col("q").alias("q_"))
    seen = _spread_of_pairings(rows, []).crossJoin(F.broadcast(total))  # one row each
    got = null.crossJoin(F.broadcast(seen)).groupBy("n", "q").agg(((F.count_if(F.col("q_") >= F.col("q")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
    return got.select("n", "q", "p", chi2_tail3("q").alias("p_normal"))
