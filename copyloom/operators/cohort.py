"""Statistics over samples: robust location and scale, sinks, heredity, families."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copyloom.operators import intervals
from copyloom.session import kept


#: Rows up to which a side is broadcast, once they have been counted.
BROADCAST = 100_000
#: Parts of about equal size that a key's different values are dealt to when their order matters.
PARTS = 64


def _parts(counts: DataFrame, keys: list[str], value: str, parts: int) -> DataFrame:
    """Adds part_, the values' range by order, from cuts that are about even."""
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], 10 * parts).alias("cuts_"))
    return counts.join(cuts, keys).withColumn("part_", F.size(F.filter("cuts_", lambda x: x < F.col(value)))).drop("cuts_")


def medians(df: DataFrame, keys: list[str], value: str, parts: int = PARTS, count: str | None = None) -> DataFrame:
    """(keys, n, median) of the values that are neither null nor NaN, exactly, without a buffer or a window of a key's values: equal values are counted first, sums of parts tell in which of them the middle lies, and those alone
    are put in order. A row stands for as many as its count, where that is named."""
    at = df.select(*keys, F.col(value).cast("double").alias(value), (F.lit(1).cast("long") if count is None else F.col(count)).alias("c_")).where(F.col(value).isNotNull() & ~F.isnan(value))
    counts = at.groupBy(*keys, value).agg(F.sum("c_").alias("n_"))
    counts = kept(_parts(counts, keys, value, parts), "value-counts")
    before = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(*keys, "part_").agg(F.sum("n_").alias("sum_")).withColumn("base_", F.coalesce(F.sum("sum_").over(before), F.lit(0))).withColumn("n", F.sum("sum_").over(Window.partitionBy(*keys)))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    holds = lambda rank: (F.col("base_") < rank) & (rank <= F.col("base_") + F.col("sum_"))
    near = counts.join(sums.where(holds(low) | holds(high)), [*keys, "part_"])
    upto = F.col("base_") + F.sum("n_").over(Window.partitionBy(*keys, "part_").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("upto_", upto)
    first = lambda rank: F.min(F.when(F.col("upto_") >= rank, F.col(value)))
    return near.groupBy(*keys, "n").agg(((first(low) + first(high)) / 2).alias("median")).select(*keys, "n", "median")


def robust(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, median, mad_sd): median and 1.4826 times the median deviation, of values that are neither null nor NaN."""
    at = kept(df.select(*keys, value), "robust-values")
    mid = kept(medians(at, keys, value), "medians")
    off = medians(at.join(F.broadcast(mid) if mid.limit(BROADCAST + 1).count() <= BROADCAST else mid, keys).select(*keys, F.abs(F.col(value) - F.col("median")).alias("off_")), keys, "off_")
    return mid.join(off.select(*keys, (F.lit(1.4826) * F.col("median")).alias("mad_sd")), keys).select(*keys, "n", "median", "mad_sd")


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The first value, in order, at which the weights so far reach half of all."""
    at = df.groupBy(*keys, value).agg(F.sum(weight).alias("w_"))
    order = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("so_far_", F.sum("w_").over(order)).withColumn("all_", F.sum("w_").over(Window.partitionBy(*keys)))
    return at.where("so_far_ * 2 >= all_").groupBy(*keys).agg(F.min(value).alias("weighted_median"))


def histogram_mode(df: DataFrame, keys: list[str], value: str, count: str) -> DataFrame:
    """The commonest value; of several, the largest."""
    return df.groupBy(*keys).agg(F.max(F.struct(F.col(count), F.col(value)))[value].alias("mode"))


def noise(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """1.4826 / sqrt(2) times the median deviation of successive differences."""
    step = df.withColumn("d_", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order))).where("d_ is not null")
    mid = robust(step, keys, "d_")
    return mid.select(*keys, (F.col("mad_sd") / F.sqrt(F.lit(2.0))).alias("noise"))


def runs(df: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """Stretches of equal state: keys, state, first, last, n."""
    w = Window.partitionBy(*keys).orderBy(order)
    at = df.withColumn("new_", F.when(F.col(state).eqNullSafe(F.lag(state).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    at = at.withColumn("run_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return at.groupBy(*keys, "run_", state).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("run_")


def learn_sinks(placements: DataFrame, min_frac: float, min_reads: int, coarse: int) -> DataFrame:
    """Bins to read for a class: those whose coarse bin holds max(min_reads, min_frac of the class's reads) in any sample.

    placements: (sample, class, bin, reads)."""
    at = placements.withColumn("coarse", F.floor(F.col("bin") / coarse))
    total = placements.groupBy("sample", "class").agg(F.sum("reads").alias("total"))
    wide = at.groupBy("sample", "class", "coarse").agg(F.sum("reads").alias("reads")).join(total, ["sample", "class"])
    good = wide.where(F.col("reads") >= F.greatest(F.lit(float(min_reads)), F.lit(min_frac) * F.col("total"))).select("class", "coarse").distinct()
    return at.join(good, ["class", "coarse"]).groupBy("class", "bin").agg(F.sum("reads").alias("reads"), F.count_distinct("sample").alias("samples"))


def sink_statistics(placements: DataFrame) -> DataFrame:
    """(class, bin, share_median, share_p10, share_max, rank, cumulative): what share of a class's reads each bin holds over the samples."""
    total = placements.groupBy("sample", "class").agg(F.sum("reads").alias("total"))
    bins = placements.select("class", "bin").distinct()
    every = bins.join(total, "class").join(placements, ["sample", "class", "bin"], "left")
    share = F.coalesce(F.col("reads"), F.lit(0)) / F.col("total")
    at = every.groupBy("class", "bin").agg(F.percentile(share, 0.5).alias("share_median"), F.percentile(share, 0.1).alias("share_p10"), F.max(share).alias("share_max"))
    order = Window.partitionBy("class").orderBy(F.desc("share_median"), F.desc("share_max"), "bin")
    return at.withColumn("rank", F.row_number().over(order)).withColumn("cumulative", F.sum("share_median").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def centred(df: DataFrame, group: str, value: str, least: int = 5) -> DataFrame:
    """The value less its group's mean, or the grand mean in groups with fewer than `least` rows."""
    mean = df.groupBy(group).agg(F.avg(value).alias("mean_"), F.count(value).alias("n_"))
    grand = df.agg(F.avg(value).alias("grand_"))
    at = df.join(mean, group).crossJoin(F.broadcast(grand))  # one row
    return at.withColumn("centred", F.col(value) - F.when(F.col("n_") >= least, F.col("mean_")).otherwise(F.col("grand_"))).drop("mean_", "n_", "grand_")


def centred_chain(df: DataFrame, groups: list[str], value: str, least: int = 5) -> DataFrame:
    """The value less the mean of its group by all of `groups`, or by the first of them alone that has `least` rows, or the grand mean. Rows without a value count nowhere."""
    at, tries = df, [groups, *([g] for g in groups)]
    for k, keys in enumerate(tries):
        mean = df.groupBy(*keys).agg(F.avg(value).alias(f"mean{k}_"), F.count(value).alias(f"n{k}_"))
        at = at.join(mean.withColumnsRenamed({c: f"{c}{k}_" for c in keys}), [at[c].eqNullSafe(F.col(f"{c}{k}_")) for c in keys]).drop(*(f"{c}{k}_" for c in keys))
    at = at.crossJoin(F.broadcast(df.agg(F.avg(value).alias("grand_"))))  # one row
    mean = F.coalesce(*(F.when(F.col(f"n{k}_") >= least, F.col(f"mean{k}_")) for k in range(len(tries))), F.col("grand_"))
    return at.withColumn("centred", F.col(value) - mean).drop("grand_", *(f"{x}{k}_" for k in range(len(tries)) for x in ("mean", "n")))


def trimmed_mean(df: DataFrame, keys: list[str], value: str, z: float = 3.0) -> DataFrame:
    """(keys, mean, kept): the mean of the values within z robust standard deviations of the median."""
    mid = robust(df, keys, value).select(*keys, "median", "mad_sd")
    near = df.join(mid, keys).where(F.abs(F.col(value) - F.col("median")) <= z * F.col("mad_sd"))
    return near.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("kept"))


def level_windows(windows: DataFrame, excluded: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Windows (keys, start, end) that overlap no excluded interval (keys, start, end)."""
    at = intervals.reached(windows, excluded, keys, "reach_", max(width, intervals.RANGE))
    return at.where(~F.coalesce(F.col("reach_") > F.col("start"), F.lit(False))).drop("reach_")


def by_sex(at: DataFrame) -> DataFrame:
    """(child_sex, parent_sex, n, r, z, q, q_all): correlations of children with fathers and mothers by the child's sex, Fisher's z, and Cochran's Q of all pairings' z about their mean weighted
    by n - 3, with each pairing's part. at: (child_value, father_value, mother_value, sex)."""
    both = at.select(F.col("sex").alias("child_sex"), "child_value", F.inline(F.array(F.struct(F.lit("father").alias("parent_sex"), F.col("father_value").alias("p")), F.struct(F.lit("mother").alias("parent_sex"), F.col("mother_value").alias("p")))))
    r = both.groupBy("child_sex", "parent_sex").agg(F.count(F.lit(1)).alias("n"), F.corr("child_value", "p").alias("r")).where("n > 3").withColumn("z", F.atanh("r")).withColumn("w_", F.col("n") - 3)
    mid = r.agg((F.sum(F.col("w_") * F.col("z")) / F.sum("w_")).alias("mid_"))
    q = r.crossJoin(F.broadcast(mid)).withColumn("q", F.col("w_") * (F.col("z") - F.col("mid_")) * (F.col("z") - F.col("mid_")))  # one row
    return q.crossJoin(F.broadcast(q.agg(F.sum("q").alias("q_all")))).select("child_sex", "parent_sex", "n", "r", "z", "q", "q_all")


def trios(people: DataFrame, links: DataFrame, value: str) -> DataFrame:
    """(child, father, mother) and their values, for complete trios. people: (person, value); links: (child, father, mother)."""
    at = links
    for who in ("child", "father", "mother"):
        at = at.join(people.select(F.col("person").alias(who), F.col(value).alias(f"{who}_value")), who)
    return at.where(" and ".join(f"{w}_value is not null" for w in ("child", "father", "mother")))


def transmission(at: DataFrame) -> DataFrame:
    """Point estimates over trios: the slope of the child on the midparent, on each parent, and correlations."""
    mid = (F.col("father_value") + F.col("mother_value")) / 2
    at = at.withColumn("mid", mid)
    return at.agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("child_value", "mid").alias("slope_mid"), F.regr_slope("child_value", "father_value").alias("slope_father"),
        F.regr_slope("child_value", "mother_value").alias("slope_mother"), F.corr("child_value", "mid").alias("corr_mid"), F.corr("father_value", "mother_value").alias("corr_parents"),
        F.stddev_samp(F.col("child_value") - F.col("mid")).alias("sd_residual"),
    )


def _uniform(*what) -> Column:
    """A number in [0, 1) that follows from what it is made of."""
    return F.pmod(F.xxhash64(*what), F.lit(1 << 52)) / float(1 << 52)


def poisson(u: Column) -> Column:
    """A Poisson number of mean 1 from a uniform one."""
    w, upto = F.lit(0), 0.0
    for k in range(12):
        upto += float(np.exp(-1) / np.prod(np.arange(1, k + 1)))
        w = w + F.when(u >= upto, 1).otherwise(0)
    return w


def family_bootstrap(at: DataFrame, x: str, y: str, family: str, times: int = 200, seed: int = 1) -> DataFrame:
    """(slope, se, low, high): the slope of y on x and its spread over `times` resamples of whole families, each drawn a Poisson number of times by a hash; a resample's slope is one
    row's work in a grouped sum."""
    drawn = at.select(family, x, y, F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("r_"))
    drawn = drawn.withColumn("w_", poisson(_uniform(family, "r_", F.lit(seed)))).where("w_ > 0").withColumn("a_", F.col(x).cast("double")).withColumn("b_", F.col(y).cast("double"))
    sums = drawn.groupBy("r_").agg(*(F.sum(F.col("w_") * v).alias(n) for n, v in (("n", F.lit(1.0)), ("a", F.col("a_")), ("b", F.col("b_")), ("ab", F.col("a_") * F.col("b_")), ("aa", F.col("a_") * F.col("a_")))))
    slope = (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / (F.col("aa") - F.col("a") * F.col("a") / F.col("n"))
    spread = sums.select(slope.alias("s")).agg(F.stddev_samp("s").alias("se"), F.percentile("s", 0.025).alias("low"), F.percentile("s", 0.975).alias("high"))
    return at.agg(F.regr_slope(y, x).alias("slope")).crossJoin(spread)  # one row each


def heredity_errors(at: DataFrame, x: str, y: str) -> DataFrame:
    """(n, slope, se): the slope of y on x and its error by squared residuals, each row with its own variance (n / (n - 2))."""
    fit = at.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx_"), F.avg(y).alias("my_"), F.regr_slope(y, x).alias("slope"))
    u = F.col(x) - F.col("mx_")
    e = F.col(y) - F.col("my_") - F.col("slope") * u
    sums = at.crossJoin(F.broadcast(fit)).groupBy("n", "slope").agg(F.sum(u * u).alias("xx_"), F.sum(u * u * e * e).alias("mid_"))  # fit is one row
    return sums.select("n", "slope", (F.sqrt(F.col("mid_") * F.col("n") / (F.col("n") - 2)) / F.col("xx_")).alias("se"))


def mean_ranks(rows: DataFrame, keys: list[str], value: str, name: str, parts: int = PARTS, count: str | None = None) -> DataFrame:
    """(keys, value, name): the rank of each different value in its key; equal values share their mean rank. Values are ordered part by part of
    about equal size, so no window holds a key."""
    at = kept(_parts(rows.groupBy(*keys, value).agg((F.count(F.lit(1)) if count is None else F.sum(count)).alias("n_")), keys, value, parts), "value-counts")
    before = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    base = at.groupBy(*keys, "part_").agg(F.sum("n_").alias("sum_")).withColumn("base_", F.coalesce(F.sum("sum_").over(before), F.lit(0))).drop("sum_")
    inside = Window.partitionBy(*keys, "part_").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("upto_", F.sum("n_").over(inside)).join(base, [*keys, "part_"])
    return at.select(*keys, value, (F.col("base_") + F.col("upto_") - (F.col("n_") - 1) / 2).alias(name))


def agreement(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, log_median, log_sd, pearson, spearman) of pairs (keys, x, y), both above 0. Equal values share their mean rank. Pairs are read once for what sums alone tell,
    and counted by value for what takes order, so that joins and ranges hold a row for each different pair."""
    log = F.log(F.col("y") / F.col("x"))
    pairs = pairs.where("x > 0 and y > 0")
    told = kept(pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(log).alias("log_sd"), F.corr("x", "y").alias("pearson")), "sums")
    at = kept(pairs.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("n_")).withColumn("log_", log), "pair-counts")
    mid = medians(at, keys, "log_", count="n_").select(*keys, F.col("median").alias("log_median"))
    for c in ("x", "y"):
        at = at.join(mean_ranks(at, keys, c, f"rank_{c}", count="n_"), [*keys, c])
    # Ranks have a mean that is known, so their sums of products are taken about it.
    x, y = (F.col(f"rank_{c}") - (F.col("n") + 1) / 2 for c in ("x", "y"))
    at = at.join(F.broadcast(told) if told.limit(BROADCAST + 1).count() <= BROADCAST else told, keys)
    ranks = at.groupBy(*keys).agg(*(F.sum(F.col("n_") * a * b).alias(k) for k, a, b in (("xx_", x, x), ("yy_", y, y), ("xy_", x, y))))
    spread = F.sqrt(F.col("xx_")) * F.sqrt(F.col("yy_"))
    got = told.join(ranks, keys).join(mid, keys)
    return got.select(*keys, "n", "log_median", "log_sd", "pearson", F.when(spread > 0, F.col("xy_") / spread).alias("spearman"))


def adjust(rows: DataFrame, value: str, covariates: list[str]) -> DataFrame:
    """Adds adjusted, the value without its linear part on the covariates (its mean stays), and r2. The sums of products are Spark's;
    the driver solves one equation for each covariate."""
    names = [*covariates, value]
    ok = rows.where(" and ".join(f"`{c}` is not null" for c in names))
    mean = ok.agg(*(F.avg(c).alias(c) for c in names)).first()
    if mean[value] is None:
        return rows.withColumn("adjusted", F.col(value)).withColumn("r2", F.lit(None).cast("double"))
    mid = {c: F.col(c) - mean[c] for c in names}
    sums = ok.agg(*(F.sum(mid[a] * mid[b]).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i)).first()
    m = np.array([[sums[f"{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))])
    beta = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
    part = sum((float(b) * mid[c] for b, c in zip(beta, covariates, strict=True)), F.lit(0.0))
    r2 = float(beta @ m[:-1, -1] / m[-1, -1]) if m[-1, -1] else 0.0
    return rows.withColumn("adjusted", F.col(value) - part).withColumn("r2", F.lit(r2))


def present(rows: DataFrame, keys: list[str], share: float = 0.9) -> DataFrame:
    """(keys, window, present): windows with a value in at least `share` of the samples that have any. rows: (keys, sample, window, y)."""
    have = rows.where(F.col("y").isNotNull() & ~F.isnan("y"))
    samples = have.groupBy(*keys).agg(F.count_distinct("sample").alias("samples_"))
    at = have.groupBy(*keys, "window").agg(F.count_distinct("sample").alias("n_")).join(samples, keys)
    return at.select(*keys, "window", (F.col("n_") / F.col("samples_")).alias("present")).where(F.col("present") >= share)


def ranked(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def capture_curve(rows: DataFrame) -> DataFrame:
    """(class, rank, median, p10): what share of a class's reads the intervals up to a rank hold, over samples. rows: (sample, class, rank, share),
    each rank there for each sample."""
    order = Window.partitionBy("class", "sample").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    at = rows.withColumn("sum_", F.sum("share").over(order))
    return at.groupBy("class", "rank").agg(F.percentile("sum_", 0.5).alias("median"), F.percentile("sum_", 0.1).alias("p10"))


def capture_bound(statistics: DataFrame, kept: DataFrame) -> DataFrame:
    """(class, bound): what is captured at least if only the kept ranks are read: the full capture less the largest shares of the others, or
    the curve at the longest prefix of ranks that is kept whole, whichever is more. statistics: (class, rank, share_max, curve); kept: (class, rank)."""
    at = statistics.join(kept.select("class", "rank", F.lit(True).alias("kept_")).distinct(), ["class", "rank"], "left").withColumn("kept_", F.coalesce("kept_", F.lit(False)))
    first = at.groupBy("class").agg(F.min(F.when(~F.col("kept_"), F.col("rank"))).alias("gap_"), F.max_by("curve", "rank").alias("full_"), F.sum(F.when(~F.col("kept_"), F.col("share_max")).otherwise(0.0)).alias("lost_"))
    curve = at.join(first, "class").groupBy("class", "full_", "lost_").agg(F.max(F.when(F.col("gap_").isNull() | (F.col("rank") < F.col("gap_")), F.struct("rank", "curve")))["curve"].alias("prefix_"))
    return curve.select("class", F.greatest(F.col("full_") - F.col("lost_"), F.coalesce("prefix_", F.lit(0.0))).alias("bound"))


def families(links: DataFrame, folder: str) -> DataFrame:
    """(person, family) of everyone in links (child, father, mother): people who share a trio, or are tied by others, are one family, named by its
    smallest person. Each round, a family takes the smallest name next to it and names point to their own name's name; it is written to the folder, which all
    executors must share, so that a round doesn't repeat those before it."""
    spark = links.sparkSession
    at = links.select("child", F.explode(F.array("father", "mother")).alias("parent")).where("child is not null and parent is not null and child != parent")
    at.select(F.col("child").alias("a"), F.col("parent").alias("b")).distinct().write.parquet(f"{folder}/edges")
    ties = spark.read.parquet(f"{folder}/edges")
    both = ties.unionByName(ties.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both.groupBy(F.col("a").alias("person")).agg(F.least(F.first("a"), F.min("b")).alias("family")).write.parquet(f"{folder}/0")
    k = 0
    while True:
        names = spark.read.parquet(f"{folder}/{k}")
        near = both.join(names.toDF("b", "family"), "b").groupBy(F.col("a").alias("person")).agg(F.min("family").alias("near_"))
        met = names.join(near, "person").select("person", F.col("family").alias("was_"), F.least("family", "near_").alias("low_"))
        low = met.groupBy(F.col("was_").alias("old_")).agg(F.min("low_").alias("low_"))
        nxt = met.select("person", "was_").join(low, F.col("was_") == F.col("old_")).select("person", "was_", F.col("low_").alias("family"))
        jump = names.toDF("family", "jump_")
        nxt = nxt.join(jump, "family", "left").select("person", "was_", F.least("family", F.coalesce("jump_", "family")).alias("family"))
        k += 1
        nxt.write.parquet(f"{folder}/{k}-changed")
        done = spark.read.parquet(f"{folder}/{k}-changed")
        if done.where("was_ != family").isEmpty():
            return done.select("person", "family")
        done.select("person", "family").write.parquet(f"{folder}/{k}")
