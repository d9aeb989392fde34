"""The cohort layer: one table of calibrated copies of all classes, their profiles' components, and the control regions' components, from estimates of samples.

Windows are (sample, class, start, end, gc, cn), cn null where a window isn't usable. A class is calibrated on the samples that have it; what a sample lacks is null in
the table, and lacking() says why.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copyloom.operators import components, intervals, models, tallies
from copyloom.operators.estimate import ANCHOR_GC
from copyloom.session import kept

#: Offsets of a comb that are tried, how near a whole level a sample must be to take part, how many must, and samples that a pin of the scale needs.
OFFSETS, NEAR, TEETH, PINNED = np.arange(-0.03, 0.20125, 0.0025), 0.25, 20, 50
#: Samples that control components need, samples for each component, components beyond those above noise.
CONTROLS, PER_COMPONENT, WRITTEN = 10, 5, 20


@dataclass
class Rule:
    """What a class's calibration is told: intervals that the level leaves out, the copies that most people have (for the pin of the scale), and polymorphic intervals as (name, start, end, offset, gain): the log
    offset of their windows' effects where it isn't found here, and the share of samples that may hold more copies of the interval than of the rest."""

    excluded: list[tuple[int, int]] = field(default_factory=list)
    expected: float | None = None
    polymorphic: list[tuple[str, int, int, float, float]] = field(default_factory=list)


def comb(ratios: DataFrame, keys: list[str], gain: float = 0.15) -> DataFrame:
    """(keys, offset, n): the log offset under which an interval's copies are whole numbers in most samples. ratios: (keys, ratio, level), an interval's estimate over the level, and the level in copies;
    rows may have a gain of their own.

    A sample near N copies whose interval has k of them has ratio k / N, so ratio times N is whole once the interval is right. Each sample meets each offset of a grid; of the offsets at which the mean squared
    distance to whole numbers is least among its neighbours, the smallest that leaves at most `gain` of the samples above their own level is taken (as a copy seldom holds the interval twice), else the
    one of least distance. 0 with fewer than TEETH samples near a whole level."""
    at = ratios if "gain" in ratios.columns else ratios.withColumn("gain", F.lit(gain))
    n = F.round("level")
    at = at.where("ratio is not null and level is not null and not isnan(ratio) and not isnan(level)").withColumn("whole_", n).where((F.abs(F.col("level") - n) < NEAR) & (n > 0))
    grid = at.select(*keys, "whole_", "gain", (F.col("ratio") * F.col("whole_")).alias("held_"), F.posexplode(F.array(*map(F.lit, OFFSETS.tolist()))).alias("k_", "offset"))
    grid = grid.withColumn("held_", F.col("held_") * F.exp(-F.col("offset")))
    far = F.least(F.abs(F.col("held_") - F.round("held_")), F.lit(0.5))
    cost = grid.groupBy(*keys, "k_", "offset").agg(F.avg(far * far).alias("cost_"), F.avg((F.round("held_") > F.col("whole_")).cast("double")).alias("above_"), F.count(F.lit(1)).alias("n"), F.first("gain").alias("gain"))
    order = Window.partitionBy(*keys).orderBy("k_")  # a row for each offset
    low = (F.col("cost_") <= F.coalesce(F.lag("cost_").over(order), F.lit(np.inf))) & (F.col("cost_") < F.coalesce(F.lead("cost_").over(order), F.lit(np.inf)))
    cost = cost.withColumn("good_", low & (F.col("above_") <= F.col("gain")))
    got = cost.groupBy(*keys).agg(F.min(F.when(F.col("good_"), F.col("offset"))).alias("first_"), F.min_by("offset", "cost_").alias("least_"), F.max("n").alias("n"))
    return got.select(*keys, F.when(F.col("n") >= TEETH, F.coalesce("first_", "least_")).otherwise(0.0).alias("offset"), "n")


def checked(windows: DataFrame) -> None:
    """Raises ValueError if a sample is given twice, or the samples of a class have different windows."""
    twice = windows.groupBy("sample", "class", "start").count().where(F.col("count") > 1).select("sample").distinct().limit(5).collect()
    if twice:
        raise ValueError(f"given twice: {', '.join(str(r[0]) for r in twice)}")
    shape = windows.groupBy("class", "sample").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("start", "end").cast("decimal(38,0)")).alias("h"))
    odd = shape.groupBy("class").agg(F.count_distinct("n", "h").alias("k")).where("k > 1").limit(5).collect()
    if odd:
        raise ValueError(f"samples have different windows of {', '.join(str(r[0]) for r in odd)}")


def lacking(windows: DataFrame, samples: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """(sample, class, why) of the classes that a sample has no calibrated copies of. samples: (sample); status: (sample, class, status) where a class may be other than ok."""
    classes = windows.select("class").distinct()
    have = windows.groupBy("sample", "class").agg(F.count_if(F.col("cn") > 0).alias("n"))
    every = samples.select("sample").join(F.broadcast(classes), F.lit(True))  # a row for each class of a sample
    at = every.join(have, ["sample", "class"], "left")
    if status is not None:
        at = at.join(status.select("sample", "class", "status"), ["sample", "class"], "left")
    bad = F.concat(F.lit("status "), "status") if status is not None else F.lit(None).cast("string")
    other = F.when(F.col("status") != "ok", bad) if status is not None else bad
    return at.select("sample", "class", F.coalesce(other, F.when(F.col("n").isNull(), "absent").when(F.col("n") == 0, "no usable window")).alias("why")).where("why is not null")


def fixed_effects(table: DataFrame, windows: DataFrame) -> DataFrame:
    """The saved table of effects (class, start, effect), once it is known to be of these windows; else ValueError says which class is of others."""
    mine = windows.select("class", "start").distinct().withColumn("here_", F.lit(True))
    odd = table.select("class", "start").distinct().withColumn("there_", F.lit(True)).join(mine, ["class", "start"], "full").where("here_ is null or there_ is null")
    odd = odd.join(table.select("class").distinct(), "class", "left_semi").groupBy("class").agg(F.min("start").alias("start")).limit(5).collect()
    if odd:
        raise ValueError("the table was learned on other windows: " + ", ".join(f"{r[0]} from {r[1]} on" for r in odd))
    return table.select("class", F.col("start").alias("window"), "effect")


def calibrated(windows: DataFrame, anchors: DataFrame, rules: dict[str, Rule] | None = None, effects: DataFrame | None = None, unstable: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, offsets): cells are (class, sample, window, level, effect, residual, core), the log level of each sample, the effect of each window kept, and what is left; offsets are what was
    moved, (class, name, offset, n): `scale` for a pin to the mode, and the polymorphic intervals by name. With `effects`, a saved table, only levels are found."""
    rules = rules or {}
    spark = windows.sparkSession
    excluded = spark.createDataFrame([(c, s, e) for c, r in rules.items() for s, e in r.excluded], "class string, start long, end long")
    spots = kept(windows.select("class", "start", "end").distinct(), "spots")
    out = intervals.overlaps(spots, excluded, ["class"], 1 << 14).select("class", "start").distinct().withColumn("out_", F.lit(True))
    held = anchors.select("class", F.col("start").alias("s_"), F.col("end").alias("e_"))
    inside = spots.join(F.broadcast(held), "class").where("s_ <= start and end <= e_").select("class", "start").distinct().withColumn("in_", F.lit(True))  # anchors: some intervals a class
    told = spots.join(out, ["class", "start"], "left").join(inside, ["class", "start"], "left").join(anchors.select("class").distinct().withColumn("has_", F.lit(True)), "class", "left")
    gc = windows.groupBy("class", "start").agg(F.percentile("gc", 0.5).alias("gc"))
    told = told.join(gc, ["class", "start"]).select("class", F.col("start").alias("window"), F.col("end"), F.isnull("out_").alias("core"), (F.isnull("out_") & F.col("gc").between(*ANCHOR_GC) & (F.isnull("has_") | F.col("in_").isNotNull())).alias("anchor"))
    told = kept(told, "window-flags")
    y = windows.select("class", "sample", F.col("start").alias("window"), F.when(F.col("cn") > 0, F.log("cn")).alias("y")).join(told.select("class", "window", "core", "anchor"), ["class", "window"])
    if effects is None:
        fit = models.efficiencies(y.select("class", "sample", "window", "y", F.col("core").alias("level"), "anchor"), ["class"], unstable=unstable)
    else:
        fit = fixed_effects(effects, windows)
    cells = y.where("y is not null").join(kept(fit, "effects").select("class", "window", "effect"), ["class", "window"]).where("effect is not null")
    level = cells.where("core").groupBy("class", "sample").agg(F.percentile(F.col("y") - F.col("effect"), 0.5).alias("level"))
    cells = kept(cells.join(level, ["class", "sample"]).select("class", "sample", "window", "core", "level", "effect", (F.col("y") - F.col("effect") - F.col("level")).alias("residual")), "calibrated")
    moved = spark.createDataFrame([], "class string, name string, offset double, n long")
    if effects is not None:
        return cells, moved
    levels = kept(cells.select("class", "sample", "level").distinct(), "levels")
    n = {r["class"]: r["n"] for r in levels.where(F.col("class").isin(list(rules))).groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each class with a rule
    pins = [c for c, r in rules.items() if r.expected and n.get(c, 0) >= PINNED]
    for c in pins:
        pin = models.mode_pin(levels.where(F.col("class") == c), ["class"], rules[c].expected)
        moved = moved.unionByName(pin.select("class", F.lit("scale").alias("name"), F.col("delta").alias("offset"), F.col("n").cast("long").alias("n")))
    moved = kept(moved, "pins")
    cells = cells.join(F.broadcast(moved.where("name = 'scale'").select("class", F.col("offset").alias("d_"))), "class", "left").withColumn("d_", F.coalesce("d_", F.lit(0.0)))  # a row for each pin
    cells = kept(cells.withColumn("level", F.col("level") - F.col("d_")).withColumn("effect", F.col("effect") + F.col("d_")).drop("d_"), "pinned")
    poly = [(c, name, s, e, o, g, c in pins) for c, r in rules.items() for name, s, e, o, g in r.polymorphic]
    if not poly:
        return cells, moved
    table = F.broadcast(spark.createDataFrame(poly, "class string, name string, s_ long, e_ long, told_ double, gain double, pinned_ boolean"))
    on = cells.join(table, "class").where("s_ <= window and window < e_")
    ratio = on.where("pinned_").groupBy("class", "name", "sample", "gain").agg(F.exp(F.percentile("residual", 0.5)).alias("ratio"), F.exp(F.first("level")).alias("level"))
    found = comb(ratio, ["class", "name"])
    offset = on.select("class", "name", "told_").distinct().join(found, ["class", "name"], "left").select("class", "name", F.coalesce("offset", "told_").alias("offset"), F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))
    offset = kept(offset, "offsets")
    of = on.select("class", "sample", "window", "name").join(F.broadcast(offset.select("class", "name", "offset")), ["class", "name"]).groupBy("class", "sample", "window").agg(F.sum("offset").alias("o_"))
    cells = cells.join(of, ["class", "sample", "window"], "left").withColumn("o_", F.coalesce("o_", F.lit(0.0)))
    return kept(cells.withColumn("effect", F.col("effect") + F.col("o_")).withColumn("residual", F.col("residual") - F.col("o_")).drop("o_"), "offset-cells"), moved.unionByName(offset)


def measured(cells: DataFrame) -> DataFrame:
    """(class, sample, cn, cn_se_rel, profile_sd, cn_unit): a sample's copies, their relative error by the spread of the core's windows, the spread of all windows, and the copies over the whole unit."""
    mid = cells.groupBy("class", "sample").agg(F.percentile("residual", 0.5).alias("mid_"), F.percentile(F.when(F.col("core"), F.col("residual")), 0.5).alias("core_"), F.count_if("core").alias("n_"))
    off = cells.join(mid, ["class", "sample"]).groupBy("class", "sample", "mid_", "level", "n_").agg(
        (1.4826 * F.percentile(F.abs(F.col("residual") - F.col("mid_")), 0.5)).alias("sd_"), (1.4826 * F.percentile(F.when(F.col("core"), F.abs(F.col("residual") - F.col("core_"))), 0.5)).alias("sd_core_")
    )
    return off.select("class", "sample", F.exp("level").alias("cn"), (1.2533 * F.col("sd_core_") / F.sqrt(F.greatest("n_", F.lit(1)))).alias("cn_se_rel"), F.col("sd_").alias("profile_sd"), F.exp(F.col("level") + F.col("mid_")).alias("cn_unit"))


@dataclass
class Cohort:
    """values: (sample, column, value), the table in long form. effects: (class, window, effect, window_sd, samples). offsets: what was moved. lacking: (sample, class, why). controls: (components, edge, written), one row if there are
    enough samples. columns: the table's columns in order."""

    values: DataFrame
    effects: DataFrame
    offsets: DataFrame
    lacking: DataFrame
    controls: DataFrame | None
    columns: list[str]

    def wide(self) -> DataFrame:
        return tallies.wide(self.values, "sample", "column", "value", self.columns)


def cohort_table(windows: DataFrame, controls: DataFrame, anchors: DataFrame, rules: dict[str, Rule] | None = None, effects: DataFrame | None = None, status: DataFrame | None = None, unstable: float | None = None, profile: int = 3) -> Cohort:
    """The whole layer. controls: (sample, region, log_ratio); samples whose regions aren't those that most samples have get no control components. status: (sample, class, status); classes that
    aren't ok are not calibrated for that sample. Raises ValueError if a sample is given twice or windows differ."""
    checked(windows)
    samples = windows.select("sample").union(controls.select("sample")).distinct()
    if status is not None:
        windows = windows.join(status.where("status != 'ok'").select("sample", "class"), ["sample", "class"], "left_anti")
    cells, moved = calibrated(windows, anchors, rules, effects, unstable)
    got = kept(measured(cells), "measured")
    names = ("cn", "cn_se_rel", "profile_sd", "cn_unit")
    values = got.select("sample", F.inline(F.array(*(F.struct(F.concat_ws(".", "class", F.lit(c)).alias("column"), F.col(c).alias("value")) for c in names))))
    classes = [r[0] for r in got.select("class").distinct().orderBy("class").collect()]  # a row for each class
    columns = [f"{c}.{x}" for c in classes for x in names]
    for c in classes:
        mine = cells.where(F.col("class") == c)
        if got.where(F.col("class") == c).count() > profile + 2:
            scores, _ = components.profile_components(mine, profile)
            values = values.unionByName(scores.select("sample", F.concat(F.lit(f"{c}.profilePC"), "component").alias("column"), F.col("score").alias("value")))
            columns += [f"{c}.profilePC{k + 1}" for k in range(profile)]
    # The regions must be the same in all samples that components are taken of.
    ratio = controls.where("log_ratio is not null and not isnan(log_ratio)")
    sets = ratio.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("region").cast("decimal(38,0)")).alias("h"))
    best = sets.groupBy("n", "h").count().orderBy(F.desc("count"), F.desc("n"), "h").first()
    edge = None
    if best is not None and best["count"] >= CONTROLS:
        use = sets.where((F.col("n") == best.n) & (F.col("h") == best.h)).select("sample")
        most = max(best["count"] // PER_COMPONENT, 1)
        scores, found = components.control_components(ratio.join(use, "sample", "left_semi"), most)
        edge = components.noise_edge(found.select("value", F.lit(best["count"]).alias("n"), F.lit(best.n).alias("p")))
        above = edge.first()
        above = above.components if above else 0
        written = min(most, max(2 * above, WRITTEN), best.n)
        values = values.unionByName(scores.where(F.col("component") <= written).select("sample", F.concat(F.lit("ctrlPC"), "component").alias("column"), F.col("score").alias("value")))
        values = values.unionByName(use.select("sample", F.lit("ctrlPC_mp").alias("column"), F.lit(float(above)).alias("value")))
        columns += ["ctrlPC_mp", *(f"ctrlPC{k + 1}" for k in range(written))]
        edge = edge.withColumn("written", F.lit(written))
    mid = cells.groupBy("class", "window").agg(F.percentile("residual", 0.5).alias("mid_"), F.count(F.lit(1)).alias("samples"))
    spread = cells.join(mid, ["class", "window"]).groupBy("class", "window", "samples").agg(F.first("effect").alias("effect"), (1.4826 * F.percentile(F.abs(F.col("residual") - F.col("mid_")), 0.5)).alias("window_sd"))
    return Cohort(values, spread.select("class", "window", "effect", "window_sd", "samples"), moved, lacking(windows, samples, status), edge, columns)
