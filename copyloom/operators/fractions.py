"""Steps and levels of a fraction of a copy along a unit, judged against a cohort.

A profile's log over its called whole numbers is fitted by a level for each stretch and smooth terms (place along the unit, and GC) beside them. What a fit needs of a stretch
are differences of running sums, so all places for one more step, or a pair, are tried at once. A step stands if the sample's contrast across it is far out among the
same contrast in the other samples, which one join of the cells with the contrast's weights gives for all samples together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.session import kept

#: Gain of a fit that a step must bring; copies it is high, windows apart and from an end; windows between places that are tried; steps at most.
TAU, HEIGHT, APART, EVERY, MOST = 16.0, 0.25, 100, 10, 6
#: Deviations at which a step, and a level, is off; samples that a cohort needs; deviations beyond which a window is drawn in; spreads of scale and lean without a cohort.
STEP_Z, LEVEL_Z, LEAST, CAP, SCALE_SD, LEAN_SD = 4.0, 5.0, 50, 3.5, 0.02, 0.03


class Sums:
    """Running sums of w, w y and w x of a profile (y, weights w, smooth terms x), and the priors of the terms about none."""

    def __init__(self, y: np.ndarray, w: np.ndarray, x: np.ndarray, sd: np.ndarray):
        self.n, self.q = len(y), x.shape[1]
        self.sums = np.concatenate([np.zeros((1, 2 + self.q)), np.cumsum(np.column_stack([w, w * y, w[:, None] * x]), 0)])
        self.xx, self.xy = (x * w[:, None]).T @ x + np.diag(1 / np.asarray(sd) ** 2), x.T @ (w * y)

    def fit(self, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Levels, coefficients and gains of many fits at once; a row of cuts, in order, has the windows at which new stretches begin. Levels are eliminated from the normal equations."""
        cuts = np.atleast_2d(np.asarray(cuts, np.int64))
        ends = np.column_stack([np.zeros(len(cuts), np.int64), cuts, np.full(len(cuts), self.n)])
        d = np.diff(self.sums[ends], axis=1)
        w, m, v = d[..., 0] + 1e-9 * max(self.sums[-1, 0], 1.0), d[..., 1], d[..., 2:]
        a = self.xx - np.einsum("csi,csj,cs->cij", v, v, 1 / w)
        b = self.xy - np.einsum("csi,cs->ci", v, m / w)
        beta = np.linalg.solve(a, b[..., None])[..., 0]
        return (m - np.einsum("csi,ci->cs", v, beta)) / w, beta, ((m * m / w).sum(1) + (b * beta).sum(1)) / 2


def steps(sums: Sums, copies: float, also=(), tau: float = TAU, height: float = HEIGHT, apart: int = APART, every: int = EVERY, most: int = MOST) -> list[int]:
    """The windows at which the profile steps. The step that improves the fit most is added as long as it brings tau and is high enough; where no single one does, a pair that brings twice as much, for a
    stretch inside. Steps keep `apart` from the ends and each other; they are tried at every few windows and at those of `also`."""
    places = np.unique([p for p in [*range(apart, sums.n - apart + 1, every), *also] if apart <= p <= sums.n - apart]).astype(np.int64)
    thin = np.unique([*places[::2], *(p for p in also if apart <= p <= sums.n - apart)]).astype(np.int64)
    cuts = np.zeros(0, np.int64)
    gain = sums.fit(cuts.reshape(1, 0))[2][0]

    def best(tries: np.ndarray) -> tuple[float, np.ndarray, np.ndarray] | None:
        tries = np.sort(np.column_stack([np.tile(cuts, (len(tries), 1)), tries]), 1)
        tries = tries[(np.diff(tries, axis=1) >= apart).all(1)] if tries.shape[1] > 1 else tries
        if not len(tries):
            return None
        levels, _, gains = sums.fit(tries)
        k = int(np.argmax(gains))
        return gains[k], tries[k], levels[k]

    def high(row: np.ndarray, levels: np.ndarray) -> bool:
        new = ~np.isin(row, cuts)
        return bool((copies * np.abs(np.diff(np.exp(levels)))[new] >= height).all())

    while len(cuts) < most and len(places):
        one = best(places[:, None])
        if one is not None and one[0] - gain >= tau and high(one[1], one[2]):
            gain, cuts = one[0], one[1]
            continue
        i, j = np.triu_indices(len(thin), 1)
        two = best(np.column_stack([thin[i], thin[j]])) if len(cuts) + 2 <= most else None
        if two is None or two[0] - gain < 2 * tau or not high(two[1], two[2]):
            break
        gain, cuts = two[0], two[1]
    return cuts.tolist()


def _centre_spread(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    mid = df.groupBy(*keys).agg(F.percentile(x, 0.5).alias("mid_"), F.count(x).alias("n_"))
    both = df.join(mid, keys) if keys else df.crossJoin(F.broadcast(mid))  # without keys, one row
    return both.groupBy(*keys, "mid_", "n_").agg((1.4826 * F.percentile(F.abs(F.col(x) - F.col("mid_")), 0.5)).alias("spread_"))


def relative(profiles: DataFrame, calls: DataFrame, windows: DataFrame) -> DataFrame:
    """(sample, window, y, w, state): each window's log over its called whole number, drawn in to CAP of its own deviations of the sample's median, and its weight, 0 where nothing is called or read.

    profiles: (sample, window, value, state); calls: (sample, sigma, scale, tilt), a window's noise in copies and the profile's scale and lean; windows: (window, place, rel), place from -1/2 to 1/2, rel a
    window's noise against the others'."""
    at = profiles.join(calls.select("sample", "sigma", "scale", "tilt"), "sample").join(F.broadcast(windows.select("window", "place", "rel")), "window")  # the windows of one unit
    ok = F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") > 0) & (F.col("state") > 0)
    at = at.withColumn("y_", F.when(ok, F.log(F.col("value") / F.col("state")))).withColumn("r_", F.col("sigma") * F.coalesce("rel", F.lit(1.0)) / (F.greatest("state", F.lit(1)) * F.col("scale") * F.exp(F.col("tilt") * F.col("place"))))
    at = at.join(at.groupBy("sample").agg(F.coalesce(F.percentile("y_", 0.5), F.lit(0.0)).alias("mid_")), "sample")
    y = F.coalesce(F.least(F.greatest("y_", F.col("mid_") - CAP * F.col("r_")), F.col("mid_") + CAP * F.col("r_")), F.col("mid_"))
    return at.select("sample", "window", y.alias("y"), F.when(F.col("y_").isNotNull(), 1 / (F.col("r_") * F.col("r_"))).otherwise(0.0).alias("w"), "state")


def _design(windows: pd.DataFrame) -> np.ndarray:
    """The smooth terms: place, and GC where windows differ in it."""
    x = windows[["place"]].to_numpy(float)
    gc = windows.gc.to_numpy(float) if "gc" in windows else np.zeros(len(windows))
    mid = np.average(gc, weights=windows.w) if windows.w.sum() > 0 else 0.0
    return np.column_stack([x, gc - mid]) if np.average((gc - mid) ** 2, weights=windows.w if windows.w.sum() > 0 else None) > 1e-8 else x


def find(profiles: DataFrame, calls: DataFrame, windows: DataFrame, tau: float = TAU, height: float = HEIGHT, apart: int = APART, every: int = EVERY, step_z: float = STEP_Z, least: int = LEAST, spread: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(levels, steps) of one class's samples. levels: (sample, ratio, off, off_z, spread), the level over its whole number, how many copies it is off, and in deviations of the cohort's scales (or of `spread`,
    without a cohort). steps: (sample, first, last, state, offset, z, windows), stretches a fraction of a copy off the number called there.

    profiles, and windows with gc as well if known, as for relative(), the polymorphic windows left out of both; calls also have copies and uncertain. Fewer than `least` samples are no cohort: no steps are looked
    for. The windows of one unit, some thousands at most, are brought to each task."""
    spark = profiles.sparkSession
    cells = kept(relative(profiles, calls, windows), "relative")
    kind = profiles.schema["sample"].dataType.simpleString()
    none = spark.createDataFrame([], f"sample {kind}, first long, last long, state long, offset double, z double, windows long")
    quiet = calls.where("not uncertain").select("sample")
    n = cells.select("sample").distinct().count()
    typical = cells.groupBy("window").agg(F.percentile("w", 0.5).alias("w"))
    told = windows.join(typical, "window").orderBy("place", "window").toPandas()  # one unit's windows
    judged = n >= least and len(told) >= 2 * apart and told.w.sum() > 0
    if not len(told):
        return spark.createDataFrame([], f"sample {kind}, ratio double, off double, off_z double, spread double"), none
    x = _design(told) if judged else told[["place"]].to_numpy(float)
    prior = np.full(x.shape[1], LEAN_SD)
    if judged:
        # The terms' priors are the cohort's own spreads of them, from a fit of every sample with the same weights and no prior.
        a = np.column_stack([np.ones(len(told)), x]) * np.sqrt(told.w.to_numpy())[:, None]
        weights = np.linalg.lstsq(a, np.diag(np.sqrt(told.w.to_numpy())), rcond=None)[0][1:]
        table = spark.createDataFrame(pd.DataFrame({"window": told.window, "b": weights.T.tolist()}), f"window {windows.schema['window'].dataType.simpleString()}, b array<double>")
        terms = cells.join(F.broadcast(table), "window").join(quiet, "sample").groupBy("sample").agg(*(F.sum(F.col("b")[k] * F.col("y")).alias(f"t{k}") for k in range(x.shape[1])))
        found = [_centre_spread(terms, [], f"t{k}").first() for k in range(x.shape[1])]
        prior = np.array([max(f.spread_ if f else 0.0, 0.005 if k == 0 else 1e-6) for k, f in enumerate(found)])
    order = {w: k for k, w in enumerate(told.window)}
    copies = calls.select("sample", "copies")

    def fitted(cut_of: DataFrame | None) -> DataFrame:
        """(sample, cuts, levels, states): the search where no cuts are given, else the fit of those."""

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            at = pdf.window.map(order).to_numpy()
            y, w, state = np.zeros(len(told)), np.zeros(len(told)), np.full(len(told), np.nan)
            y[at], w[at], state[at] = pdf.y, pdf.w, pdf.state.where(pdf.state > 0)
            sums = Sums(y, w, x, prior)
            if "cuts" in pdf:
                cuts = list(pdf.cuts.iloc[0])
            else:
                known = np.where(np.isnan(state), -1, state)
                also = (np.flatnonzero(np.diff(known)) + 1).tolist()
                mid = pdf.copies.iloc[0]
                cuts = steps(sums, float(np.nanmedian(state) if mid is None or np.isnan(mid) else mid), also, tau, height, apart, every) if judged else []
            levels = sums.fit(np.array(cuts, np.int64).reshape(1, -1))[0][0]
            parts = np.split(state, cuts)
            return pd.DataFrame([{"sample": pdf["sample"].iloc[0], "cuts": cuts, "levels": levels.tolist(), "states": [int(np.nanmedian(p)) if not np.isnan(p).all() else 0 for p in parts]}])

        rows = cells.join(copies, "sample") if cut_of is None else cells.join(cut_of, "sample")
        return kept(rows.groupBy("sample").applyInPandas(one, f"sample {kind}, cuts array<long>, levels array<double>, states array<long>"), "fitted")

    fits = fitted(None)
    stands = None
    while judged:
        # The stretch whose level puts the scale nearest one is what the others are set against.
        with_cuts = fits.where("size(cuts) > 0").withColumn("ref", F.expr("array_position(transform(levels, x -> abs(x)), array_min(transform(levels, x -> abs(x)))) - 1"))
        if with_cuts.isEmpty():
            stands = None
            break

        def contrast(batches):
            """(sample, stretch, window, b): the weights that give a sample's contrast of a stretch with the reference from its windows."""
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    ends = [0, *row.cuts, len(told)]
                    a = np.column_stack([*(np.eye(len(ends) - 1)[np.repeat(np.arange(len(ends) - 1), np.diff(ends))].T), x])
                    w = told.w.to_numpy()
                    p = np.r_[np.full(len(ends) - 1, 1e-9 * max(w.sum(), 1.0)), 1 / prior**2]
                    b = np.linalg.solve((a * w[:, None]).T @ a + np.diag(p), (a * w[:, None]).T)
                    for j in range(len(ends) - 1):
                        if j != row.ref:
                            yield pd.DataFrame({"owner": row.sample, "stretch": j, "window": told.window, "b": b[j] - b[row.ref]})

        weights = with_cuts.select("sample", "cuts", "ref").mapInPandas(contrast, f"owner {kind}, stretch long, window {windows.schema['window'].dataType.simpleString()}, b double")
        seen = kept(cells.join(weights, "window").groupBy("owner", "stretch", "sample").agg(F.sum(F.col("b") * F.col("y")).alias("c")), "contrasts")
        others = _centre_spread(seen.where("sample != owner").join(quiet, "sample"), ["owner", "stretch"], "c")
        z = seen.where("sample = owner").join(others, ["owner", "stretch"]).select(F.col("owner").alias("sample"), "stretch", F.when(F.col("spread_") > 0, (F.col("c") - F.col("mid_")) / F.col("spread_")).otherwise(0.0).alias("z"))
        rows = with_cuts.join(z, "sample").withColumn("state", F.col("states")[F.col("stretch").cast("int")])
        offset = F.col("state") * (F.exp(F.col("levels")[F.col("stretch").cast("int")] - F.col("levels")[F.col("ref").cast("int")]) - 1)
        rows = kept(rows.withColumn("offset", offset).withColumn("ends_", F.concat(F.array(F.lit(0).cast("long")), "cuts", F.array(F.lit(len(told)).cast("long")))).withColumn("from_", F.col("ends_")[F.col("stretch").cast("int")]).withColumn("to_", F.col("ends_")[(F.col("stretch") + 1).cast("int")])
                    .where((F.abs("z") >= step_z) & (F.abs("offset") >= height)), "standing")
        keep = rows.groupBy("sample").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.array("from_", "to_"), lambda v: (v > 0) & (v < len(told))))))).alias("keep"))
        again = with_cuts.select("sample", "cuts").join(keep, "sample", "left").select("sample", "cuts", F.coalesce("keep", F.array().cast("array<long>")).alias("keep")).where("cuts != keep")
        stands = rows
        if again.isEmpty():
            break
        fits = kept(fits.join(again.select("sample"), "sample", "left_anti").unionByName(fitted(again.select("sample", F.col("keep").alias("cuts")))), "refitted")
    nearest = F.expr("element_at(levels, int(array_position(transform(levels, x -> abs(x)), array_min(transform(levels, x -> abs(x))))))")
    level = kept(fits.select("sample", nearest.alias("l")).join(calls.select("sample", "copies", "uncertain"), "sample"), "levels")
    at = _centre_spread(level.where("not uncertain"), [], "l").first() if judged else None
    own = at is not None and at.n_ >= least and at.spread_ > 0
    mid, sd = (at.mid_, at.spread_) if own else (0.0, float(spread or SCALE_SD))
    levels = level.select("sample", F.exp("l").alias("ratio"), (F.col("copies") * (F.exp(F.col("l") - mid) - 1)).alias("off"), ((F.col("l") - mid) / sd).alias("off_z"), F.lit(sd).alias("spread"))
    if stands is None:
        return levels, none
    names = F.array(*map(F.lit, told.window.tolist()))
    return levels, stands.select("sample", names[F.col("from_").cast("int")].cast("long").alias("first"), names[(F.col("to_") - 1).cast("int")].cast("long").alias("last"), F.col("state").cast("long").alias("state"), "offset", "z", (F.col("to_") - F.col("from_")).alias("windows"))


def statuses(levels: DataFrame, found: DataFrame, calls: DataFrame, level_z: float = LEVEL_Z) -> DataFrame:
    """(sample, status): uncertain as called; fractional if the level or a stretch is off its whole number; else settled."""
    has = found.select("sample").distinct().withColumn("step_", F.lit(True))
    at = calls.select("sample", "uncertain").join(levels.select("sample", "off_z"), "sample", "left").join(has, "sample", "left")
    return at.select("sample", F.when(F.col("uncertain"), "uncertain").when(F.col("step_") | (F.abs("off_z") >= level_z), "fractional").otherwise("settled").alias("status"))
