"""Chromosomes in copies, from single-copy regions: whole chromosomes, arms and stretches.

Cells are (sample, region, log_ratio), the log of observed over expected. A model, learned on a cohort, has for each region its efficiency and spread and its
loadings on modes that the libraries share. A sample is scored on the modes by what the regions of a chromosome do relative to each other, so that a whole
chromosome gained or lost leaves the scores alone; each chromosome is set against the line that the others' levels follow in GC, itself left out; along it, a chain
over levels in copies finds stretches. What is off its whole number is left out of the next round's level and scores, until the set is stable.

All samples go through each step together: cells, chromosomes, places and stretches are tables, and small kernels take one sample's scores, one sample's line, or one chromosome's places.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copyloom.operators import components
from copyloom.session import kept

#: Pieces less than GAP apart are one place, no longer than SPAN; regions of a chromosome, places of an arm, and places of a stretch at least.
GAP, SPAN, LEAST, ARM, SHORTEST = 50_000, 150_000, 3, 5, 4
#: The chain: cost of a change of level, step of levels, deviations beyond which a place counts as this far, highest level, and the share of the reference below which noise falls no further.
TAU, STEP, CAP, HIGHEST, DIM = 14.0, 0.05, 4.0, 5.0, 0.1
#: Deviations at which a level is off its whole number, copies that it must be off as well, error that is too wide to tell; deviations at which a value has no say.
OFF_Z, OFF, WIDE, FAR = 5.0, 0.03, 0.10, 5.0
#: Rounds of reading; learning: values beyond so many deviations are pulled in, components for so many samples, spread at which a region isn't used, share on one chromosome that is no library's.
ROUNDS, CLIP, MODES, PER_MODE, LOUD, LOCAL_SHARE = 5, 4.0, 20, 20, 3.0, 0.5
#: Readings that count as one copy, two copies.
ONE, TWO = (0.75, 1.25), (1.70, 2.20)

REGION = r"^([^:]+):([0-9]+)-([0-9]+)$"
AUTOSOMES = [f"chr{i}" for i in range(1, 23)]


def _places(pdf: pd.DataFrame) -> pd.DataFrame:
    """Numbers the places of one chromosome's regions in order."""
    pdf = pdf.sort_values(["start", "end"], ignore_index=True)
    place, first, last, out = -1, 0, None, []
    for s, e in zip(pdf.start, pdf.end, strict=True):
        if last is None or s - last > GAP or e - first > SPAN:
            place, first = place + 1, s
        last = e
        out.append(place)
    return pdf.assign(place=out)


def layout(names: DataFrame, arms: DataFrame) -> DataFrame:
    """(region, chrom, start, end, arm, kind, place) of the regions in names (region, like chr1:100-200): its arm by arms (chrom, border), null if not known; A on an
    autosome, X, Y; the place along the chromosome. Other names are left out."""
    at = names.select("region").distinct().where(F.col("region").rlike(REGION))
    at = at.select("region", F.regexp_extract("region", REGION, 1).alias("chrom"), F.regexp_extract("region", REGION, 2).cast("long").alias("start"), F.regexp_extract("region", REGION, 3).cast("long").alias("end"))
    kind = F.when(F.col("chrom").isin(AUTOSOMES), "A").when(F.col("chrom") == "chrX", "X").when(F.col("chrom") == "chrY", "Y")
    at = at.withColumn("kind", kind).where("kind is not null").join(F.broadcast(arms.select("chrom", "border")), "chrom", "left")  # a row for each chromosome
    at = at.select("region", "chrom", "start", "end", F.when((F.col("start") + F.col("end")) / 2 < F.col("border"), "p").when(F.col("border").isNotNull(), "q").alias("arm"), "kind")
    return at.groupBy("chrom").applyInPandas(_places, "region string, chrom string, start long, end long, arm string, kind string, place long")


@dataclass
class Model:
    """regions: (region, chrom, start, end, arm, kind, place, a, sd, v, u): log efficiency at two copies (one on X and Y), spread, loadings, what a second X reads of the first. spread: the variances of
    scores. errors: (key, phi, floor), by chromosome, or chrX:2 for a sex chromosome at two; the factor on a level's error and its floor at the reference. gc: (chrom, gc), for the line."""

    regions: DataFrame
    spread: list[float]
    errors: DataFrame
    gc: DataFrame
    info: dict = field(default_factory=dict)


def _scorer(spread: list[float]):
    k = len(spread)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        """One sample's level, scores with their covariance, and noise, from its autosomal regions that are on their whole numbers."""
        head = {"sample": pdf["sample"].iloc[0]}
        base = pdf[(pdf.kind == "A") & ~pdf.off]
        base = pdf[pdf.kind == "A"] if len(base) < 20 else base
        if len(base) < 20:
            return pd.DataFrame([], columns=["sample", "level", "noise", "scores", "cov"])
        e, sd, chrom = base.e.to_numpy(), base.sd.to_numpy(), pd.factorize(base.chrom)[0]
        v, w = np.array(base.v.tolist(), float).reshape(len(base), k), 1 / sd**2
        order = np.argsort(e)
        level = e[order][np.searchsorted(np.cumsum(w[order]), w.sum() / 2)]
        d, mid = e - level, np.array([np.median((e - level)[chrom == c]) for c in range(chrom.max() + 1)])
        limit = CLIP * max(0.5, _mad(d / sd)) * sd
        d = mid[chrom] + np.clip(d - mid[chrom], -limit, limit)
        mean = lambda x: np.bincount(chrom, w * x) / np.bincount(chrom, w)
        use = np.bincount(chrom)[chrom] >= LEAST
        x, y = (v - np.stack([mean(c) for c in v.T], 1)[chrom])[use] if k else v[use], (d - mean(d)[chrom])[use]
        cov = np.linalg.inv((x * w[use, None]).T @ x + np.diag(1 / np.array(spread))) if k else np.zeros((0, 0))
        scores = cov @ ((x * w[use, None]).T @ y)
        noise = max(0.5, _mad((e - level - v @ scores) / sd))
        return pd.DataFrame([head | {"level": level, "noise": noise, "scores": scores.tolist(), "cov": cov.reshape(-1).tolist()}])

    return score


def _mad(x: np.ndarray) -> float:
    return float(1.4826 * np.median(np.abs(x - np.median(x))))


def _line(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each chromosome of a sample, what the line through the other autosomes' levels over GC says of it, and that value's variance. Levels far off the line lose their say."""
    fit = (pdf.kind == "A").to_numpy() & np.isfinite(pdf.gc.to_numpy(float)) & np.isfinite(pdf.mu.to_numpy(float))
    x = np.stack([np.ones(len(pdf)), pdf.gc.to_numpy(float) - pdf.gc.to_numpy(float)[fit].mean() if fit.any() else np.zeros(len(pdf))], 1)
    out = pdf[["sample", "chrom"]].assign(tilt=0.0, tilt_var=0.0)
    if fit.sum() < 8:
        return out
    mu, se = pdf.mu.to_numpy(float), pdf.se.to_numpy(float)
    weight = np.where(fit, 1.0, 0.0)
    solve = lambda w: np.linalg.solve((x[fit] * w[fit, None]).T @ x[fit] + 1e-12 * np.eye(2), (x[fit] * w[fit, None]).T @ mu[fit])
    beta = np.array([np.median(mu[fit]), 0.0])
    for step in range(40):
        z = np.where(fit, np.abs(mu - x @ beta) / se, np.inf)
        weight = np.minimum(1, 1.5 / np.maximum(z, 1e-12))
        if step >= 10:
            hard = np.maximum(0, 1 - (z / 4.685) ** 2) ** 2
            weight = hard if (hard > 0).sum() >= max(8, fit.sum() // 2) else weight
        new = solve(np.where(fit, weight / se**2, 0))
        still, beta = np.abs(new - beta).max() < 1e-9, new
        if still and step > 10:
            break
    w = np.where(fit, weight / se**2, 0)
    for k in range(len(pdf)):
        rest = np.where(np.arange(len(pdf)) == k, 0, w)
        if np.isfinite(x[k, 1]) and (rest > 0).sum() >= 3:
            inverse = np.linalg.inv((x[fit] * rest[fit, None]).T @ x[fit] + 1e-12 * np.eye(2))
            out.iloc[k, 2] = x[k] @ inverse @ ((x[fit] * rest[fit, None]).T @ mu[fit])
            out.iloc[k, 3] = x[k] @ inverse @ x[k]
    return out


def near_mean(x: np.ndarray, sd: np.ndarray, at: float) -> tuple[float, float, int]:
    """The weighted mean of the values within FAR deviations of it, from `at` on, its error, and how many values are further; the nearest half where none is near."""
    for _ in range(8):
        z = np.abs(x - at) / sd
        near = z <= FAR if (z <= FAR).any() else z <= np.median(z)
        w = np.where(near, 1 / sd**2, 0)
        new = float((w * x).sum() / w.sum())
        if new == at:
            break
        at = new
    return at, float(1 / np.sqrt(w.sum())), int((~near).sum())


def chain(x: np.ndarray, sd: np.ndarray, ref: float, tau: float = TAU) -> np.ndarray:
    """The cheapest path of levels through places: half their capped squared deviations, by noise that grows with the root of the level, and tau for each change."""
    levels = np.arange(0, HIGHEST + STEP / 2, STEP)
    grow = np.sqrt(np.maximum(levels, DIM * ref) / ref)
    cost = 0.5 * np.minimum(np.abs(x[:, None] - levels) / (sd[:, None] * grow), CAP) ** 2 + np.log(grow)
    total, back = cost[0], np.zeros(cost.shape, np.int32)
    for i in range(1, len(x)):
        low = int(np.argmin(total))
        back[i] = np.where(total[low] + tau < total, low, np.arange(len(levels)))
        total = np.minimum(total, total[low] + tau) + cost[i]
    path = [int(np.argmin(total))]
    for i in range(len(x) - 1, 0, -1):
        path.append(back[i, path[-1]])
    return levels[np.array(path[::-1])]


def cut(x: np.ndarray, sd: np.ndarray, ref: float, tau: float = TAU) -> list[tuple[int, int, float, float, int]]:
    """(first, last, level, error, places too far) of the stretches of one chromosome's places: runs of the chain, the closest neighbours joined as long as their levels don't differ by what a change costs,
    or one of them is too short."""

    def level(s: int, e: int) -> tuple[float, float, int]:
        mid = float(np.median(x[s:e]))
        return near_mean(x[s:e], sd[s:e] * np.sqrt(max(mid, DIM * ref) / ref), mid)

    path = chain(x, sd, ref, tau) if len(x) >= 2 * SHORTEST else np.zeros(len(x))
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(x)]
    found = [level(s, e) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
    while len(found) > 1:
        size = np.diff(cuts)
        gap = np.array([(a[0] - b[0]) ** 2 / (a[1] ** 2 + b[1] ** 2) for a, b in zip(found[:-1], found[1:], strict=True)])
        short = np.minimum(size[:-1], size[1:]) < SHORTEST
        k = int(np.argmin(np.where(short, gap - 1e12, gap)))
        if not short[k] and gap[k] > 2 * tau:
            break
        del cuts[k + 1]
        found[k : k + 2] = [level(cuts[k], cuts[k + 1])]
    return [(s, e - 1, *f) for s, e, f in zip(cuts[:-1], cuts[1:], found, strict=True)]


def _stretches(tau: float):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        """The stretches of a sample's chromosomes."""
        pdf = pdf.sort_values(["chrom", "place"])
        chrom, place, x, sd, ref = (pdf[c].to_numpy() for c in ("chrom", "place", "x", "sd", "ref"))
        edges = [0, *(np.flatnonzero(chrom[1:] != chrom[:-1]) + 1).tolist(), len(chrom)]
        rows = [(chrom[s], place[s + a], place[s + b], *rest) for s, e in zip(edges[:-1], edges[1:], strict=True) for a, b, *rest in cut(x[s:e], sd[s:e], float(ref[s]), tau)]
        return pd.DataFrame(rows, columns=["chrom", "first", "last", "copies", "se", "far"]).assign(sample=pdf["sample"].iloc[0])[["sample", "chrom", "first", "last", "copies", "se", "far"]]

    return one


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _rounded(x: Column, most: int) -> Column:
    return F.least(F.greatest(F.floor(x + 0.5), F.lit(0)), F.lit(most))


@dataclass
class Readings:
    """samples: (sample, level, noise, complement, karyotype, status). chromosomes: (sample, chrom, copies, se, se0, mean, whole, off, z, status, places, far, tilt). stretches: (sample, chrom, start,
    end, span, copies, se, places). events: stretches off what is expected, with delta, z, full (in every cell), label. off: (sample, region) of the regions in them."""

    samples: DataFrame
    chromosomes: DataFrame
    stretches: DataFrame
    events: DataFrame
    off: DataFrame


def _weighted(df: DataFrame, keys: list[str], x: str, sd: str) -> DataFrame:
    """(keys, n, x, w, ww): the weighted mean of the values within FAR deviations of their median (of all, if none is), and sums of weights and of their squares."""
    mid = df.groupBy(*keys).agg(F.percentile(x, 0.5).alias("mid_"))
    at = df.join(mid, keys).withColumn("near_", F.abs(F.col(x) - F.col("mid_")) <= FAR * F.col(sd)).withColumn("w_", 1 / (F.col(sd) * F.col(sd)))
    some = lambda v: F.coalesce(F.sum(F.when(F.col("near_"), v)), F.sum(v))
    return at.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (some(F.col("w_") * F.col(x)) / some(F.col("w_"))).alias("x"), some(F.col("w_")).alias("w"), some(F.col("w_") * F.col("w_")).alias("ww"))


def _dealt(df: DataFrame) -> DataFrame:
    """Rows by sample over all cores: a sample has few rows and much work, so partitions must not be joined for their size."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, "sample")


def _round(at: DataFrame, model: Model, tau: float, local: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored, chromosomes, stretches) of one round: at has the cells with their regions' model, e, and off."""
    scored = kept(_dealt(at).groupBy("sample").applyInPandas(_scorer(model.spread), f"sample {at.schema['sample'].dataType.simpleString()}, level double, noise double, scores array<double>, cov array<double>"), "scores")
    base = F.when(F.col("kind") == "A", F.col("level")).otherwise(F.col("level") - float(np.log(2)))
    rest = kept(at.join(scored.drop("cov"), "sample").select("sample", "region", "chrom", "kind", "place", "arm", "start", "end", "off", "sd", "u", "noise", (F.col("e") - base - _dot("v", "scores")).alias("r")), "residuals")
    on = rest.where("kind = 'A' and not off").withColumn("s_", F.col("sd") * F.col("noise"))
    levels = _weighted(on, ["sample", "chrom"], "r", "s_").where(F.col("n") >= LEAST)
    errors = F.broadcast(model.errors)  # a row for each chromosome
    levels = levels.join(errors, F.col("chrom") == F.col("key"), "left").withColumn("se", F.sqrt(F.pow(F.greatest(F.coalesce("phi", F.lit(1.0)), F.lit(1.0)), 2) / F.col("w") + F.pow(F.coalesce("floor", F.lit(0.0)) / 2, 2)))
    every = rest.select("sample", "chrom", "kind").distinct().join(levels.select("sample", "chrom", F.col("x").alias("mu"), "se"), ["sample", "chrom"], "left").join(F.broadcast(model.gc), "chrom", "left")
    lines = kept(_dealt(every).groupBy("sample").applyInPandas(_line, f"sample {at.schema['sample'].dataType.simpleString()}, chrom string, tilt double, tilt_var double"), "lines")
    u = F.coalesce("u", F.lit(1.0))
    r = F.exp(F.col("r") - F.col("tilt"))
    x = F.when(F.col("kind") == "A", 2 * r).when(F.col("kind") == "X", 1 + (r - 1) / u).otherwise(r)
    wide = F.col("sd") * F.col("noise") * F.when(F.col("kind") == "A", F.lit(2.0)).when(F.col("kind") == "X", 1 / u).otherwise(F.lit(1.0))
    cells = rest.join(lines, ["sample", "chrom"]).select("sample", "chrom", "place", F.when(F.col("kind") == "A", 2.0).otherwise(1.0).alias("ref"), x.alias("c"), wide.alias("s"))
    spots = _weighted(cells, ["sample", "chrom", "ref", "place"], "c", "s")
    shared = F.pow(F.lit(local) * F.col("ref"), 2) * (1 - F.col("ww") / (F.col("w") * F.col("w")))  # what pieces of one place share isn't known better by having more of them
    spots = kept(spots.select("sample", "chrom", "ref", "place", "x", F.sqrt(1 / F.col("w") + shared).alias("sd")), "places")
    enough = spots.groupBy("sample", "chrom").count().where(F.col("count") >= LEAST).drop("count")
    found = kept(_dealt(spots.join(enough, ["sample", "chrom"])).groupBy("sample").applyInPandas(_stretches(tau), f"sample {at.schema['sample'].dataType.simpleString()}, chrom string, first long, last long, copies double, se double, far long"), "cuts")
    # The scores' and the line's share of a level's error.
    k = len(model.spread)
    mean = model.regions.groupBy("chrom", "kind").agg(F.array(*(F.sum(F.col("v")[i] / (F.col("sd") * F.col("sd"))) / F.sum(1 / (F.col("sd") * F.col("sd"))) for i in range(k))).cast("array<double>").alias("vm"))
    mean = mean.select("chrom", "kind", F.flatten(F.transform("vm", lambda a: F.transform("vm", lambda b: a * b))).alias("outer"))
    got = found.join(F.broadcast(mean), "chrom").join(scored.select("sample", "noise", "cov"), "sample").join(lines, ["sample", "chrom"])  # mean: a row for each chromosome
    ref = F.when(F.col("kind") == "A", 2.0).otherwise(1.0)
    more = F.pow(F.greatest(F.col("copies"), DIM * ref), 2) * (F.col("noise") * F.col("noise") * _dot("outer", "cov") + F.col("tilt_var"))
    stretches = got.select("sample", "chrom", "kind", ref.alias("ref"), "first", "last", "copies", F.sqrt(F.col("se") * F.col("se") + more).alias("se0"), "far", "tilt")
    # Where places lie: a breakpoint is midway between the places on both sides.
    where = rest.groupBy("sample", "chrom", "place").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("arm").alias("arm"))
    inside = stretches.join(where, ["sample", "chrom"]).where("place between first and last")
    size = inside.groupBy(*stretches.columns).agg(F.count(F.lit(1)).alias("places"), F.count_if(F.col("arm") == "p").alias("p_"), F.count_if(F.col("arm") == "q").alias("q_"), F.min("start").alias("start"), F.max("end").alias("end"))
    per, order = Window.partitionBy("sample", "chrom"), Window.partitionBy("sample", "chrom").orderBy("first")
    size = size.withColumn("s_", F.coalesce(F.floor((F.col("start") + F.lag("end").over(order)) / 2), F.col("start"))).withColumn("e_", F.coalesce(F.floor((F.col("end") + F.lead("start").over(order)) / 2), F.col("end")))
    size = size.drop("start", "end").withColumnsRenamed({"s_": "start", "e_": "end"})
    arm = lambda mine, other: (F.sum(mine).over(per) > 0) & (F.sum(other).over(per) > 0) & (F.col(mine) >= F.greatest(F.sum(mine).over(per) - 1, 0.9 * F.sum(mine).over(per))) & (F.col(other) <= F.greatest(F.lit(1.0), 0.1 * F.sum(other).over(per)))
    first, last = F.col("first") == F.min("first").over(per), F.col("last") == F.max("last").over(per)
    span = F.when(first & last, "whole").when(arm("p_", "q_"), "p").when(arm("q_", "p_"), "q").when(first & (F.col("p_") > 0), "pter").when(last & (F.col("q_") > 0), "qter").otherwise("inner")
    size = size.withColumn("span", span).withColumn("mean", F.sum(F.col("copies") * (F.col("end") - F.col("start") + 1)).over(per) / F.sum(F.col("end") - F.col("start") + 1).over(per))
    size = size.withColumn("expected", F.when(F.col("kind") == "A", 2).otherwise(_rounded(F.col("mean"), 4)))
    # Sex chromosomes have errors by whole number; what the cohort held too few of takes those of the nearest it had.
    keys = [F.when(F.col("kind") == "A", F.col("chrom")).otherwise(F.concat_ws(":", "chrom", n)) for n in (F.col("expected"), F.least(F.col("expected"), F.lit(2)), F.lit(1))]
    for i, key in enumerate(keys):
        size = size.withColumn("ask_", key).join(F.broadcast(model.errors.toDF("ask_", f"phi{i}", f"floor{i}")), "ask_", "left").drop("ask_")
    phi, floor = (F.coalesce(*(F.col(f"{c}{i}") for i in range(3)), F.lit(d)) for c, d in (("phi", 1.0), ("floor", 0.0)))
    size = size.withColumn("se", F.sqrt(F.pow(F.col("se0") * F.greatest(phi, F.lit(1.0)), 2) + F.pow(floor * F.greatest(F.col("copies"), DIM * F.col("ref")) / F.col("ref"), 2)))
    size = size.withColumn("whole", _rounded(F.col("copies"), 6)).withColumn("off", F.col("copies") - F.col("whole")).withColumn("delta", F.col("copies") - F.col("expected"))
    beyond = lambda d: (F.abs(F.col(d)) >= OFF) & (F.abs(F.col(d)) >= OFF_Z * F.col("se"))
    size = size.withColumn("part", beyond("off")).withColumn("event", (~F.col("part") & (F.col("whole") != F.col("expected"))) | (F.col("part") & beyond("delta")))
    size = size.withColumn("main", F.row_number().over(per.orderBy(F.desc("places"), "first")) == 1).withColumn("all_places", F.sum("places").over(per)).withColumn("all_far", F.sum("far").over(per))
    stretches = kept(size.drop(*(f"{c}{i}" for c in ("phi", "floor") for i in range(3)), "p_", "q_"), "stretches")
    status = F.when((F.col("se") > WIDE), "uncertain").when(F.col("part"), "fractional").when((F.col("all_far") >= 2) & (F.col("all_far") >= 0.15 * F.col("all_places")), "uncertain").otherwise("settled")
    chromosomes = stretches.where("main").select("sample", "chrom", "copies", "se", "se0", "mean", "whole", "off", (F.col("off") / F.col("se")).alias("z"), status.alias("status"), F.col("all_places").alias("places"), F.col("all_far").alias("far"), "tilt")
    return scored, chromosomes, stretches


def read(cells: DataFrame, model: Model, tau: float = TAU, local: float = 0.0, rounds: int = ROUNDS) -> Readings:
    """Reads every sample of cells (sample, region, log_ratio) against the model. Regions it doesn't know, nulls and NaNs are left out; a sample with fewer than 20 autosomal regions isn't read, nor is a
    chromosome with fewer than LEAST places. `local` is the deviation (log) that the pieces of one place share."""
    known = model.regions.where("a is not null and sd > 0")
    at = cells.where("log_ratio is not null and not isnan(log_ratio)").join(known, "region").withColumn("e", F.col("log_ratio") - F.col("a")).drop("log_ratio")
    at = kept(at, "read-cells")
    off = at.limit(0).select("sample", "region")
    for _ in range(rounds):
        marked = at.join(off.withColumn("off", F.lit(True)), ["sample", "region"], "left").withColumn("off", F.coalesce("off", F.lit(False)))
        scored, chromosomes, stretches = _round(marked, model, tau, local)
        hit = stretches.where("event").select("sample", "chrom", "first", "last")
        new = kept(at.select("sample", "region", "chrom", "place").join(hit, ["sample", "chrom"]).where("place between first and last").select("sample", "region").distinct(), "off")
        if new.join(off, ["sample", "region"], "left_anti").isEmpty():
            break
        off = kept(new.unionByName(off).distinct(), "off")
    events = stretches.where("event").withColumn("full", ~F.col("part"))
    name = F.substring("chrom", 4, 9)
    places = F.concat(F.lit("("), F.format_string("%.0f-%.0f", F.col("start") / 1e6, F.col("end") / 1e6), F.lit("Mb)"))
    where = F.concat(name, F.when(F.col("span") == "whole", "").when(F.col("span").isin("p", "q"), F.col("span")).otherwise(places))
    sign = F.when(F.col("delta") > 0, "+").otherwise("-")
    label = F.when(F.col("full"), F.array_join(F.array_repeat(F.concat(sign, where), F.greatest(F.lit(1), F.round(F.abs("delta")).cast("int"))), ",")).otherwise(F.concat(sign, where, F.format_string("[%.2f]", F.abs("delta"))))
    events = events.select("sample", "chrom", "kind", "start", "end", "span", "copies", "se", "delta", (F.col("delta") / F.col("se")).alias("z"), "full", "places", label.alias("label"))
    of = lambda c, n: F.max(F.when(F.col("chrom") == c, _rounded(F.col("mean"), n)))
    sexes = chromosomes.groupBy("sample").agg(F.coalesce(of("chrX", 5), F.lit(0)).alias("x_"), F.coalesce(of("chrY", 4), F.lit(0)).alias("y_"), F.max((F.col("chrom") == "chrX").cast("int")).alias("has_x"), *(F.max((F.col("status") == s).cast("int")).alias(s) for s in ("fractional", "uncertain")))
    told = F.col("kind").isin("X", "Y") & F.col("full") & (F.col("span") == "whole")  # the letters say it
    number = F.when(F.col("kind") == "A", F.substring("chrom", 4, 9).cast("int")).otherwise(0)
    listed = events.groupBy("sample").agg(
        F.array_sort(F.collect_list(F.when(~told, F.struct(number.alias("n"), "chrom", "start", "label")))).alias("events_"),
        F.coalesce(F.sum(F.when(F.col("full") & (F.col("span") == "whole") & (F.col("kind") == "A"), F.round("delta").cast("long"))), F.lit(0)).alias("more_"), F.max((~F.col("full")).cast("int")).alias("part_"),
    )
    got = scored.select("sample", "level", "noise").join(sexes, "sample").join(listed, "sample", "left")
    complement = F.concat(F.repeat(F.lit("X"), F.col("x_").cast("int")), F.repeat(F.lit("Y"), F.col("y_").cast("int")))
    count = (44 + F.coalesce("more_", F.lit(0)) + F.length(complement)).cast("string")
    karyotype = F.when(F.col("has_x") == 1, F.array_join(F.concat(F.array(count, complement), F.coalesce(F.transform("events_", lambda x: x["label"]), F.array().cast("array<string>"))), ","))
    status = F.when((F.col("fractional") == 1) | (F.col("part_") == 1), "fractional").when(F.col("uncertain") == 1, "uncertain").otherwise("settled")
    samples = got.select("sample", "level", "noise", F.when(F.col("has_x") == 1, complement).alias("complement"), karyotype.alias("karyotype"), status.alias("status"))
    return Readings(samples, chromosomes, stretches.select("sample", "chrom", "start", "end", "span", "copies", "se", "places"), events, off)


def _regressed(k: int):
    def solve(batches):
        """(region, coefficients) from the sums of products of each region, with 1 and the scores."""
        for pdf in batches:
            g = np.array(pdf.g.tolist(), float).reshape(-1, k + 1, k + 1)
            b = np.array(pdf.b.tolist(), float).reshape(-1, k + 1, 1)
            got = np.linalg.solve(g + 1e-9 * np.eye(k + 1), b)[:, :, 0] if len(pdf) else np.zeros((0, k + 1))
            got[g[:, 0, 0] <= k + 3] = 0
            yield pd.DataFrame({"region": pdf.region, "coefficients": list(got)})

    return solve


def fit(cells: DataFrame, regions: DataFrame, gc: DataFrame, modes: int = MODES, rounds: int = 2, tau: float = TAU, reads: int = ROUNDS) -> Model:
    """Learns a model on a cohort: cells (sample, region, log_ratio), regions as layout() gives them, gc (chrom, gc). Efficiencies are medians and spreads robust; modes are the components of contrasts within
    chromosomes above the edge of noise, without those that live on one chromosome; what a reading finds off its whole number stays out of the next round. X is learned on samples with one copy of it (on those
    with two, if fewer than 10 have one), Y on those with one. `reads` bounds the rounds of
    each reading."""
    spark = cells.sparkSession
    y = cells.where("log_ratio is not null and not isnan(log_ratio)").join(regions.select("region", "chrom", "kind"), "region")
    level = y.where("kind = 'A'").groupBy("sample").agg(F.percentile("log_ratio", 0.5).alias("level_"))
    y = kept(y.join(level, "sample").withColumn("z", F.col("log_ratio") - F.col("level_")), "fit-cells")
    sexes = kept(y.groupBy("sample").agg(*((2 * F.exp(F.percentile(F.when(F.col("kind") == k, F.col("z")), 0.5))).alias(k) for k in "XY")), "sexes")
    n = sexes.count()
    within = lambda c, r: (F.col(c) > r[0]) & (F.col(c) < r[1])
    held = sexes.agg(F.count_if(within("X", ONE)).alias("one_x"), F.count_if(within("X", TWO)).alias("two_x"), F.count_if(within("Y", ONE)).alias("one_y")).first().asDict()
    from_one = held["one_x"] >= 10
    x_rows = within("X", ONE) if from_one else within("X", TWO) if held["two_x"] >= 10 else F.lit(False)
    use = (F.col("kind") == "A") | (F.col("kind") == "X") & x_rows | (F.col("kind") == "Y") & within("Y", ONE) & F.lit(held["one_y"] >= 10)
    shift = F.when(F.col("kind") == "Y", float(np.log(2))).when(F.col("kind") == "X", float(np.log(2)) if from_one else 0.0).otherwise(0.0)
    y = kept(y.withColumn("z", F.col("z") + shift).join(sexes.drop("Y").join(sexes.select("sample", "Y"), "sample"), "sample").select("sample", "region", "chrom", "kind", "z", F.coalesce(use, F.lit(False)).alias("use"), F.coalesce(within("X", TWO), F.lit(False)).alias("two_x")), "learned-cells")
    off, model, scores, found = y.limit(0).select("sample", "region"), None, None, 0
    most = max(0, min(modes, n // PER_MODE))
    for k in range(rounds + 1):
        on = kept(y.where("use").join(off, ["sample", "region"], "left_anti"), "used-cells")
        mid = on.groupBy("region").agg(F.percentile("z", 0.5).alias("a"), F.count(F.lit(1)).alias("n")).where("n >= 10")
        e = on.join(mid.select("region", "a"), "region").select("sample", "region", "chrom", "kind", (F.col("z") - F.col("a")).alias("e"))
        sd = e.groupBy("region").agg((1.4826 * F.percentile(F.abs("e"), 0.5)).alias("sd"))
        told = kept(mid.join(sd, "region").join(regions.select("region", "kind"), "region"), "told-regions")
        v, width = told.select("region", F.array().cast("array<double>").alias("v")), 0
        spread: list[float] = []
        if k and most:
            typical = told.where("kind = 'A'").agg(F.percentile("sd", 0.5)).first()[0] or 0.0
            core = told.where((F.col("kind") == "A") & (F.col("n") >= 0.95 * n) & (F.col("sd") <= LOUD * typical)).select("region", "sd")
            x = e.join(core, "region").withColumn("e", F.least(F.greatest("e", -CLIP * F.col("sd")), CLIP * F.col("sd")))
            mean = x.groupBy("sample", "chrom").agg(F.avg("e").alias("m_"), F.count(F.lit(1)).alias("n_"))
            x = x.join(mean, ["sample", "chrom"]).where(F.col("n_") >= LEAST).select("sample", "region", "chrom", (F.col("e") - F.col("m_")).alias("x"))
            x = kept(x.join(x.groupBy("region").agg(F.avg("x").alias("m_")), "region").select("sample", "region", "chrom", (F.col("x") - F.col("m_")).alias("x")), "contrasts")
            scores, values = components.decomposed(x, "sample", "region", most)
            edge = components.noise_edge(values.select("value", F.lit(n).alias("n"), F.lit(x.select("region").distinct().count()).alias("p"))).first()
            found = edge.components if edge else 0
            top = kept(scores.where(F.col("component") <= found), "scores")
            # A component with most of its weight on one chromosome is a gain or loss that part of the cohort shares.
            load = x.join(top, "sample").groupBy("component", "chrom", "region").agg(F.sum(F.col("x") * F.col("score")).alias("l_")).groupBy("component", "chrom").agg(F.sum(F.col("l_") * F.col("l_")).alias("q_"))
            good = [r[0] for r in load.groupBy("component").agg((F.max("q_") / F.sum("q_")).alias("s_")).where(F.col("s_") <= LOCAL_SHARE).select("component").orderBy("component").collect()][:most]
            width = len(good)
            if width:
                t = top.groupBy("sample").agg(F.array(*(F.coalesce(F.max(F.when(F.col("component") == c, F.col("score"))), F.lit(0.0)) for c in good)).alias("t"))
                spread = [r[0] / n for r in values.where(F.col("component").isin(good)).select(F.col("value") * F.col("value")).orderBy("component").collect()]
                rows = e.join(told.select("region", F.greatest("sd", F.lit(1e-9)).alias("sd")), "region").join(t, "sample")
                rows = rows.withColumn("o", F.concat(F.array(F.lit(1.0)), "t")).withColumn("c", F.least(F.greatest("e", -CLIP * F.col("sd")), CLIP * F.col("sd")))
                rows = kept(rows.select("region", "e", "o", "c"), "regressed")
                sums = rows.groupBy("region").agg(F.array(*(F.sum(F.col("o")[i] * F.col("o")[j]) for i in range(width + 1) for j in range(width + 1))).alias("g"), F.array(*(F.sum(F.col("o")[i] * F.col("c")) for i in range(width + 1))).alias("b"))
                fits = kept(sums.mapInPandas(_regressed(width), "region string, coefficients array<double>"), "loadings")
                left = rows.join(fits, "region").select("region", (F.col("e") - _dot("o", "coefficients")).alias("r"))
                mid2 = left.groupBy("region").agg(F.percentile("r", 0.5).alias("m_"))
                noise = left.join(mid2, "region").groupBy("region").agg((1.4826 * F.percentile(F.abs(F.col("r") - F.col("m_")), 0.5)).alias("left_"))
                told = kept(told.join(fits, "region").join(noise, "region").select("region", (F.col("a") + F.col("coefficients")[0]).alias("a"), "n", (F.col("left_") * F.sqrt((F.col("n") + width + 1) / F.greatest(F.col("n") - width - 1, F.lit(1)))).alias("sd"), "kind", F.slice("coefficients", 2, width).alias("v")), "told-regions")
                v = told.select("region", "v")
                told = told.drop("v")
        typical = told.where("kind = 'A'").agg(F.percentile("sd", 0.5)).first()[0] or 0.0
        sd_used = F.when(~((F.col("kind") == "A") & (F.col("sd") > LOUD * typical)), F.col("sd"))
        base = told.join(v, "region").select("region", "a", sd_used.alias("sd"), "v")
        second = y.where("kind = 'X' and two_x").join(base, "region").select("sample", "region", "z", "a", "v")
        if width and from_one:
            second = second.join(t, "sample").select("region", (F.exp(F.col("z") - F.col("a") - _dot("v", "t")) - 1).alias("u_"))
        else:
            second = second.select("region", (F.exp(F.col("z") - F.col("a")) - 1).alias("u_"))
        u = second.groupBy("region").agg(F.percentile("u_", 0.5).alias("u"), F.count(F.lit(1)).alias("n_")).where("n_ >= 10").drop("n_") if from_one else spark.createDataFrame([], "region string, u double")
        table = kept(regions.join(base, "region", "left").join(u, "region", "left"), "model")
        none = spark.createDataFrame([], "key string, phi double, floor double")
        model = Model(table.withColumn("v", F.coalesce("v", F.array_repeat(F.lit(0.0), width))), spread, none, gc, held | {"samples": n, "components": width, "above_noise": int(found), "x_from": "one" if from_one else "two"})
        if k < rounds:
            off = read(cells, model, tau, rounds=reads).off
    return model


def calibrated(model: Model, chromosomes: DataFrame, least: int = 30) -> Model:
    """The model with errors: how far levels lie from their whole numbers in the cohort's readings (made without errors), as factor^2 se^2 + floor^2 over bins of se, each chromosome widened by its own factor
    if that isn't enough; the sex chromosomes by whole number, with the factor and a floor of their own. Chromosomes with fewer than `least` levels have none."""
    sex = F.col("chrom").isin("chrX", "chrY")
    at = chromosomes.where("off is not null and se0 > 0").select(F.when(sex, F.concat_ws(":", "chrom", "whole")).otherwise(F.col("chrom")).alias("key"), sex.alias("sex"), "off", "se0")
    at = kept(at.where(~F.col("sex") | F.col("key").isin("chrX:1", "chrX:2", "chrY:1")), "levels")
    auto = at.where("not sex")
    cuts = auto.agg(F.percentile_approx("se0", [k / 12 for k in range(1, 12)], 1000).alias("cuts"))
    binned = auto.crossJoin(F.broadcast(cuts)).withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("se0"))))  # one row
    mid = binned.groupBy("bin").agg(F.percentile("off", 0.5).alias("m_"), F.pow(F.percentile("se0", 0.5), 2).alias("e_"), F.count(F.lit(1)).alias("n_"))
    var = binned.join(mid, "bin").groupBy("bin", "e_", "n_").agg(F.pow(1.4826 * F.percentile(F.abs(F.col("off") - F.col("m_")), 0.5), 2).alias("v_")).where("v_ > 0 and n_ >= 30")
    x, one = F.col("e_") / F.col("v_"), 1 / F.col("v_")
    s = var.agg(F.count(F.lit(1)).alias("n"), *(F.sum(q).alias(name) for name, q in (("xx", x * x), ("xo", x * one), ("oo", one * one), ("x", x), ("o", one)))).first()
    m2, s2 = 1.0, 0.0
    if s.n:
        det = s.xx * s.oo - s.xo**2
        m2, s2 = ((s.x * s.oo - s.o * s.xo) / det, (s.o * s.xx - s.x * s.xo) / det) if s.n > 1 and det > 1e-12 * s.xx * s.oo else (s.x / s.xx, 0.0)
        if s2 < 0:
            m2, s2 = s.x / s.xx, 0.0
        if m2 < 1:
            m2, s2 = 1.0, max((s.o - s.xo) / s.oo, 0.0)
    mad = lambda df, c: df.join(df.groupBy("key").agg(F.percentile(c, 0.5).alias("m_")), "key").groupBy("key").agg((1.4826 * F.percentile(F.abs(F.col(c) - F.col("m_")), 0.5)).alias("mad"), F.count(F.lit(1)).alias("n"), F.percentile("se0", 0.5).alias("se_")).where(F.col("n") >= least)
    wide = F.greatest(F.col("mad"), F.lit(1.0))
    own = mad(auto.withColumn("z_", F.col("off") / F.sqrt(m2 * F.col("se0") * F.col("se0") + s2)), "z_").select("key", (float(np.sqrt(m2)) * wide).alias("phi"), (float(np.sqrt(s2)) * wide).alias("floor"))
    sexes = mad(at.where("sex"), "off").select("key", F.lit(float(np.sqrt(m2))).alias("phi"), (F.sqrt(F.greatest(F.lit(0.0), F.col("mad") * F.col("mad") - m2 * F.col("se_") * F.col("se_"))) / F.substring_index("key", ":", -1).cast("int")).alias("floor"))
    return Model(model.regions, model.spread, kept(own.unionByName(sexes), "errors"), model.gc, model.info | {"factor": float(np.sqrt(m2)), "floor": float(np.sqrt(s2))})
