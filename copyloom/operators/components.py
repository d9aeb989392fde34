"""Components of matrices of samples by regions or windows, how many of them stand above noise, and how many to adjust for.

A matrix is a table of its cells. The products of its shorter side's items are summed in blocks, one task for a pair of blocks and a share of the longer side; the
sums of one matrix, at most SIDE on a side, are decomposed in one task, and scores are sums over cells again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copyloom.session import kept

#: Items that the shorter side of a matrix may have, items of a block, and cells of the longer side that a task's products are summed over.
SIDE, BLOCK, SHARE = 4096, 256, 1 << 16
#: How far a cell may lie from its row's and column's medians.
CLIP = 0.5


def centred_cells(cells: DataFrame, row: str, col: str, value: str, clip: float = CLIP) -> DataFrame:
    """(row, col, x): the value less its row's median, less the column's median of that, held within `clip` of 0, so that one deleted region is no component."""
    have = cells.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(row, col, F.col(value).cast("double").alias("x"))
    at = have.join(have.groupBy(row).agg(F.percentile("x", 0.5).alias("mid_")), row).select(row, col, (F.col("x") - F.col("mid_")).alias("x"))
    at = kept(at, "row-centred")
    mid = at.groupBy(col).agg(F.percentile("x", 0.5).alias("mid_"))
    return at.join(mid, col).select(row, col, F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col("x") - F.col("mid_"))).alias("x"))


def filled_cells(cells: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """(row, col, x) of every row and column that has a value: missing cells are 0, then each column's mean is taken off."""
    have = cells.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(row, col, F.col(value).cast("double").alias("x"))
    have = kept(have, "cells")
    n = have.agg(F.count_distinct(row)).first()[0]
    mean = have.groupBy(col).agg((F.sum("x") / F.lit(float(max(n, 1)))).alias("mean_"))
    means = mean.agg(F.map_from_entries(F.collect_list(F.struct(col, "mean_"))).alias("means_"))  # one row, a number for each column
    rows = have.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(col, "x"))).alias("xs_")).crossJoin(F.broadcast(means))
    every = rows.select(row, "xs_", F.explode("means_").alias(col, "mean_"))
    return every.select(row, col, (F.coalesce(F.try_element_at("xs_", F.col(col)), F.lit(0.0)) - F.col("mean_")).alias("x"))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bi, bj, sums) of rows (bi, bj, part, item, left, right) sorted by part: the sums of the outer products of the blocks' values, as bytes; a block's values are (place in it, value)."""
    key, total, left, right = None, None, [], []

    def out() -> Iterator[pa.RecordBatch]:
        if key is not None:
            add()
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["bi", "bj", "sums"])

    def add() -> None:
        nonlocal total
        if left:
            total += np.stack(left).T @ np.stack(right)
            left.clear()
            right.clear()

    def vector(x: list) -> np.ndarray:
        v = np.zeros(BLOCK)
        v[[p["at"] for p in x]] = [p["x"] for p in x]
        return v

    for batch in batches:
        for bi, bj, part, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (bi, bj, part):
                yield from out()
                key, total = (bi, bj, part), np.zeros((BLOCK, BLOCK))
            left.append(vector(a))
            right.append(vector(b))
            if len(left) == 4096:
                add()
    yield from out()


def _solver(size: int, most: int):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(component, value, share, vector): all values, and the vectors of the first, from the blocks of sums."""
        nb = -(-size // BLOCK)
        g = np.zeros((nb * BLOCK, nb * BLOCK))
        for batch in batches:
            for bi, bj, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(sums).reshape(BLOCK, BLOCK)
                g[bi * BLOCK : (bi + 1) * BLOCK, bj * BLOCK : (bj + 1) * BLOCK] += part
                if bi != bj:
                    g[bj * BLOCK : (bj + 1) * BLOCK, bi * BLOCK : (bi + 1) * BLOCK] += part.T
        w, v = np.linalg.eigh(g[:size, :size]) if size else (np.zeros(0), np.zeros((0, 0)))
        w, v = np.maximum(w[::-1], 0), v[:, ::-1]
        v = v * np.where(v[np.abs(v).argmax(0), np.arange(size)] < 0, -1, 1) if size else v  # the largest entry is positive
        vectors = [v[:, k].tolist() if k < most else None for k in range(size)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, size + 1)), pa.array(np.sqrt(w)), pa.array(w / max(w.sum(), 1e-30)), pa.array(vectors, pa.list_(pa.float64()))], names=["component", "value", "share", "vector"])

    return solve


def decomposed(cells: DataFrame, row: str, col: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(scores, values) of the matrix of cells (row, col, x), by its singular values: scores are (row, component, score) of the first `most` components, values are
    (component, value, share) of all, where value is the singular value. A vector's largest entry on the shorter side is positive. Missing cells are 0; a matrix without cells has neither. Raises ValueError if both
    sides have more than SIDE items."""
    cells = kept(cells.select(row, col, "x"), "matrix")
    sizes = {c: cells.select(c).distinct().count() for c in (row, col)}
    short, long = (col, row) if sizes[col] <= sizes[row] else (row, col)
    size = sizes[short]
    if size > SIDE:
        raise ValueError(f"the shorter side has {size} items, more than {SIDE}")
    items = kept(cells.select(short).distinct().withColumn("at_", F.row_number().over(Window.orderBy(short)) - 1), "items")  # at most SIDE rows
    at = cells.join(F.broadcast(items), short).select(long, F.expr(f"at_ div {BLOCK}").cast("int").alias("block_"), F.struct((F.col("at_") % BLOCK).cast("int").alias("at"), "x").alias("v_"))
    blocks = at.groupBy(long, "block_").agg(F.collect_list("v_").alias("vs_"))
    parts = max(1, -(-sizes[long] // SHARE))
    pairs = blocks.groupBy(long).agg(F.collect_list(F.struct("block_", "vs_")).alias("bs_")).select(F.pmod(F.xxhash64(long), F.lit(parts)).cast("int").alias("part"), F.array_sort("bs_").alias("bs_"))
    pairs = pairs.select("part", F.posexplode("bs_").alias("k_", "a_"), "bs_").select("part", "a_", F.explode(F.expr("slice(bs_, k_ + 1, size(bs_) - k_)")).alias("b_"))
    pairs = pairs.select(F.col("a_.block_").alias("bi"), F.col("b_.block_").alias("bj"), "part", F.col("a_.vs_").alias("left"), F.col("b_.vs_").alias("right"))
    sums = pairs.repartition("bi", "bj", "part").sortWithinPartitions("bi", "bj", "part").mapInArrow(_products, "bi int, bj int, sums binary")
    found = kept(kept(sums, "products").coalesce(1).mapInArrow(_solver(size, most), "component long, value double, share double, vector array<double>"), "components")
    values = found.select("component", "value", "share")
    vectors = found.where("vector is not null").select("component", "value", F.posexplode("vector").alias("at_", "part_")).join(F.broadcast(items), "at_")
    if short == row:  # the vectors are the rows' own
        return vectors.select(row, "component", (F.col("part_") * F.col("value")).alias("score")), values
    scores = cells.join(vectors.select(col, "component", "part_"), col).groupBy(row, "component").agg(F.sum(F.col("x") * F.col("part_")).alias("score"))
    return scores, values


def control_components(cells: DataFrame, most: int = 10, row: str = "sample", col: str = "region", value: str = "log_ratio") -> tuple[DataFrame, DataFrame]:
    """Scores and singular values of the control regions' log ratios, rows then columns centred by their medians and clipped."""
    return decomposed(centred_cells(cells, row, col, value), row, col, most)


def profile_components(cells: DataFrame, most: int = 5, row: str = "sample", col: str = "window", value: str = "residual") -> tuple[DataFrame, DataFrame]:
    """Scores and singular values of calibrated residuals, which hold nothing of the samples' levels: missing ones are 0, columns are centred by their means."""
    return decomposed(filled_cells(cells, row, col, value), row, col, most)


def noise_edge(values: DataFrame, keys: list[str] | None = None, z: float = 4.0, margin: float = 0.01, least: int = 30) -> DataFrame:
    """(keys, components, edge, slope, sd): how many singular values stand above the edge of noise. values: (keys, value, n, p), the values of an n x p matrix, all or the largest.

    The j-th largest value of noise lies at edge - slope * (j - 1/2)^(2/3), so a line through the lower half of the leading values gives the edge, whatever the
    variances of rows and columns. What is above it by the margin, the Tracy-Widom scale and z deviations of the fit is set aside, and ranks are counted from there, until no
    more is. Fewer than `least` rows, or 12 values, have no components and no edge."""
    keys = keys or []
    at = values.where("value > 0").withColumn("n_", F.least("n", "p").cast("double")).withColumn("p_", F.greatest("n", "p").cast("double"))
    at = at.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value")))).withColumn("all_", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    lead = F.when(F.col("all_") < 0.9 * (F.col("n_") - 1), F.col("all_")).otherwise(F.least("all_", F.greatest(F.lit(40), F.round(0.15 * F.col("all_")))))
    at = kept(at.withColumn("lead_", lead).where("rank_ <= lead_").select(*keys, "value", "rank_", "lead_", "n_", "p_", "all_"), "leading")
    state = at.groupBy(*keys).agg(F.max("n_").alias("n_"), F.max("p_").alias("p_"), F.max("all_").alias("all_")).select(*keys, F.lit(0).cast("long").alias("components"), *(F.lit(None).cast("double").alias(c) for c in ("edge", "slope", "sd")), ((F.col("n_") >= least) & (F.col("all_") >= 12)).alias("open_"))
    both = (lambda a, b: a.join(b, keys)) if keys else (lambda a, b: a.crossJoin(F.broadcast(b)))  # without keys, one row
    while True:
        state = kept(state, "edge")
        if state.where("open_").isEmpty():
            return state.drop("open_")
        m = F.col("components")
        ranks = both(at, state.where("open_")).withColumn("noise_", F.col("rank_") >= F.greatest(m + 1, F.floor(F.col("lead_") / 2) + 1)).withColumn("x_", F.pow(F.greatest(F.col("rank_") - m, F.lit(1)) - 0.5, F.lit(2 / 3)))
        y, x = F.when(F.col("noise_"), F.col("value")), F.col("x_")
        fit = ranks.groupBy(*keys).agg(F.count(y).alias("k_"), F.regr_intercept(y, x).alias("e_"), (-F.regr_slope(y, x)).alias("a_"), F.regr_sxx(y, x).alias("xx_"), F.regr_sxy(y, x).alias("xy_"), F.regr_syy(y, x).alias("yy_"))
        fit = fit.withColumn("s_", F.sqrt(F.greatest(F.lit(0.0), F.col("yy_") - F.col("xy_") * F.col("xy_") / F.col("xx_")) / (F.col("k_") - 2))).select(*keys, "k_", "e_", "a_", "s_")
        scale = F.pow(1 / F.sqrt("n_") + 1 / F.sqrt("p_"), F.lit(1 / 3)) / (F.sqrt("n_") + F.sqrt("p_"))
        over = both(ranks, fit).groupBy(*keys).agg(F.count_if(F.col("value") > F.col("e_") * (1 + scale + margin) + z * F.col("s_")).alias("over_"), *(F.first(c).alias(c) for c in ("k_", "e_", "a_", "s_")))
        met = state.join(over, keys, "left") if keys else state.crossJoin(F.broadcast(over))
        fitted, more = F.col("open_") & (F.col("k_") >= 6), F.col("open_") & (F.col("k_") >= 6) & (F.col("over_") > F.col("components"))
        state = met.select(*keys, F.when(more, F.col("over_")).otherwise(F.col("components")).alias("components"), *(F.when(fitted, F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("e_", "edge"), ("a_", "slope"), ("s_", "sd"))), F.coalesce(more, F.lit(False)).alias("open_"))


def noise_quantiles(asked: DataFrame, cells: int = 4096, bins: int = 64) -> DataFrame:
    """(n, p, prob, value): quantiles of the singular values of an n x p matrix of noise of variance 1 (Marchenko and Pastur). asked: (n, p, prob).

    The law is tabulated over half a turn, x = mid - half * cos(t), where its density is smooth, and a probability finds its cell by a join on ranges of probability."""
    shapes = asked.select("n", "p").distinct().withColumn("g_", F.least("n", "p") / F.greatest("n", "p").cast("double")).withColumn("mid_", 1 + F.col("g_")).withColumn("half_", 2 * F.sqrt("g_"))
    t = (F.col("cell_") + 0.5) * F.lit(np.pi / cells)
    at = shapes.withColumn("cell_", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).withColumn("d_", F.sin(t) * F.sin(t) / (F.col("mid_") - F.col("half_") * F.cos(t)))
    order = Window.partitionBy("n", "p").orderBy("cell_")
    whole = F.sum("d_").over(Window.partitionBy("n", "p"))
    upto = F.sum("d_").over(order.rowsBetween(Window.unboundedPreceding, 0)) / whole
    at = at.withColumn("hi_", upto).withColumn("share_", F.col("d_") / whole).withColumn("lo_", F.col("hi_") - F.col("share_"))
    at = at.withColumn("bin_", F.explode(F.sequence(F.floor(F.greatest("lo_", F.lit(0.0)) * bins), F.least(F.floor(F.col("hi_") * bins), F.lit(bins - 1)))))
    want = asked.withColumn("bin_", F.least(F.floor(F.col("prob") * bins), F.lit(bins - 1)))
    met = want.join(at, ["n", "p", "bin_"]).where("prob >= lo_ - 1e-15 and prob <= hi_ + 1e-15").groupBy("n", "p", "prob").agg(F.min_by(F.struct("cell_", "lo_", "share_", "mid_", "half_"), "cell_").alias("c_"))
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("prob") - F.col("c_.lo_")) / F.col("c_.share_")))
    x = F.col("c_.mid_") - F.col("c_.half_") * F.cos((F.col("c_.cell_") + part) * F.lit(np.pi / cells))
    return met.select("n", "p", "prob", F.sqrt(F.greatest(F.lit(0.0), x) * F.greatest("n", "p")).alias("value"))


def _fold_sums(width: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(column, fold, n, sums) of rows (column, fold, values): the products of all values, 1 first, summed over a task's rows."""
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            values = np.asarray(batch.column(2).flatten()).reshape(-1, width)
            one = np.concatenate([np.ones((len(values), 1)), values], 1)
            groups: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                groups.setdefault(key, []).append(k)
            for key, at in groups.items():
                held[key] = held.get(key, 0) + one[at].T @ one[at]
        keys = list(held)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k].tobytes() for k in keys], pa.binary())], names=["column", "fold", "sums"])

    return sums


def _fold_fits(width: int, folds: int):
    """For each fold of a column, the coefficients of the nested models on all other folds: from one factorisation of the sums, its leading parts."""

    def fit(pdf):
        import pandas as pd

        total = [np.zeros((width + 1, width + 1)) for _ in range(folds)]
        for fold, sums in zip(pdf.fold, pdf.sums, strict=True):
            total[fold] = total[fold] + np.frombuffer(sums).reshape(width + 1, width + 1)
        every, k = sum(total), width - 1  # 1, the covariates, y
        n = round(every[0, 0])
        out = []
        for f in range(folds if n >= max(3 * folds, k + folds + 2) else 0):
            g = every - total[f]
            mean = g[0, 1:] / g[0, 0]
            c = g[1:, 1:] - np.outer(mean, mean) * g[0, 0]
            spread = np.sqrt(np.maximum(np.diag(c)[:k], 1e-300))
            low = np.linalg.cholesky(c[:k, :k] / np.outer(spread, spread) + 1e-12 * np.eye(k)) if k else np.zeros((0, 0))
            part = np.linalg.solve(low, c[:k, k] / spread) if k else np.zeros(0)
            beta = [np.r_[np.linalg.solve(low[:j, :j].T, part[:j]) / spread[:j], np.zeros(k - j)] if j else np.zeros(k) for j in range(k + 1)]
            out.append({"column": pdf.column.iloc[0], "fold": f, "mean_y": mean[k], "mean_x": mean[:k].tolist(), "mean_all": every[0, width] / n, "betas": [b.tolist() for b in beta]})
        return pd.DataFrame(out, columns=["column", "fold", "mean_y", "mean_x", "mean_all", "betas"])

    return fit


def cross_validated(rows: DataFrame, folds: int = 10, seed: int = 1, fold: Column | None = None) -> DataFrame:
    """(sample, column, k, adjusted): the values of each column without their part on the first k covariates, for all k from 0, as predicted from the other folds; the column's mean
    stays. rows: (sample, column, y, covariates), the covariates an array of one length. Rows with a null or NaN count nowhere; a sample's fold, below `folds`, follows from its hash unless it is told. k = 0 is no adjustment. Columns with
    fewer than 3 rows a fold, or than covariates and folds together and 2, give none.

    One pass sums each fold's products; a fit takes the sums of the other folds, and its nested models are leading parts of one factorisation."""
    rows = kept(rows.where("y is not null and not isnan(y) and covariates is not null and not exists(covariates, x -> x is null or isnan(x))").withColumn("fold", (F.pmod(F.xxhash64("sample", F.lit(seed)), F.lit(folds)) if fold is None else fold).cast("int")), "folds")
    first = rows.select(F.size("covariates")).first()
    schema = f"sample {rows.schema['sample'].dataType.simpleString()}, column string, k long, adjusted double"
    if first is None:
        return rows.sparkSession.createDataFrame([], schema)
    width = first[0] + 1
    sums = rows.select(F.col("column").cast("string").alias("column"), "fold", F.concat("covariates", F.array(F.col("y").cast("double"))).alias("values")).mapInArrow(_fold_sums(width), "column string, fold int, sums binary")
    fits = kept(sums.groupBy("column").applyInPandas(_fold_fits(width, folds), "column string, fold int, mean_y double, mean_x array<double>, mean_all double, betas array<array<double>>"), "fits")
    at = rows.join(fits, ["column", "fold"]).withColumn("dev_", F.zip_with("covariates", "mean_x", lambda a, b: a - b))
    out = at.select("sample", "column", "y", "mean_y", "mean_all", "dev_", F.posexplode("betas").alias("k", "beta_"))
    told = F.aggregate(F.zip_with("dev_", "beta_", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return out.select("sample", "column", F.col("k").cast("long").alias("k"), F.when(F.col("k") == 0, F.col("y")).otherwise(F.col("y") - told - F.col("mean_y") + F.col("mean_all")).alias("adjusted"))


def sweep(adjusted: DataFrame) -> DataFrame:
    """(column, k, n, rmse, sd, sd_robust, bias) of cross_validated() errors or logs: root mean square, standard and robust deviations, mean."""
    mid = adjusted.groupBy("column", "k").agg(F.percentile("adjusted", 0.5).alias("mid_"))
    return adjusted.join(mid, ["column", "k"]).groupBy("column", "k").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("adjusted") * F.col("adjusted"))).alias("rmse"), F.stddev_samp("adjusted").alias("sd"),
        (F.lit(1.4826) * F.percentile(F.abs(F.col("adjusted") - F.col("mid_")), 0.5)).alias("sd_robust"), F.avg("adjusted").alias("bias"),
    )


#: A median deviation of n normal values spreads 1.65 times as much as their standard deviation.
MAD_LOSS = 1.65


def recommended(measured: DataFrame) -> DataFrame:
    """(column, best, pick, at_0, at_pick, at_best, se): the fewest components whose error is within one standard error of the least. measured: (column, k, error, n), and se if known; if
    not, error is taken for a robust deviation of n values. The first of equal errors is the best; columns without any error are left out."""
    at = measured.where("error is not null and not isnan(error)")
    se = F.col("se") if "se" in measured.columns else F.lit(None).cast("double")
    best = at.withColumn("se_", se).groupBy("column").agg(F.min(F.struct("error", "k", F.col("n"), F.col("se_"))).alias("b"), F.max(F.when(F.col("k") == 0, F.col("error"))).alias("at_0"))
    spread = F.coalesce("b.se_", F.col("b.error") * MAD_LOSS / F.sqrt(2 * F.greatest(F.col("b.n"), F.lit(2)))) if "se" not in measured.columns else F.coalesce("b.se_", F.lit(0.0))
    best = best.select("column", F.col("b.k").alias("best"), F.col("b.error").alias("at_best"), spread.alias("se"), "at_0")
    pick = at.select("column", "k", "error").join(best, "column").where("error <= at_best + se").groupBy("column", "best", "at_best", "se", "at_0").agg(F.min(F.struct("k", "error")).alias("p"))
    return pick.select("column", "best", F.col("p.k").alias("pick"), "at_0", F.col("p.error").alias("at_pick"), "at_best", "se")
