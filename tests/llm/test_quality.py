"""The quality fit over all labels, and the threshold by rank."""

import numpy as np
import pytest

from copyloom.llm import quality


def test_quality_learns_from_every_label(spark, monkeypatch):
    """Each labelled row is in pairs, in groups far smaller than all; the threshold is the rank's among all strengths."""
    monkeypatch.setattr(quality, "GROUP", 64)
    monkeypatch.setattr(quality, "FEW", 50)
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(3000, quality.FEATURES)), rng.integers(0, 2, 3000)
    x[:, 0] += 2 * y
    x[:, 1] = 0.5
    df = spark.createDataFrame([(i, v, float(k)) for i, (v, k) in enumerate(zip(x.tolist(), y.tolist(), strict=True))], "doc_id long, x array<double>, y double").repartition(7)
    seen = []
    w, at = quality.fit(df)
    s = np.sort(x @ w)
    bad = int((y == 0).sum())
    assert at == pytest.approx((s[bad - 1] + s[bad]) / 2, rel=1e-9) and w[1] == 0 and w[0] > 10 * np.abs(w[2:]).max() / 3 and w[0] > 1
    met = df.selectExpr("pmod(xxhash64(doc_id), 47L) as group", "x", "y", "doc_id").toPandas().sort_values(["group", "doc_id"])
    for group, rows in met.groupby("group"):
        i, j = quality.pairs(rows.y.to_numpy(), group)
        seen += [*rows.doc_id.iloc[i], *rows.doc_id.iloc[j]]
        assert (rows.y.iloc[i] == 1).all() and (rows.y.iloc[j] == 0).all() and len(i) == quality.PARTNERS * len(rows)
    assert set(seen) == set(range(3000))


def test_a_rank_is_found_exactly(spark, monkeypatch):
    monkeypatch.setattr(quality, "FEW", 3)
    monkeypatch.setattr(quality, "CELLS", 4)
    v = [*np.random.default_rng(1).normal(size=200).tolist(), *[0.25] * 60, 1e9]
    df = spark.createDataFrame([(float(x),) for x in v], "s double")
    assert [quality.ranked(df, k) for k in (1, 100, 150, 261)] == [sorted(v)[k - 1] for k in (1, 100, 150, 261)]
