import numpy as np
import pytest

from copyloom.operators import karyotype

ARMS = [(c, 5_000_000) for c in [*karyotype.AUTOSOMES, "chrX", "chrY"]]


class World:
    """Regions on all chromosomes, two library modes, a slope on GC, spreads that differ."""

    def __init__(self, seed, per=26):
        rng = np.random.default_rng(seed)
        self.names, self.chrom, self.mid = [], [], []
        for c in [*karyotype.AUTOSOMES, "chrX", "chrY"]:
            for k in range(per if c != "chrY" else 12):
                for piece in range(1 + k % 2):
                    s = 200_000 + k * 400_000 + piece * 20_000
                    self.names.append(f"{c}:{s}-{s + 10_000}")
                    self.chrom.append(c)
                    self.mid.append(s)
        m = len(self.names)
        self.chrom, self.mid = np.array(self.chrom), np.array(self.mid)
        self.a, self.sd = rng.normal(0, 0.15, m), rng.uniform(0.02, 0.05, m)
        self.v = np.stack([np.sin(np.arange(m) / 3), rng.normal(0, 1, m)], 1) * 0.05
        self.gc = {c: 0.36 + 0.005 * k for k, c in enumerate(karyotype.AUTOSOMES)}

    def sample(self, rng, sex="XX", changes=()):
        copies = np.where(self.chrom == "chrX", sex.count("X"), np.where(self.chrom == "chrY", sex.count("Y"), 2)).astype(float)
        for chrom, lo, hi, level in changes:
            copies[(self.chrom == chrom) & (self.mid >= lo) & (self.mid < hi)] = level
        read = np.where((self.chrom == "chrX") & (copies > 1), 1 + 0.95 * (copies - 1), copies)
        tilt = rng.normal(0, 0.3) * (np.array([self.gc.get(c, 0.4125) for c in self.chrom]) - 0.4125)
        return rng.normal(0, 0.3) + self.a + self.v @ rng.normal(size=2) + tilt + np.log(np.maximum(read, 1e-3) / 2) + rng.normal(0, 1, len(self.names)) * self.sd

    def cells(self, spark, rows):
        data = [(s, n, float(x)) for s, values in rows.items() for n, x in zip(self.names, values, strict=True)]
        return spark.createDataFrame(data, "sample string, region string, log_ratio double").repartition(4)


END = 10**9
CHANGES = {
    "plain": ("XX", ()), "trisomy": ("XY", [("chr21", 0, END, 3)]), "mosaic": ("XX", [("chr8", 0, END, 2.4)]), "arm": ("XY", [("chr5", 5_000_000, END, 1)]),
    "stretch": ("XX", [("chr3", 2_000_000, 5_000_000, 1)]), "turner": ("X", ()), "klinefelter": ("XXY", ()), "two": ("XX", [("chr12", 0, END, 3), ("chr17", 0, 4_900_000, 1)]), "tetra": ("XY", [("chr9", 0, END, 4)]),
}


@pytest.fixture(scope="module")
def world(spark):
    w, rng = World(1), np.random.default_rng(2)
    cohort = {f"c{i}": w.sample(rng, "XX" if i % 2 else "XY", [("chr12", 0, END, 3)] if i % 10 == 0 else ()) for i in range(120)}
    regions = karyotype.layout(spark.createDataFrame([(n,) for n in [*w.names, "odd name", "chrM:1-5"]], "region string"), spark.createDataFrame(ARMS, "chrom string, border long"))
    gc = spark.createDataFrame(list(w.gc.items()), "chrom string, gc double")
    cells = w.cells(spark, cohort)
    model = karyotype.fit(cells, regions, gc)
    first = karyotype.read(cells, model)
    model = karyotype.calibrated(model, first.chromosomes)
    got = karyotype.read(w.cells(spark, {k: w.sample(rng, *c) for k, c in CHANGES.items()} | {"few": np.r_[w.sample(rng)[:10], np.full(len(w.names) - 10, np.nan)]}), model)
    return w, model, first, got


def test_layout(spark):
    names = ["chr1:0-100", "chr1:40000-50100", "chr1:100000-160000", "chr1:300000-300100", "chrX:5-9", "chrY:7000000-7000100", "else"]
    got = {r.region: (r.arm, r.kind, r.place) for r in karyotype.layout(spark.createDataFrame([(n,) for n in names], "region string"), spark.createDataFrame(ARMS[:-1], "chrom string, border long")).collect()}
    assert got == {"chr1:0-100": ("p", "A", 0), "chr1:40000-50100": ("p", "A", 0), "chr1:100000-160000": ("p", "A", 1), "chr1:300000-300100": ("p", "A", 2), "chrX:5-9": ("p", "X", 0), "chrY:7000000-7000100": (None, "Y", 0)}


def test_the_model_is_the_worlds(world):
    """A tenth of the cohort has a third chromosome 12; neither its efficiencies nor the modes follow it."""
    w, model, _, _ = world
    rows = {r.region: r for r in model.regions.collect()}
    a = np.array([rows[n].a for n in w.names])
    auto = ~np.isin(w.chrom, ["chrX", "chrY"])
    off = a - w.a
    assert np.abs(off[auto] - np.median(off[auto])).max() < 0.03 and abs(np.median(off[w.chrom == "chr12"]) - np.median(off[auto])) < 0.01
    assert model.info["components"] == 2 and len(model.spread) == 2
    sd = np.array([rows[n].sd or np.nan for n in w.names])
    assert np.nanmedian(np.abs(sd[auto] / w.sd[auto] - 1)) < 0.12
    # The loadings span what the planted ones do, up to what chromosomes share.
    v = np.array([rows[n].v for n in w.names])[auto]
    q, q2 = np.linalg.qr(v - v.mean(0))[0], np.linalg.qr(w.v[auto] - w.v[auto].mean(0))[0]
    assert np.linalg.svd(q.T @ q2, compute_uv=False).min() > 0.95
    u = np.array([rows[n].u for n in w.names if n.startswith("chrX")])
    assert abs(np.median(u) - 0.95) < 0.02


def test_errors_cover_the_spread(world):
    _, model, first, _ = world
    errors = {r.key: r for r in model.errors.collect()}
    assert set(karyotype.AUTOSOMES) <= set(errors) and {"chrX:1", "chrX:2", "chrY:1"} <= set(errors)
    assert all(1 <= r.phi < 3 and 0 <= r.floor < 0.05 for r in errors.values())
    calls = {r.sample: r.karyotype for r in first.samples.collect()}
    assert sum(calls[f"c{i}"].startswith("47,") == (i % 10 == 0) for i in range(120)) >= 117


@pytest.mark.parametrize(
    "sample, want",
    [("plain", "46,XX"), ("trisomy", "47,XY,+21"), ("arm", "46,XY,-5q"), ("turner", "45,X"), ("klinefelter", "47,XXY"), ("tetra", "48,XY,+9,+9")],
)
def test_planted_karyotypes(world, sample, want):
    got = {r.sample: r.karyotype for r in world[3].samples.collect()}
    assert got[sample] == want


def test_planted_parts_and_stretches(world):
    got = world[3]
    samples = {r.sample: r for r in got.samples.collect()}
    events = {}
    for r in got.events.collect():
        events.setdefault(r.sample, []).append(r)
    assert "few" not in samples and not events.get("plain")
    (m,) = events["mosaic"]
    assert m.chrom == "chr8" and not m.full and abs(m.copies - 2.4) < 0.05 and samples["mosaic"].status == "fractional" and "+8[0." in samples["mosaic"].karyotype
    (s,) = events["stretch"]
    assert s.chrom == "chr3" and s.full and s.delta < -0.9 and abs(s.start - 2_000_000) < 500_000 and abs(s.end - 5_000_000) < 500_000 and "-3(2-5Mb)" in samples["stretch"].karyotype
    assert sorted((e.chrom, e.span, round(e.delta)) for e in events["two"]) == [("chr12", "whole", 1), ("chr17", "p", -1)]


def test_a_gain_has_no_part_in_its_own_correction(world):
    """A whole chromosome gained leaves no contrast, so its sample's scores and line stay with the others."""
    got = {(r.sample, r.chrom): r for r in world[3].chromosomes.collect()}
    assert abs(got["trisomy", "chr21"].copies - 3) < 0.06 and abs(got["tetra", "chr9"].copies - 4) < 0.1
    assert all(abs(got["tetra", c].copies - 2) < 0.06 for c in karyotype.AUTOSOMES if c != "chr9")


def test_chain_and_near_mean():
    rng = np.random.default_rng(3)
    x = np.r_[np.full(30, 2.0), np.full(12, 3.0), np.full(30, 2.0)] + rng.normal(0, 0.1, 72)
    x[5] = 9.0  # one place can't buy a change
    path = karyotype.chain(x, np.full(72, 0.1), 2.0)
    assert np.flatnonzero(np.diff(path)).tolist() == [29, 41] and abs(path[35] - 3) < 0.06
    level, se, far = karyotype.near_mean(np.array([1.0, 1.1, 0.9, 7.0]), np.full(4, 0.1), 1.0)
    assert (round(level, 6), far) == (1.0, 1) and abs(se - 0.1 / np.sqrt(3)) < 1e-9
