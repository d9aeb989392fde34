import random

from copyloom.operators import assembly
from copyloom.sources import tables

SCHEMA = "sample string, haplotype int, contig string, start long, end long, parts array<string>"


def test_planted_stretches(spark, tmp_path):
    """Two records half a kilobase apart are one stretch; a gap is not sequence; a stray record counts in the total."""
    rows = {1: ["c1\t20000\t420000\trDNA\t0\t.", "c1\t420500\t520000\trDNA\t0\t.", "c1\t520000\t530000\tcenSat(ACRO1,COMP)\t0\t.", "c1\t36200000\t36203000\trDNA\t0\t.", "c2\t0\t2000000\tGAP,rDNA\t0\t."], 2: ["track name=x", "c3\t28000\t489000\trDNA\t0\t.", "c3\t489000\t489100\tGAP\t0\t."]}
    for hap, lines in rows.items():
        (tmp_path / f"S1_hap{hap}_x.cenSat.bed").write_text("\n".join(lines) + "\n")
    got = assembly.longest(assembly.stretches(tables.read_annotation(spark, str(tmp_path)))).first()
    assert (got.total, got.longest, got.haplotypes) == (963_500, 500_000, 2)


def test_a_gap_ends_a_stretch(spark):
    at = [("s", 1, "c", 0, 100_000, ["rDNA"]), ("s", 1, "c", 100_000, 100_100, ["GAP"]), ("s", 1, "c", 100_100, 150_000, ["rDNA"]), ("s", 1, "c", 150_999, 160_000, ["rDNA"]), ("s", 1, "c", 161_000, 170_000, ["rDNA"]), ("s", 1, "c", 161_500, 162_000, ["rDNA"])]
    got = sorted((r.start, r.end, r.bases) for r in assembly.stretches(spark.createDataFrame(at, SCHEMA)).collect())
    assert got == [(0, 100_000, 100_000), (100_100, 160_000, 49_900 + 9001), (161_000, 170_000, 9000)]


def brute(rows):
    out = {}
    add = lambda s, c, k, v: out.setdefault((s, c), [0, 0, 0]).__setitem__(k, out[s, c][k] + v)
    for s, h, c, a, b, parts in rows:
        cls = {"HSat2": "HSat2", "SST1x": "SST1", "active_hor(S1)": "aSatHOR", "cenSat(ACRO1,COMP)": "ACRO"}
        mine = next((cls[p] for p in parts if p in cls), None)
        if mine:
            add(s, mine, int("GAP" in parts), b - a)
        if parts == ["GAP"]:
            near = {next((cls[p] for p in q if p in cls), None) for s2, h2, c2, x, y, q in rows if (s2, h2, c2) == (s, h, c) and q != ["GAP"] and x <= b and y >= a} - {None}
            for n in near:
                add(s, n, 1, (b - a) / len(near))
                add(s, n, 2, int(b - a == 100))
    return {k: tuple(round(x, 6) for x in v) for k, v in out.items()}


def test_mass_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(assembly, "BIN", 300)
    rng = random.Random(4)
    kinds = [["HSat2"], ["SST1x"], ["active_hor(S1)"], ["cenSat(ACRO1,COMP)"], ["GAP"], ["GAP"], ["GAP", "HSat2"], ["ct"], ["cenSat"], []]
    rows = []
    for _ in range(400):
        a = rng.randrange(0, 6000, 50)
        rows.append((rng.choice("ab"), rng.randint(1, 2), rng.choice("xy"), a, a + rng.choice([50, 100, 100, 400]), rng.choice(kinds)))
    got = {(r.sample, r["class"]): (r.mass, round(r.gapped, 6), r.unsized) for r in assembly.mass(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == brute(rows)
    assert not assembly.mass(spark.createDataFrame([], SCHEMA)).count()
