import random
from collections import Counter

import pytest

from copyloom.functions import sequences as S
from copyloom.operators import intervals, loci
from copyloom.sources import tables

K = 21


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_pieces(spark):
    df = spark.createDataFrame([("u", "ACGTACGTAC"), ("short", "ACG")], "class string, seq string")
    assert rows(loci.pieces(df, 4, 3)) == [("u", 0, "ACGT"), ("u", 3, "TACG"), ("u", 6, "GTAC")]


def test_loci_from_alignments(spark, tmp_path):
    lines = [
        "c_0\t2000\t0\t2000\t+\tchr1\t9000\t3000\t5000\t1950\t2000\t60\tNM:i:50",
        "c_1\t2000\t0\t600\t-\tchr1\t9000\t6900\t7500\t600\t600\t60",
        "c_2\t2000\t0\t2000\t+\tchr1\t9000\t100\t2100\t1700\t2000\t60",  # not alike enough
        "c_3\t2000\t0\t400\t+\tchr2\t9000\t100\t500\t400\t400\t60",  # too short
    ]
    (tmp_path / "a.paf").write_text("\n".join(lines) + "\n")
    hits = tables.read_paf(spark, str(tmp_path / "a.paf"))
    assert [tuple(r) for r in hits.select("contig", "back", "cs").collect()] == [("chr1", False, None), ("chr1", True, None), ("chr1", False, None), ("chr2", False, None)]
    got = loci.class_loci(hits.withColumn("class", hits.name.substr(1, 1)), ["class"])
    assert rows(got) == [("c", "chr1", 1000, 9000, 2)]
    (tmp_path / "b.paf").write_text("c_0\t2000\t0\n")
    with pytest.raises(Exception, match="not a PAF line"):
        tables.read_paf(spark, str(tmp_path / "b.paf")).collect()


def test_core_kmers_of_planted_copies(spark):
    """Three genomes hold a unit once each, inside a locus; one lacks its middle and another holds that twice; a part of the unit lies elsewhere, and a part comes twice in the unit."""
    rng = random.Random(4)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a, b, c, twice, d = dna(300), dna(100), dna(300), dna(60), dna(200)
    unit = a + b + c + twice + d + twice
    canon = lambda x: min(x, turned(x))
    genomes, bed, seen = [], [], []
    for g, copy in enumerate((unit, a + c + twice + d + twice, unit + dna(7) + b)):
        seq = dna(400) + (turned(copy) if g == 1 else copy) + dna(400) + (d[:80] if g == 2 else "") + dna(500)
        genomes += [(f"g{g}", "x", at, seq[at : at + 256 + K - 1]) for at in range(0, len(seq), 256)]
        bed.append((f"g{g}", "x", 400, 400 + len(copy)))
        inside = Counter(canon(seq[p : p + K]) for p in range(400, 400 + len(copy)))
        seen.append((inside, Counter(canon(seq[p : p + K]) for p in range(len(seq) - K + 1)) - inside))
    gs = spark.createDataFrame(genomes, "genome string, contig string, off long, seq string")
    at = S.packed_kmers(spark.createDataFrame([("u", unit)], "class string, seq string"), "seq", K).select("class", "off", "code")
    counts = loci.counted(gs, at, K, spark.createDataFrame(bed, "genome string, contig string, start long, end long"))

    own = [canon(unit[p : p + K]) for p in range(len(unit) - K + 1)]
    times = Counter(own)
    free = [(p, [i[x] for i, _ in seen]) for p, x in enumerate(own) if times[x] == 1 and not any(o[x] for _, o in seen)]
    each = rows(loci.core(at, counts, 3), "pos")
    assert [p for p, in each] == [p for p, n in free if n == [1, 1, 1]] and len(each) > 500
    total = rows(loci.core(at, counts, 3, each=False), "pos", "even")
    assert total == [(p, n == [1, 1, 1]) for p, n in free if sum(n) == 3] and (310, False) in total
    got = rows(loci.core_intervals(loci.core(at, counts, 3)), "class", "start", "end", "members")
    assert sum(e - s for _, s, e, _ in got) == len(each) == sum(n for *_, n in got) and all(x[2] < y[1] for x, y in zip(got, got[1:]))
    assert loci.core(at, loci.counted(gs, at, K), 3).count() == 0  # without loci all is outside


def difference_string(unit, rng):
    """A genome's copy of the unit, and what tells them apart."""
    out, cs, at = "", "", 0
    want = []
    while at < len(unit):
        n = min(rng.randrange(1, 40), len(unit) - at)
        out, cs, at = out + unit[at : at + n], cs + f":{n}", at + n
        if at + 3 >= len(unit):
            continue
        what = rng.choice("sid")
        if what == "s":
            new = rng.choice([x for x in "ACGT" if x != unit[at]])
            want.append(("sub", at, len(out), unit[at], new))
            out, cs, at = out + new, cs + f"*{new.lower()}{unit[at].lower()}", at + 1
        elif what == "i":
            want.append(("ins", at, len(out), unit[at : at + 2], ""))
            cs, at = cs + f"+{unit[at : at + 2].lower()}", at + 2
        else:
            want.append(("del", at, len(out), "", "GAT"))
            out, cs = out + "GAT", cs + "-gat"
    return out, cs, want


@pytest.mark.parametrize("back", [False, True])
def test_difference_sites(spark, back):
    rng = random.Random(7)
    unit = "".join(rng.choice("ACGT") for _ in range(500))
    seen = turned(unit) if back else unit
    copy, cs, want = difference_string(seen, rng)
    if back:
        flip = lambda k, p, u: len(unit) - p - len(u)
        want = [(k, flip(k, p, u), at, turned(u), turned(g)) for k, p, at, u, g in want]
    hits = spark.createDataFrame([("u", "x", 1000, 1000 + len(copy), 50, 550, back, cs), ("u", "y", 0, 500, 50, 550, False, ":500")], "class string, contig string, start long, end long, from long, to long, back boolean, cs string")
    got = loci.difference_sites(hits, ["class"])
    assert rows(got) == sorted(("u", "x", k, p + 50, 1000 + at, u, g) for k, p, at, u, g in want)
    subs = sorted((p + 50, 1, 2) for k, p, *_ in want if k == "sub")
    assert rows(loci.differing(hits, got, ["class"], 100), "pos", "differing", "covering") == subs
    for bad in (cs + ":1", cs + "~gt5ag", None):
        with pytest.raises(Exception, match="not the differences"):
            loci.difference_sites(spark.createDataFrame([("u", "x", 1000, 1000 + len(copy), 50, 550, back, bad)], hits.schema), ["class"]).collect()


def test_loci_serve_the_count(spark):
    """Loci as class_loci() gives them are those that counted() takes."""
    hits = spark.createDataFrame([("g", "x", 900, 100, 700, 0, 600, 600, 600)], "genome string, contig string, length long, start long, end long, from long, to long, matches long, columns long")
    got = loci.class_loci(hits, ["genome"], pad=50)
    assert rows(got) == [("g", "x", 50, 750, 1)] and intervals.merge(got, ["genome", "contig"]).count() == 1
