import random

import pytest

from copyloom.sources import genomes


def fasta(rng, sizes, width, end="\n"):
    seqs = {f"c{k}": "".join(rng.choices("ACGTN", k=n)) for k, n in enumerate(sizes)}
    lines = []
    for name, s in seqs.items():
        w = width or rng.randint(5, 90)
        lines += [f">{name} some words", *(s[i : i + w].lower() if i % 3 else s[i : i + w] for i in range(0, len(s), w)), *([""] if rng.random() < 0.5 else [])]
    return seqs, end.join(lines) + end


@pytest.mark.parametrize("chunk,end", [(100, "\n"), (1000, "\r\n"), (7, "\n")])
def test_chunks_and_fetches_equal_whole_contigs(spark, tmp_path, monkeypatch, chunk, end):
    monkeypatch.setattr(genomes, "PART", 500)
    rng = random.Random(chunk)
    seqs, text = fasta(rng, [1000, 1, 0, 999, 2503, 100], 0, end)
    (tmp_path / "g.fa").write_text(text, newline="")
    chunks = genomes.read_chunks(spark, str(tmp_path / "g.fa"), chunk).cache()
    by = {}
    for r in chunks.collect():
        assert len(r.bases) <= chunk and r.length == len(seqs[r.contig])
        by.setdefault(r.contig, {})[r.chunk] = r.bases
    assert {c: "".join(x[k] for k in sorted(x)) for c, x in by.items()} == {c: s for c, s in seqs.items() if s}
    regions = [(c, s, s + n) for c in [*seqs, "none"] for s in (0, 5, 95, 990, -7, 5000) for n in (0, 1, 10, 300)]
    df = spark.createDataFrame(regions, "contig string, start long, end long")
    got = {(r.contig, r.start, r.end): r.seq for r in genomes.fetched(chunks, df, chunk).collect()}
    assert len(got) == len(regions)
    assert all(got[c, s, e] == (seqs[c][max(0, s) : max(0, e)] if seqs.get(c) else None) for c, s, e in regions)


def test_windows_across_chunks_are_whole(spark, tmp_path):
    seqs, text = fasta(random.Random(1), [333, 64], 60)
    (tmp_path / "g.fa").write_text(text)
    at = genomes.tiled(genomes.read_chunks(spark, str(tmp_path / "g.fa"), 64), 9, 64)
    got = sorted((r.contig, r.off + i, r.seq[i : i + 10]) for r in at.collect() for i in range(min(64, max(0, len(r.seq) - 9))))
    assert got == sorted((c, i, s[i : i + 10]) for c, s in seqs.items() for i in range(len(s) - 9))


@pytest.mark.parametrize("text,why", [("ACGT\n>a\nAC\n", "before the first name"), (">a\nAC\n>b\nA\n>a\nAC\n", "comes twice")])
def test_refusals(spark, tmp_path, text, why):
    (tmp_path / "g.fa").write_text(text)
    with pytest.raises(ValueError, match=why):
        genomes.read_chunks(spark, str(tmp_path / "g.fa"))


def test_other_letters_end_the_job(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">a\nAC!T\n")
    with pytest.raises(Exception, match="not a sequence"):
        genomes.read_chunks(spark, str(tmp_path / "g.fa")).count()
