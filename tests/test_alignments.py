import random
import struct
import zlib

import pytest

from copyloom.sources import alignments

CONTIGS = [("c1", 1_000_000), ("c2", 5000)]


def block(data):
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return struct.pack("<4sIBBHBBHH", b"\x1f\x8b\x08\x04", 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(r):
    name, flags, contig, pos, mapq, cigar, tlen, seq = r
    ref = next((k for k, (c, _) in enumerate(CONTIGS) if c == contig), -1)
    ops, n = [], ""
    for c in cigar if cigar != "*" else "":
        n, ops = (n + c, ops) if c.isdigit() else ("", [*ops, int(n) << 4 | "MIDNSHP=X".index(c)])
    code = ["=ACMGRSVTWYHKDBN".index(c) for c in (seq or "")] + [0] * (len(seq or "") % 2)
    packed = bytes(a << 4 | b for a, b in zip(code[::2], code[1::2], strict=True))
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(ops), flags, len(seq or ""), -1, -1, tlen) + name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + b"\xff" * len(seq or "")
    return struct.pack("<i", len(body)) + body


def made(rng, n, sizes, longest=200):
    rows = []
    for k in range(n):
        placed = rng.random() < 0.9
        size = rng.choice([0, 1, 50, rng.randint(1, longest)])
        contig = rng.choice(CONTIGS) if placed else (None, 0)
        rows.append((f"read{k}:{rng.randrange(10**rng.randint(1, 30))}", rng.randrange(4096), contig[0], rng.randrange(contig[1]) if placed else -1, rng.randrange(256), f"{size}M2S" if placed else "*", rng.randint(-500, 500), "".join(rng.choices("ACGTN", k=size)) or None))
    text = b"@HD\tVN:1.6\n"
    raw = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(CONTIGS)) + b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", s) for c, s in CONTIGS)
    raw += b"".join(map(record, rows))
    out, at = b"", 0
    while at < len(raw):
        k = rng.randint(*sizes)
        out, at = out + block(raw[at : at + k]), at + k
    return rows, out + alignments.END


@pytest.mark.parametrize("seed,sizes,longest", [(1, (200, 2000), 200), (2, (20, 60), 200), (3, (5000, 60_000), 200), (4, (300, 900), 8000), (5, (1, 5), 30)])
def test_any_cuts_give_the_same_rows(tmp_path, seed, sizes, longest):
    rows, data = made(random.Random(seed), 150 if sizes[0] < 10 else 700, sizes, longest)
    path = tmp_path / "a.bam"
    path.write_bytes(data)
    for split in (len(data), len(data) // 2 + 1, len(data) // 7 + 1, len(data) // 40 + 1):
        got = [tuple(r.values()) for s in range(0, len(data), split) for b in alignments.records(str(path), s, min(s + split, len(data))) for r in b.to_pylist()]
        assert got == rows, split


def test_source_reads_by_splits(spark, tmp_path):
    rows, data = made(random.Random(6), 2000, (500, 3000))
    (tmp_path / "a.bam").write_bytes(data)
    df = alignments.read_bam(spark, str(tmp_path / "a.bam"), splitBytes=str(len(data) // 5))
    assert df.rdd.getNumPartitions() == 6 and sorted(map(tuple, df.collect()), key=repr) == sorted(rows, key=repr)
    assert df.where("contig is null").count() == sum(r[2] is None for r in rows)


def test_no_records(tmp_path):
    _, data = made(random.Random(7), 0, (10, 20))
    (tmp_path / "a.bam").write_bytes(data)
    assert not list(alignments.records(str(tmp_path / "a.bam"), 0, len(data))) and not list(alignments.records(str(tmp_path / "a.bam"), 30, len(data)))
    got = alignments.probe(str(tmp_path / "a.bam"))
    assert got["whole"] and got["contigs"] == CONTIGS and got["text"].startswith("@HD")


def test_truncated_and_other_files_are_refused(spark, tmp_path):
    rows, data = made(random.Random(8), 300, (500, 3000))
    cut, other, short = tmp_path / "cut.bam", tmp_path / "other.bam", tmp_path / "short.bam"
    cut.write_bytes(data[: -len(alignments.END)])
    other.write_bytes(block(b"not alignments, but packed alike") + alignments.END)
    short.write_bytes(data[: len(data) // 2])
    for path, why in ((cut, "truncated"), (other, "not a BAM"), (short, "truncated")):
        with pytest.raises(Exception, match=why):
            alignments.read_bam(spark, str(path)).count()
    assert alignments.read_bam(spark, str(cut), endMarker="unchecked").count() == len(rows)
    with pytest.raises(Exception, match="cut short"):
        alignments.read_bam(spark, str(short), endMarker="unchecked").count()
