"""Sequences, k-mers and alignment records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
#: Starts of k-mers that are cut from one stretch; substring() walks a string from its start, so long ones are tiled first.
TILE = 256


def dna(text: Column) -> Column:
    """A stand-in sequence from prose: its letters a-z, four bases in turn."""
    return F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]", ""), LETTERS, BASES)


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement; string order is the order of packed bases."""
    return F.least(kmer, reverse_complement(kmer))


def circular(seq: Column, k: int) -> Column:
    """A circular unit with its first k - 1 bases repeated at its end."""
    return F.concat(seq, F.substring(seq, 1, k - 1))


#: Bytes of text in a part; a count of each different k-mer takes some 60 bytes.
PART_BYTES = 2_000_000


def spread_out(df: DataFrame, text: str | None = None) -> DataFrame:
    """The rows dealt out if the table comes in fewer partitions than there are cores, as a few small files do; larger ones stay as they are.
    If a column is named, also in parts of about PART_BYTES of it, so that what a task has of their k-mers doesn't grow with the table."""
    parts = df.sparkSession.sparkContext.defaultParallelism
    if text is not None:
        parts = max(parts, -(-(df.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0) // PART_BYTES))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def kmers(df: DataFrame, seq: str, k: int, spread: bool = False) -> DataFrame:
    """A row for each start of a k-mer of ACGT: off (0-based), kmer, canon, fwd (the k-mer is its own canonical form).

    Other columns stay but seq. K-mers that hold anything else are left out and the rest keep their offsets. spread deals the rows
    out first where a table comes in few partitions.
    """
    at = spread_out(df) if spread else df
    at = at.where(F.length(seq) >= k).withColumn("tile_", F.explode(F.sequence(F.lit(0), F.length(seq) - k, F.lit(TILE))))
    at = at.withColumn("piece_", F.expr(f"substring({seq}, tile_ + 1, {TILE + k - 1})")).drop(seq)
    at = at.withColumn("in_", F.explode(F.sequence(F.lit(0), F.length("piece_") - k)))
    at = at.withColumn("off", F.col("tile_") + F.col("in_")).withColumn("kmer", F.upper(F.expr(f"substring(piece_, in_ + 1, {k})"))).drop("tile_", "piece_", "in_")
    at = at.where(F.translate("kmer", "ACGT", "") == "")
    return at.withColumn("canon", canonical(F.col("kmer"))).withColumn("fwd", F.col("kmer") == F.col("canon"))


def valid_kmers(seq: Column, k: int) -> Column:
    """How many k-mers of ACGT a sequence has: those of each stretch without other letters."""
    stretches = F.split(F.upper(seq), "[^ACGT]+")
    return F.aggregate(stretches, F.lit(0).cast("long"), lambda n, x: n + F.greatest(F.length(x) - (k - 1), F.lit(0)))


#: Two bits a base; 4 is no base.
_BASE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _BASE[[_b, _b + 32]] = _i
#: Bases that are rolled together.
_PIECE = 1 << 20


def code(kmer: Column) -> Column:
    """A k-mer (at most 31 bases) as a number, two bits a base; numbers are in the order of the strings."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def rolled(c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all k-mers of bases c (0 to 3), and of their reverse complements, put together from those of lengths 1, 2, 4..."""
    n, got, block = len(c), None, (c.astype(np.uint64), 3 - c.astype(np.uint64), 1)
    while True:
        forward, back, size = block
        if k & size:
            if got is None:
                got = block
            else:
                f, r, a = got
                m = n - a - size + 1
                got = (f[:m] << np.uint64(2 * size) | forward[a : a + m], back[a : a + m] << np.uint64(2 * a) | r[:m], a + size)
        if got is not None and got[2] == k:
            return got[:2]
        m = n - 2 * size + 1
        block = (forward[:m] << np.uint64(2 * size) | forward[size : size + m], back[size : size + m] << np.uint64(2 * size) | back[:m], 2 * size)


def rolled_kmers(buf: np.ndarray, offs: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, off, code, fwd) of the k-mers of ACGT of sequences that stand end to end, piece by piece; the code is the canonical form's."""
    for lo in range(0, len(buf), _PIECE):
        c = _BASE[buf[lo : lo + _PIECE + k - 1]]
        if len(c) < k:
            return
        row = np.searchsorted(offs, np.arange(lo, lo + len(c)), "right") - 1
        bad = np.r_[0, np.cumsum(c == 4)]
        at = np.flatnonzero((bad[k:] == bad[:-k]) & (row[k - 1 :] == row[: len(row) - k + 1]))
        forward, back = (x[at] for x in rolled(c & 3, k))
        yield row[at], lo + at - offs[row[at]], np.minimum(forward, back).astype(np.int64), forward <= back


class Wanted:
    """A set of codes: a table of bits by hash rules most others out, a sorted array decides."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.unique(codes)
        self.bits = min(27, max(10, int(16 * len(self.codes)).bit_length()))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self._slot(self.codes)] = True

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def has(self, codes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.table[self._slot(codes)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.codes, codes[maybe]), len(self.codes) - 1)
            maybe = maybe[self.codes[at] == codes[maybe]]
        return maybe


def _end_to_end(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column's sequences, and where each starts."""
    col = col.fill_null("") if col.null_count else col
    wide = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offs = np.frombuffer(col.buffers()[1], wide)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8), offs - offs[0]


def counted_kmers(df: DataFrame, seq: str, k: int, parts: int) -> DataFrame:
    """(code, n): how often each k-mer of ACGT is in seq, k at most 31. They are counted piece by piece, and the counts summed in so many parts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, codes, _ in rolled_kmers(*_end_to_end(batch.column(0)), k):
                code, n = np.unique(codes, return_counts=True)
                for lo in range(0, len(code), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)].astype(np.int64)) for x in (code, n)], names=["code", "n"])

    return df.select(seq).mapInArrow(count, "code long, n long").repartition(parts, "code").groupBy("code").agg(F.sum("n").alias("n"))


def packed_kmers(df: DataFrame, seq: str, k: int, wanted: DataFrame | None = None, most: int = 2_000_000) -> DataFrame:
    """The other columns of df with off, code and fwd for each k-mer of ACGT in seq, k at most 31; only those whose code is in wanted (code) if it
    is given. Up to `most` wanted codes go to the tasks, which look them up before a row is made; more are joined."""
    slim = df.select(*(c for c in df.columns if c != seq), F.col(seq).alias("seq_"))
    look = None
    if wanted is not None:
        wanted = wanted.select("code").distinct()
        some = wanted.limit(most + 1).toPandas().code.to_numpy(np.int64)
        look = df.sparkSession.sparkContext.broadcast(some) if len(some) <= most else None
    schema = slim.drop("seq_").schema.add("off", "long").add("code", "long").add("fwd", "boolean")

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Wanted(look.value) if look is not None else None
        for batch in batches:
            for row, off, codes, fwd in rolled_kmers(*_end_to_end(batch.column(batch.num_columns - 1)), k):
                if found is not None:
                    at = found.has(codes)
                    row, off, codes, fwd = row[at], off[at], codes[at], fwd[at]
                for lo in range(0, len(row), 1 << 16):
                    part = slice(lo, lo + (1 << 16))
                    take = pa.array(row[part])
                    cols = [batch.column(i).take(take) for i in range(batch.num_columns - 1)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(off[part]), pa.array(codes[part]), pa.array(fwd[part])], names=schema.names)

    got = slim.mapInArrow(roll, schema)
    return got.join(wanted, "code", "left_semi").select(*schema.names) if wanted is not None and look is None else got


def low_complexity(kmer: Column) -> Column:
    """At most two different bases, or a run of 18."""
    return (F.size(F.array_distinct(F.split(kmer, ""))) <= 2) | kmer.rlike("A{18}|C{18}|G{18}|T{18}")


def primary(flags: Column) -> Column:
    """Not secondary, not failed, not supplementary; duplicates and low mapping qualities stay."""
    return flags.bitwiseAND(0xB00) == 0


def five_prime(pos: Column, cigar: Column, reverse: Column) -> Column:
    """Where the sequenced 5' end of a read lies, clipped bases included; hard clips are stepped over."""
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), 1)
    kind = lambda x: F.substring(x, -1, 1)
    size = lambda x: F.regexp_extract(x, r"^\d+", 0).cast("long")
    soft = F.filter(ops, lambda x: kind(x) != "H")
    lead = F.when(kind(F.get(soft, F.lit(0))) == "S", size(F.get(soft, F.lit(0)))).otherwise(0)
    last = F.get(soft, F.size(soft) - 1)
    trail = F.when(kind(last) == "S", size(last)).otherwise(0)
    along = F.aggregate(F.filter(ops, lambda x: kind(x).isin("M", "D", "N", "=", "X")), F.lit(0).cast("long"), lambda s, x: s + size(x))
    return F.when(reverse, pos + along + trail - 1).otherwise(pos - lead)


def gc_percent(gc: Column, length: Column | int) -> Column:
    """The rounded percentage (100 gc + length / 2) div length."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.floor((100 * gc + F.floor(n / 2)) / n).cast("long")


def hit_bin(hits: Column, valid: Column) -> Column:
    """The tenth of a read's k-mers that hit: 0 to 10."""
    return F.least(F.lit(10).cast("long"), F.floor(hits * 10 / F.greatest(valid, F.lit(1))))
