"""Block-compressed alignments (BAM) as a Spark data source that splits a file anywhere.

A split begins at the first compressed block after its cut, and at the first record that begins there: the place from which records follow one another without a
contradiction through the blocks at hand. A record belongs to the split of the block in which it begins. Files are opened by path on every executor, so they must lie on a file system that all mount.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from copyloom.sources.tables import READS

#: The empty block that ends a whole file; bytes of a split; bytes that are unpacked before records' places are judged; records of a batch.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
SPLIT, AHEAD, BATCH = 64 << 20, 1 << 18, 8192
_MAGIC, _LONGEST = b"\x1f\x8b\x08\x04", 1 << 28
_BASES, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_PAIRS = [_BASES[b >> 4] + _BASES[b & 15] for b in range(256)]
_FIXED = struct.Struct("<iiiBBHHHiiii")


def _block_size(head: bytes) -> int | None:
    """The size of the block that begins with these bytes, from its extra field; null if they begin none."""
    if len(head) < 18 or head[:4] != _MAGIC:
        return None
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= min(end, len(head)):
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return None


def _first_block(f: BinaryIO, at: int, size: int) -> int | None:
    """Where the first block at or after a place begins: one that another, or the end of the file, follows."""
    f.seek(at)
    data = f.read(1 << 17)
    k = data.find(_MAGIC)
    while k >= 0:
        n = _block_size(data[k : k + 512])
        if n is not None and (at + k + n == size or data[k + n : k + n + 4] == _MAGIC[: len(data[k + n : k + n + 4])] != b""):
            return at + k
        k = data.find(_MAGIC, k + 1)
    return None


def _blocks(f: BinaryIO, at: int) -> Iterator[tuple[int, bytes]]:
    """(place, data) of the blocks from a place on. Raises ValueError where a block is cut short."""
    f.seek(at)
    while head := f.read(18):
        n = _block_size(head)
        if n is None:
            raise ValueError(f"no block at {at}")
        body = head + f.read(n - 18)
        if len(body) < n:
            raise ValueError(f"the block at {at} is cut short")
        yield at, zlib.decompressobj(31).decompress(body)
        at += n


class _Stream:
    """The unpacked bytes from a block on, with the places of the blocks they come from."""

    def __init__(self, f: BinaryIO, at: int):
        self.blocks, self.data, self.base, self.ended = _blocks(f, at), bytearray(), 0, False
        self.starts: list[tuple[int, int]] = []  # (place in the unpacked bytes, place of the block)

    def more(self, upto: int) -> bool:
        """Unpacks until the place `upto` is at hand; whether it is."""
        while self.base + len(self.data) < upto and not self.ended:
            try:
                place, data = next(self.blocks)
            except StopIteration:
                self.ended = True
                break
            self.starts.append((self.base + len(self.data), place))
            self.data += data
        return self.base + len(self.data) >= upto

    def take(self, at: int, n: int) -> bytes:
        return bytes(self.data[at - self.base : at - self.base + n])

    def block(self, at: int) -> int:
        """The block in which a place lies; places before it are let go."""
        while len(self.starts) > 1 and self.starts[1][0] <= at:
            self.starts.pop(0)
        if at - self.base > 1 << 20:
            del self.data[: at - self.base]
            self.base = at
        return self.starts[0][1]


def header(f: BinaryIO) -> tuple[str, list[tuple[str, int]], int]:
    """(text, contigs, place of the first record in the unpacked file). Raises ValueError if this is no such file."""
    s = _Stream(f, 0)
    if not s.more(12) or s.take(0, 4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    n = int.from_bytes(s.take(4, 4), "little")
    s.more(12 + n)
    text = s.take(8, n).rstrip(b"\0").decode("utf-8", "replace")
    at, contigs = 12 + n, []
    for _ in range(int.from_bytes(s.take(8 + n, 4), "little")):
        s.more(at + 4)
        k = int.from_bytes(s.take(at, 4), "little")
        if not s.more(at + 8 + k):
            raise ValueError("the header is cut short")
        contigs.append((s.take(at + 4, k - 1).decode(), int.from_bytes(s.take(at + 4 + k, 4), "little")))
        at += 8 + k
    return text, contigs, at


def probe(path: str) -> dict:
    """Format, header text, contigs, and whether the file has its end marker."""
    with open(path, "rb") as f:
        text, contigs, _ = header(f)
        f.seek(max(0, os.path.getsize(path) - len(END)))
        return {"format": "BAM", "text": text, "contigs": contigs, "whole": f.read() == END}


def _fits(s: _Stream, at: int, contigs: list[tuple[str, int]]) -> int | None:
    """The place after the record at a place, if the bytes there can be one."""
    head = s.take(at, 36)
    size, ref, pos, name, _, _, ops, _, bases, mate, mate_pos, _ = _FIXED.unpack(head)
    if not 32 <= size <= _LONGEST or not -1 <= ref < len(contigs) or not -1 <= mate < len(contigs) or name < 1 or bases < 0 or pos < -1 or mate_pos < -1:
        return None
    if 32 + name + 4 * ops + (bases + 1) // 2 + bases > size or ref >= 0 and pos > contigs[ref][1] or mate >= 0 and mate_pos > contigs[mate][1]:
        return None
    told = s.take(at + 36, name)
    if len(told) == name and (told[-1] or not all(33 <= c <= 126 for c in told[:-1])):
        return None
    return at + 4 + size


def _first_record(s: _Stream, contigs: list[tuple[str, int]], end: int) -> int | None:
    """The first place, in a block before `end`, from which records follow one another through all that is at hand."""
    at = 0
    while True:
        if not s.more(at + 36) or s.block(at) >= end:
            return None
        s.more(at + AHEAD)
        place, steps = at, 0
        while place is not None and s.more(place + 36) and (place < at + AHEAD or steps < 2):
            place, steps = _fits(s, place, contigs), steps + 1
        if place is not None and (not s.ended or place == s.base + len(s.data)):
            return at
        at += 1


def _decoded(s: _Stream, at: int, contigs: list[tuple[str, int]]) -> tuple:
    size, ref, pos, name, mapq, _, ops, flags, bases, _, _, tlen = _FIXED.unpack(s.take(at, 36))
    rest = s.take(at + 36, size - 32)
    cigar = struct.unpack_from(f"<{ops}I", rest, name)
    seq = "".join(map(_PAIRS.__getitem__, rest[name + 4 * ops : name + 4 * ops + (bases + 1) // 2]))[:bases]
    told = "".join(f"{c >> 4}{_OPS[c & 15]}" for c in cigar) or "*"
    return rest[: name - 1].decode(), flags, contigs[ref][0] if ref >= 0 else None, pos, mapq, told, tlen, seq or None


_KINDS = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string())
_NAMES = [c.split()[0] for c in READS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def records(path: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
    """The records that begin in blocks of [start, end), in batches."""
    with open(path, "rb") as f:
        _, contigs, first = header(f)
        block = 0 if start == 0 else _first_block(f, start, os.path.getsize(path))
        if block is None or block >= end:
            return
        at = first
        if start > 0:
            # The header may go on here: its end is known, as are the blocks before.
            head = _Stream(f, 0)
            while head.more(head.base + len(head.data) + 1) and head.starts[-1][1] < block and head.starts[-1][0] <= first:
                pass
            lead = next((k for k, place in head.starts if place == block), -1)
        s = _Stream(f, block)
        if start > 0:
            at = first - lead if 0 <= lead <= first else _first_record(s, contigs, end)
        rows: list[tuple] = []
        while at is not None and s.more(at + 36) and s.block(at) < end:
            nxt = at + 4 + int.from_bytes(s.take(at, 4), "little")
            if not s.more(nxt):
                raise ValueError(f"{path}: the last record is cut short")
            rows.append(_decoded(s, at, contigs))
            at = nxt
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


class Cut(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split, self.unchecked = options["path"].removeprefix("file://"), int(options.get("splitBytes", SPLIT)), options.get("endMarker", "required") != "required"

    def partitions(self) -> list[Cut]:
        if not self.unchecked and not probe(self.path)["whole"]:
            raise ValueError(f"{self.path} has no end marker: it is truncated")
        size = os.path.getsize(self.path)
        return [Cut(self.path, s, min(s + self.split, size)) for s in range(0, size, self.split)]

    def read(self, partition: Cut) -> Iterator[pa.RecordBatch]:
        return records(partition.path, partition.start, partition.end)


class Alignments(DataSource):
    """Options: splitBytes; endMarker, unchecked to read files without one."""

    @classmethod
    def name(cls) -> str:
        return "alignments"

    def schema(self) -> str:
        return READS

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read_bam(spark: SparkSession, path: str, **options) -> DataFrame:
    """The alignment records (READS) of a BAM file; positions are 0-based, and contig is null for reads without a place. Raises an error for a file that is truncated or of another kind."""
    spark.dataSource.register(Alignments)
    return spark.read.format("alignments").options(**options).load(path)
