"""Packing: concatenate and cut.

The documents of all partitions stand end to end. A first pass tokenizes and gives each partition's total; prefix sums over
those totals give every document its place in the whole; the second pass cuts fixed windows, and a document that
crosses a boundary leaves a record in each window that it touches.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copyloom.llm.common import chunks, give_back, giving_back, small, stored, text_bytes

WINDOW, END_ID = 2048, 1
#: Stretches whose ids a Python worker remembers; it forgets all when there are more. Bytes of text that are looked up together, some thirty of memory each;
#: words encoded as one text, and texts encoded in one call, as the encoder's own results hold some hundred bytes a token.
REMEMBERED, TOGETHER, LOT, CALL = 600_000, 2 << 20, 32, 256
_TOKENIZERS: dict = {}
_MARKS = ".,;:!?$%&*#|"
#: How the default tokenizer prepares a text: spaces of any kind become one space, no piece holds a space, and what is no letter or digit
#: is a piece apart from them.
_APART = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pieces": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Ids:
    """The ids of stretches of text, remembered end to end in one array.

    A tokenizer that prepares texts as _APART says gives the same ids for the stretches between spaces and line feeds as for the whole
    text, and for marks at the end of a stretch as for the marks alone where an ASCII letter or digit stands before them; for any other
    tokenizer, a stretch is a whole text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        added = told.get("added_tokens") or []
        self.added = [x["content"] for x in added]
        plain = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added) and not any(c.isspace() for x in self.added for c in x) and not any(x[-1] in _MARKS for x in self.added)
        alike = told.get("normalizer") == _APART["normalizer"] and steps[0].get("pattern") == _APART["pieces"] and steps[0].get("invert") and len(steps) == 2 and steps[1].get("add_prefix_space") is False
        self.apart = bool(alike and plain and told.get("post_processor") is None)
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        suffix = told["model"].get("end_of_word_suffix")
        self.ends[[k for x, k in vocabulary.items() if suffix and x.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.sizes = [np.zeros(1 << 16, np.int64) for _ in range(2)]
        self.ids, self.filled = np.zeros(1 << 18, np.uint32), 0

    def _keep(self, stretches: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        k, n, end = len(self.place), len(stretches), self.filled + len(ids)
        while k + n > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.filled : end] = ids
        self.starts[k : k + n], self.sizes[k : k + n] = self.filled + np.cumsum(sizes) - sizes, sizes
        self.place.update(zip(stretches, range(k, k + n), strict=True))
        self.filled = end

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for k in range(0, len(texts), CALL) for e in self.model.encode_batch_fast(texts[k : k + CALL], add_special_tokens=False)]

    def learn(self, stretches: Iterable[str]) -> None:
        """Encodes those that are new. Words of letters go many at a time: each is one piece, with one end, or its lot is encoded word by word."""
        if len(self.place) > REMEMBERED:
            self.forget()
        new = [w for w in stretches if w not in self.place]
        words = [w for w in new if w.isalpha()] if self.apart else []
        lots = [words[k : k + LOT] for k in range(0, len(words), LOT)]
        ids, sizes, kept = [], [], []
        for lot, found in zip(lots, self._encoded([" ".join(x) for x in lots]), strict=True):
            ends = np.flatnonzero(self.ends[found])
            if len(ends) == len(lot):
                sizes.append(ends)
                ids += found
                kept += lot
        if kept:
            self._keep(kept, np.concatenate([np.diff(x, prepend=-1) for x in sizes]), np.array(ids, np.uint32))
            new = [w for w in new if w not in self.place]
        if new:
            found = self._encoded(new)
            self._keep(new, np.array([len(x) for x in found]), np.array([x for some in found for x in some], np.uint32))

    def places(self, stretches: pa.Array) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, stretches.to_pylist()), np.int64, len(stretches))

    def _cut(self, stretches: pa.Array) -> list[pa.Array]:
        """Words, in lower case where they are of ASCII and hold no added token, and the marks at their ends."""
        trimmed = pc.utf8_rtrim(stretches, characters=_MARKS)
        cut = pc.match_substring_regex(trimmed, "[A-Za-z0-9]$")
        word = pc.if_else(cut, trimmed, stretches)
        marks = pc.if_else(cut, pc.replace_substring_regex(stretches, rf"(?s)^.*[^{re.escape(_MARKS)}]", ""), "")
        lower = pc.string_is_ascii(word)
        for x in self.added:
            lower = pc.and_(lower, pc.invert(pc.match_substring(word, x, ignore_case=True)))
        return [pc.if_else(lower, pc.ascii_lower(word), word), marks]

    def texts(self, col: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each with the end id, and how many each has."""
        if self.apart:
            words = pc.split_pattern(pc.replace_substring(col, "\n", " "), " ")
            n, flat = pc.list_value_length(words).to_numpy(zero_copy_only=False), words.flatten().dictionary_encode()
            parts = [x.dictionary_encode() for x in self._cut(flat.dictionary)]
        else:
            n, flat = np.ones(len(col), np.int64), col.dictionary_encode()
            parts = [flat.dictionary.dictionary_encode()]
        ids, size = self._joined(parts)
        stretch = flat.indices.to_numpy(zero_copy_only=False)
        out, upto = _gathered(ids, (np.cumsum(size) - size)[stretch], size[stretch])
        total = upto[np.r_[0, np.cumsum(n)]]
        packed = np.full(len(out) + len(col), end_id, np.uint32)
        inner = np.ones(len(packed), bool)
        inner[total[1:] + np.arange(len(col))] = False
        packed[inner] = out
        return packed, np.diff(total) + 1

    def _joined(self, parts: list[pa.DictionaryArray]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stretches that consist of parts, end to end, and how many each has."""
        self.learn(dict.fromkeys(w for x in parts for w in x.dictionary.to_pylist()))
        at = np.stack([self.places(x.dictionary)[x.indices.to_numpy(zero_copy_only=False)] for x in parts], 1)
        ids, _ = _gathered(self.ids, self.starts[at].reshape(-1), self.sizes[at].reshape(-1))
        return ids, self.sizes[at].sum(1)


def _gathered(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of x end to end, and where each begins (and the last ends)."""
    upto = np.r_[0, np.cumsum(size)]
    return x[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])], upto


def token_table(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(part, start, n, doc_id, ids): each document's ids with the end id, and its start among those of its partition."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"part int, start long, n long, doc_id {slim.schema[0].dataType.simpleString()}, ids binary"

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _TOKENIZERS:
            _TOKENIZERS[tokenizer] = _Ids(tokenizer)
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offs = text_bytes(batch.column(1))
            for i, j in chunks(offs, TOGETHER):
                some = batch.slice(i, j - i)
                ids, n = _TOKENIZERS[tokenizer].texts(some.column(1).fill_null(""), end_id)
                ends = np.cumsum(n)
                raw = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((4 * np.r_[0, ends]).astype(np.int32)), pa.py_buffer(ids)])
                cols = [pa.array(np.full(j - i, part, np.int32)), pa.array(place + ends - n), pa.array(n), some.column(0), raw]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "start", "n", "doc_id", "ids"])
                place += int(ends[-1])
            give_back()

    return slim.mapInArrow(giving_back(tokenize), schema)


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document in a window: doc_id, start (its document's ids before it), length, doc_tokens (with the
    end id), sequence_id, offset (place in the window), continued and continues (the boundary records), ids (binary,
    unsigned 32-bit little-endian).

    Every window is full but the last. A null or empty text has the end id alone; repeated rows and null doc_ids are
    packed like others; an empty table gives no row; other columns are ignored. Rows can be of any length: a document
    is cut as often as it crosses a boundary.
    """
    made = stored(token_table(docs, tokenizer or default_tokenizer(), id_col, text_col, end_id), "ids")
    total = made.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row per input partition
    at = made.join(small(stored(base, "bases")), "part").withColumn("g", F.col("base") + F.col("start"))
    at = at.withColumn("sequence_id", F.explode(F.expr(f"sequence(g div {window}, (g + n - 1) div {window})")))
    lo = F.greatest("g", F.col("sequence_id") * window)
    hi = F.least(F.col("g") + F.col("n"), (F.col("sequence_id") + 1) * window)
    at = at.select("doc_id", (lo - F.col("g")).alias("start"), (hi - lo).alias("length"), F.col("n").alias("doc_tokens"), "sequence_id", (lo - F.col("sequence_id") * window).alias("offset"), "ids")
    return at.select(
        "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset",
        (F.col("start") > 0).alias("continued"), (F.col("start") + F.col("length") < F.col("doc_tokens")).alias("continues"),
        F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))").alias("ids"),
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the pieces of each window put together; a group has at most a window of ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))
