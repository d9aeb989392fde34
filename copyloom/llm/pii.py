"""Personal data by bootstrapped contextual extraction.

Base matches of four kinds are the seed entities. The words around them are lexical patterns, and so are the words around whatever else looks like an
identifier; Spark scores patterns by the share of their instances that are known to be of a kind, and instances by their best pattern, in turns.
Patterns of high confidence then name what stands in their slot, in whatever form, and what is found so supports patterns in turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.llm.common import small, stored

KINDS = ("email", "ip", "card", "phone")
#: Known instances that a pattern needs; share of known instances that makes a pattern, and its instances, trusted; mean rise of
#: scores in a round at which they count as settled; characters before and after a span in which its context is sought.
SUPPORT, TRUST, SETTLED, BEFORE, AFTER = 5, 0.8, 1e-6, 80, 40
#: The kind of a candidate that isn't known.
ANY = -1

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match always starts a run of digits
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Forms that span several words: addresses spelt out or without a dot, long numbers in groups, local numbers; names and labels of an address have at most 64 and 63 characters.
_LOOSE = (
    re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|@|(?<= )at(?= )) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.|(?<= )dot(?= )) ?[A-Za-z0-9-]{1,63})+|[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]{1,63}"),
    re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    re.compile(r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{2,6}){2,4}(?![0-9])"),
    re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-][0-9]{3,4}(?![0-9])"),
)
#: Any other word with a digit or an @ in it may be an identifier, without the marks around it, if it has so many characters.
_WORD, LEAST = re.compile(r"\S+"), 4
_AROUND = "\"'`.,;:!?()[]{}<>|*=%"


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if k % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int, int]]:
    """Before each @, the run of an address's characters; a run whose @ has no domain after it begins no address from any of its places."""
    at, done = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        found = _DOMAIN.match(text, at + 1) if lo < at else None
        done = found.end() if found else at + 1
        if found:
            yield 0, lo, done
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base matches, by kind, then start."""
    out = list(_emails(text))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _free(spans: Iterable[tuple[int, int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those spans, in order of their starts, that overlap none of the taken ones."""
    held, out, k, reach = sorted((s, e) for _, s, e in taken), [], 0, 0
    for kind, start, end in spans:
        while k < len(held) and held[k][0] < end:
            reach = max(reach, held[k][1])
            k += 1
        if start >= reach:
            out.append((kind, start, end))
    return out


def _candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What else may be an identifier, of whatever kind: forms of several words, then words; none overlaps another or a base span."""
    if not _DIGIT.search(text) and "@" not in text and "at" not in text:
        return []
    out: list[tuple[int, int, int]] = []
    for kind, form in enumerate(_LOOSE):
        if kind == 0 and not ("@" in text or "(at)" in text or "[at]" in text or " dot " in text):
            continue
        whole = ((ANY, m.start(), m.end()) for m in form.finditer(text) if _edge(text, m.start() - 1) and _edge(text, m.end()))
        out += _free(whole, base + out)
    return out + _free(_words(text), base + out)


def _edge(text: str, k: int) -> bool:
    return not 0 <= k < len(text) or text[k].isspace() or text[k] in _AROUND


def _words(text: str) -> Iterator[tuple[int, int, int]]:
    for m in _WORD.finditer(text):
        if not _DIGIT.search(m[0]) and "@" not in m[0]:
            continue
        word = m[0].lstrip(_AROUND)
        start = m.end() - len(word)
        word = word.rstrip(_AROUND)
        if len(word) >= LEAST:
            yield ANY, start, start + len(word)


def _contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns that a span stands in: the word before it, the two before it, and the words on both sides; lower-cased."""
    left = text[max(0, start - BEFORE) : start].lower().split()[-2:]
    right = text[end : end + AFTER].lower().split()[:1]
    one = left[-1] if left else ""
    return [f"1 {one}", f"2 {' '.join(left)}", f"3 {one} _ {right[0] if right else ''}"]


def _key(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True)


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_SEEN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))])


def _scan(docs: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, seen = [], []
            for text in batch.column(2).to_pylist():
                text = text or ""
                spans = base_spans(text)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                both = [(x, True) for x in spans] + [(x, False) for x in _candidates(text, spans)]
                seen.append([{"kind": k, "start": s, "end": e, "seed": seed, "instance": _key(text[s:e]), "patterns": [_key(c) for c in _contexts(text, s, e)]} for (k, s, e), seed in both])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, pa.list_(_SPAN)), pa.array(seen, pa.list_(_SEEN))], names=["uid", "doc_id", "base", "seen"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(scan, f"uid long, doc_id {kind}, base array<struct<kind:int,start:bigint,end:bigint>>, seen array<struct<kind:int,start:bigint,end:bigint,seed:boolean,instance:bigint,patterns:array<bigint>>>")


def _bootstrapped(seen: DataFrame) -> DataFrame:
    """Rows of seen, not seeds, whose instance ends as known: (uid, kind, start, end), with the kind of the best pattern.

    A pattern's trust in a kind is the share of all its different instances that are known to be of it, by their scores. Instances found in one round
    count as support in the next. Scores only rise, so rounds come to rest; they end when none adds an instance or raises scores further, as rising
    scores alone can still carry a pattern over TRUST.
    """
    of = F.when(F.col("seed"), F.col("kind"))
    graph = seen.select("instance", of.alias("seed"), F.explode("patterns").alias("pattern"))
    graph = stored(graph.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "graph")
    # Patterns with fewer instances than the support asks for never gain it; all others can, if a seed stands in one of them.
    live = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") >= SUPPORT)
    graph = stored(graph.join(live, "pattern"), "live")
    seeds = graph.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    known, before = seeds.distinct(), (0, 0.0)
    while True:
        rated = graph.join(known, "instance").groupBy("pattern", "kind").agg((F.sum("score") / F.first("all")).alias("trust"), F.count_if(F.col("score") >= TRUST).alias("known"))
        rated = rated.where((F.col("trust") >= TRUST) & (F.col("known") >= SUPPORT)).select("pattern", "kind", "trust")
        met = graph.where("seed is null").join(small(stored(rated, "rated")), "pattern")
        best = met.groupBy("instance").agg(F.max(F.struct("trust", -F.col("kind"))).alias("b")).select("instance", (-F.col("b.col2")).alias("kind"), F.col("b.trust").alias("score"))
        best = stored(best, "best")
        now = best.agg(F.count(F.lit(1)), F.coalesce(F.sum("score"), F.lit(0.0))).first()
        if now[0] == before[0] and now[1] - before[1] <= SETTLED * max(1, now[0]):
            break
        known, before = seeds.distinct().unionByName(best.join(seeds.select("instance").distinct(), "instance", "left_anti")), now
    return seen.where("not seed").drop("kind").join(best.select("instance", "kind"), "instance").select("uid", "kind", "start", "end")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added): the spans (kind, start, end) of the base rules and those that trusted patterns add, in code
    points of the whole text, end exclusive; kind is a place in KINDS. Added spans overlap no base span.

    One row per row of docs; a null or empty text has no spans, repeated rows have the same spans each (their instances count
    once in the graph). An empty table gives an empty one; other columns are ignored.
    """
    slim = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = stored(_scan(slim), "spans")
    seen = table.select("uid", F.inline("seen"))
    more = _bootstrapped(seen).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    return table.join(more, "uid", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def _told(spans):
    names = F.array(*map(F.lit, KINDS))
    one = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans (base and added), n_added, n_spans (all)."""
    found = find_pii(docs)
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))
