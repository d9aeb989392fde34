"""Which terms set a source apart from its language, and how far sources are from one another.

Counts of terms by group (lang, source) are smoothed to integer probabilities, and two of them differ by f = (p - q)^2 div (p + q). The terms of
a group that stand out most are searched by upper bounds: its postings lie in buckets of similar counts, the largest p of a bucket and the least q
of its terms in the language bound f for all of it, and buckets are evaluated in waves, best bound first, until all that is left is strictly below
the tenth value. Pairs of sources are summed from the postings that two sources share, plus what each has alone by its histogram of probabilities.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copyloom.llm.common import small, stored

#: Documents of a language that a term needs, and ranks of terms returned.
LEAST_DOCS, TOP = 10, 10
#: Different (group, term) counts that a task holds before it passes them on; sources in a block of a tile; terms of a tile compared together.
HELD, BLOCK, TERMS = 1 << 19, 512, 512
#: Terms that the first wave's buckets reach, and by how much further those of each wave reach than those of the one before.
WAVE, GROWTH = 2 * TOP, 8
#: An exact probability of n among total = N + 2 V, and f of p and q; decimals hold a product of any two counts.
_SHARE = "1 + (1000000000BD * cast({n} + 2 as decimal(19, 0))) div cast({total} as decimal(19, 0))"
_F = "(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))"

_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of columns lang, source and text as bytes, in parts."""
    counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
    again: dict[tuple[str, str], Counter] = defaultdict(Counter)  # occurrences beyond the first of each document

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), seen in counts.items():
            terms, more = list(seen), again[lang, source]
            n = np.fromiter(seen.values(), np.int64, len(seen))
            docs = n - np.fromiter((more.get(w, 0) for w in terms), np.int64, len(seen))
            for lo in range(0, len(n), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                cols = (pa.array([x] * len(terms[part]), pa.string()) for x in (lang, source))
                yield pa.RecordBatch.from_arrays([*cols, pa.array(terms[part], pa.binary()), pa.array(n[part]), pa.array(docs[part])], names=["lang", "source", "term", "n", "docs"])
        counts.clear()
        again.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = text.as_py().translate(_TERM).split()
            seen, own = counts[lang, source], Counter(words)
            held -= len(seen)
            seen.update(words)
            held += len(seen)
            again[lang, source].update({w: k - 1 for w, k in own.items() if k > 1})
            if held >= HELD:
                yield from out()
                held = 0
    yield from out()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by pair (lang, a, b), a < b, over the terms that both have, of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).

    A row has a block's postings of a term, as arrays of (source's number, p, p0); rows of a tile stand together, those of a term side by side.
    """
    f = lambda p, q: (p - q) ** 2 // (p + q)
    state: dict = {"tile": None, "sum": None, "rows": []}

    def add() -> None:
        rows, (_, i, j) = state["rows"], state["tile"]
        if not rows:
            return
        terms = {t: k for k, t in enumerate(dict.fromkeys(r[0] for r in rows))}
        size = [len(posts) for _, _, posts in rows]
        k, block = (np.repeat(x, size) for x in ([terms[r[0]] for r in rows], [r[1] for r in rows]))
        posts = np.concatenate([r[2] for r in rows])
        p, p0, has = (np.zeros((2, len(terms), BLOCK), x) for x in (np.int64, np.int64, bool))
        for side, of in enumerate((i, j)):
            here = block == of
            at = (side, k[here], posts[here, 0] % BLOCK)
            p[at], p0[at], has[at] = posts[here, 1], posts[here, 2], True
        for a in np.flatnonzero(has[0].any(0)):
            t = np.flatnonzero(has[0][:, a])
            b = np.flatnonzero(has[1][t].any(0))
            b = b[b > a] if i == j else b
            x, x0, y, y0, both = p[0][t, a][:, None], p0[0][t, a][:, None], p[1][t][:, b], p0[1][t][:, b], has[1][t][:, b]
            x, x0, y, y0 = (np.where(both, v, 1) for v in (x, x0, y, y0))
            state["sum"][a, b] += np.where(both, f(x, y) - f(x, y0) - f(x0, y) + f(x0, y0), 0).sum(0)
        rows.clear()

    def out() -> Iterator[pa.RecordBatch]:
        if state["tile"] is not None:
            add()
            lang, i, j = state["tile"]
            a, b = np.nonzero(state["sum"])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a + i * BLOCK), pa.array(b + j * BLOCK), pa.array(state["sum"][a, b])], names=["lang", "a", "b", "f"])

    for batch in batches:
        lists = batch.column(5)
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = np.stack([c.to_numpy() for c in lists.flatten().flatten()], 1)
        for (lang, i, j, term, block), s, e in zip(zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if (lang, i, j) != state["tile"]:
                yield from out()
                state |= {"tile": (lang, i, j), "sum": np.zeros((BLOCK, BLOCK), np.int64)}
            elif len(state["rows"]) >= TERMS and term != state["rows"][-1][0]:
                add()
            state["rows"].append((term, block, flat[s:e]))
    yield from out()


def _pairs(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of a language's sources.

    A sum over all V terms is V f(p0, q0), plus what the terms of either side alone add to that, as if the other had none of them (from the
    side's histogram of p), plus the correction for the terms that both have, from tiles of two blocks of sources by ranges of terms.
    """
    numbered = Window.partitionBy("lang").orderBy("source")
    at = groups.withColumn("at", (F.row_number().over(numbered) - 1).cast("long")).withColumn("p0", F.expr(_SHARE.format(n="cast(0 as long)", total="total")))
    at = stored(at.where("v > 0"), "numbered-groups")
    hist = terms.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k"))
    hist = stored(hist.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "k")).alias("hist")), "histograms")
    mine = at.join(small(hist), ["lang", "source"], "left").select("lang", F.col("at").alias("x"), F.col("p0").alias("x0"), "hist", "v")
    other = small(at.select("lang", F.col("at").alias("y"), F.col("p0").alias("y0")))
    none = _F.format(p="x0", q="y0")
    alone = F.expr(f"coalesce(aggregate(hist, 0L, (s, h) -> s + h.k * ({_F.format(p='h.p', q='y0')} - {none})), 0L) + if(x < y, v * ({none}), 0L)")
    alone = mine.join(other, "lang").where("x != y").select("lang", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), alone.alias("f"))
    blocks = at.groupBy("lang").agg(F.expr(f"max(at) div {BLOCK} + 1").alias("blocks"))
    posts = terms.join(small(at.select("lang", "source", "at", "p0")), ["lang", "source"]).withColumn("block", F.expr(f"at div {BLOCK}"))
    posts = posts.groupBy("lang", "term", "block").agg(F.collect_list(F.struct("at", "p", "p0")).alias("posts")).join(F.broadcast(blocks), "lang")
    posts = posts.withColumn("o", F.explode(F.expr("sequence(0L, blocks - 1)"))).where("blocks > 1 or size(posts) > 1")
    tiles = posts.select("lang", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "term", "block", "posts")
    tiles = tiles.repartition("lang", "i", "j", F.pmod(F.xxhash64("term"), F.lit(1024))).sortWithinPartitions("lang", "i", "j", "term")
    both = tiles.mapInArrow(_shared, "lang string, a long, b long, f long")
    total = stored(alone.unionByName(both).groupBy("lang", "a", "b").agg(F.sum("f").alias("value")), "pairs")
    names = [small(at.select("lang", F.col("at").alias(k), F.col("source").alias(name))) for k, name in (("a", "source"), ("b", "item"))]
    named = total.join(names[0], ["lang", "a"]).join(names[1], ["lang", "b"]).select("lang", "source", "item", "value")
    return named.unionByName(named.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def _standing_out(terms: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): of each group the TOP terms by f among those with p > q, by bounds of buckets."""
    group = ["lang", "source"]
    bounds = terms.groupBy(*group, "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q"), F.count(F.lit(1)).alias("k")).where("p > q")
    bounds = bounds.select(*group, "bucket", "k", F.expr(_F.format(p="p", q="q")).alias("bound"))
    best = Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bounds = stored(bounds.withColumn("before", F.coalesce(F.sum("k").over(best), F.lit(0))), "buckets")  # some hundreds a group at most
    order = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    top, lo, hi = None, 0, WAVE
    while True:
        left = bounds.where(F.col("before") >= lo)
        if top is not None:
            tenth = top.where(F.col("rank") == TOP).select(*group, F.col("value").alias("tenth"))
            left = left.join(small(tenth), group, "left").where("tenth is null or bound >= tenth")
            if left.isEmpty():
                return top
        seen = terms.where("p > q").join(small(stored(left.where(F.col("before") < hi).select(*group, "bucket"), "wave")), [*group, "bucket"], "left_semi")
        seen = seen.select(*group, F.col("term").alias("item"), F.expr(_F.format(p="p", q="q")).alias("value"))
        if top is not None:
            seen = seen.unionByName(top.select(*group, "item", "value"))
        top = stored(seen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP), "top")
        lo, hi = hi, hi * GROWTH


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: for each group, part `pair` has every other source of its language with the sum of f over the
    language's terms, and part `term` the TOP terms with the largest f to the language's own probabilities, of those that the group has more of.

    Null texts, languages and sources count as empty. Terms are runs of letters A-Z, lower-cased, and of all characters beyond ASCII. A
    language keeps the terms in at least least_docs of its documents; a group without any of them has pairs (with nothing but added counts), and
    pairs of a language without terms have value 0. Ties have the item first in order of UTF-8. Repeated rows count each. An empty table gives
    an empty one; other columns are ignored.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    slim = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source"), name(text_col).cast("binary").alias("text"))
    parts = slim.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    counts = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # A row per term with its postings: as many as the language has sources.
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.collect_list(F.struct("source", "n")).alias("posts"))
    kept = stored(kept.where(F.col("docs") >= least_docs).select("lang", F.col("term").cast("string").alias("term"), "all", "posts"), "postings")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("all_n"))
    sums = kept.select("lang", F.inline("posts")).groupBy("lang", "source").agg(F.sum("n").alias("sum_n"))
    groups = slim.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stored(groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("sum_n", F.lit(0)) + 2 * F.col("v")).alias("total"), (F.col("all_n") + 2 * F.col("v")).alias("lang_total")), "groups")
    terms = kept.select("lang", "term", "all", F.inline("posts")).join(small(groups), ["lang", "source"])
    bucket = F.when(F.col("n") < 64, F.col("n")).otherwise(16 + F.floor(8 * F.log2("n")))  # single counts, then eighths of octaves
    terms = stored(terms.select("lang", "source", "term", bucket.alias("bucket"), F.expr(_SHARE.format(n="n", total="total")).alias("p"), F.expr(_SHARE.format(n="all", total="lang_total")).alias("q")), "terms")
    pairs = _pairs(groups, terms)
    void = groups.where("v = 0").select("lang", "source")
    pairs = pairs.unionByName(void.join(small(void.select("lang", F.col("source").alias("item"))), "lang").where("source != item").select("lang", "source", "item", F.lit(0).cast("long").alias("value")))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    parts = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, x in (("pair", ranked), ("term", _standing_out(terms)))]
    return parts[0].unionByName(parts[1])


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT id, lang, source, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 10),
langs AS (SELECT lang, sum(n)::HUGEINT AS n, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(t.n, 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) t USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.n + 2 * l.v) AS p, 1 + 1000000000 * (k.n + 2) // (l.n + 2 * l.v) AS q
  FROM g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM k WHERE part = 'pair' OR rank <= 10
"""
