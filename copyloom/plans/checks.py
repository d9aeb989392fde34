"""Queries of sinks, contracts and keep intervals over the test tables, and their SQL: events are placements, lines of orders are counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.functions import sequences as S
from copyloom.operators import contracts, intervals, panel, sinks
from copyloom.queries import _BANDS, _MERGE, _UK, _bands, _dna, _place_sql, _places, _units, query, six, table
from copyloom.session import kept

#: Bases of a placement bin and of a neighbourhood, and of padding.
WIDTH, NEAR, PAD = 10, 30, 20

_PLACED = f"""raw AS (SELECT user_id % 20 AS sample, event_type AS class, CASE WHEN event_id % 23 = 0 THEN '*' ELSE concat('c', user_id % 3) END AS contig, CAST(floor(value) AS BIGINT) // {WIDTH} * {WIDTH} AS s FROM events),
placed AS (SELECT sample, class, contig, s, count(*) AS reads FROM raw GROUP BY ALL), cov AS (SELECT sample, contig, s, count(*) AS every FROM raw GROUP BY ALL), contigs AS (SELECT concat('c', r) AS contig, 470 + 7 * r AS length FROM range(2) t(r))"""
_LEARNED = f"""{_PLACED}, tot AS (SELECT sample, class, sum(reads) AS total FROM placed GROUP BY ALL), held AS (SELECT sample, class, contig, s // {NEAR} AS near, sum(reads) AS held FROM placed WHERE contig <> '*' GROUP BY ALL),
good AS (SELECT sample, class, contig, near FROM held JOIN tot USING (sample, class) WHERE held >= greatest(2, 0.05 * total)),
bands AS (SELECT DISTINCT placed.class || '/' || placed.contig AS contig, s, s + {WIDTH} AS e FROM placed JOIN good ON placed.sample = good.sample AND placed.class = good.class AND placed.contig = good.contig AND s // {NEAR} = near),
{_MERGE.format(name="m", gap=PAD)},
bed AS (SELECT split_part(m.contig, '/', 1) AS class, split_part(m.contig, '/', 2) AS contig, greatest(0, s - {PAD}) AS s, CASE WHEN length IS NULL THEN e + {PAD} ELSE least(e + {PAD}, length) END AS e FROM m LEFT JOIN contigs ON contigs.contig = split_part(m.contig, '/', 2))"""


def _placed(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    contig = F.when(F.col("event_id") % 23 == 0, "*").otherwise(F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")))
    raw = e.select((F.col("user_id") % 20).alias("sample"), F.col("event_type").alias("class"), contig.alias("contig"), (F.floor(F.floor("value") / WIDTH) * WIDTH).alias("start"))
    every = raw.groupBy("sample", "contig", "start").agg(F.count(F.lit(1)).alias("all"))
    return raw.groupBy("sample", "class", "contig", "start").agg(F.count(F.lit(1)).alias("reads")).join(every, ["sample", "contig", "start"])


def _contigs(spark) -> DataFrame:
    return spark.range(2).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("contig"), (470 + 7 * F.col("id")).alias("length"))


def _learned(spark, d) -> DataFrame:
    return kept(sinks.learned(_placed(spark, d), _contigs(spark), WIDTH, NEAR, 0.05, 2, PAD), "learned")


@query(f'WITH {_LEARNED} SELECT class, contig, s AS "start", e AS "end" FROM bed')
def learned_intervals(spark, d):
    return _learned(spark, d)


_INSIDE = f"""j_r AS (SELECT *, max(e) OVER (PARTITION BY class, contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM bed),
j_n AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY class, contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM j_r), j AS (SELECT class, contig, min(s) AS a, max(e) AS b FROM j_n GROUP BY class, contig, run),
pl AS (SELECT placed.*, every, CASE WHEN length IS NULL THEN placed.s + {WIDTH} ELSE least(placed.s + {WIDTH}, length) END AS upto FROM placed JOIN cov USING (sample, contig, s) LEFT JOIN contigs ON contigs.contig = placed.contig),
ins AS (SELECT pl.*, (SELECT max(bed.s) FROM bed WHERE bed.class = pl.class AND bed.contig = pl.contig AND bed.s <= pl.s) AS a FROM pl JOIN j ON j.class = pl.class AND j.contig = pl.contig AND j.a <= s AND upto <= b)"""


@query(f'WITH {_LEARNED}, {_INSIDE}, i AS (SELECT sample, class, sum(reads) AS n FROM ins GROUP BY ALL) SELECT sample, class, CAST(total AS BIGINT) AS total, CAST(coalesce(n, 0) AS BIGINT) AS "inside" FROM tot LEFT JOIN i USING (sample, class)')
def sink_capture(spark, d):
    return sinks.capture(_placed(spark, d), _learned(spark, d), _contigs(spark), WIDTH)


@query(f"""WITH {_LEARNED}, {_INSIDE}, h AS (SELECT sample, class, contig, a, sum(reads) AS reads, sum(every) AS every FROM ins GROUP BY ALL),
v AS (SELECT tot.sample, bed.class, bed.contig, bed.s, bed.e, coalesce(reads, 0) / total AS share, coalesce(every, 0) AS every FROM bed JOIN tot USING (class) LEFT JOIN h ON h.sample = tot.sample AND h.class = bed.class AND h.contig = bed.contig AND h.a = bed.s),
g AS (SELECT class, contig, s, e, count(*) AS scans, quantile_cont(share, 0.5) AS m, quantile_cont(share, 0.1) AS p, max(share) AS x, quantile_cont(every::DOUBLE, 0.5) AS r FROM v GROUP BY ALL),
k AS (SELECT *, m / greatest(r, 1) AS per, row_number() OVER (PARTITION BY class ORDER BY m / greatest(r, 1) DESC, m DESC, contig, s, e) AS rank FROM g),
c AS (SELECT k.class, rank, sum(share) OVER (PARTITION BY sample, k.class ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM v JOIN k ON k.class = v.class AND k.contig = v.contig AND k.s = v.s),
q AS (SELECT class, rank, quantile_cont(c, 0.5) AS cm, quantile_cont(c, 0.1) AS cp FROM c GROUP BY ALL)
SELECT k.class, k.rank, contig, s AS "start", e AS "end", scans, round(m, 6) AS share_median, round(p, 6) AS share_p10, round(x, 6) AS share_max, round(r, 3) AS reads_median, round(cm, 6) AS cum_capture_median, round(cp, 6) AS cum_capture_p10 FROM k JOIN q ON k.class = q.class AND k.rank = q.rank""")
def interval_statistics(spark, d):
    got = sinks.interval_statistics(_placed(spark, d), _learned(spark, d), _contigs(spark), WIDTH)
    return got.select("class", "rank", "contig", "start", "end", "scans", *(six(c).alias(c) for c in ("share_median", "share_p10", "share_max", "cum_capture_median", "cum_capture_p10")), F.round("reads_median", 3).alias("reads_median"))


@query(f"""WITH {_BANDS}, {_MERGE.format(name="q", gap=40)}, rk AS (SELECT contig, s AS a, e AS b, s // 500 AS rank FROM q), sl AS (SELECT event_id, contig, s, e, user_id + 1 AS size FROM ({_place_sql("20", 17)})),
f AS (SELECT event_id, size, min(rank) AS rank FROM rk JOIN sl ON rk.contig = sl.contig AND a < e AND s < b GROUP BY ALL), t AS (SELECT rank, sum(size) AS added FROM f GROUP BY rank)
SELECT rank, CAST(coalesce(added, 0) AS BIGINT) AS added, CAST(sum(coalesce(added, 0)) OVER (ORDER BY rank) AS BIGINT) AS bytes FROM (SELECT DISTINCT rank FROM rk) LEFT JOIN t USING (rank)""")
def union_price(spark, d):
    q = intervals.merge(_bands(spark, d), ["contig"], 40).select("contig", "start", "end", F.floor(F.col("start") / 500).alias("rank"))
    s = _places(spark, d, 20, 17).select("contig", F.col("event_id").alias("slice"), "start", "end", (F.col("user_id") + 1).alias("size"))
    return sinks.union_price(q, s, ["contig"], 128)


_SIGNED = """signed AS (SELECT DISTINCT l_suppkey % 6 AS sample, l_partkey % 25 AS class, CASE WHEN l_partkey % 25 % 5 = 0 THEN 'compositional' ELSE 'positional' END AS kind, CASE WHEN l_suppkey % 6 = 5 AND l_partkey % 25 % 4 = 1 THEN 21 ELSE 31 END AS k,
100 + l_partkey % 25 AS length, CASE WHEN l_partkey % 25 = 7 THEN NULL ELSE 50 + (l_suppkey % 6) // 4 * (l_partkey % 25 % 3) END AS kmers FROM lineitem)"""


def _signed(spark, d) -> DataFrame:
    x = table(spark, d, "lineitem").select((F.col("l_suppkey") % 6).alias("sample"), (F.col("l_partkey") % 25).alias("class")).distinct()
    return x.select("sample", "class", F.when(F.col("class") % 5 == 0, "compositional").otherwise("positional").alias("kind"), F.when((F.col("sample") == 5) & (F.col("class") % 4 == 1), 21).otherwise(31).alias("k"), (100 + F.col("class")).alias("length"), F.when(F.col("class") != 7, 50 + F.floor(F.col("sample") / 4) * (F.col("class") % 3)).alias("kmers"))


@query(f"""WITH {_SIGNED}, p AS (SELECT DISTINCT class, CASE WHEN class = 3 THEN 'compositional' ELSE 'positional' END AS kind, 31 AS k, CASE WHEN class = 8 THEN 99 ELSE length END AS length, 50 AS kmers FROM signed WHERE class < 20)
SELECT sample, s.class, concat_ws('; ', CASE WHEN p.kind <> 'positional' THEN 'kind ' || p.kind END, CASE WHEN s.k <> p.k THEN concat('k ', s.k, ' for ', p.k) END, CASE WHEN s.length <> p.length THEN concat('length ', s.length, ' for ', p.length) END, CASE WHEN s.kmers <> p.kmers THEN concat('kmers ', s.kmers, ' for ', p.kmers) END) AS message
FROM signed s JOIN p ON s.class = p.class WHERE s.kind = 'positional' AND (p.kind <> 'positional' OR s.k <> p.k OR s.length <> p.length OR s.kmers <> p.kmers)""")
def panel_mismatch(spark, d):
    s = _signed(spark, d)
    p = s.where("class < 20").select("class", F.when(F.col("class") == 3, "compositional").otherwise("positional").alias("kind"), F.lit(31).alias("k"), F.when(F.col("class") == 8, 99).otherwise(F.col("length")).alias("length"), F.lit(50).alias("kmers")).distinct()
    return contracts.panel_mismatch(s, p)


@query(f"""WITH {_SIGNED}, u AS (SELECT class, unnest(['kind', 'k', 'length', 'kmers']) AS field, unnest([kind, k::VARCHAR, length::VARCHAR, kmers::VARCHAR]) AS value FROM signed)
SELECT class, field, string_agg(DISTINCT value, ' / ' ORDER BY value) AS "values" FROM u WHERE value IS NOT NULL GROUP BY class, field HAVING count(DISTINCT value) > 1""")
def mixed_signatures(spark, d):
    return contracts.mixed_signatures(_signed(spark, d), ["kind", "k", "length", "kmers"])


@query("""WITH c AS (SELECT DISTINCT user_id % 30 AS sample, event_type AS class FROM events), k AS (SELECT user_id % 30 AS sample, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS class, count(*) AS intervals, sum(event_id % 100) AS bp FROM events GROUP BY ALL),
s AS (SELECT * FROM k WHERE (sample + intervals) % 3 = 0), a AS (SELECT c.sample, c.class, intervals, bp FROM s JOIN c ON s.sample = c.sample AND (s.class = c.class OR s.class = '')), t AS (SELECT sample, class, sum(intervals) AS intervals, sum(bp) AS bp FROM a GROUP BY ALL), m AS (SELECT * FROM c WHERE sample % 4 = 1 AND class IN ('click', 'error'))
SELECT coalesce(t.sample, m.sample) AS sample, coalesce(t.class, m.class) AS class, CASE WHEN m.sample IS NOT NULL THEN 'no_sinks_in_fetch' ELSE 'sinks_skipped' END AS status, CAST(intervals AS DOUBLE) AS intervals, CAST(bp AS DOUBLE) AS bp FROM t FULL JOIN m ON t.sample = m.sample AND t.class = m.class""")
def incomplete_sinks(spark, d):
    e = table(spark, d, "events").withColumn("sample", F.col("user_id") % 30)
    counted = e.select("sample", F.col("event_type").alias("class")).distinct()
    k = e.groupBy("sample", F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("class")).agg(F.count(F.lit(1)).alias("intervals"), F.sum(F.col("event_id") % 100).alias("bp"))
    got = contracts.incomplete_sinks(counted, k.where("(sample + intervals) % 3 = 0"), counted.where("sample % 4 = 1 and class in ('click', 'error')"))
    return got.withColumn("intervals", F.col("intervals").cast("double")).withColumn("bp", F.col("bp").cast("double"))


_OPTIONS = "opt AS (SELECT event_type AS class, concat('c', r) AS contig, 100 * r AS s, 100 * r + 60 + 40 * r AS e FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'view'), range(3) t(r))"
_FINE = "placed AS (SELECT DISTINCT user_id AS sample, event_type AS class, concat('c', event_id % 3) AS contig, CAST(floor(value / 4) AS BIGINT) // 10 * 10 + 100 * (event_id % 3) AS s FROM events)"


def _options(spark, d) -> DataFrame:
    c = table(spark, d, "events").select(F.col("event_type").alias("class")).where("class <> 'view'").distinct()
    return c.select("class", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("r")).select("class", F.concat(F.lit("c"), F.col("r").cast("string")).alias("contig"), (100 * F.col("r")).alias("start"), (100 * F.col("r") + 60 + 40 * F.col("r")).alias("end"))


def _only(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("sample"), F.col("event_type").alias("class"), (F.col("event_id") % 3).alias("r"), F.floor(F.col("value") / 4).alias("v"))
    p = e.select("sample", "class", F.concat(F.lit("c"), F.col("r").cast("string")).alias("contig"), (F.floor(F.col("v") / 10) * 10 + 100 * F.col("r")).alias("start")).distinct()
    return contracts.subset_only(p, _options(spark, d), WIDTH)


_ONLY = f"{_FINE}, {_OPTIONS}, chk AS (SELECT sample, class, contig, s, EXISTS (SELECT 1 FROM opt WHERE opt.class = placed.class AND opt.contig = placed.contig AND opt.s < placed.s + {WIDTH} AND placed.s < opt.e) AS met FROM placed WHERE class IN (SELECT class FROM opt))"


@query(f"WITH {_ONLY} SELECT sample, class, count(*) AS bins FROM chk GROUP BY ALL HAVING bool_and(met)")
def subset_only(spark, d):
    return _only(spark, d)


@query(f"""WITH {_ONLY}, oo AS (SELECT sample, class FROM chk GROUP BY ALL HAVING bool_and(met))
SELECT DISTINCT user_id AS sample, event_type AS class FROM events WHERE user_id % 7 NOT IN (0, 2, 5) AND event_type IN (SELECT class FROM opt) AND (user_id, event_type) NOT IN (SELECT (sample, class) FROM oo)""")
def unverified(spark, d):
    e = table(spark, d, "events")
    counted = e.select(F.col("user_id").alias("sample"), F.col("event_type").alias("class")).distinct()
    fetches = e.select(F.col("user_id").alias("sample"), (F.col("user_id") % 7).alias("sinks")).distinct()
    known = spark.createDataFrame([(0,), (2,), (5,)], "sinks long")
    return contracts.unverified(counted, _options(spark, d), fetches, known, _only(spark, d))


@query("""WITH c AS (SELECT o_custkey AS sample, o_orderpriority AS contig, max(o_orderkey % 4) AS length FROM orders GROUP BY ALL), e AS (SELECT DISTINCT o_orderpriority AS contig, 3 AS length FROM orders WHERE o_orderpriority <> '5-LOW'),
b AS (SELECT sample, c.contig, c.length, e.length AS expected FROM c JOIN e ON c.contig = e.contig WHERE c.length <> e.length)
SELECT sample, min(contig) AS contig, arg_min(length, contig) AS length, arg_min(expected, contig) AS expected, count(*) AS contigs FROM b GROUP BY sample""")
def other_build(spark, d):
    o = table(spark, d, "orders")
    c = o.groupBy(F.col("o_custkey").alias("sample"), F.col("o_orderpriority").alias("contig")).agg(F.max(F.col("o_orderkey") % 4).alias("length"))
    e = o.select(F.col("o_orderpriority").alias("contig"), F.lit(3).alias("length")).where("contig <> '5-LOW'").distinct()
    return contracts.other_build(c, e)


@query("""WITH u AS (SELECT DISTINCT c_custkey % 40 AS sample, c_nationkey % 3 AS hash FROM customer WHERE c_nationkey % 3 <> 2 OR c_custkey % 40 % 3 = 0), s AS (SELECT sample, list_sort(list(hash)) AS st FROM u GROUP BY sample), f AS (SELECT st, min(sample) AS sample FROM s GROUP BY st)
SELECT a.sample, b.sample AS other FROM f a JOIN f b ON a.sample < b.sample WHERE NOT list_has_all(a.st, b.st) AND NOT list_has_all(b.st, a.st)""")
def clashing_panels(spark, d):
    c = table(spark, d, "customer").select((F.col("c_custkey") % 40).alias("sample"), (F.col("c_nationkey") % 3).alias("hash"))
    return contracts.clashing_panels(c.where("hash <> 2 or sample % 3 = 0").distinct())


@query("SELECT c_name AS sample, c_acctbal AS value, s_acctbal AS pc FROM customer LEFT JOIN supplier ON c_name = replace(s_name, 'Supplier', 'Customer')")
def with_covariates(spark, d):
    pcs = table(spark, d, "supplier").select(F.concat(F.regexp_replace("s_name", "Supplier", "Customer"), F.when(F.col("s_suppkey") % 2 == 0, ".by1000.").otherwise(".")).alias("sample"), F.col("s_acctbal").alias("pc"))
    return contracts.with_covariates(table(spark, d, "customer").select(F.col("c_name").alias("sample"), F.col("c_acctbal").alias("value")), pcs)


@query(f"""WITH {_UK}, n AS (SELECT c, item_id, count(*) AS n, min(off) AS pos FROM uk GROUP BY c, item_id), sh AS (SELECT c, count(*) > 1 AS shared FROM n GROUP BY c),
r AS (SELECT item_id, CASE WHEN shared THEN 'shared' WHEN item_id % 2 = 0 AND NOT (pos BETWEEN 20 AND 89 OR pos BETWEEN 150 AND 199) THEN 'outside' WHEN n > 1 THEN 'repeated' ELSE 'kept' END AS reason FROM n JOIN sh USING (c))
SELECT item_id, reason, count(*) AS kmers FROM r GROUP BY ALL""")
def panel_keep(spark, d):
    b = table(spark, d, "benchmark").where("item_id % 2 = 0").select(F.col("item_id").alias("class"), F.explode(F.array(F.struct(F.lit(20).alias("start"), F.lit(90).alias("end")), F.struct(F.lit(150).alias("start"), F.lit(200).alias("end")))).alias("i"))
    got = panel.candidates(_units(spark, d), None, b.select("class", "i.start", "i.end"))
    return got.select(F.col("class").alias("item_id"), panel.reason().alias("reason")).groupBy("item_id", "reason").agg(F.count(F.lit(1)).alias("kmers"))


@query(f"""WITH s AS (SELECT item_id, {_dna("text")} AS s FROM benchmark), o AS (SELECT item_id, s || substr(s, 1, 14) AS s, unnest(range(0, length(s))) AS off FROM s), k AS (SELECT item_id, off, substr(s, off + 1, 15) AS km FROM o WHERE off + 15 <= length(s))
SELECT item_id, count(*) AS kmers, max(off) AS last, count(*) FILTER (km <= translate(reverse(km), 'ACGT', 'TGCA')) AS fwd FROM k GROUP BY item_id""")
def circular_kmers(spark, d):
    u = table(spark, d, "benchmark").select("item_id", S.dna(F.col("text")).alias("seq")).where("seq <> ''")
    return S.kmers(u.withColumn("seq", S.circular(F.col("seq"), 15)), "seq", 15).groupBy("item_id").agg(F.count(F.lit(1)).alias("kmers"), F.max("off").alias("last"), F.count_if("fwd").alias("fwd"))
