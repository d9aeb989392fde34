"""Queries of loci, core k-mers, difference sites and profiles over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.functions import sequences as S
from copyloom.operators import contracts, loci, profiles
from copyloom.operators import estimate as E
from copyloom.queries import _DK, _UK, K, query, six, table
from copyloom.session import dealt, kept

_HITS = """hits AS (SELECT l_partkey % 20 AS class, l_suppkey % 9 AS contig, 120000 AS length, CAST(floor(l_extendedprice) AS BIGINT) AS s, CAST(floor(l_extendedprice) AS BIGINT) + 300 + l_orderkey % 900 AS e, 300 + l_orderkey % 900 AS cols, CAST(ceil((300 + l_orderkey % 900) * (1 - l_discount)) AS BIGINT) AS matches FROM lineitem),
wide AS (SELECT class, contig, greatest(0, s - 150) AS s, least(length, e + 150) AS e FROM hits WHERE e - s >= 500 AND matches >= 0.97 * cols)"""


@query(f"""WITH {_HITS}, o AS (SELECT *, max(e) OVER (PARTITION BY class, contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM wide),
g AS (SELECT *, count(*) FILTER (reach IS NULL OR s > reach) OVER (PARTITION BY class, contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM o)
SELECT class, contig, min(s) AS "start", max(e) AS "end", count(*) AS members FROM g GROUP BY class, contig, run""")
def class_loci(spark, d):
    size, at = 300 + F.col("l_orderkey") % 900, F.floor("l_extendedprice")
    hits = table(spark, d, "lineitem").select(
        (F.col("l_partkey") % 20).alias("class"), (F.col("l_suppkey") % 9).alias("contig"), F.lit(120000).cast("long").alias("length"), at.alias("start"), (at + size).alias("end"),
        F.lit(0).alias("from"), size.alias("to"), F.ceil(size * (1 - F.col("l_discount"))).alias("matches"), size.alias("columns"),
    )
    return loci.class_loci(hits, ["class"], 500, 0.97, 150)


@query(f"""WITH {_UK}, {_DK}, once AS (SELECT c, min(item_id) AS class, min(off) AS pos FROM uk GROUP BY c HAVING count(*) = 1),
n AS (SELECT dk.doc_id % 2 AS genome, c, count(*) FILTER (dk.off < 4000) AS i, count(*) FILTER (dk.off >= 4000) AS o FROM dk JOIN once USING (c) GROUP BY ALL),
v AS (SELECT c, sum(i) AS i, sum(o) AS o, count(*) FILTER (i = 1) = 2 AS even FROM n GROUP BY c), k AS (SELECT class, pos, even, pos - row_number() OVER (PARTITION BY class ORDER BY pos) AS run FROM once JOIN v USING (c) WHERE o = 0 AND i = 2)
SELECT class AS item_id, min(pos) AS "start", max(pos) + 1 AS "end", count(*) AS kmers FROM k GROUP BY class, run""")
def core_kmers(spark, d):
    u = table(spark, d, "benchmark").select(F.col("item_id").alias("class"), S.dna(F.col("text")).alias("seq"))
    g = S.spread_out(table(spark, d, "documents").select((F.col("doc_id") % 2).alias("genome"), F.col("doc_id").alias("contig"), "text"))
    g = g.select("genome", "contig", F.lit(0).cast("long").alias("off"), S.dna(F.col("text")).alias("seq"))
    units = S.packed_kmers(u, "seq", K).select("class", "off", "code")
    held = g.select("genome", "contig", F.lit(0).cast("long").alias("start"), F.lit(4000).cast("long").alias("end"))
    got = loci.core(units, loci.counted(g, units, K, held), 2, each=False)
    return loci.core_intervals(got).withColumnsRenamed({"class": "item_id", "members": "kmers"})


_CS = """al AS (SELECT l_suppkey % 30 AS class, l_shipdate::DATE::VARCHAR AS contig, CAST(floor(l_extendedprice) AS BIGINT) AS s, l_partkey % 40 * 5 AS f, l_linestatus = 'O' AS back, 1 + l_partkey % 50 AS a, 1 + l_orderkey % 20 AS b, 1 + l_linenumber % 9 AS c FROM lineitem),
sites AS (SELECT class, contig, 'sub' AS kind, CASE WHEN back THEN f + b + c + 2 ELSE f + a END AS pos, s + a AS place, CASE WHEN back THEN 'G' ELSE 'C' END AS unit, CASE WHEN back THEN 'T' ELSE 'A' END AS genome FROM al
UNION ALL SELECT class, contig, 'ins', CASE WHEN back THEN f + c ELSE f + a + b + 1 END, s + a + b + 1, CASE WHEN back THEN 'CC' ELSE 'GG' END, '' FROM al
UNION ALL SELECT class, contig, 'del', CASE WHEN back THEN f + c ELSE f + a + b + 3 END, s + a + b + 1, '', CASE WHEN back THEN 'CGT' ELSE 'ACG' END FROM al)"""


def _alignments(spark, d) -> DataFrame:
    a, b, c, f, s = 1 + F.col("l_partkey") % 50, 1 + F.col("l_orderkey") % 20, 1 + F.col("l_linenumber") % 9, F.col("l_partkey") % 40 * 5, F.floor("l_extendedprice")
    cs = F.concat(F.lit(":"), a.cast("string"), F.lit("*ac:"), b.cast("string"), F.lit("+gg-acg:"), c.cast("string"))
    return table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 30).alias("class"), F.col("l_shipdate").cast("date").cast("string").alias("contig"), s.alias("start"), (s + a + b + c + 4).alias("end"), f.alias("from"), (f + a + b + c + 3).alias("to"),
        (F.col("l_linestatus") == "O").alias("back"), cs.alias("cs"),
    )


@query(f"WITH {_CS} SELECT class, contig, kind, pos, place, unit, genome FROM sites")
def difference_sites(spark, d):
    return loci.difference_sites(_alignments(spark, d), ["class"])


@query(f"""WITH {_CS}, p AS (SELECT class, pos, count(*) AS differing FROM sites WHERE kind = 'sub' GROUP BY ALL)
SELECT p.class, pos, differing, count(*) AS covering, round(differing / count(*), 6) AS share FROM p JOIN al ON p.class = al.class AND f <= pos AND pos < f + a + b + c + 3 GROUP BY p.class, pos, differing""")
def differing_bases(spark, d):
    hits = _alignments(spark, d)
    return loci.differing(hits, loci.difference_sites(hits, ["class"]), ["class"], 64).withColumn("share", six("share"))


@query("SELECT l_suppkey AS sample, CAST(count(*) FILTER (l_linenumber = 1) AS BIGINT) AS ctrl_reads, count(*) AS total, CASE WHEN l_suppkey % 5 = 0 THEN 'not a scan' WHEN count(*) FILTER (l_linenumber = 1) > 0.14 * count(*) THEN 'cut' ELSE 'whole' END AS state FROM lineitem GROUP BY l_suppkey")
def scan_state(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample")).agg(F.count_if(F.col("l_linenumber") == 1).alias("ctrl_reads"), F.count(F.lit(1)).alias("primary"))
    c = c.withColumn("mode", F.when(F.col("sample") % 5 == 0, "fetch").otherwise("scan"))
    return contracts.scan_state(c, 0.14).join(c, "sample").select("sample", "ctrl_reads", F.col("primary").alias("total"), "state")


@query("""WITH w AS (SELECT l_suppkey AS sample, l_partkey % 20 AS class, CASE WHEN l_partkey % 6 > 0 THEN l_extendedprice / 10000 END AS cn, l_orderkey % 5 AS obs FROM lineitem)
SELECT sample, class, round(sqrt(var_samp(ln(cn)) FILTER (cn > 0) / count(*) FILTER (cn > 0) + 1.0 / sum(obs)), 6) AS cn_se_rel FROM w GROUP BY sample, class HAVING count(*) FILTER (cn > 0) >= 3 AND sum(obs) > 0""")
def relative_error(spark, d):
    w = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample"), (F.col("l_partkey") % 20).alias("class"), F.when(F.col("l_partkey") % 6 > 0, F.col("l_extendedprice") / 10000).alias("cn"), (F.col("l_orderkey") % 5).alias("obs"))
    return E.relative_error(w).select("sample", "class", six("cn_se_rel").alias("cn_se_rel")).where("cn_se_rel is not null")


_READ = """g AS (SELECT l_orderkey AS sample, l_orderkey % 5 AS unit, l_linenumber AS n, CAST(sum(l_quantity) AS BIGINT) * 1000 AS size, 9 + max(l_partkey) % 3 AS state FROM lineitem GROUP BY ALL), b AS (SELECT *, CAST(sum(size) OVER (PARTITION BY sample ORDER BY n) AS BIGINT) AS e FROM g),
s AS (SELECT sample, unit, r AS reading, -r * (1 + sample % 4) AS score, e - size AS s, e, size, state + CASE r WHEN 0 THEN 0 WHEN 1 THEN sample % 2 ELSE 1 END AS state, e - size >= 10000 * unit - 5000 AND e <= 10000 * unit + 65000 AS poly FROM b, range(3) t(r)),
l AS (SELECT *, size >= 40000 AND NOT poly AS core, row_number() OVER (PARTITION BY sample, reading ORDER BY size DESC, s) AS place, bool_or(size >= 40000 AND NOT poly) OVER (PARTITION BY sample, reading) AS any_core FROM s),
h AS (SELECT sample, reading, state, sum(size) AS held, min(s) AS first_s FROM l WHERE core OR NOT any_core AND place = 1 GROUP BY ALL), c AS (SELECT sample, reading, CASE WHEN bool_or(state = 10) THEN 10 ELSE first(state ORDER BY held DESC, abs(state - 10), first_s) END AS copies FROM h GROUP BY ALL),
f AS (SELECT sample, reading, state, sum(size) AS free, min(s) AS first_s FROM s WHERE NOT poly GROUP BY ALL), k AS (SELECT sample, reading, first(state ORDER BY free DESC, first_s) AS bulk FROM f GROUP BY ALL), z AS (SELECT sample, reading, first(state ORDER BY s) AS st, any_value(score) AS score FROM s GROUP BY ALL),
each AS (SELECT sample, reading, score, copies, coalesce(bulk, st) AS bulk FROM z JOIN c USING (sample, reading) LEFT JOIN k USING (sample, reading))"""
_EVENTS = """d AS (SELECT s.*, state - copies AS delta, copies, e - s AS width FROM s JOIN each USING (sample, reading) WHERE reading = 0),
w AS (SELECT *, coalesce(bool_and(poly OR delta > 0) OVER bef, true) OR coalesce(bool_and(poly OR delta > 0) OVER aft, true) AS up, coalesce(bool_and(poly OR delta < 0) OVER bef, true) OR coalesce(bool_and(poly OR delta < 0) OVER aft, true) AS down FROM d
WINDOW bef AS (PARTITION BY sample ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), aft AS (PARTITION BY sample ORDER BY s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
v AS (SELECT sample, unit, copies, delta, s, e, CASE WHEN delta > 0 THEN CASE WHEN up AND width >= 40000 THEN 'partial copy' ELSE 'gain' END WHEN down AND width >= 40000 THEN 'partial loss' ELSE 'loss' END AS kind FROM w WHERE delta <> 0)"""


def _read(spark, d) -> tuple[DataFrame, DataFrame]:
    g = dealt(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey"), "l_orderkey").groupBy(F.col("l_orderkey").alias("sample"), (F.col("l_orderkey") % 5).alias("unit"), F.col("l_linenumber").alias("n")).agg((F.sum("l_quantity").cast("long") * 1000).alias("size"), (9 + F.max("l_partkey") % 3).alias("state"))
    g = g.withColumn("end", F.expr("sum(size) OVER (PARTITION BY sample ORDER BY n)")).withColumn("start", F.col("end") - F.col("size")).withColumn("reading", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    state = F.col("state") + F.when(F.col("reading") == 0, 0).when(F.col("reading") == 1, F.col("sample") % 2).otherwise(1)
    g = g.select("sample", "unit", "reading", (-F.col("reading") * (1 + F.col("sample") % 4)).alias("score"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("lean"), F.lit(0.1).alias("sd"), "start", "end", state.alias("state"))
    poly = table(spark, d, "orders").select((F.col("o_orderkey") % 5).alias("unit")).distinct().select("unit", (10000 * F.col("unit")).alias("start"), (10000 * F.col("unit") + 60000).alias("end"))
    return kept(g, "readings"), poly


_ON = ["sample", "unit"]


@query(f"""WITH {_READ}, a AS (SELECT o.sample, first(o.copies ORDER BY o.reading) AS alternative, first(x.score - o.score ORDER BY o.reading) AS gap FROM each o JOIN each x ON o.sample = x.sample AND x.reading = 0 AND o.reading > 0 AND o.bulk <> x.bulk GROUP BY o.sample)
SELECT sample, copies, bulk, CAST(alternative AS DOUBLE) AS alternative, CAST(gap AS DOUBLE) AS gap, coalesce(gap < 3, false) AS uncertain FROM each LEFT JOIN a USING (sample) WHERE reading = 0""")
def profile_calls(spark, d):
    g, poly = _read(spark, d)
    got = profiles.calls(g, _ON, polymorphic=poly, on=["unit"], expected=10)
    return got.select("sample", "copies", "bulk", F.col("alternative").cast("double").alias("alternative"), F.col("gap").cast("double").alias("gap"), "uncertain")


@query(f'WITH {_READ}, {_EVENTS} SELECT sample, unit, copies, delta, s AS "start", e AS "end", kind FROM v')
def profile_events(spark, d):
    g, poly = _read(spark, d)
    return profiles.described(g, profiles.calls(g, _ON, polymorphic=poly, on=["unit"], expected=10), _ON, polymorphic=poly, on=["unit"])


@query(f"""WITH {_READ}, {_EVENTS}, p AS (SELECT *, lag(e) OVER w AS pe, lag(delta) OVER w AS pd FROM v WHERE kind = 'partial copy' WINDOW w AS (PARTITION BY sample ORDER BY s)),
n AS (SELECT *, CASE WHEN pd = delta AND pe BETWEEN 10000 * unit - 5000 AND 10000 * unit + 65000 AND s BETWEEN 10000 * unit - 5000 AND 10000 * unit + 65000 THEN 0 ELSE 1 END AS nw FROM p), r AS (SELECT *, sum(nw) OVER (PARTITION BY sample ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT sample, delta, min(s) AS "start", max(e) AS "end" FROM r GROUP BY sample, delta, run""")
def partial_copies(spark, d):
    g, poly = _read(spark, d)
    events = profiles.described(g, profiles.calls(g, _ON, polymorphic=poly, on=["unit"], expected=10), _ON, polymorphic=poly, on=["unit"])
    return profiles.partial_copies(events, _ON, polymorphic=poly, on=["unit"]).select("sample", "delta", "start", "end")


@query(f"""WITH {_READ}, t AS (SELECT sample, max(e) // 50000 AS blocks FROM s GROUP BY sample), x AS (SELECT sample, unnest(range(blocks)) AS block FROM t)
SELECT x.sample, block, CAST(first(state ORDER BY least(e, block * 50000 + 50000) - greatest(s, block * 50000) DESC, s) AS BIGINT) AS state FROM x JOIN s ON x.sample = s.sample AND reading = 0 AND s < block * 50000 + 50000 AND e > block * 50000 GROUP BY x.sample, block""")
def block_states(spark, d):
    return profiles.states_at(_read(spark, d)[0], ["sample"], 50000)


@query()
def profile_readings(spark, d):
    """The readings of customers' balances by nation as profiles in order of keys, with what is called of them."""
    c = table(spark, d, "customer").select((F.col("c_nationkey") % 3).alias("sample"), (F.col("c_custkey") * 250).alias("start"), (F.round(F.col("c_acctbal") / 4000 + 8) + F.col("c_custkey") % 7 / 40).alias("cn"), (0.8 + F.col("c_custkey") % 3 / 5).alias("noise"))
    return profiles.calls(profiles.readings(c, ["sample"], 250, lean=False), ["sample"])


@query(f"""WITH r AS (SELECT * FROM (SELECT item_id % 8 AS class, off + item_id % 3 AS pos, CASE WHEN off % 50 = 7 THEN translate(reverse(c), 'ACGT', 'TGCA') WHEN off % 50 = 9 THEN substr(c, 2) ELSE c END AS canon FROM (WITH {_UK} SELECT * FROM uk))),
c AS (SELECT DISTINCT item_id % 8 AS class, CASE WHEN item_id % 8 = 3 THEN 'compositional' ELSE 'positional' END AS kind, 300 AS length FROM benchmark WHERE item_id % 8 < 7), n AS (SELECT canon, count(*) AS n FROM r GROUP BY canon),
f AS (SELECT r.class, CASE WHEN length(canon) <> {K} THEN 'length' WHEN canon > translate(reverse(canon), 'ACGT', 'TGCA') THEN 'not canonical' WHEN c.class IS NULL THEN 'undeclared class' WHEN CASE kind WHEN 'compositional' THEN pos <> 0 ELSE pos >= 300 END THEN 'outside' WHEN n > 1 THEN 'twice' END AS fault
FROM r JOIN n USING (canon) LEFT JOIN c ON c.class = r.class) SELECT class, fault, count(*) AS kmers FROM f WHERE fault IS NOT NULL GROUP BY ALL""")
def panel_faults(spark, d):
    b = table(spark, d, "benchmark")
    u = S.kmers(b.select("item_id", S.dna(F.col("text")).alias("seq")), "seq", K, spread=True)
    canon = F.when(F.col("off") % 50 == 7, S.reverse_complement(F.col("canon"))).when(F.col("off") % 50 == 9, F.expr("substring(canon, 2)")).otherwise(F.col("canon"))
    rows = u.select((F.col("item_id") % 8).alias("class"), (F.col("off") + F.col("item_id") % 3).alias("pos"), canon.alias("canon"))
    classes = b.select((F.col("item_id") % 8).alias("class")).distinct().where("class < 7").select("class", F.when(F.col("class") == 3, "compositional").otherwise("positional").alias("kind"), F.lit(300).alias("length"))
    return contracts.panel_faults(rows, classes, K).groupBy("class", "fault").agg(F.count(F.lit(1)).alias("kmers"))


@query("""WITH r AS (SELECT DISTINCT user_id % 40 AS contig, CAST(floor(value * 3000) AS BIGINT) AS s, CAST(floor(value * 3000) AS BIGINT) + 5 + event_id % 3 * 5 AS e, CASE WHEN event_id % 4 = 0 THEN 'test' ELSE 'control' END AS role FROM events),
o AS (SELECT *, max(e) OVER (PARTITION BY contig ORDER BY s, e, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
f AS (SELECT *, CASE WHEN contig % 10 = 9 THEN CASE WHEN role = 'control' THEN 'absent' END WHEN s < reach THEN 'overlap' END AS fault FROM o) SELECT contig, s AS "start", e AS "end", role, fault FROM f WHERE fault IS NOT NULL""")
def control_faults(spark, d):
    start = F.floor(F.col("value") * 3000)
    r = table(spark, d, "events").select((F.col("user_id") % 40).alias("contig"), start.alias("start"), (start + 5 + F.col("event_id") % 3 * 5).alias("end"), F.when(F.col("event_id") % 4 == 0, "test").otherwise("control").alias("role")).distinct()
    return contracts.control_faults(r, r.select("contig").distinct().where("contig % 10 <> 9"))
