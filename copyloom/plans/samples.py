"""Queries over the test tables of tallies, contracts, screens and cohorts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.functions import sequences as S
from copyloom.operators import cohort, contracts, intervals, panel, screens, tallies
from copyloom.queries import _BANDS, _DK, _MERGE, _PANEL, _PL, _UK, K, _bands, _dna, _kmer_sql, _place_sql, _placements, _places, _units, query, six, table
from copyloom.session import scratch

_FLAGS = "CAST(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN event_id % 11 = 0 THEN 1024 ELSE 0 END AS INT)"


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("flags", F.expr(_FLAGS)).withColumn("mapq", (F.col("event_id") % 60).cast("int")).withColumn("pos", F.floor(F.col("value") * 100))


@query(f"SELECT event_type, count(*) AS reads, count(*) FILTER ({_FLAGS} & 1024 <> 0) AS dup, count(*) FILTER (event_id % 60 = 0) AS mapq0, count(*) FILTER (event_id % 60 < 20) AS mapq_lt20 FROM events GROUP BY event_type")
def library_stats(spark, d):
    return tallies.library_stats(_events(spark, d), ["event_type"])


_HIST = "h AS (SELECT event_type, least(CAST(floor(value * 5) AS BIGINT), 1500) // 10 AS bin, count(*) AS n FROM events WHERE event_id % 3 = 0 AND CAST(floor(value * 5) AS BIGINT) > 0 GROUP BY ALL)"


def _inserts(spark, d) -> DataFrame:
    return tallies.insert_histogram(_events(spark, d).withColumn("tlen", F.floor(F.col("value") * 5).cast("int")), ["event_type"])


@query(f"WITH {_HIST} SELECT * FROM h")
def insert_histogram(spark, d):
    return _inserts(spark, d)


@query(f"WITH {_HIST}, s AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, sum(n) OVER (PARTITION BY event_type) AS t FROM h) SELECT event_type, min(bin) AS median FROM s WHERE c * 2 >= t GROUP BY event_type")
def insert_median(spark, d):
    return tallies.histogram_median(_inserts(spark, d), ["event_type"], "bin", "n")


@query(f"""WITH d AS (SELECT {_dna("text")} AS s FROM documents) SELECT (100 * len(regexp_replace(s, '[^CG]', '', 'g')) + len(s) // 2) // len(s) AS gc, count(*) AS reads FROM d WHERE len(s) > 0 GROUP BY gc""")
def read_gc(spark, d):
    s = table(spark, d, "documents").select(S.dna(F.col("text")).alias("s")).where("length(s) > 0")
    gc = S.gc_percent(F.length(F.translate("s", "AT", "")), F.length("s"))
    return s.groupBy(gc.alias("gc")).agg(F.count(F.lit(1)).alias("reads"))


@query("""WITH e AS (SELECT event_type AS class, user_id % 2 = 1 AS reverse, CAST(floor(value * 100) AS BIGINT) - 20000 AS pos FROM events)
SELECT class, reverse, (((pos % 3000) + 3000) % 3000) // 50 AS bin, count(*) AS n FROM e GROUP BY ALL""")
def unit_positions(spark, d):
    e = _events(spark, d).select(F.col("event_type").alias("class"), (F.col("user_id") % 2 == 1).alias("reverse"), (F.col("pos") - 20000).alias("pos"))
    return tallies.unit_positions(e, 3000, 50)


@query("""WITH e AS (SELECT CASE WHEN event_id % 5 < 3 THEN event_type END AS class, CASE WHEN event_type IN ('click', 'view') THEN 10 ELSE 1 END AS f, user_id % 4 AS contig, CAST(floor(value * 100) AS BIGINT) AS pos, event_id % 11 = 0 AS dup FROM events),
m AS (SELECT class, contig, f, pos // (200 * f) AS b, count(*) AS reads FROM e WHERE class IS NOT NULL GROUP BY ALL),
a AS (SELECT f.f, contig, pos // (200 * f.f) AS b, count(*) AS n, count(*) FILTER (dup) AS dup FROM e, (VALUES (1), (10)) f(f) GROUP BY ALL)
SELECT class, m.contig, m.b * 200 * m.f AS "start", reads, CAST(n AS BIGINT) AS "all", CAST(dup AS BIGINT) AS dup FROM m JOIN a ON m.contig = a.contig AND m.b = a.b AND m.f = a.f""")
def placement_census(spark, d):
    e = _events(spark, d).select(F.when(F.col("event_id") % 5 < 3, F.col("event_type")).alias("class"), F.when(F.col("event_type").isin("click", "view"), "compositional").otherwise("positional").alias("kind"), (F.col("user_id") % 4).alias("contig"), "pos", "flags")
    return tallies.placements(e, 200)


_REGIONS = "r AS (SELECT l_suppkey AS region, l_linestatus AS label, sum(l_quantity) AS obs, CAST(count(*) AS DOUBLE) * 25 AS exp FROM lineitem GROUP BY ALL)"


def _regions(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("region"), F.col("l_linestatus").alias("label")).agg(F.sum("l_quantity").alias("obs"), (F.count(F.lit(1)).cast("double") * 25).alias("exp"))


@query(f"""WITH {_REGIONS}, o AS (SELECT label, 2 * obs / exp AS cn FROM r), m AS (SELECT label, count(*) AS regions, 2 * sum(obs) / sum(exp) AS copies FROM r GROUP BY label), q AS (SELECT label, quantile_cont(cn, 0.5) AS med FROM o GROUP BY label)
SELECT o.label, regions, round(copies, 6) AS copies, round(med, 6) AS median, round(1.4826 * quantile_cont(abs(cn - med), 0.5), 6) AS mad_sd FROM o JOIN m ON o.label = m.label JOIN q ON o.label = q.label GROUP BY o.label, regions, copies, med""")
def truth_copies(spark, d):
    got = tallies.truth_copies(_regions(spark, d), ["label"])
    return got.select("label", "regions", *(six(c).alias(c) for c in ("copies", "median", "mad_sd")))


@query(f"WITH {_REGIONS} SELECT region, label, round(ln(greatest(obs, 0.5) / greatest(exp, 1e-9)), 6) AS log_ratio FROM r")
def region_log_ratio(spark, d):
    return _regions(spark, d).select("region", "label", six(tallies.log_ratio("obs", "exp")).alias("log_ratio"))


_BY_GC = "g AS (SELECT l_returnflag AS sample, CAST(l_quantity AS BIGINT) AS gc, count(*) AS n FROM lineitem GROUP BY ALL)"


@query(f"WITH {_BY_GC} SELECT sample, round(sum(n / (0.5 + gc / 100.0)) / 0.9, 4) AS mass FROM g GROUP BY sample")
def compositional_mass(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("sample"), F.col("l_quantity").cast("long").alias("gc")).agg(F.count(F.lit(1)).alias("n"))
    curve = spark.range(101).select(F.col("id").alias("gc"), (F.lit(0.5) + F.col("id") / 100.0).alias("rate"))
    return tallies.mass(g, curve, ["sample"], 0.9).select("sample", F.round("mass", 4).alias("mass"))


@query("SELECT o_orderkey, CAST(arg_min(l_linenumber * 100, abs(l_linenumber * 100 - o_custkey % 700) * 1000 + l_linenumber) AS INT) AS l FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def nearest_table(spark, d):
    x = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return tallies.nearest_table(x.select("o_orderkey", (F.col("l_linenumber") * 100).alias("l"), (F.col("o_custkey") % 700).alias("t")), ["o_orderkey"], "t")


_AT = """kept_at AS (SELECT item_id, off + n * j AS off, j, c IN (SELECT c FROM panel) AS kept FROM (SELECT *, unnest(CASE WHEN item_id % 3 = 1 THEN range(-((50 + n - 1) // n), (50 + n - 1) // n + 1) ELSE [0] END) AS j FROM (SELECT item_id, off, c, count(*) OVER (PARTITION BY item_id) AS n FROM uk)))"""


@query(f"""WITH {_UK}, {_PANEL}, {_AT}, f AS (SELECT item_id, j, count(*) OVER a AS na, count(*) FILTER (kept) OVER a AS ka, count(*) OVER b AS nb, count(*) FILTER (kept) OVER b AS kb FROM kept_at
WINDOW a AS (PARTITION BY item_id ORDER BY off ROWS BETWEEN CURRENT ROW AND 35 FOLLOWING), b AS (PARTITION BY item_id ORDER BY off ROWS BETWEEN 49 PRECEDING AND 14 PRECEDING))
SELECT item_id, count(*) AS starts, count(*) FILTER (na = 36 AND ka >= 30) AS ahead, count(*) FILTER (nb = 36 AND kb >= 30) AS back FROM f WHERE j = 0 GROUP BY item_id""")
def callable_starts(spark, d):
    u = _units(spark, d)
    kept = panel.build(u).select("canon", F.lit(True).alias("kept"))
    at = u.join(kept, "canon", "left").select("class", F.col("off").alias("pos"), F.coalesce("kept", F.lit(False)).alias("kept"), (F.col("class") % 3 == 1).alias("circular"))
    got = tallies.callable_starts(at, 50, K, 30)
    return got.groupBy(F.col("class").alias("item_id")).agg(F.count(F.lit(1)).alias("starts"), F.count_if("ahead").alias("ahead"), F.count_if("back").alias("back"))


@query("SELECT c_nationkey, " + ", ".join(f"round(sum(CASE WHEN c_mktsegment = '{x}' THEN c_acctbal END), 2) AS \"{x}\"" for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD")) + " FROM customer GROUP BY c_nationkey")
def wide_table(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.round(F.sum("c_acctbal"), 2).alias("v"))
    return tallies.wide(c, "c_nationkey", "c_mktsegment", "v", ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"])


# -- contracts --------------------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT DISTINCT user_id AS sample, event_type AS class FROM events), w AS (SELECT DISTINCT event_type AS class FROM events WHERE event_type <> 'view'),
e AS (SELECT sample, w.class FROM (SELECT DISTINCT sample FROM c), w), r AS (SELECT user_id AS sample, props AS panel FROM events),
n AS (SELECT panel, count(DISTINCT sample) AS n FROM r GROUP BY panel), b AS (SELECT min(panel) AS common FROM n WHERE n = (SELECT max(n) FROM n))
SELECT sample, 'error' AS level, 'missing_classes' AS code, string_agg(class, ',' ORDER BY class) AS message FROM e WHERE (sample, class) NOT IN (SELECT (sample, class) FROM c) GROUP BY sample
UNION ALL SELECT sample, 'warning', 'unknown_classes', string_agg(class, ',' ORDER BY class) FROM c WHERE class NOT IN (SELECT class FROM w) GROUP BY sample
UNION ALL SELECT sample, 'error', 'mixed_panel', string_agg(DISTINCT panel, ',' ORDER BY panel) FROM r, b WHERE panel <> common GROUP BY sample""")
def contract_issues(spark, d):
    e = table(spark, d, "events")
    counted = e.select(F.col("user_id").alias("sample"), F.col("event_type").alias("class"))
    wanted = e.where("event_type <> 'view'").select(F.col("event_type").alias("class")).distinct()
    return contracts.issues(wanted, counted, e.select(F.col("user_id").alias("sample"), F.col("props").alias("panel")), "panel")


@query("""WITH b AS (SELECT s_suppkey AS region, s_nationkey AS role FROM supplier), c AS (SELECT DISTINCT l_partkey % 500 AS sample, l_suppkey + l_linenumber % 2 AS region FROM lineitem),
e AS (SELECT DISTINCT c.sample, b.region, role FROM c, b)
SELECT coalesce(e.sample, c.sample) AS sample, coalesce(e.region, c.region) AS region, coalesce(role, -1) AS role, CASE WHEN e.region IS NULL THEN 'extra' WHEN c.region IS NULL THEN 'missing' ELSE 'both' END AS state FROM e FULL JOIN c ON e.sample = c.sample AND e.region = c.region""")
def region_match(spark, d):
    bundle = table(spark, d, "supplier").select(F.col("s_suppkey").alias("region"), F.col("s_nationkey").alias("role"))
    counted = table(spark, d, "lineitem").select((F.col("l_partkey") % 500).alias("sample"), (F.col("l_suppkey") + F.col("l_linenumber") % 2).alias("region"))
    return contracts.region_match(bundle, counted).withColumn("role", F.coalesce("role", F.lit(-1)))


# -- screens ----------------------------------------------------------------------------------------------------------------------


_UNLIKE = " OR ".join(f"len(list_filter(range(1, {K - p + 1}), lambda i: c[i] <> c[i + {p}])) <= 2" for p in range(1, 7))


@query(f"""WITH {_UK}, {_PANEL} SELECT item_id, count(*) FILTER ({_UNLIKE}) AS periodic, count(*) FILTER (len(list_distinct(string_split(c, ''))) <= 2 OR regexp_matches(c, 'A{{18}}|C{{18}}|G{{18}}|T{{18}}')) AS low FROM panel GROUP BY item_id""")
def kmer_screens(spark, d):
    p = panel.build(_units(spark, d))
    return p.groupBy(F.col("class").alias("item_id")).agg(F.count_if(screens.periodic(F.col("canon"), K)).alias("periodic"), F.count_if(S.low_complexity(F.col("canon"))).alias("low"))


@query(f"""WITH {_UK}, {_DK}, {_PANEL}, o AS (SELECT DISTINCT c, doc_id % 40 AS other FROM dk)
SELECT item_id, count(*) AS kmers FROM panel WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.c = panel.c AND other <> item_id) GROUP BY item_id""")
def not_shared(spark, d):
    loci = S.spread_out(table(spark, d, "documents").select((F.col("doc_id") % 40).alias("class"), "text")).withColumn("seq", S.dna(F.col("text"))).drop("text")
    got = screens.not_shared(panel.build(_units(spark, d)), loci, K)
    return got.groupBy(F.col("class").alias("item_id")).agg(F.count(F.lit(1)).alias("kmers"))


@query(f"""WITH {_UK}, {_kmer_sql("bk", "conversations", "conv_id")}, {_PANEL},
s AS (SELECT c, item_id, substr(c, 1, i) || b || substr(c, i + 2) AS x, c[i + 1] AS was, b FROM panel, range({K}) r(i), (VALUES ('A'), ('C'), ('G'), ('T')) t(b)),
n AS (SELECT c, item_id, least(x, translate(reverse(x), 'ACGT', 'TGCA')) AS near FROM s WHERE was <> b), bg AS (SELECT c, count(*) AS n FROM bk GROUP BY c)
SELECT n.c AS canon, item_id, CAST(sum(bg.n) AS BIGINT) AS near_hits FROM n JOIN bg ON n.near = bg.c GROUP BY n.c, item_id""")
def near_background(spark, d):
    bg = S.spread_out(table(spark, d, "conversations").select("text"), "text").select(S.dna(F.col("text")).alias("seq"))
    return screens.near_background(panel.build(_units(spark, d)), bg, K).withColumnRenamed("class", "item_id")


@query(f"""WITH {_UK}, {_PANEL}, z AS (SELECT item_id, (max(off) - 85) // 10 + 1 AS tiles FROM uk GROUP BY item_id HAVING max(off) >= 85), t AS (SELECT item_id, unnest(range(0, tiles)) AS tile FROM z),
h AS (SELECT t.item_id, tile, panel.item_id AS cls, count(*) AS n FROM t JOIN uk ON uk.item_id = t.item_id AND off BETWEEN tile * 10 AND tile * 10 + 85 JOIN panel ON panel.c = uk.c GROUP BY ALL HAVING count(*) >= 4),
s AS (SELECT item_id, count(DISTINCT tile) FILTER (cls = item_id) AS found, count(DISTINCT tile) FILTER (cls <> item_id) AS crossed FROM h GROUP BY item_id)
SELECT z.item_id, tiles, coalesce(found, 0) AS found, coalesce(crossed, 0) AS crossed FROM z LEFT JOIN s ON z.item_id = s.item_id""")
def panel_recall(spark, d):
    u = _units(spark, d)
    return screens.recall(u, panel.build(u), K, tile=100).withColumnRenamed("class", "item_id")


# -- intervals --------------------------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {_BANDS}, o AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY s, e) AS i FROM bands),
p AS (SELECT contig, i, s AS first, e AS reach, i AS place FROM o WHERE i = 1 UNION ALL SELECT o.contig, o.i, CASE WHEN on_ THEN first ELSE o.s END, CASE WHEN on_ THEN greatest(reach, o.e) ELSE o.e END, CASE WHEN on_ THEN place ELSE o.i END
FROM (SELECT p.*, o.s - reach <= 60 AND o.e - first <= 400 AS on_ FROM p JOIN o ON o.contig = p.contig AND o.i = p.i + 1) p JOIN o ON o.contig = p.contig AND o.i = p.i + 1)
SELECT contig, first AS "start", max(reach) AS "end", count(*) AS members FROM p GROUP BY contig, place, first""")
def places(spark, d):
    return intervals.places(_bands(spark, d), ["contig"], 60, 400)


@query(f"""WITH {_BANDS}, {_MERGE.format(name="m", gap=0)}, a AS (SELECT event_id AS id, contig, s, e FROM ({_place_sql("80", 31)})),
h AS (SELECT id, a.contig, a.s AS s0, a.e AS e0, m.s AS ms, m.e AS me FROM a JOIN m ON a.contig = m.contig AND m.s < a.e AND a.s < m.e),
g AS (SELECT id, contig, me AS s, coalesce(lead(ms) OVER (PARTITION BY id ORDER BY ms), e0) AS e FROM h UNION ALL SELECT id, contig, s0, min(ms) FROM h GROUP BY id, contig, s0
UNION ALL SELECT id, contig, s, e FROM a WHERE id NOT IN (SELECT id FROM h)) SELECT contig, id, s AS "start", e AS "end" FROM g WHERE s < e""")
def subtract_intervals(spark, d):
    a = _places(spark, d, 80, 31).select("contig", F.col("event_id").alias("id"), "start", "end")
    return intervals.subtract(a, intervals.merge(_bands(spark, d), ["contig"]).drop("members"), ["contig"], 128)


# -- cohorts ----------------------------------------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT c_custkey % 100 AS x, c_acctbal AS y FROM customer), f AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b FROM x)
SELECT n, round(b, 6) AS slope, round(sqrt(sum((x - mx) * (x - mx) * (y - my - b * (x - mx)) * (y - my - b * (x - mx))) * n / (n - 2)) / sum((x - mx) * (x - mx)), 6) AS se FROM x, f GROUP BY n, b""")
def heredity_errors(spark, d):
    c = table(spark, d, "customer").select((F.col("c_custkey") % 100).alias("x"), F.col("c_acctbal").alias("y"))
    return cohort.heredity_errors(c, "x", "y").select("n", six("slope").alias("slope"), six("se").alias("se"))


@query("""WITH p AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY x) + (count(*) OVER (PARTITION BY l_returnflag, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY y) + (count(*) OVER (PARTITION BY l_returnflag, y) - 1) / 2.0 AS ry FROM p)
SELECT l_returnflag, count(*) AS n, round(quantile_cont(ln(y / x), 0.5), 6) AS log_median, round(stddev_samp(ln(y / x)), 6) AS log_sd, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY l_returnflag""")
def agreement(spark, d):
    p = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    got = cohort.agreement(p, ["l_returnflag"])
    return got.select("l_returnflag", "n", *(six(c).alias(c) for c in got.columns[2:]))


@query("""WITH f AS (SELECT regr_slope(c_acctbal, c_nationkey) AS b, avg(c_nationkey) AS m, regr_r2(c_acctbal, c_nationkey) AS r FROM customer) SELECT c_custkey, round(c_acctbal - b * (c_nationkey - m), 4) AS adjusted, round(r, 6) AS r2 FROM customer, f""")
def adjusted(spark, d):
    got = cohort.adjust(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_acctbal", ["c_nationkey"])
    return got.select("c_custkey", F.round("adjusted", 4).alias("adjusted"), six("r2").alias("r2"))


@query("""WITH r AS (SELECT DISTINCT event_type AS class, user_id % 10 AS sample, CAST(floor(value / 25) AS BIGINT) AS w FROM events), s AS (SELECT class, count(DISTINCT sample) AS n FROM r GROUP BY class)
SELECT r.class, w AS window, round(count(*) / n, 6) AS present FROM r JOIN s USING (class) GROUP BY r.class, w, n HAVING count(*) / n >= 0.5""")
def window_presence(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("class"), (F.col("user_id") % 10).alias("sample"), F.floor(F.col("value") / 25).alias("window"), F.col("value").alias("y"))
    return cohort.present(e, ["class"], 0.5).select("class", "window", six("present").alias("present"))


_CURVE = f"""{_PL}, k AS (SELECT DISTINCT class, bin FROM p), n AS (SELECT class, bin, row_number() OVER (PARTITION BY class ORDER BY bin) AS rank FROM k),
x AS (SELECT n.class, t.sample, rank, coalesce(reads, 0) / total AS share FROM n JOIN t USING (class) LEFT JOIN p ON p.class = n.class AND p.bin = n.bin AND p.sample = t.sample),
c AS (SELECT class, rank, sum(share) OVER (PARTITION BY class, sample ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM x),
v AS (SELECT class, rank, quantile_cont(s, 0.5) AS med, quantile_cont(s, 0.1) AS p10 FROM c GROUP BY class, rank)"""


def _shares(spark, d) -> DataFrame:
    p = _placements(spark, d)
    total = p.groupBy("sample", "class").agg(F.sum("reads").alias("total"))
    rank = cohort.ranked(p.select("class", "bin").distinct(), ["class"], "bin")
    at = rank.join(total, "class").join(p, ["sample", "class", "bin"], "left")
    return at.select("sample", "class", "rank", (F.coalesce("reads", F.lit(0)) / F.col("total")).alias("share"))


@query(f"WITH {_CURVE} SELECT class, rank, round(med, 6) AS median, round(p10, 6) AS p10 FROM v")
def capture_curve(spark, d):
    return cohort.capture_curve(_shares(spark, d)).select("class", "rank", six("median").alias("median"), six("p10").alias("p10"))


@query(f"""WITH {_CURVE}, z AS (SELECT class, rank, max(share) AS mx FROM x GROUP BY class, rank), q AS (SELECT v.class, v.rank, med, mx, v.rank % 9 <> 8 AS kept FROM v JOIN z ON v.class = z.class AND v.rank = z.rank),
b AS (SELECT class, arg_max(med, rank) AS fl, sum(CASE WHEN kept THEN 0 ELSE mx END) AS lost, min(CASE WHEN NOT kept THEN rank END) AS gap FROM q GROUP BY class)
SELECT b.class, round(greatest(fl - lost, coalesce(max(med) FILTER (gap IS NULL OR rank < gap), 0)), 6) AS bound FROM b JOIN q ON q.class = b.class GROUP BY b.class, fl, lost""")
def capture_bound(spark, d):
    x = _shares(spark, d)
    at = cohort.capture_curve(x).join(x.groupBy("class", "rank").agg(F.max("share").alias("share_max")), ["class", "rank"]).withColumnRenamed("median", "curve")
    return cohort.capture_bound(at, at.where("rank % 9 <> 8").select("class", "rank")).select("class", six("bound").alias("bound"))


@query("""WITH RECURSIVE l AS (SELECT c_custkey AS a, c_custkey // 9 * 9 + d * (1 + c_custkey % 3) AS b FROM customer, (VALUES (0), (1)) t(d)),
e AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b), r(p, q) AS (SELECT a, b FROM e UNION SELECT r.p, e.b FROM r JOIN e ON r.q = e.a) SELECT p AS person, min(q) AS family FROM r GROUP BY p""")
def families(spark, d):
    c, first = table(spark, d, "customer"), F.floor(F.col("c_custkey") / 9) * 9
    return cohort.families(c.select(F.col("c_custkey").alias("child"), first.alias("father"), (first + 1 + F.col("c_custkey") % 3).alias("mother")), scratch(spark, "families"))
