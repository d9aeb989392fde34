"""Queries of read filters, tallies by place, chains of group means and pairings by sex over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.functions import sequences as S
from copyloom.operators import cohort, intervals, panel, tallies
from copyloom.operators import estimate as E
from copyloom.plans.estimates import _BINS, LENGTH
from copyloom.queries import _BANDS, _MERGE, _PANEL, _UK, _bands, _place_sql, _places, _units, query, six, table

_FLAGS = "(event_id % 13 // 12 * 4 + event_id % 2 * 16 + event_id % 11 // 10 * 1024)"
_READS = f"reads AS (SELECT concat(event_type, '-', event_id % 40) AS contig, CAST(floor(value * 20) AS BIGINT) AS pos, CAST({_FLAGS} AS INT) AS flags, event_id % 60 AS mapq, user_id % 3 AS sample, 30 + event_id % 500 AS length FROM events)"


def _reads(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    flags = F.floor(F.col("event_id") % 13 / 12) * 4 + F.col("event_id") % 2 * 16 + F.floor(F.col("event_id") % 11 / 10) * 1024
    return e.select(F.concat_ws("-", "event_type", F.col("event_id") % 40).alias("contig"), F.floor(F.col("value") * 20).alias("pos"), flags.cast("int").alias("flags"), (F.col("event_id") % 60).alias("mapq"), (F.col("user_id") % 3).alias("sample"), (30 + F.col("event_id") % 500).alias("length"))


@query(f"WITH {_READS} SELECT contig, pos // 100 AS bin, count(*) AS reads, count(*) FILTER (flags & 1024 <> 0) AS dup FROM reads WHERE flags & 4 = 0 GROUP BY ALL")
def bin_tally(spark, d):
    return tallies.bin_tally(_reads(spark, d), 100)


@query(f"WITH {_READS} SELECT contig, count(*) AS reads, count(*) FILTER (flags & 1024 <> 0) AS dup FROM reads WHERE flags & 4 = 0 GROUP BY ALL")
def contig_reads(spark, d):
    return tallies.contig_reads(_reads(spark, d))


@query(f"WITH {_READS} SELECT sample, least(length, 400) AS length, count(*) AS n FROM reads GROUP BY ALL")
def read_lengths(spark, d):
    return tallies.read_lengths(_reads(spark, d), ["sample"])


@query(f"WITH {_READS}, {_BANDS}, {_MERGE.format(name='m', gap=0)} SELECT sample, count(*) AS ctrl, count(*) FILTER (flags & 1024 <> 0) AS ctrl_dup, count(*) FILTER (mapq = 0) AS ctrl_mapq0 FROM reads JOIN m ON reads.contig = m.contig AND s <= pos AND pos < e WHERE flags & 4 = 0 GROUP BY sample")
def control_stats(spark, d):
    return tallies.control_stats(_reads(spark, d), intervals.merge(_bands(spark, d), ["contig"]).drop("members"), ["sample"], 64)


@query(f"""WITH {_BINS}, ends AS (SELECT l_partkey % 40 AS class, l_suppkey * 7 % 500 AS pos, l_linestatus = 'O' AS reverse, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT p.gc, count(*) AS n, CAST(coalesce(sum(ends.n), 0) AS BIGINT) AS o FROM p LEFT JOIN ends USING (class, pos, reverse) WHERE p.gc >= 0 GROUP BY p.gc""")
def gc_observed(spark, d):
    u = table(spark, d, "benchmark").select(F.col("item_id").alias("class"), S.dna(F.col("text")).alias("seq"), (F.col("item_id") % 4 == 1).alias("circular")).where("seq <> ''")
    ends = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 40).alias("class"), (F.col("l_suppkey") * 7 % 500).alias("pos"), (F.col("l_linestatus") == "O").alias("reverse")).agg(F.count(F.lit(1)).alias("n"))
    return tallies.gc_observed(E.position_gc(u, LENGTH), ends)


@query("SELECT l_suppkey AS region, CAST(count(*) AS BIGINT) AS positions, round(sum(CAST(l_quantity AS BIGINT)) / count(*) / 100, 6) AS mean_gc FROM lineitem GROUP BY l_suppkey")
def region_totals(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("region"), F.col("l_quantity").cast("long").alias("gc")).agg(F.count(F.lit(1)).alias("n"))
    return tallies.region_totals(t).select("region", "positions", six("mean_gc").alias("mean_gc"))


@query(f"""WITH {_READS} SELECT pos, length, flags, sample, count(*) AS n, CASE WHEN NOT stored THEN pos WHEN against THEN pos - length + 1 ELSE pos + length - 1 END AS end5, against <> stored AS reverse
FROM (SELECT *, flags & 16 <> 0 AND flags & 4 = 0 AS stored, sample = 1 AS against FROM reads) GROUP BY pos, length, flags, sample, stored, against""")
def sequenced_end(spark, d):
    end, reverse = tallies.sequenced_end(F.col("pos"), F.col("length"), F.col("sample") == 1, tallies.stored_reversed(F.col("flags")))
    return _reads(spark, d).groupBy("pos", "length", "flags", "sample").agg(F.count(F.lit(1)).alias("n")).select("*", end.alias("end5"), reverse.alias("reverse"))


@query("""WITH p AS (SELECT event_type AS class, user_id % 5 AS contig, CAST(floor(value) AS BIGINT) AS "start", count(*) AS reads FROM events GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY class ORDER BY reads DESC, contig, "start") AS place FROM p""")
def placement_order(spark, d):
    p = table(spark, d, "events").groupBy(F.col("event_type").alias("class"), (F.col("user_id") % 5).alias("contig"), F.floor("value").alias("start")).agg(F.count(F.lit(1)).alias("reads"))
    return tallies.placement_order(p)


@query(f"""WITH {_UK}, {_PANEL}, k AS (SELECT c, item_id, CASE WHEN item_id % 3 = 0 THEN 'compositional' ELSE 'positional' END AS kind FROM panel) SELECT item_id, item_id IN (2, 3, 7) AS asked, count(*) AS kmers FROM k WHERE item_id IN (2, 3, 7) OR kind = 'compositional' GROUP BY ALL""")
def selected_classes(spark, d):
    p = panel.build(_units(spark, d)).withColumn("kind", F.when(F.col("class") % 3 == 0, "compositional").otherwise("positional"))
    return panel.selected(p, [2, 3, 7]).groupBy(F.col("class").alias("item_id"), "asked").agg(F.count(F.lit(1)).alias("kmers"))


@query(f"""WITH {_BANDS}, x AS (SELECT DISTINCT contig, s, e FROM ({_place_sql("4", 45)})) SELECT contig, s AS "start", e AS "end" FROM bands b WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.contig = b.contig AND x.s < b.e AND b.s < x.e)""")
def level_windows(spark, d):
    return cohort.level_windows(_bands(spark, d), _places(spark, d, 4, 45).select("contig", "start", "end"), ["contig"], 64)


@query("""WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS med FROM events GROUP BY event_type), s AS (SELECT e.event_type, med, 1.4826 * quantile_cont(abs(value - med), 0.5) AS sd FROM events e JOIN m USING (event_type) GROUP BY e.event_type, med)
SELECT event_type, round(avg(value), 6) AS mean, count(*) AS kept FROM events JOIN s USING (event_type) WHERE abs(value - med) <= 1.2 * sd GROUP BY event_type""")
def trimmed_mean(spark, d):
    return cohort.trimmed_mean(table(spark, d, "events"), ["event_type"], "value", 1.2).select("event_type", six("mean").alias("mean"), "kept")


@query("""WITH a AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS m, count(*) AS n FROM customer GROUP BY ALL), b AS (SELECT c_nationkey, avg(c_acctbal) AS m, count(*) AS n FROM customer GROUP BY ALL), c AS (SELECT c_mktsegment, avg(c_acctbal) AS m, count(*) AS n FROM customer GROUP BY ALL)
SELECT c_custkey, round(c_acctbal - CASE WHEN a.n >= 12 THEN a.m WHEN b.n >= 12 THEN b.m WHEN c.n >= 12 THEN c.m ELSE (SELECT avg(c_acctbal) FROM customer) END, 8) AS centred FROM customer JOIN a USING (c_nationkey, c_mktsegment) JOIN b USING (c_nationkey) JOIN c USING (c_mktsegment)""")
def centred_chain(spark, d):
    return cohort.centred_chain(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], "c_acctbal", 12).select("c_custkey", F.round("centred", 8).alias("centred"))


@query("""WITH t AS (SELECT c.c_acctbal AS child, f.c_acctbal AS father, m.c_acctbal AS mother, c.c_custkey % 2 AS sex FROM customer c JOIN customer f ON f.c_custkey = c.c_custkey + 1 JOIN customer m ON m.c_custkey = c.c_custkey + 2),
b AS (SELECT sex AS child_sex, 'father' AS parent_sex, child, father AS p FROM t UNION ALL SELECT sex, 'mother', child, mother FROM t), r AS (SELECT child_sex, parent_sex, count(*) AS n, corr(child, p) AS r FROM b GROUP BY ALL),
z AS (SELECT *, 0.5 * ln((1 + r) / (1 - r)) AS z FROM r), m AS (SELECT sum((n - 3) * z) / sum(n - 3) AS mid FROM z), q AS (SELECT z.*, (n - 3) * (z - mid) * (z - mid) AS q FROM z, m)
SELECT child_sex, parent_sex, n, round(r, 6) AS r, round(z, 6) AS z, round(q, 5) AS q, round(sum(q) OVER (), 5) AS q_all FROM q""")
def by_sex(spark, d):
    c = table(spark, d, "customer")
    links = c.select(F.col("c_custkey").alias("child"), (F.col("c_custkey") + 1).alias("father"), (F.col("c_custkey") + 2).alias("mother"))
    at = cohort.trios(c.select(F.col("c_custkey").alias("person"), "c_acctbal"), links, "c_acctbal").withColumn("sex", F.col("child") % 2)
    return cohort.by_sex(at).select("child_sex", "parent_sex", "n", six("r").alias("r"), six("z").alias("z"), F.round("q", 5).alias("q"), F.round("q_all", 5).alias("q_all"))
