"""Queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copyloom.functions import sequences as S
from copyloom.operators import cohort, intervals, models, panel
from copyloom.streaming.counts import stream_bins

K = 15
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def six(c: str | Column) -> Column:
    return F.round(c, 6)


# -- sequences: documents are reads, benchmark items are units -----------------------------------------------------------------


def _units(spark, d) -> DataFrame:
    u = table(spark, d, "benchmark").select(F.col("item_id").alias("class"), F.lit("positional").alias("kind"), S.dna(F.col("text")).alias("seq"))
    return S.kmers(u, "seq", K, spread=True)


def _hits(spark, d) -> DataFrame:
    r = S.spread_out(table(spark, d, "documents").select(F.col("doc_id").alias("read"), "text"))
    return panel.hits(r.select("read", S.dna(F.col("text")).alias("seq")), panel.build(_units(spark, d)), K)


def _dna(col: str) -> str:
    return f"translate(regexp_replace(lower(coalesce({col}, '')), '[^a-z]', '', 'g'), '{S.LETTERS}', '{S.BASES}')"


def _kmer_sql(name: str, tab: str, key: str) -> str:
    return f"""{name}_s AS (SELECT {key}, {_dna("text")} AS s FROM {tab}),
{name}_o AS (SELECT {key}, s, unnest(range(0, greatest(length(s) - {K - 1}, 0))) AS off FROM {name}_s),
{name}_k AS (SELECT {key}, off, substr(s, off + 1, {K}) AS km FROM {name}_o),
{name} AS (SELECT {key}, off, least(km, translate(reverse(km), 'ACGT', 'TGCA')) AS c, km <= translate(reverse(km), 'ACGT', 'TGCA') AS fwd FROM {name}_k)"""


_UK, _DK = _kmer_sql("uk", "benchmark", "item_id"), _kmer_sql("dk", "documents", "doc_id")
_PANEL = "panel AS (SELECT c, min(item_id) AS item_id, min(off) AS pos, bool_and(fwd) AS fwd FROM uk GROUP BY c HAVING count(*) = 1)"


@query(f"""WITH {_UK}, {_DK}, {_PANEL},
valid AS (SELECT doc_id, count(*) AS valid FROM dk GROUP BY doc_id),
hits AS (SELECT doc_id, panel.item_id, count(*) AS hits FROM dk JOIN panel USING (c) GROUP BY ALL),
top AS (SELECT *, row_number() OVER w AS r, lead(hits, 1, 0) OVER w AS second FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY hits DESC, item_id))
SELECT doc_id, item_id, hits, second, valid, least(10, hits * 10 // greatest(valid, 1)) AS hit_frac_bin,
CASE WHEN hits < 4 THEN 'below' WHEN 5 * second > hits THEN 'ambiguous' ELSE 'assigned' END AS state FROM top JOIN valid USING (doc_id) WHERE r = 1""")
def k_classify(spark, d):
    got = panel.classify(_hits(spark, d))
    return got.withColumnsRenamed({"read": "doc_id", "class": "item_id"})


@query(f"""WITH {_UK}, {_DK}, {_PANEL},
h AS (SELECT doc_id, panel.item_id, dk.fwd = panel.fwd AS same, dk.off, pos FROM dk JOIN panel USING (c)),
g AS (SELECT doc_id, item_id, count(*) AS hits, count(*) FILTER (NOT same) > count(*) FILTER (same) AS reverse,
list_sort(list(pos - off) FILTER (same)) AS ahead, list_sort(list(pos + {K - 1} + off) FILTER (NOT same)) AS back FROM h GROUP BY doc_id, item_id)
SELECT doc_id, item_id, hits, reverse, CAST(CASE WHEN reverse THEN back[len(back) // 2 + 1] ELSE ahead[len(ahead) // 2 + 1] END AS BIGINT) AS diagonal FROM g WHERE hits >= 4""")
def k_locate(spark, d):
    got = panel.locate(_hits(spark, d), K)
    return got.withColumnsRenamed({"read": "doc_id", "class": "item_id"})


@query(f"""WITH {_UK}, {_kmer_sql("bk", "conversations", "conv_id")},
n AS (SELECT c, item_id, count(*) AS n FROM uk GROUP BY c, item_id), sh AS (SELECT c, count(*) > 1 AS shared FROM n GROUP BY c),
bg AS (SELECT c, count(*) AS b FROM bk WHERE c IN (SELECT c FROM n) GROUP BY c),
r AS (SELECT n.item_id, CASE WHEN shared THEN 'shared' WHEN n > 1 THEN 'repeated' WHEN coalesce(b, 0) > 0 THEN 'background' ELSE 'kept' END AS reason FROM n JOIN sh USING (c) LEFT JOIN bg USING (c))
SELECT item_id, reason, count(*) AS kmers FROM r GROUP BY item_id, reason""")
def panel_report(spark, d):
    bg = table(spark, d, "conversations").select(S.dna(F.col("text")).alias("seq"))
    got = panel.candidates(_units(spark, d), S.kmers(bg, "seq", K, spread=True).select("canon"))
    return got.select(F.col("class").alias("item_id"), panel.reason().alias("reason")).groupBy("item_id", "reason").agg(F.count(F.lit(1)).alias("kmers"))


@query(f"""WITH {_UK}, {_PANEL}, e AS (SELECT c, item_id FROM panel WHERE item_id % 2 = 0 OR item_id % 5 = 0), o AS (SELECT c, item_id FROM panel WHERE item_id % 2 = 1)
SELECT item_id, count(*) AS kmers FROM (SELECT * FROM e UNION ALL SELECT * FROM o) WHERE c NOT IN (SELECT c FROM e INTERSECT SELECT c FROM o) GROUP BY item_id""")
def panel_merge(spark, d):
    p = panel.build(_units(spark, d))
    got = panel.merge(p.where("class % 2 = 0 or class % 5 = 0"), p.where("class % 2 = 1"))
    return got.groupBy(F.col("class").alias("item_id")).agg(F.count(F.lit(1)).alias("kmers"))


@query(f"""WITH u AS (SELECT item_id, {_dna("text")} AS s FROM benchmark),
w AS (SELECT item_id, s, l, unnest(range(0, greatest(length(s) - l + 1, 0))) AS off FROM u, (VALUES (100), (150), (200)) t(l)),
g AS (SELECT l, (100 * len(regexp_replace(substr(s, off + 1, l), '[^CG]', '', 'g')) + l // 2) // l AS gc FROM w)
SELECT CAST(l AS INT) AS l, gc, count(*) AS n FROM g GROUP BY l, gc""")
def gc_table(spark, d):
    u = table(spark, d, "benchmark").select(F.col("item_id").alias("unit"), S.dna(F.col("text")).alias("seq"))
    return models.gc_windows(u, [100, 150, 200]).groupBy("l", "gc").agg(F.count(F.lit(1)).alias("n"))


_CIGAR = "concat(event_id % 7, 'S', 40 + event_id % 50, 'M', event_id % 3 + 1, 'D', 20 + event_id % 9, 'M', event_id % 5 + 1, 'S')"


@query("""SELECT event_id, CAST(CASE WHEN event_id % 2 = 1 THEN pos + (40 + event_id % 50) + (event_id % 3 + 1) + (20 + event_id % 9) + (event_id % 5 + 1) - 1 ELSE pos - event_id % 7 END AS BIGINT) AS end5
FROM (SELECT event_id, CAST(floor(value * 1000) AS BIGINT) AS pos FROM events) WHERE event_id % 4 <> 3""")
def five_prime(spark, d):
    e = table(spark, d, "events").select("event_id", F.floor(F.col("value") * 1000).alias("pos"), F.expr(_CIGAR).alias("cigar"), F.when(F.col("event_id") % 4 == 3, 0x100).otherwise((F.col("event_id") % 2) * 16).cast("int").alias("flags"))
    e = e.where(S.primary(F.col("flags")))
    return e.select("event_id", S.five_prime(F.col("pos"), F.col("cigar"), F.col("flags").bitwiseAND(16) != 0).alias("end5"))


# -- intervals: events as places along contigs of one type and one of 40 parts each ----------------------------------------------


def _places(spark, d, length, shift=0) -> DataFrame:
    """Each event as an interval: (event_id, user_id, contig, start, end)."""
    e = table(spark, d, "events")
    start = F.floor(F.col("value") * 20) + shift
    return e.select("event_id", "user_id", F.concat_ws("-", "event_type", F.col("event_id") % 40).alias("contig"), start.alias("start"), (start + length).alias("end"))


def _place_sql(length: str, shift: int = 0) -> str:
    return f"SELECT event_id, user_id, concat(event_type, '-', event_id % 40) AS contig, CAST(floor(value * 20) AS BIGINT) + {shift} AS s, CAST(floor(value * 20) AS BIGINT) + {shift} + {length} AS e FROM events"


_LENGTH = "5 + event_id % 60"


def _bands(spark, d) -> DataFrame:
    return _places(spark, d, F.expr(_LENGTH)).select("contig", "start", "end")


_BANDS = f"bands AS ({_place_sql(_LENGTH)})"
_MERGE = """{name}_r AS (SELECT *, max(e) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM bands),
{name}_n AS (SELECT *, sum(CASE WHEN s - reach <= {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM {name}_r),
{name} AS (SELECT contig, min(s) AS s, max(e) AS e, count(*) AS members FROM {name}_n GROUP BY contig, run)"""
_POINTS = f"points AS (SELECT event_id, contig, s AS pos FROM ({_place_sql('1', 31)}))"


def _points(spark, d) -> DataFrame:
    return _places(spark, d, 1, 31).select("event_id", "contig", F.col("start").alias("pos"))


@query(f'WITH {_BANDS}, {_MERGE.format(name="m", gap=0)} SELECT contig, s AS "start", e AS "end", members FROM m')
def merge_intervals(spark, d):
    return intervals.merge(_bands(spark, d), ["contig"])


@query(f'WITH {_BANDS}, {_MERGE.format(name="m", gap=40)} SELECT contig, s AS "start", e AS "end", members FROM m')
def group_within_gap(spark, d):
    return intervals.merge(_bands(spark, d), ["contig"], 40)


@query(f'WITH {_BANDS}, {_MERGE.format(name="m", gap=0)}, g AS (SELECT contig, lag(e) OVER (PARTITION BY contig ORDER BY s) AS a, s AS b FROM m) SELECT contig, a AS "start", b AS "end" FROM g WHERE a < b')
def complement_intervals(spark, d):
    return intervals.complement(intervals.merge(_bands(spark, d), ["contig"]), ["contig"])


@query(f'WITH {_BANDS}, {_POINTS}, {_MERGE.format(name="m", gap=0)} SELECT contig, s AS "start", e AS "end", count(*) AS ends FROM points JOIN m USING (contig) WHERE pos >= s AND pos < e GROUP BY ALL')
def region_tally(spark, d):
    m = intervals.merge(_bands(spark, d), ["contig"]).drop("members")
    return intervals.points_in(_points(spark, d), m, ["contig"], 64).groupBy("contig", "start", "end").agg(F.count(F.lit(1)).alias("ends"))


@query(f'WITH {_BANDS}, {_POINTS} SELECT contig, points.event_id AS event_id, pos, max(s) AS "start" FROM points JOIN bands USING (contig) WHERE pos >= s AND pos < e GROUP BY contig, points.event_id, pos')
def last_interval(spark, d):
    return intervals.last_holding(_points(spark, d), _bands(spark, d), ["contig"], 64, ["event_id"])


@query(f"""WITH {_BANDS}, {_MERGE.format(name="m", gap=0)}, {_POINTS}
SELECT points.contig AS contig, count(*) AS bins FROM points JOIN m ON points.contig = m.contig AND m.s <= pos AND pos + 3 <= m.e GROUP BY points.contig""")
def bins_within(spark, d):
    x = _places(spark, d, 3, 31).select("event_id", "contig", "start", "end")
    m = intervals.merge(_bands(spark, d), ["contig"]).drop("members")
    return intervals.within(x, m, ["contig"], 64).groupBy("contig").agg(F.count(F.lit(1)).alias("bins"))


@query(f"""WITH {_BANDS}, {_MERGE.format(name="q", gap=40)}, sl AS (SELECT event_id, contig, s AS a, e AS b, user_id + 1 AS size FROM ({_place_sql("20", 17)})),
met AS (SELECT DISTINCT q.contig, q.s, event_id, size FROM q JOIN sl ON q.contig = sl.contig AND q.s < sl.b AND sl.a < q.e), f AS (SELECT DISTINCT event_id, size FROM met)
SELECT (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM met) AS bytes, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM f) AS floor_bytes, (SELECT count(*) FROM f) AS slices""")
def plan_price(spark, d):
    q = intervals.merge(_bands(spark, d), ["contig"], 40).select("contig", "start", "end", F.concat_ws(":", "contig", "start").alias("query"))
    s = _places(spark, d, 20, 17).select("contig", F.col("event_id").alias("slice"), "start", "end", (F.col("user_id") + 1).alias("size"))
    return intervals.price(q, s, ["contig"], 128)


# -- samples --------------------------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS med, count(*) AS n FROM events GROUP BY event_type)
SELECT e.event_type, n, round(med, 6) AS median, round(1.4826 * quantile_cont(abs(value - med), 0.5), 6) AS mad_sd FROM events e JOIN m USING (event_type) GROUP BY e.event_type, n, med""")
def robust_scale(spark, d):
    got = cohort.robust(table(spark, d, "events"), ["event_type"], "value")
    return got.select("event_type", "n", six("median").alias("median"), six("mad_sd").alias("mad_sd"))


@query("""WITH g AS (SELECT l_returnflag, l_quantity, sum(l_linenumber) AS w FROM lineitem GROUP BY ALL),
s AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM g)
SELECT l_returnflag, min(l_quantity) AS weighted_median FROM s WHERE c * 2 >= t GROUP BY l_returnflag""")
def weighted_median(spark, d):
    return cohort.weighted_median(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_linenumber")


@query("""WITH h AS (SELECT l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_linestatus, l_linenumber AS mode FROM (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY n DESC, l_linenumber DESC) AS r FROM h) WHERE r = 1""")
def histogram_mode(spark, d):
    h = table(spark, d, "lineitem").groupBy("l_linestatus", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return cohort.histogram_mode(h, ["l_linestatus"], "l_linenumber", "n")


@query("""WITH s AS (SELECT event_type, value - lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS d FROM events), m AS (SELECT event_type, quantile_cont(d, 0.5) AS med FROM s WHERE d IS NOT NULL GROUP BY event_type)
SELECT s.event_type, round(1.4826 * quantile_cont(abs(d - med), 0.5) / sqrt(2.0), 6) AS noise FROM s JOIN m USING (event_type) WHERE d IS NOT NULL GROUP BY s.event_type""")
def step_noise(spark, d):
    return cohort.noise(table(spark, d, "events"), ["event_type"], "event_id", "value").select("event_type", six("noise").alias("noise"))


@query("""WITH s AS (SELECT conv_id, turn, length(text) // 100 AS state FROM conversations), f AS (SELECT *, CASE WHEN state IS NOT DISTINCT FROM lag(state) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS nw FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(nw) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM f) SELECT conv_id, state, min(turn) AS first, max(turn) AS last, count(*) AS n FROM r GROUP BY conv_id, run, state""")
def state_runs(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.floor(F.length("text") / 100).alias("state"))
    return cohort.runs(c, ["conv_id"], "turn", "state")


def _placements(spark, d) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("sample"), F.col("event_type").alias("class"), F.floor(F.col("value") / 10).alias("bin"))
    return e.groupBy("sample", "class", "bin").agg(F.count(F.lit(1)).alias("reads"))


_PL = "p AS (SELECT user_id % 20 AS sample, event_type AS class, CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS reads FROM events GROUP BY ALL), t AS (SELECT sample, class, sum(reads) AS total FROM p GROUP BY ALL)"


@query(f"""WITH {_PL}, c AS (SELECT sample, class, bin // 4 AS co, sum(reads) AS reads FROM p GROUP BY ALL), g AS (SELECT DISTINCT class, co FROM c JOIN t USING (sample, class) WHERE reads >= greatest(3, 0.01 * total))
SELECT p.class, bin, CAST(sum(reads) AS BIGINT) AS reads, count(DISTINCT sample) AS samples FROM p JOIN g ON p.class = g.class AND p.bin // 4 = g.co GROUP BY p.class, bin""")
def learn_sinks(spark, d):
    return cohort.learn_sinks(_placements(spark, d), 0.01, 3, 4)


@query(f"""WITH {_PL}, b AS (SELECT DISTINCT class, bin FROM p), e AS (SELECT b.class, b.bin, coalesce(reads, 0) / total AS share FROM b JOIN t ON b.class = t.class LEFT JOIN p ON p.class = b.class AND p.bin = b.bin AND p.sample = t.sample),
s AS (SELECT class, bin, quantile_cont(share, 0.5) AS m, quantile_cont(share, 0.1) AS q, max(share) AS x FROM e GROUP BY class, bin)
SELECT class, bin, round(m, 6) AS share_median, round(q, 6) AS share_p10, round(x, 6) AS share_max FROM s""")
def sink_statistics(spark, d):
    got = cohort.sink_statistics(_placements(spark, d))
    return got.select("class", "bin", *(six(c).alias(c) for c in ("share_median", "share_p10", "share_max")))


@query("""WITH m AS (SELECT c_nationkey, avg(c_acctbal) AS a, count(*) AS n FROM customer GROUP BY c_nationkey) SELECT c_custkey, round(c_acctbal - CASE WHEN n >= 55 THEN a ELSE (SELECT avg(c_acctbal) FROM customer) END, 4) AS centred FROM customer JOIN m USING (c_nationkey)""")
def centre_groups(spark, d):
    return cohort.centred(table(spark, d, "customer"), "c_nationkey", "c_acctbal", 55).select("c_custkey", F.round("centred", 4).alias("centred"))


@query("""WITH t AS (SELECT c.c_acctbal AS c, f.c_acctbal AS f, m.c_acctbal AS m, (f.c_acctbal + m.c_acctbal) / 2 AS mid FROM customer c JOIN customer f ON f.c_custkey = c.c_custkey + 1 JOIN customer m ON m.c_custkey = c.c_custkey + 2)
SELECT count(*) AS n, round(regr_slope(c, mid), 6) AS slope_mid, round(regr_slope(c, f), 6) AS slope_father, round(regr_slope(c, m), 6) AS slope_mother, round(corr(c, mid), 6) AS corr_mid, round(corr(f, m), 6) AS corr_parents, round(stddev_samp(c - mid), 4) AS sd_residual FROM t""")
def transmission(spark, d):
    c = table(spark, d, "customer")
    links = c.select(F.col("c_custkey").alias("child"), (F.col("c_custkey") + 1).alias("father"), (F.col("c_custkey") + 2).alias("mother"))
    got = cohort.transmission(cohort.trios(c.select(F.col("c_custkey").alias("person"), "c_acctbal"), links, "c_acctbal"))
    return got.select("n", *(six(x).alias(x) for x in got.columns[1:-1]), F.round("sd_residual", 4).alias("sd_residual"))


@query("""SELECT event_type AS contig, CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY ALL""")
def stream_counts(spark, d):
    return stream_bins(spark, d, "events.parquet")


@query()
def gc_curve(spark, d):
    x = table(spark, d, "lineitem")
    rows = x.groupBy((F.col("l_linenumber") % 2).alias("sample"), (F.col("l_quantity") + 25).cast("long").alias("gc")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("o"))
    return models.gc_curves(rows, ["sample"], min_positions=50, min_ends=500)


@query()
def calibration(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    y = x.groupBy((F.col("o_custkey") % 100).alias("sample"), (F.col("l_partkey") % 60).alias("window")).agg(F.avg(F.log("l_extendedprice")).alias("y"))
    return models.calibrate(y.withColumn("class", F.lit("all")), ["class"])


@query()
def copy_states(spark, d):
    x = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("window"), (F.length("text") / 100).alias("cn"))
    return models.segment(x, ["conv_id"], sd=0.7)
