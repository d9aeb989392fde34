"""Queries of the estimates over the test tables, and their SQL: benchmark items are units, lines of orders are what was counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.functions import sequences as S
from copyloom.operators import cohort, heredity, models
from copyloom.operators import estimate as E
from copyloom.queries import _dna, query, six, table

#: Bases of a fragment window, of a bin, and bins of a window.
LENGTH, WIDTH, PER = 40, 10, 5
FLAT = 0.024

_CURVE = "curve AS (SELECT s AS sample, g AS gc, CASE WHEN g BETWEEN 30 AND 65 + s THEN 0.02 + g * 0.0001 * (s + 1) END AS rate FROM range(3) a(s), range(-1, 101) b(g))"
_SEEN = "seen AS (SELECT l_linenumber % 3 AS sample, l_partkey % 40 AS class, l_suppkey % 37 AS bin, l_linestatus = 'O' AS reverse, count(*) AS n FROM lineitem GROUP BY ALL)"
_ANCHORS = "SELECT item_id AS class, 23 AS s, 140 + 10 * (item_id % 9) AS e FROM benchmark WHERE item_id % 2 = 0"
_BINS = f"""u AS (SELECT item_id AS class, {_dna("text")} AS seq, item_id % 4 = 1 AS circular FROM benchmark),
v AS (SELECT class, length(seq) AS size, CASE WHEN circular THEN seq || substr(seq, 1, {LENGTH - 1}) ELSE seq END AS x FROM u),
w AS (SELECT class, size, x, unnest(range(0, greatest(length(x) - {LENGTH - 1}, 0))) AS off FROM v),
g AS (SELECT class, size, off, (100 * len(regexp_replace(substr(x, off + 1, {LENGTH}), '[^CG]', '', 'g')) + {LENGTH // 2}) // {LENGTH} AS gc FROM w WHERE off < size),
d AS (SELECT class, off AS pos, false AS reverse, gc FROM g UNION ALL SELECT class, (off + {LENGTH - 1}) % size, true, gc FROM g),
p AS (SELECT class, pos, reverse, coalesce(gc, -1) AS gc, CASE WHEN reverse THEN pos % 89 <> 7 ELSE pos % 97 <> 5 END AS ok
FROM (SELECT class, pos, reverse FROM (SELECT class, unnest(range(0, size)) AS pos FROM v), (VALUES (false), (true)) t(reverse)) LEFT JOIN d USING (class, pos, reverse)),
{_CURVE}, {_SEEN},
b AS (SELECT sample, class, pos // {WIDTH} AS bin, reverse, bool_and(ok AND rate IS NOT NULL) AS usable, coalesce(sum(rate) FILTER (ok), 0) AS exp, avg(p.gc) FILTER (p.gc >= 0) / 100 AS gc, count(*) FILTER (ok AND rate IS NOT NULL) AS positions
FROM p JOIN curve USING (gc) GROUP BY sample, class, pos // {WIDTH}, reverse),
bins AS (SELECT b.*, coalesce(n, 0) AS obs FROM b LEFT JOIN seen USING (sample, class, bin, reverse)),
win AS (SELECT sample, class, bin // {PER} AS w, coalesce(avg(gc) FILTER (usable), avg(gc)) AS gc, coalesce(sum(obs) FILTER (usable), 0) AS obs, coalesce(sum(exp) FILTER (usable), 0) AS exp, avg(usable::INT) AS usable, max(bin) AS last FROM bins GROUP BY ALL),
windows AS (SELECT sample, class, w * {PER * WIDTH} AS "start", least((last + 1) * {WIDTH}, size) AS "end", gc, obs, exp, usable, CASE WHEN usable >= 0.5 AND exp > 0 THEN 2 * obs / exp END AS cn FROM win JOIN v USING (class))"""


def curve(spark) -> DataFrame:
    c = spark.range(3).select(F.col("id").alias("sample")).join(spark.range(101).select(F.col("id").alias("gc")))
    return E.whole_curve(c.where("gc between 30 and 65 + sample").select("sample", "gc", F.expr("0.02d + gc * 0.0001d * (sample + 1)").alias("rate")))


def _strand_bins(spark, d) -> DataFrame:
    u = table(spark, d, "benchmark").select(F.col("item_id").alias("class"), S.dna(F.col("text")).alias("seq"), (F.col("item_id") % 4 == 1).alias("circular")).where("seq <> ''")
    p = E.position_gc(u, LENGTH)
    ok = p.select("class", "pos", "reverse", F.when(F.col("reverse"), F.col("pos") % 89 != 7).otherwise(F.col("pos") % 97 != 5).alias("ok"))
    x = table(spark, d, "lineitem")
    seen = x.groupBy((F.col("l_linenumber") % 3).alias("sample"), (F.col("l_partkey") % 40).alias("class"), (F.col("l_suppkey") % 37).alias("bin"), (F.col("l_linestatus") == "O").alias("reverse")).agg(F.count(F.lit(1)).alias("n"))
    return E.strand_bins(p, ok, curve(spark), seen, WIDTH)


def _anchors(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").where("item_id % 2 = 0").select(F.col("item_id").alias("class"), F.lit(23).alias("start"), (F.lit(140) + 10 * (F.col("item_id") % 9)).alias("end"))


@query(f'WITH {_BINS} SELECT sample, class, "start", "end", round(gc, 6) AS gc, CAST(obs AS BIGINT) AS obs, round(exp, 6) AS exp, round(usable, 6) AS usable, round(cn, 6) AS cn FROM windows')
def copy_windows(spark, d):
    lengths = table(spark, d, "benchmark").select(F.col("item_id").alias("class"), F.length(S.dna(F.col("text"))).alias("length"))
    w = E.windows(_strand_bins(spark, d), PER, WIDTH, lengths)
    return w.select("sample", "class", "start", "end", "obs", *(six(c).alias(c) for c in ("gc", "exp", "usable", "cn")))


_ESTIMATE = f"""{_BINS}, a AS ({_ANCHORS}), i AS (SELECT DISTINCT class, unnest(range((s + {WIDTH - 1}) // {WIDTH}, e // {WIDTH})) AS bin FROM a),
f AS (SELECT *, usable AND gc BETWEEN 0.4 AND 0.6 AND ((SELECT count(*) FROM a WHERE a.class = bins.class) = 0 OR EXISTS (SELECT 1 FROM i WHERE i.class = bins.class AND i.bin = bins.bin)) AS anchor FROM bins),
m AS (SELECT sample, class, coalesce(sum(obs) FILTER (usable), 0) AS n_all, sum(exp) FILTER (usable) AS e_all, coalesce(sum(obs) FILTER (anchor), 0) AS n_anchor, sum(exp) FILTER (anchor) AS e_anchor, sum(positions) FILTER (usable) AS ps, avg(usable::INT) AS usable_fraction FROM f GROUP BY ALL),
k AS (SELECT sample, class, quantile_cont(cn, 0.5) AS cn_median, CASE WHEN count(*) FILTER (cn > 0) > 2 THEN stddev_pop(CASE WHEN cn > 0 THEN ln(cn) END) END AS window_log_sd FROM windows WHERE cn IS NOT NULL GROUP BY ALL),
est AS (SELECT m.sample, m.class, CASE WHEN n_anchor >= 20 THEN 'anchor' ELSE 'all' END AS cn_basis, CASE WHEN e_all > 0 THEN 2 * n_all / e_all END AS cn_all, n_all, CASE WHEN e_anchor > 0 THEN 2 * n_anchor / e_anchor END AS cn_anchor, n_anchor,
CASE WHEN ps > 0 THEN 2 * n_all / (ps * {FLAT}) END AS cn_all_flat, cn_median, window_log_sd, usable_fraction FROM m LEFT JOIN k ON m.sample = k.sample AND m.class = k.class)"""


def _positional(spark, d) -> DataFrame:
    return E.positional(_strand_bins(spark, d), _anchors(spark, d), PER, WIDTH, FLAT, ends=20)


_ROUNDED = ("cn", "cn_all", "cn_anchor", "cn_all_flat", "cn_median", "window_log_sd", "usable_fraction")


@query(f"""WITH {_ESTIMATE} SELECT sample, class, cn_basis, CAST(n_all AS BIGINT) AS n_all, CAST(n_anchor AS BIGINT) AS n_anchor, round(CASE WHEN cn_basis = 'anchor' THEN cn_anchor ELSE cn_all END, 6) AS cn,
{", ".join(f"round({c}, 6) AS {c}" for c in _ROUNDED[1:])} FROM est""")
def positional_estimate(spark, d):
    return _positional(spark, d).select("sample", "class", "cn_basis", "n_all", "n_anchor", *(six(c).alias(c) for c in _ROUNDED))


@query(f"""WITH {_BINS}, n AS (SELECT item_id AS class, 'left' AS feature, 15 AS s, 118 AS e FROM benchmark UNION ALL SELECT item_id, 'right', 97, 263 FROM benchmark),
i AS (SELECT DISTINCT class, feature, unnest(range((s + {WIDTH - 1}) // {WIDTH}, e // {WIDTH})) AS bin FROM n)
SELECT sample, class, feature, CAST(coalesce(sum(obs) FILTER (usable), 0) AS BIGINT) AS n, round(CASE WHEN sum(exp) FILTER (usable) > 0 THEN 2 * sum(obs) FILTER (usable) / sum(exp) FILTER (usable) END, 6) AS cn, round(avg(gc), 6) AS gc FROM bins JOIN i USING (class, bin) GROUP BY ALL""")
def feature_copies(spark, d):
    n = table(spark, d, "benchmark").select(F.col("item_id").alias("class"), F.expr("inline(array(struct('left' as feature, 15 as start, 118 as end), struct('right' as feature, 97 as start, 263 as end)))"))
    return E.features(_strand_bins(spark, d), n, WIDTH).select("sample", "class", "feature", "n", six("cn").alias("cn"), six("gc").alias("gc"))


_READS = "reads AS (SELECT l_linenumber % 3 AS sample, l_suppkey % 7 AS class, CAST(l_quantity AS BIGINT) + 20 AS gc, count(*) AS n FROM lineitem GROUP BY ALL)"


def _compositional(spark, d) -> DataFrame:
    r = table(spark, d, "lineitem").groupBy((F.col("l_linenumber") % 3).alias("sample"), (F.col("l_suppkey") % 7).alias("class"), (F.col("l_quantity").cast("long") + 20).alias("gc")).agg(F.count(F.lit(1)).alias("n"))
    return E.compositional(r, curve(spark))


_MASS = f"{_CURVE}, {_READS}, mass AS (SELECT sample, class, sum(n / rate) / (sum(n) FILTER (rate IS NOT NULL) / sum(n)) AS mass_bp, sum(n) FILTER (rate IS NOT NULL) / sum(n) AS gc_supported_fraction, sum(n * gc) / sum(n) / 100 AS mean_read_gc FROM reads JOIN curve USING (sample, gc) GROUP BY ALL)"


@query(f"WITH {_MASS} SELECT sample, class, round(mass_bp, 3) AS mass_bp, round(gc_supported_fraction, 6) AS gc_supported_fraction, round(mean_read_gc, 6) AS mean_read_gc FROM mass")
def compositional_estimate(spark, d):
    return _compositional(spark, d).select("sample", "class", F.round("mass_bp", 3).alias("mass_bp"), six("gc_supported_fraction").alias("gc_supported_fraction"), six("mean_read_gc").alias("mean_read_gc"))


#: Suppliers are control regions, nations chromosomes; some of either depart. Counts are cut a little above whole numbers, where sums in either order agree.
_OFF = "(1 + 0.02 * (s_suppkey % 5 - 2)) * CASE WHEN s_suppkey % 17 = 3 THEN 1.7 ELSE 1 END * CASE WHEN s_nationkey % 9 = 4 THEN 1.25 ELSE 1 END"
_TABLES = "tables AS (SELECT l_suppkey AS region, CAST(l_quantity AS BIGINT) + 20 AS gc, count(*) * 400 AS n FROM lineitem GROUP BY ALL)"
_REGION = f"""{_CURVE}, {_TABLES}, plain AS (SELECT sample, region, sum(n * rate) AS s, sum(n) FILTER (rate IS NOT NULL) AS k, sum(n) AS t FROM tables JOIN curve USING (gc) GROUP BY ALL),
regions AS (SELECT sample, region, concat('chr', s_nationkey) AS chrom, CAST(t / 2 + region % 3 AS DOUBLE) AS len, CAST(floor(s * {_OFF} + 0.31234567) AS BIGINT) AS obs FROM plain JOIN supplier ON region = s_suppkey),
x AS (SELECT regions.*, s / (k / t) * 2 * len / t AS exp FROM regions JOIN plain USING (sample, region))"""


def _regions(spark, d) -> DataFrame:
    t = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("region"), (F.col("l_quantity").cast("long") + 20).alias("gc")).agg((F.count(F.lit(1)) * 400).alias("n"))
    plain = t.join(curve(spark), "gc").groupBy("sample", "region").agg(F.sum(F.col("n") * F.col("rate")).alias("s"), F.sum("n").alias("t"))
    r = plain.join(table(spark, d, "supplier"), F.col("region") == F.col("s_suppkey"))
    r = r.select("sample", "region", F.concat(F.lit("chr"), "s_nationkey").alias("chrom"), (F.col("t") / 2 + F.col("region") % 3).alias("len"), F.floor(F.col("s") * F.expr(_OFF) + 0.31234567).alias("obs"))
    return E.region_expected(r, t, curve(spark))


@query(f"WITH {_REGION} SELECT sample, region, obs, round(exp, 4) AS exp FROM x")
def region_expected(spark, d):
    return _regions(spark, d).select("sample", "region", "obs", F.round("exp", 4).alias("exp"))


def _departs(k: int) -> str:
    """The chromosomes flagged in one more round."""
    return f"""t{k} AS (SELECT sample, ln(sum(ko) / sum(ke)) AS tot FROM c WHERE (sample, chrom) NOT IN (SELECT (sample, chrom) FROM f{k}) GROUP BY sample),
f{k + 1} AS (SELECT c.sample, chrom FROM c JOIN t{k} USING (sample) WHERE n >= 3 AND abs(ln(o / e) - tot) > 0.04 AND abs(ln(o / e) - tot) > 5 * sqrt(phi / e))"""


@query(f"""WITH {_REGION}, l AS (SELECT *, ln(obs / exp) AS lr, 1 / sqrt(greatest(exp, 1)) AS se FROM x), m AS (SELECT sample, quantile_cont(lr, 0.5) AS mid, quantile_cont(se, 0.5) AS error FROM l GROUP BY sample),
h AS (SELECT sample, greatest(1, power(1.4826 * quantile_cont(abs(lr - mid), 0.5) / first(error), 2)) AS phi FROM l JOIN m USING (sample) GROUP BY sample),
o AS (SELECT sample, chrom, quantile_cont(lr, 0.5) AS own FROM l GROUP BY ALL),
y AS (SELECT l.*, phi, NOT (abs(lr - mid) > 0.3 AND abs(lr - mid) > 5 * sqrt(phi) * se) AS keep, NOT (abs(lr - own) > 0.3 AND abs(lr - own) > 5 * sqrt(phi) * se) AS mine FROM l JOIN m USING (sample) JOIN h USING (sample) JOIN o USING (sample, chrom)),
c AS (SELECT sample, chrom, count(*) FILTER (mine) AS n, coalesce(sum(obs) FILTER (mine), 0) AS o, coalesce(sum(exp) FILTER (mine), 0) AS e, coalesce(sum(obs) FILTER (keep), 0) AS ko, coalesce(sum(exp) FILTER (keep), 0) AS ke, count(*) FILTER (keep) AS kn, sum(obs) AS ao, sum(exp) AS ae, count(*) AS an, first(phi) AS phi FROM y GROUP BY ALL),
f0 AS (SELECT sample, chrom FROM c WHERE false), {", ".join(_departs(k) for k in range(5))},
z AS (SELECT c.*, (sample, chrom) IN (SELECT (sample, chrom) FROM f5) AS bad FROM c),
r AS (SELECT y.sample, lr FROM y WHERE keep AND (sample, chrom) NOT IN (SELECT (sample, chrom) FROM f5)), rm AS (SELECT sample, quantile_cont(lr, 0.5) AS mid FROM r GROUP BY sample), rs AS (SELECT sample, 1.4826 * quantile_cont(abs(lr - mid), 0.5) AS sd FROM r JOIN rm USING (sample) GROUP BY sample)
SELECT z.sample, round((sum(ko) FILTER (NOT bad) / sum(ke) FILTER (NOT bad)) / (sum(ao) / sum(ae)), 6) AS rescale, CAST(sum(an) AS BIGINT) AS n_regions, CAST(sum(an) - coalesce(sum(kn) FILTER (NOT bad), 0) AS BIGINT) AS n_flagged_regions,
coalesce(string_agg(chrom, ',' ORDER BY CAST(chrom[4:] AS INT)) FILTER (bad), '') AS flagged, coalesce(string_agg(chrom, ',' ORDER BY CAST(chrom[4:] AS INT)) FILTER (n < 3), '') AS untestable, round(first(sd), 6) AS region_log_sd FROM z LEFT JOIN rs ON z.sample = rs.sample GROUP BY z.sample""")
def control_qc(spark, d):
    q = E.control_qc(_regions(spark, d))
    return q.select("sample", six("rescale").alias("rescale"), "n_regions", "n_flagged_regions", F.array_join("flagged", ",").alias("flagged"), F.array_join("untestable", ",").alias("untestable"), six("region_log_sd").alias("region_log_sd"))


_STATUS = """cls AS (SELECT DISTINCT l_linenumber % 3 AS sample, l_partkey % 40 AS class FROM lineitem),
st AS (SELECT sample, class, CASE WHEN class % 11 = 0 AND sample = 1 THEN 'no_sinks_in_fetch' WHEN class % 7 = sample THEN 'panel_mismatch' WHEN class % 13 = 2 THEN 'subset_only' WHEN class % 5 = 4 THEN 'experimental' ELSE 'ok' END AS status FROM cls)"""


@query(f"""WITH {_ESTIMATE}, {_STATUS}, {_READS}, mass AS (SELECT sample, class, sum(n / rate) / (sum(n) FILTER (rate IS NOT NULL) / sum(n)) AS mass_bp FROM reads JOIN curve USING (sample, gc) GROUP BY ALL)
SELECT st.sample, st.class, status, CASE WHEN status = 'experimental' AND cn_basis IS NOT NULL THEN 'all' WHEN status IN ('ok', 'experimental') THEN cn_basis END AS cn_basis,
round(CASE WHEN status = 'ok' AND cn_basis = 'anchor' THEN cn_anchor WHEN status IN ('ok', 'experimental') THEN cn_all END, 6) AS cn, round(CASE WHEN status = 'ok' THEN cn_anchor END, 6) AS cn_anchor, CAST(CASE WHEN status IN ('ok', 'experimental') THEN n_all END AS DOUBLE) AS n_all,
round(CASE WHEN status IN ('ok', 'experimental') THEN mass_bp END, 3) AS mass_bp FROM st LEFT JOIN est ON st.sample = est.sample AND st.class = est.class LEFT JOIN mass ON st.sample = mass.sample AND st.class = mass.class""")
def sample_estimates(spark, d):
    c = table(spark, d, "lineitem").select((F.col("l_linenumber") % 3).alias("sample"), (F.col("l_partkey") % 40).alias("class")).distinct()
    found = {"no_sinks_in_fetch": c.where("class % 11 = 0 and sample = 1"), "panel_mismatch": c.where("class % 7 = sample"), "subset_only": c.where("class % 13 = 2")}
    got = E.estimate(E.class_status(c, found, c.where("class % 5 = 4").select("class")), _positional(spark, d), _compositional(spark, d))
    return got.select("sample", "class", "status", "cn_basis", six("cn").alias("cn"), six("cn_anchor").alias("cn_anchor"), F.col("n_all").cast("double").alias("n_all"), F.round("mass_bp", 3).alias("mass_bp"))


@query("""WITH p AS (SELECT user_id % 5 AS sample, event_type AS class, user_id % 3 AS contig, CAST(floor(value) AS BIGINT) // 10 * 10 AS s, count(*) AS reads FROM events GROUP BY ALL),
o AS (SELECT event_type AS class, concat(event_type, '-', c) AS option, c AS contig, 45 + 30 * c AS s, 174 + 65 * c AS e FROM (SELECT DISTINCT event_type FROM events), range(2) r(c)),
w AS (SELECT DISTINCT user_id % 5 AS sample, event_type AS class FROM events), n AS (SELECT sample, option, sum(reads) AS reads FROM p JOIN o ON p.class = o.class AND p.contig = o.contig AND p.s >= o.s AND least(p.s + 10, 174 + 60 * p.contig) <= o.e GROUP BY ALL)
SELECT w.sample, o.option, w.class, CAST(coalesce(reads, 0) AS BIGINT) AS reads, round(coalesce(reads, 0) * (0.5 + w.sample), 6) AS mass FROM w JOIN o ON w.class = o.class LEFT JOIN n ON n.sample = w.sample AND n.option = o.option""")
def sub_options(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("sample"), F.col("event_type").alias("class"), (F.col("user_id") % 3).alias("contig"), (F.floor(F.floor("value") / 10) * 10).alias("start"))
    o = e.select("class").distinct().select("class", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("contig"))
    o = o.select("class", F.concat_ws("-", "class", "contig").alias("option"), "contig", (45 + 30 * F.col("contig")).alias("start"), (174 + 65 * F.col("contig")).alias("end"))
    worth = e.select("sample", "class").distinct().withColumn("worth", 0.5 + F.col("sample"))
    got = E.sub_options(e.groupBy("sample", "class", "contig", "start").agg(F.count(F.lit(1)).alias("reads")), o, worth, 10, e.select("contig").distinct().select("contig", (174 + 60 * F.col("contig")).alias("length")))
    return got.withColumn("mass", six("mass"))


@query("""WITH l AS (SELECT c_nationkey % 5 AS class, ln(10 + c_acctbal / 4000) AS level FROM customer), m AS (SELECT class, quantile_cont(exp(level), 0.5) AS mid FROM l GROUP BY class),
k AS (SELECT class, exp(level) AS cn FROM l JOIN m USING (class) WHERE abs(exp(level) - mid) < 0.5 * mid / 10) SELECT class, round(ln(quantile_cont(cn, 0.5) / 10), 4) AS delta, round(quantile_cont(cn, 0.5), 4) AS mode, count(*) AS n FROM k GROUP BY class""")
def mode_pin(spark, d):
    c = table(spark, d, "customer").select((F.col("c_nationkey") % 5).alias("class"), F.log(10 + F.col("c_acctbal") / 4000).alias("level"))
    return models.mode_pin(c, ["class"], 10.0).select("class", F.round("delta", 4).alias("delta"), F.round("mode", 4).alias("mode"), "n")


@query("""WITH t AS (SELECT conv_id, turn, length(text) // 150 AS state FROM conversations), f AS (SELECT *, CASE WHEN state IS NOT DISTINCT FROM lag(state) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS nw FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(nw) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM f), s AS (SELECT conv_id, state, min(turn) AS a, max(turn) AS b, max(turn) - min(turn) + 1 AS size FROM g GROUP BY conv_id, run, state),
x AS (SELECT conv_id, max(size) AS mx, min(a) AS lo, max(b) AS hi FROM s GROUP BY conv_id), h AS (SELECT s.conv_id, state, sum(size) AS held FROM s JOIN x USING (conv_id) WHERE size >= 2 OR (mx < 2 AND size = mx) GROUP BY ALL),
c AS (SELECT conv_id, state AS copies FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY held DESC, state) AS r FROM h) WHERE r = 1),
d AS (SELECT s.*, copies, state - copies AS delta, lo, hi FROM s JOIN c USING (conv_id) JOIN x USING (conv_id)), n AS (SELECT *, CASE WHEN delta IS NOT DISTINCT FROM lag(delta) OVER (PARTITION BY conv_id ORDER BY a) THEN 0 ELSE 1 END AS nw FROM d),
r AS (SELECT *, sum(nw) OVER (PARTITION BY conv_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM n),
e AS (SELECT conv_id, copies, delta, min(a) AS first, max(b) AS last, sum(size) AS n, bool_or(a = lo OR b = hi) AS at_end FROM r WHERE delta <> 0 GROUP BY conv_id, copies, delta, run)
SELECT conv_id, copies, first, last, delta, CASE WHEN n >= 2 AND at_end THEN 'partial ' || CASE WHEN delta > 0 THEN 'copy' ELSE 'loss' END WHEN delta > 0 THEN 'gain' ELSE 'loss' END AS kind FROM e""")
def segment_events(spark, d):
    x = table(spark, d, "conversations").select("conv_id", "turn", F.floor(F.length("text") / 150).alias("state"))
    return models.events(cohort.runs(x, ["conv_id"], "turn", "state"), ["conv_id"], 2)


@query()
def heredity_resampled(spark, d):
    """The slope of customers on those before them, with its spread over resampled families of ten, and the chance of its correlation."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("y"))
    at = c.join(c.select((F.col("k") + 1).alias("k"), F.col("y").alias("x")), "k").withColumn("family", F.floor(F.col("k") / 10))
    return cohort.family_bootstrap(at, "x", "y", "family").crossJoin(heredity.permutation_p(at, "x", "y", 99))  # one row each
