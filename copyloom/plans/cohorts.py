"""Queries of components, adjustment, heredity, karyotypes, fractions and the cohort layer over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.operators import assembly, cohort, cohort_table, components, contracts, documents, fractions, heredity, intervals, karyotype, tallies
from copyloom.plans.more import _READS, _reads
from copyloom.queries import _BANDS, _MERGE, _bands, query, six, table
from copyloom.session import kept

_CELLS = "cells AS (SELECT l_suppkey % 40 AS r, l_partkey % 60 AS c, avg(ln(l_extendedprice)) AS v FROM lineitem GROUP BY ALL)"


def _cells(spark, d) -> DataFrame:
    at = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("sample"), (F.col("l_partkey") % 60).alias("region"))
    return at.agg(F.avg(F.log("l_extendedprice")).alias("log_ratio"))


@query(f"""WITH {_CELLS}, a AS (SELECT r, c, v - quantile_cont(v, 0.5) OVER (PARTITION BY r) AS x FROM cells), b AS (SELECT r, c, x - quantile_cont(x, 0.5) OVER (PARTITION BY c) AS x FROM a)
SELECT r AS sample, c AS region, round(greatest(-0.5, least(0.5, x)), 6) AS x FROM b""")
def centred_cells(spark, d):
    return components.centred_cells(_cells(spark, d), "sample", "region", "log_ratio").withColumn("x", six("x"))


def _vectors(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), F.posexplode("embedding").alias("region", "log_ratio"))
    return e.where("log_ratio is not null")


@query()
def control_components(spark, d):
    """Scores of all vectors on the ten leading components of their matrix, whose cells are their axes."""
    scores, values = components.control_components(_vectors(spark, d), 10)
    return scores.join(values, "component").select("sample", "component", F.round("score", 6).alias("score"), F.round("value", 6).alias("value"), F.round("share", 8).alias("share"))


@query()
def components_above_noise(spark, d):
    """How many components of the matrices of lines (suppliers by parts) and of vectors (by axes) stand above noise."""
    found = []
    for name, cells in (("lines", _cells(spark, d)), ("vectors", _vectors(spark, d))):
        n, p = (cells.select(c).distinct().count() for c in ("sample", "region"))
        found.append(components.control_components(cells, 1)[1].select(F.lit(name).alias("matrix"), "value", F.lit(n).alias("n"), F.lit(p).alias("p")))
    return components.noise_edge(found[0].unionByName(found[1]), ["matrix"])


@query("""WITH s AS (SELECT DISTINCT count(*) AS n, 100 + count(*) * (1 + c_nationkey % 3) AS p FROM customer GROUP BY c_nationkey), q AS (SELECT n, p, prob / 10 AS prob FROM s, (SELECT unnest(range(1, 10))::DOUBLE AS prob)),
t AS (SELECT n, p, cell, least(n, p) / greatest(n, p)::DOUBLE AS g, (cell + 0.5) * pi() / 4096 AS t FROM s, range(4096) r(cell)), d AS (SELECT *, sin(t) * sin(t) / (1 + g - 2 * sqrt(g) * cos(t)) AS d FROM t),
c AS (SELECT *, d / sum(d) OVER (PARTITION BY n, p) AS share, sum(d) OVER (PARTITION BY n, p ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(d) OVER (PARTITION BY n, p) AS hi FROM d)
SELECT n, p, round(prob, 1) AS prob, round(sqrt((1 + g - 2 * sqrt(g) * cos((cell + (prob - (hi - share)) / share) * pi() / 4096)) * greatest(n, p)), 6) AS value FROM q JOIN c USING (n, p) WHERE prob > hi - share AND prob <= hi""")
def noise_quantiles(spark, d):
    s = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).select("n", (100 + F.col("n") * (1 + F.col("c_nationkey") % 3)).alias("p")).distinct()
    q = s.withColumn("prob", F.explode(F.array(*(F.lit(k / 10) for k in range(1, 10)))))
    return components.noise_quantiles(q).select("n", "p", F.round("prob", 1).alias("prob"), six("value").alias("value"))


_ADJUSTED = """rows AS (SELECT c_custkey AS k, c_mktsegment AS col, c_acctbal AS y, c_nationkey::DOUBLE AS x, c_custkey % 5 AS f FROM customer),
fit AS (SELECT f, col, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM (SELECT r.*, t.f AS of FROM rows r JOIN (SELECT DISTINCT f FROM rows) t ON r.f != t.f) z(k, col, y, x, own, f) GROUP BY ALL),
m AS (SELECT col, avg(y) AS m FROM rows GROUP BY col), adj AS (SELECT k, col, 0 AS n, y AS v FROM rows UNION ALL SELECT k, rows.col, 1, y - a - b * x + m FROM rows JOIN fit USING (f, col) JOIN m ON m.col = rows.col)"""


def _adjusted(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    rows = c.select(F.col("c_custkey").alias("sample"), F.col("c_mktsegment").alias("column"), F.col("c_acctbal").cast("double").alias("y"), F.array(F.col("c_nationkey").cast("double")).alias("covariates"))
    return components.cross_validated(rows, 5, fold=F.col("sample") % 5)


@query(f"WITH {_ADJUSTED} SELECT k AS sample, col AS column, n AS k, round(v, 4) AS adjusted FROM adj")
def cross_validated(spark, d):
    return _adjusted(spark, d).withColumn("adjusted", F.round("adjusted", 4))


@query(f"""WITH {_ADJUSTED}, mid AS (SELECT col, n, quantile_cont(v, 0.5) AS q FROM adj GROUP BY ALL), s AS (SELECT adj.col, adj.n, count(*) AS k, 1.4826 * quantile_cont(abs(v - q), 0.5) AS e FROM adj JOIN mid ON adj.col = mid.col AND adj.n = mid.n GROUP BY ALL),
b AS (SELECT col, arg_min(n, e) AS best, min(e) AS at_best, min(e) * 1.65 / sqrt(2 * arg_min(k, e)) AS se, max(e) FILTER (n = 0) AS at_0 FROM s GROUP BY col)
SELECT col AS column, best, min(n) AS pick, round(at_0, 4) AS at_0, round(arg_min(e, n), 4) AS at_pick, round(at_best, 4) AS at_best, round(se, 4) AS se FROM s JOIN b USING (col) WHERE e <= at_best + se GROUP BY col, best, at_0, at_best, se""")
def components_recommended(spark, d):
    got = components.recommended(components.sweep(_adjusted(spark, d)).select("column", "k", F.col("sd_robust").alias("error"), "n"))
    return got.select("column", "best", "pick", *(F.round(c, 4).alias(c) for c in ("at_0", "at_pick", "at_best", "se")))


_TRIOS = "t AS (SELECT c.c_custkey % 3 AS g, c.c_custkey // 10 AS family, c.c_custkey % 2 AS sex, c.c_acctbal AS c, f.c_acctbal AS f, m.c_acctbal AS m FROM customer c JOIN customer f ON f.c_custkey = c.c_custkey + 1 JOIN customer m ON m.c_custkey = c.c_custkey + 2)"


def _trios(spark, d, value=None) -> DataFrame:
    c = table(spark, d, "customer")
    links = c.select(F.col("c_custkey").alias("child"), (F.col("c_custkey") + 1).alias("father"), (F.col("c_custkey") + 2).alias("mother"))
    people = c.select(F.col("c_custkey").alias("person"), (F.col("c_acctbal") if value is None else value).alias("v"))
    return cohort.trios(people, links, "v").withColumn("g", F.col("child") % 3).withColumn("family", F.floor(F.col("child") / 10)).withColumn("son", F.col("child") % 2 == 1)


@query(f"""WITH {_TRIOS}, p AS (SELECT g, f AS v FROM t UNION ALL SELECT g, m FROM t), v AS (SELECT g, var_samp(v) AS v, avg(v) AS pm FROM p GROUP BY g),
e AS (SELECT g, count(*) AS n, corr(f, m) AS rho, regr_slope(c, (f + m) / 2) AS b, regr_slope(c, f) AS bf, regr_slope(c, m) AS bm, corr(c, (f + m) / 2) AS r, var_samp(c - (f + m) / 2) AS d, stddev_samp(c) AS sc, avg(c) AS mc FROM t GROUP BY g)
SELECT g, n, round(rho, 6) AS spousal_r, round(b, 6) AS slope_mid, round(bf, 6) AS slope_father, round(bm, 6) AS slope_mother, round(r, 6) AS r_mid, round(b - rho * (1 - b), 6) AS reliability_mid, round(bf + bm - rho, 6) AS reliability_single,
round(1.5 - d / v, 6) AS reliability_mendel, round(sc / sqrt(v), 6) AS sd_ratio, round(b / (sc / sqrt(v)) * (1 + rho) - rho, 6) AS reliability_rescaled, round(mc / pm, 6) AS mean_ratio FROM e JOIN v USING (g)""")
def reliabilities(spark, d):
    return heredity.reliabilities(_trios(spark, d), ["g"]).select("g", "n", *(six(c).alias(c) for c in heredity.MEASURES))


@query()
def reliability_intervals(spark, d):
    """Intervals of all measures of the customers' trios over resampled families, and of the difference of balances from their logs."""
    at = _trios(spark, d)
    both = at.join(_trios(spark, d, F.log(F.col("c_acctbal") + 2000)).select("child", *(F.col(f"{w}_value").alias(f"{w}_b") for w in ("child", "father", "mother"))), "child")
    both = both.withColumnsRenamed({f"{w}_value": f"{w}_a" for w in ("child", "father", "mother")})
    got = heredity.intervals_of(at, times=200).select("measure", "low", "high")
    return got.unionByName(heredity.compared(both, times=200).select(F.lit("delta").alias("measure"), "low", "high"))


@query()
def heredity_permuted(spark, d):
    """Chances of the slope of customers on those beside them, dealt within thirds, and of a difference between pairings by sex."""
    at = _trios(spark, d)
    return heredity.permuted_slope(at, ["g"], 99).crossJoin(heredity.heterogeneity(at, 99).select("q", F.col("p").alias("p_sex"), "p_normal"))  # one row each


_CHROMOSOMES = [*karyotype.AUTOSOMES, "chrX"]


@query()
def karyotypes(spark, d):
    """Karyotypes of two dozen groups of parcels: a place's log ratio is that of what they hold of its parts to what all do. A model of the cohort reads the cohort itself."""
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    chrom = F.element_at(F.array(*map(F.lit, _CHROMOSOMES)), (F.col("l_partkey") % len(_CHROMOSOMES) + 1).cast("int"))
    at = (F.col("l_suppkey") % 8) * 400_000 + 1000
    cells = x.groupBy((F.col("o_custkey") % 24).cast("string").alias("sample"), F.format_string("%s:%d-%d", chrom, at, at + 10_000).alias("region")).agg(F.sum("l_quantity").alias("q"))
    cells = kept(cells, "sums")
    total = cells.groupBy("region").agg(F.sum("q").alias("all"))
    cells = kept(cells.join(total, "region").select("sample", "region", F.log(24 * F.col("q") / F.col("all")).alias("log_ratio")), "cells")  # the model reads them many times
    arms = spark.createDataFrame([(c, 1_700_000) for c in _CHROMOSOMES], "chrom string, border long")
    regions = karyotype.layout(cells.select("region"), arms)
    gc = spark.createDataFrame([(c, 0.36 + 0.005 * k) for k, c in enumerate(karyotype.AUTOSOMES)], "chrom string, gc double")
    got = karyotype.read(cells, karyotype.fit(cells, regions, gc, rounds=1, reads=1), rounds=2)
    return got.chromosomes.select("sample", "chrom", *(F.round(c, 4).alias(c) for c in ("copies", "se", "mean", "z")), "whole", "status", "places")


def _profiles(spark, d) -> DataFrame:
    x = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 60).alias("sample"), (F.col("l_partkey") % 120).alias("window")).agg((F.avg("l_quantity") / 2.55).alias("value"))
    return x.withColumn("state", F.lit(10).cast("long"))


@query()
def fraction_levels(spark, d):
    """How far the mean quantities of sixty groups of suppliers, over windows of parts, lie from ten, against one another."""
    x = _profiles(spark, d)
    sigma = x.groupBy("sample").agg(F.stddev_samp("value").alias("sigma"))
    calls = sigma.select("sample", F.lit(10).cast("long").alias("copies"), F.lit(False).alias("uncertain"), "sigma", F.lit(1.0).alias("scale"), F.lit(0.0).alias("tilt"))
    windows = x.select("window").distinct().select("window", (F.col("window") / 119 - 0.5).alias("place"), F.lit(1.0).alias("rel"), (F.col("window") % 7 / 20).alias("gc"))
    levels, steps = fractions.find(x, calls, windows, apart=20, every=5)
    status = fractions.statuses(levels, steps, calls)
    return levels.join(status, "sample").select("sample", "status", *(F.round(c, 5).alias(c) for c in ("ratio", "off", "off_z", "spread")))


_RATIOS = "r AS (SELECT l_suppkey % 5 AS k, 0.8 + (l_partkey % 45) / 100 AS ratio, 9 + (l_suppkey % 3) + (l_linenumber - 4) / 20 AS level, count(*) AS n FROM lineitem GROUP BY ALL)"


@query(f"""WITH {_RATIOS}, u AS (SELECT k, ratio, round(level) AS w FROM r WHERE abs(level - round(level)) < 0.25 AND round(level) > 0), o AS (SELECT i, -0.03 + i * 0.0025 AS o FROM range(93) t(i)),
g AS (SELECT k, i, o, w, ratio * w * exp(-o) AS h FROM u, o), c AS (SELECT k, i, o, avg(pow(least(abs(h - round(h)), 0.5), 2)) AS cost, avg((round(h) > w)::INT) AS above, count(*) AS n FROM g GROUP BY ALL),
l AS (SELECT *, cost <= coalesce(lag(cost) OVER w, 'inf') AND cost < coalesce(lead(cost) OVER w, 'inf') AND above <= 0.15 AS good FROM c WINDOW w AS (PARTITION BY k ORDER BY i))
SELECT k, round(CASE WHEN max(n) >= 20 THEN coalesce(min(o) FILTER (good), arg_min(o, cost)) ELSE 0 END, 6) AS "offset", max(n) AS n FROM l GROUP BY k""")
def comb_offsets(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("k"), (0.8 + (F.col("l_partkey") % 45) / 100).alias("ratio"), (9 + F.col("l_suppkey") % 3 + (F.col("l_linenumber") - 4) / 20).alias("level"))
    return cohort_table.comb(x.distinct(), ["k"]).withColumn("offset", six("offset"))


@query()
def cohort_layer(spark, d):
    """The whole cohort layer: two classes of parts over eighty groups of suppliers, with rules, and control regions by part."""
    x = table(spark, d, "lineitem")
    name = F.format_string("class%d", F.col("l_partkey") % 2)
    at = x.groupBy((F.col("l_suppkey") % 80).alias("sample"), name.alias("class"), (F.col("l_partkey") % 40 * 100).cast("long").alias("start")).agg((F.avg("l_quantity") / 2.55).alias("cn"))
    slots = at.select("class", "start").distinct().withColumn("gc", 0.35 + F.col("start") % 3000 / 10000)
    every = at.select("sample").distinct().join(F.broadcast(slots), F.lit(True))  # windows of the classes
    windows = every.join(at, ["sample", "class", "start"], "left").withColumn("end", F.col("start") + 100)
    controls = x.groupBy((F.col("l_suppkey") % 80).alias("sample"), F.format_string("r%d", F.col("l_partkey") % 50).alias("region")).agg(F.log(F.avg("l_extendedprice")).alias("log_ratio"))
    anchors = slots.select("class").distinct().select("class", F.lit(0).cast("long").alias("start"), F.lit(3000).cast("long").alias("end"))
    rules = {"class0": cohort_table.Rule(excluded=[(3500, 3800)], expected=10.0, polymorphic=[("end", 3500, 3800, 0.02, 0.15)])}
    got = cohort_table.cohort_table(windows, controls, anchors, rules)
    return got.values.select("sample", "column", F.round("value", 5).alias("value"))


_ANNOTATED = """a AS (SELECT user_id % 4 AS sample, user_id % 2 AS haplotype, event_type AS contig, CAST(floor(value * 40) AS BIGINT) AS s, CAST(floor(value * 40) AS BIGINT) + 20 + event_id % 7 * 10 AS e, event_id % 9 AS k FROM events),
b AS (SELECT *, row_number() OVER () AS id, CASE WHEN k < 2 THEN 'HSat2' WHEN k = 2 THEN 'HSat3' WHEN k = 3 THEN 'ACRO' WHEN k = 6 THEN 'SST1' END AS class, k IN (5, 6) AS gap, k = 5 AS alone, k IN (4, 8) AS rdna FROM a)"""


def _annotation(spark, d) -> DataFrame:
    kinds = ["HSat2", "HSat2", "HSat3", "cenSat(ACRO1,COMP)", "rDNA", "GAP", "GAP,SST1x", "ct", "rDNA"]
    e = table(spark, d, "events")
    start = F.floor(F.col("value") * 40)
    parts = F.split(F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 9 + 1).cast("int")), r",(?![^(]*\))")
    return e.select((F.col("user_id") % 4).alias("sample"), (F.col("user_id") % 2).alias("haplotype"), F.col("event_type").alias("contig"), start.alias("start"), (start + 20 + F.col("event_id") % 7 * 10).alias("end"), parts.alias("parts"))


@query(f"""WITH {_ANNOTATED}, near AS (SELECT DISTINCT g.id, g.sample, g.e - g.s AS size, b.class FROM b g JOIN b ON g.alone AND NOT b.alone AND b.class IS NOT NULL AND b.sample = g.sample AND b.haplotype = g.haplotype AND b.contig = g.contig AND b.s <= g.e AND b.e >= g.s),
n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM near), u AS (SELECT sample, class, sum((e - s) * (NOT gap)::INT) AS mass, sum((e - s) * gap::INT)::DOUBLE AS gapped, 0 AS unsized FROM b WHERE class IS NOT NULL GROUP BY ALL
UNION ALL SELECT sample, class, 0, sum(size / n), count(*) FILTER (size = 100) FROM n GROUP BY ALL) SELECT sample, class, sum(mass)::BIGINT AS mass, round(sum(gapped), 4) AS gapped, sum(unsized)::BIGINT AS unsized FROM u GROUP BY ALL""")
def assembly_mass(spark, d):
    return assembly.mass(_annotation(spark, d)).withColumn("gapped", F.round("gapped", 4))


@query(f"""WITH {_ANNOTATED}, p AS (SELECT *, count(*) FILTER (gap) OVER (PARTITION BY sample, haplotype, contig ORDER BY s, e, gap ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM b WHERE gap OR rdna),
r AS (SELECT *, max(e) OVER (PARTITION BY sample, haplotype, contig, part ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p WHERE NOT gap),
n AS (SELECT *, sum((reach IS NULL OR s - reach >= 30)::INT) OVER (PARTITION BY sample, haplotype, contig, part ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, CASE WHEN reach IS NULL OR s - reach >= 30 THEN e - s ELSE greatest(0, e - greatest(s, reach)) END AS fresh FROM r),
t AS (SELECT sample, haplotype, sum(fresh) AS bases, max(e) - min(s) AS span FROM n GROUP BY sample, haplotype, contig, part, run)
SELECT sample, sum(bases)::BIGINT AS total, max(span) AS longest, count(DISTINCT haplotype) AS haplotypes FROM t GROUP BY sample""")
def assembly_stretches(spark, d):
    return assembly.longest(assembly.stretches(_annotation(spark, d), near=30))


@query(f"""WITH {_READS}, {_BANDS}, {_MERGE.format(name="m", gap=0)}, g AS (SELECT contig, s, e, concat(contig, ':', s) AS region, CASE s % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'test' ELSE 'dosage' END AS role FROM m)
SELECT region, pos - s AS "offset", flags & 16 <> 0 AS reverse, count(*) AS n FROM reads JOIN g ON reads.contig = g.contig AND s <= pos AND pos < e WHERE flags & 4 = 0 AND role <> 'dosage' GROUP BY ALL""")
def control_ends(spark, d):
    m = intervals.merge(_bands(spark, d), ["contig"]).drop("members")
    role = F.element_at(F.array(F.lit("control"), F.lit("test"), F.lit("dosage")), (F.col("start") % 3 + 1).cast("int"))
    return tallies.control_ends(_reads(spark, d), m.select(F.concat_ws(":", "contig", "start").alias("region"), role.alias("role"), "contig", "start", "end"), ["control", "test"], 64)


@query("""WITH s AS (SELECT DISTINCT l_linenumber % 3 AS sample, 'c' || l_partkey % 5 AS class FROM lineitem), g AS (SELECT sample, class, bin, reverse FROM s, range(20) b(bin), (VALUES (false), (true)) r(reverse)),
e AS (SELECT l_linenumber % 3 AS sample, 'c' || l_partkey % 5 AS class, l_suppkey % 20 AS bin, l_linestatus = 'O' AS reverse, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT g.sample::VARCHAR AS sample, g.class, g.bin, g.reverse, coalesce(n, 0) AS n FROM g LEFT JOIN e ON g.sample = e.sample AND g.class = e.class AND g.bin = e.bin AND g.reverse = e.reverse""")
def document_bins(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_linenumber") % 3).alias("sample"), F.format_string("c%d", F.col("l_partkey") % 5).alias("class"), (F.col("l_suppkey") % 20).alias("bin"), (F.col("l_linestatus") == "O").alias("reverse"), "l_partkey", "l_quantity")
    ends = x.groupBy("sample", "class", "bin", "reverse").agg(F.count(F.lit(1)).alias("n"))
    classes = x.groupBy("sample", "class").agg(F.count(F.lit(1)).alias("reads")).select("sample", "class", F.lit("positional").alias("kind"), F.lit(50).alias("bin"), F.lit(20).alias("bins"), "reads", F.lit(0).alias("dup_flagged"))
    samples = x.groupBy("sample").agg(F.count(F.lit(1)).alias("records")).select("sample", F.lit("scan").alias("mode"), "records", F.col("records").alias("primary"), F.lit(300).alias("insert_median"), F.lit(100).alias("read_length_mode"))
    gc = x.groupBy("sample", F.lit(300).alias("l"), F.col("l_quantity").cast("long").alias("gc")).agg(F.count(F.lit(1)).alias("n")).withColumn("o", F.col("n"))
    placements = x.groupBy("sample", "class", F.lit("c1").alias("contig"), (F.col("l_partkey") % 9 * 1000).alias("start")).agg(F.count(F.lit(1)).alias("reads"))
    return documents.end_bins(documents.assembled(samples, gc, classes, ends, placements))


@query("""WITH c AS (SELECT DISTINCT user_id % 30 AS sample, event_type AS class FROM events), f AS (SELECT DISTINCT user_id % 30 AS sample, 'h' || user_id % 30 % 7 AS sinks FROM events), b AS (SELECT DISTINCT 'h' || user_id % 5 AS sinks, CASE WHEN user_id % 5 = 4 THEN '' ELSE event_type END AS class FROM events WHERE (length(event_type) + user_id) % 5 <> 2)
SELECT c.sample, c.class FROM c JOIN f USING (sample) WHERE sinks IN (SELECT sinks FROM b WHERE class <> '') AND NOT EXISTS (SELECT 1 FROM b WHERE b.sinks = f.sinks AND b.class = c.class)""")
def missing_from_bed(spark, d):
    e = table(spark, d, "events")
    sample = F.col("user_id") % 30
    beds = e.where((F.length("event_type") + F.col("user_id")) % 5 != 2).select(F.format_string("h%d", F.col("user_id") % 5).alias("sinks"), F.when(F.col("user_id") % 5 == 4, "").otherwise(F.col("event_type")).alias("class"))
    return contracts.missing_from_bed(e.select(sample.alias("sample"), F.col("event_type").alias("class")), e.select(sample.alias("sample"), F.format_string("h%d", sample % 7).alias("sinks")).distinct(), beds)


@query("""WITH f AS (SELECT event_id AS sample, CASE WHEN event_id % 7 = 0 THEN NULL ELSE upper(event_type) END AS p, CASE WHEN event_id % 5 > 0 THEN 'h' || event_id % 3 END AS h, event_id % 2 AS n FROM events),
t AS (SELECT *, p IS NOT NULL AS told, h IS NOT NULL AND n = 1 AS same FROM f)
SELECT sample, CASE WHEN told OR same THEN CASE WHEN concat_ws('; ', CASE WHEN told AND NOT contains(lower(p), 'click') THEN 'aligned by ' || lower(p) || ', not click' END, CASE WHEN same AND h <> 'h0' THEN 'other reference' END) = '' THEN 'ok'
ELSE concat_ws('; ', CASE WHEN told AND NOT contains(lower(p), 'click') THEN 'aligned by ' || lower(p) || ', not click' END, CASE WHEN same AND h <> 'h0' THEN 'other reference' END) END END AS status FROM t""")
def pipeline_check(spark, d):
    e = table(spark, d, "events")
    f = e.select(F.col("event_id").alias("sample"), F.when(F.col("event_id") % 7 != 0, F.array(F.upper("event_type"))).alias("programs"), F.when(F.col("event_id") % 5 > 0, F.format_string("h%d", F.col("event_id") % 3)).alias("sq_sha256"), (F.col("event_id") % 2).alias("sq_n"))
    return contracts.pipeline_check(f, spark.createDataFrame([("click", "h0", 1)], "aligner string, sq_sha256 string, sq_n long"))
