"""URL filtering: a list of rules first, association rules mined from labelled URLs for the rest.

A URL has at most one token for each of its slots (scheme, labels of the host from the right, segments of the path with their digits levelled, keys of
the query, fragment); what exceeds the slots is one token of its own, so nothing of a URL is left out and no combination has more tokens than there
are slots. FP-growth mines the combinations that labelled URLs share; those of enough support that point to one label with enough confidence are
rules. An inverted index has each rule under its rarest token, and a rule meets a URL that holds that token and all its others.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom.llm.common import small, stored

#: Host, what the path starts with, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Share of labelled URLs, and number of them, that a combination with its label needs; share of a combination's URLs that bear the label.
SUPPORT, LEAST, CONFIDENCE = 0.002, 5, 0.8
#: The verdict on a URL that no rule meets.
OTHERWISE = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _found(url: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(url, rf"(?s)^(.*?)://{pattern}", 2), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(_found(url, "([^/?#]*)"), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return _found(url, "[^/?#]*([^?#]*)")


def tokens_of(url: Column) -> Column:
    """The tokens of a URL in the order of their slots; none without ://."""
    labels = F.filter(F.split(host_of(url), r"\."), lambda x: x != "")
    steps = F.filter(F.split(F.regexp_replace(path_of(url), "[0-9]+", "#"), "/"), lambda x: x != "")
    keys = F.array_sort(F.array_distinct(F.transform(F.split(_found(url, r"[^?#]*\?([^#]*)"), "&"), lambda x: F.substring_index(x, "=", 1))))
    n = F.size(labels)
    slots = {
        "s:": F.translate(F.regexp_extract(url, "(?s)^(.*?)://", 1), _UPPER, _LOWER),
        "h1:": F.try_element_at(labels, F.lit(-1)), "h2:": F.try_element_at(labels, F.lit(-2)), "h3:": F.try_element_at(labels, F.lit(-3)),
        "h4:": F.array_join(F.slice(labels, 1, F.greatest(n - 3, F.lit(0))), "."),
        "p1:": F.try_element_at(steps, F.lit(1)), "p2:": F.try_element_at(steps, F.lit(2)), "p3:": F.array_join(F.slice(steps, 3, F.greatest(F.size(steps) - 2, F.lit(0))), "/"),
        "q:": F.array_join(keys, ","), "f:": _found(url, "[^#]*(#)"),
    }
    return F.filter(F.array(*(F.when(value != "", F.concat(F.lit(name), value)) for name, value in slots.items())), lambda x: x.isNotNull())


def listed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(uid, rule, verdict) of the rows of urls (uid, host, path) that a rule (host, path, verdict) fits, the longest of those that do; of rules of
    one length the one with the longer host, and of equal rules the one whose verdict is first.

    The hosts and paths of rules have few different numbers of labels and of characters; a URL is joined by what it would be cut to for each.
    """
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    rules = stored(rules.select(F.concat("host", "path").alias("rule"), F.length("host").alias("width"), F.size(F.split("host", r"\.")).alias("depth"), F.length("path").alias("length"), "verdict"), "rules")
    cuts = rules.select("depth", "length").distinct().collect()  # lengths of names and paths, not rules
    labels = F.split("host", r"\.")
    cut = [F.when((F.size(labels) >= d) & (F.length("path") >= k), F.concat(F.array_join(F.slice(labels, -d, d), "."), F.substring("path", 1, k))) for d, k in cuts]
    at = urls.select("uid", F.explode(F.array_compact(F.array(*cut) if cut else F.array().cast("array<string>"))).alias("rule")).join(small(rules), "rule")
    best = at.groupBy("uid").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "width")).alias("b"))
    return best.select("uid", "b.rule", "b.verdict")


def mine(labelled: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE) -> DataFrame:
    """(tokens, verdict, hits, confidence) from (tokens, verdict): the combinations that at least `support` of all rows, and `least` of them, share
    with a verdict, which at least `confidence` of the combination's rows bear. One that a rule with a token fewer and no less confidence makes
    idle isn't returned."""
    n = labelled.count()
    schema = "tokens array<string>, verdict string, hits long, confidence double"
    if not n:
        return labelled.sparkSession.createDataFrame([], schema)
    bags = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, (least - 0.5) / n))).fit(bags).freqItemsets
    label = F.element_at(F.filter("items", lambda x: x.startswith("=")), 1)
    sets = stored(sets.where(F.col("freq") >= least).select(F.array_sort(F.filter("items", lambda x: ~x.startswith("="))).alias("tokens"), F.when(F.exists("items", lambda x: x.startswith("=")), label).alias("label"), "freq"), "itemsets")
    hits = sets.where("label is not null and size(tokens) > 0").select("tokens", F.expr("substr(label, 2)").alias("verdict"), F.col("freq").alias("hits"))
    rules = hits.join(sets.where("label is null").select("tokens", "freq"), "tokens")
    rules = stored(rules.select("tokens", "verdict", "hits", (F.col("hits") / F.col("freq")).alias("confidence")).where(F.col("confidence") >= confidence), "mined")
    shorter = rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("t")).select(F.array_remove("tokens", F.col("t")).alias("shorter"), "tokens", "verdict", "confidence")
    idle = shorter.join(rules.select(F.col("tokens").alias("shorter"), "verdict", F.col("confidence").alias("c")), ["shorter", "verdict"]).where("c >= confidence")
    return rules.join(idle.select("tokens", "verdict"), ["tokens", "verdict"], "left_anti").select("tokens", "verdict", "hits", "confidence")


def matched(bags: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, pattern, verdict, confidence) of the distinct arrays `tokens` that a mined rule meets: the rule of highest confidence, then most hits,
    then fewest tokens, then the first in order."""
    counts = bags.select(F.explode("tokens").alias("token")).groupBy("token").count()
    parts = rules.select(F.col("tokens").alias("need"), "verdict", "hits", "confidence", F.explode("tokens").alias("token")).join(counts, "token", "left")
    index = parts.groupBy("need", "verdict", "hits", "confidence").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    at = bags.select("tokens", F.explode("tokens").alias("token")).join(small(stored(index, "index")), "token").where("size(array_except(need, tokens)) = 0")
    best = at.groupBy("tokens").agg(F.min(F.struct(-F.col("confidence"), -F.col("hits"), F.size("need"), F.array_join("need", " ").alias("pattern"), "verdict", F.col("confidence").alias("c"))).alias("b"))
    return best.select("tokens", "b.pattern", "b.verdict", F.col("b.c").alias("confidence"))


def judged(pages: DataFrame, rules: DataFrame | None = None, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", **how) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern, confidence: a row per row of pages. `rule` is the listed rule that decides, or null; then
    `pattern` and `confidence` are of the mined rule that does, or null, and the verdict is "allow" where no rule meets the URL.

    rules: (host, path, verdict), RULES by default; one fits its host and all subdomains of it, if the path starts with its path. labels: (url, verdict)
    of the URLs to mine; by default the pages that a listed rule decides. A null URL, or one without ://, has an empty host and path and no
    tokens. Repeated rows are judged alike and count each when mined. An empty table gives an empty one; other columns are ignored.
    """
    spark = pages.sparkSession
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string") if rules is None else rules
    url = F.col(url_col).cast("string")
    urls = pages.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens"))
    urls = stored(urls, "urls")
    urls = stored(urls.join(listed(urls, rules), "uid", "left"), "listed")
    known = urls.where("rule is not null") if labels is None else labels.select(tokens_of(F.col("url")).alias("tokens"), "verdict").where("verdict is not null")
    mined = mine(known.select("tokens", "verdict"), **how)
    bags = stored(urls.where("rule is null and size(tokens) > 0").select("tokens").distinct(), "bags")
    told = stored(matched(bags, mined).select("tokens", F.lit(True).alias("open"), "pattern", F.col("verdict").alias("found"), "confidence"), "matched")
    out = urls.withColumn("open", F.isnull("rule")).join(small(told), ["tokens", "open"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "found", F.lit(OTHERWISE)).alias("verdict"), "pattern", "confidence")


ORACLE_SQL = r"""
WITH r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT row_number() OVER () AS id, page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
s AS (SELECT *, list_filter(string_split(host, '.'), lambda x: x != '') AS l, list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda x: x != '') AS p,
  array_to_string(list_sort(list_distinct(list_transform(string_split(coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), ''), '&'), lambda x: split_part(x, '=', 1)))), ',') AS q FROM u),
t AS (SELECT id, page_id, host, path, list_filter([CASE WHEN url LIKE '%://%' AND regexp_extract(url, '(?s)^(.*?)://', 1) != '' THEN 's:' || translate(regexp_extract(url, '(?s)^(.*?)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END,
  'h1:' || l[-1], 'h2:' || l[-2], 'h3:' || l[-3], CASE WHEN len(l) > 3 THEN 'h4:' || array_to_string(l[1:len(l) - 3], '.') END,
  'p1:' || p[1], 'p2:' || p[2], CASE WHEN len(p) > 2 THEN 'p3:' || array_to_string(p[3:], '/') END, CASE WHEN q != '' THEN 'q:' || q END,
  CASE WHEN regexp_matches(url, '(?s)^.*?://[^#]*#') THEN 'f:#' END], lambda x: x IS NOT NULL) AS tokens FROM s),
b AS (SELECT t.id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict FROM t JOIN r ON (t.host = r.host OR ends_with(t.host, '.' || r.host)) AND starts_with(t.path, r.path) GROUP BY t.id),
k AS (SELECT t.*, b.rule, b.verdict FROM t LEFT JOIN b USING (id)),
m AS (SELECT verdict, list_sort(list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1)) AS need FROM (SELECT verdict, tokens, unnest(range(1, 1 << len(tokens))) AS mask FROM k WHERE rule IS NOT NULL)),
f AS (SELECT need, count(*) AS freq FROM m GROUP BY need),
h AS (SELECT need, verdict, count(*) AS hits FROM m GROUP BY ALL HAVING count(*) >= ceil((SELECT greatest(0.002::DOUBLE * count(*), 4.5) FROM k WHERE rule IS NOT NULL))),
g AS (SELECT need, verdict, hits, hits / freq AS confidence, array_to_string(need, ' ') AS pattern FROM h JOIN f USING (need) WHERE hits / freq >= 0.8),
v AS (SELECT k.id, g.verdict, g.pattern, g.confidence, row_number() OVER (PARTITION BY k.id ORDER BY g.confidence DESC, g.hits DESC, len(g.need), g.pattern) AS place FROM k JOIN g ON list_has_all(k.tokens, g.need) WHERE k.rule IS NULL)
SELECT page_id, host, path, rule, coalesce(k.verdict, v.verdict, 'allow') AS verdict, v.pattern, v.confidence FROM k LEFT JOIN v ON v.id = k.id AND v.place = 1
"""
