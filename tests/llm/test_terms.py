"""The operators on URLs, spellings and divergent terms against brute-force versions, with nulls, empty and long values, ties, repeats and clashing names."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from oracle import frames
from test_operators import CLASH, SCHEMA, empty, table, texts

from copyloom.llm import divergence, queries, url_filter, variants


@pytest.mark.parametrize("name", ["op11_url_filter", "op12_variants", "op13_divergence"])
def test_equals_sql(spark, name):
    got, want = frames(spark, queries.queries()[name], queries.oracle_sql()[name], "sf0.01")
    assert got == want and got


# URLs

URLS = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "HTTP://WWW.Example.ORG/es/1?x=1#y", "http://example.org/es", "http://example.org/en/17", "http://example.org/en/71", "http://notexample.org/es/",
    "http://a.b.c.d.example.com/de/x/y/z/17?b=2&a=1&b=3#f", "http://x.com/fr/?u=http://y.org/", "http://com/de/", "ftp://x.com?q#/de/", "://x.com/de/", "http://x.com//de/", "http://é.com/DE/", "http://net/" + "ab/" * 3000, "http://" + "a." * 3000 + "net/de/1",
]


def split(url):
    rest = (url or "").partition("://")[2]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "x", 1, "y") for k, u in enumerate(urls)], "page_id long, url string, host string, uid long, verdict string").repartition(3)


def test_listed_rules(spark):
    none = spark.createDataFrame([], "url string, verdict string")
    got = {r.page_id: r for r in url_filter.judged(pages(spark, URLS + URLS[-9:]), labels=none).collect()}
    assert len(got) == len(URLS) + 9
    for k, url in enumerate(URLS + URLS[-9:]):
        host, path = split(url)
        rule, verdict = rule_of(host, path)
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, rule, verdict or "allow"), url
    assert not url_filter.judged(pages(spark, URLS).limit(0)).count()


def test_rules_tie_and_repeat(spark):
    rules = spark.createDataFrame([("b.org", "/a", "block"), ("org", "/a12", "allow"), ("b.org", "/a", "allow"), ("x.net", "", "block")], "host string, path string, verdict string")
    got = {r.page_id: r for r in url_filter.judged(pages(spark, ["http://b.org/a123", "http://q.x.net", "http://net"]), rules).collect()}
    assert [(got[k].rule, got[k].verdict) for k in range(3)] == [("b.org/a", "allow"), ("x.net", "block"), (None, "allow")]


def labelled(rng, n):
    """URLs whose verdict hangs on two tokens together, with some noise."""
    for _ in range(n):
        name, lang, key = rng.choice(["shop", "news", "wiki"]), rng.choice(["aa", "bb"]), rng.choice(["", "?ad=1", "?q=2"])
        bad = name == "shop" and key == "?ad=1" or lang == "bb" and name == "news"
        yield f"http://{name}.x{rng.randrange(40)}.test/{lang}/{rng.randrange(999)}{key}", "block" if bad != (rng.random() < 0.03) else "allow"


def test_mined_rules_equal_all_subsets(spark):
    rows = list(labelled(random.Random(3), 900))
    bags = spark.createDataFrame(rows, "url string, verdict string").select(url_filter.tokens_of(url_filter.F.col("url")).alias("tokens"), "verdict")
    freq, hits = Counter(), Counter()
    for tokens, verdict in bags.collect():
        for k in range(1, len(tokens) + 1):
            for s in itertools.combinations(sorted(tokens), k):
                freq[s] += 1
                hits[s, verdict] += 1
    want = {(s, v): (n, n / freq[s]) for (s, v), n in hits.items() if n >= 9 and n / freq[s] >= 0.8}
    want = {(s, v): x for (s, v), x in want.items() if not any(want.get((tuple(t for t in s if t != u), v), (0, 0))[1] >= x[1] for u in s)}
    got = {(tuple(sorted(r.tokens)), r.verdict): (r.hits, r.confidence) for r in url_filter.mine(bags, support=0.01).collect()}
    assert got == want and len(got) > 5


def test_mined_rules_generalise(spark):
    rng = random.Random(4)
    known, new = list(labelled(rng, 3000)), list(labelled(rng, 800))
    none = spark.createDataFrame([], "host string, path string, verdict string")
    got = {r.page_id: r.verdict for r in url_filter.judged(pages(spark, [u for u, _ in new]), none, spark.createDataFrame([*known, (None, "block"), ("http://x/", None)], "url string, verdict string")).collect()}
    right = sum(got[k] == v for k, (_, v) in enumerate(new)) / len(new)
    assert right > 0.95, right


def test_no_labels(spark):
    got = url_filter.judged(pages(spark, ["http://a.net/de/1"]), labels=spark.createDataFrame([], "url string, verdict string")).collect()
    assert [(r.rule, r.verdict, r.pattern) for r in got] == [(None, "allow", None)]


# Spellings


def words_of(rows, least_length, least_n, noise):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += len(run) >= least_length
    return {w: n for w, n in seen.items() if n >= least_n}


def apart(a, b):
    """Whether exactly one inserted, deleted or replaced code point tells them apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(words, times):
    near = {w: [x for x in words if apart(w, x)] for w in words}
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: b for w, b in best.items() if words[b] >= times * words[w]}
    root = {}
    for w in words:
        at = w
        while at in form:
            at = form[at]
        root[w] = at
    return {w: (form.get(w), root[w], n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def spellings():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdéÿ×") for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "BananaĀx", "中 banana"]
    out = []
    for k, w in enumerate(base):
        for j in range(6):
            i = rng.randrange(len(w))
            x = rng.choice([w[:i] + w[i + 1 :], w[:i] + "e" + w[i:], w[:i] + "f" + w[i + 1 :], w])
            out.append(" ".join([x.upper() if j == 0 and x.isascii() else x] * 5 ** (k % 3) + [w] * 7))
    return [None, "", "12 --", "long" * 5000, "words and words " * 4000, *out, *out[:20]]


@pytest.mark.parametrize("least_length,least_n,times,noise", [(6, 5, 5, 7), (1, 1, 1, None), (3, 2, 3, 2)])
def test_variants_equal_brute_force(spark, least_length, least_n, times, noise):
    rows = [(None if k % 17 == 3 else k, t) for k, t in enumerate(spellings())]
    docs = spark.createDataFrame([(*r, 1, "w", "f") for r in rows], "doc_id long, text string, n long, word string, root string").repartition(5)
    got = variants.variants(docs, times, least_length=least_length, least_n=least_n, noise=noise).collect()
    want = brute_variants(words_of(rows, least_length, least_n, noise), times)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want) > 50


def test_variants_of_nothing(spark):
    assert not variants.variants(empty(spark)).count()
    assert not variants.variants(spark.createDataFrame([(1, None), (None, "a b")], "doc_id long, text string")).count()


def test_forms_lead_to_a_root(spark):
    words = {"aaaaaa": 5, "aaaaaab": 25, "aaaaabb": 125, "aaaabbb": 625, "aaabbbb": 3125}
    docs = spark.createDataFrame([(k, f"{w} " * n) for k, (w, n) in enumerate(words.items())], "doc_id long, text string")
    got = {r.word: (r.form, r.root) for r in variants.variants(docs, noise=None).collect()}
    assert got == {w: (f, "aaabbbb") for w, f in zip(words, [*list(words)[1:], None], strict=True)}


def test_keys_are_of_deletions():
    rng = random.Random(5)
    raw = list({"".join(rng.choices("abÿ", k=rng.randint(1, 8))).encode("latin-1") for _ in range(400)})
    seen = defaultdict(set)
    for word, kind, place, key in zip(*(x.tolist() for x in variants.deletion_keys(raw)), strict=True):
        w = raw[word]
        seen[key].add((place if kind == variants.REPLACED else -1, w if kind == variants.WHOLE else w[:place] + w[place + 1 :]))
    assert all(len(x) == 1 for x in seen.values())  # a key, one place and string
    assert len(set.union(*seen.values())) == len(seen)  # and the other way round


def test_words_under_a_false_key_are_told_apart():
    rows = [(variants.REPLACED, 0, "xabc", 3), (variants.REPLACED, 0, "yabc", 9), (variants.REPLACED, 0, "yqqq", 99), (variants.REPLACED, 1, "axbc", 5), (variants.SHORTENED, 1, "abcd", 7), (variants.WHOLE, -1, "acd", 2), (variants.WHOLE, -1, "zzz", 2)]
    assert sorted(variants._met(rows)) == [("abcd", 1, 2, "acd"), ("acd", 1, 7, "abcd"), ("xabc", 1, 9, "yabc"), ("yabc", 1, 3, "xabc")]


# Divergent terms


def brute_divergence(rows, least_docs):
    """rows: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t)]
    docs, own, all_ = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = terms(text)
        docs[lang].update(set(found))
        own[lang, source].update(found)
        all_[lang].update(found)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = set()
    for lang in {r[0] for r in rows}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        share = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept})(sum(c[t] for t in kept))
        q, p = share(all_[lang]), {s: share(own[x, s]) for x, s in own if x == lang}
        for s in p:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in p if o != s]
            best = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if own[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:10])):
                out |= {(lang, s, part, x, -v, k) for k, (v, _, x) in enumerate(found, 1)}
    return out


def rows_of(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("least_docs", [1, 3, 50])
def test_divergence_equals_brute_force(spark, least_docs):
    docs = table(spark).withColumn("lang", url_filter.F.expr("case when doc_id % 11 = 0 then null when doc_id % 3 = 0 then 'de' else lang end"))
    docs = docs.unionByName(spark.createDataFrame([(900, None, "xx", "a", 0, *CLASH), (901, "12", "xx", None, 0, *CLASH), (902, "Ab ab", "yy", "", 0, *CLASH)], SCHEMA))
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    assert rows_of(divergence.divergence(docs, least_docs=least_docs)) == brute_divergence(rows, least_docs)


def test_terms_in_several_waves(spark):
    """Thousands of terms with many equal values, so that bounds decide what is looked at."""
    rng = random.Random(8)
    vocab = [f"t{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(3000)]
    weights = [1 / (k + 3) for k in range(3000)]
    rows = [("l", f"s{k % 3}", " ".join(rng.choices(vocab, weights, k=800) + rng.choices(vocab[k % 3 :: 7], k=50))) for k in range(60)]
    got = rows_of(divergence.divergence(spark.createDataFrame(rows, "lang string, source string, text string"), least_docs=2))
    assert got == brute_divergence(rows, 2)


def test_more_sources_than_a_block(spark):
    rng = random.Random(9)
    rows = [("l", f"s{k}", " ".join(rng.choices("abcdefgh", k=rng.randrange(6)))) for k in range(divergence.BLOCK + 40)]
    got = rows_of(divergence.divergence(spark.createDataFrame(rows, "lang string, source string, text string"), least_docs=2).where("source in ('s0', 's7', 's530')"))
    assert got == {r for r in brute_divergence(rows, 2) if r[1] in ("s0", "s7", "s530")}


def test_divergence_of_nothing(spark):
    assert not divergence.divergence(empty(spark)).count()
    assert len(texts()) > 50
