"""Each operator against a brute-force version over a small table with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from copyloom.llm import common, exact_dedup, html_text, language_model, mixing, ngram_join, packing, pii, quality, vector_dedup, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, h long, uid long, `group` long"
CLASH = ("n", 1, 2, 3)


def texts():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    out = base + [None, None, "", "   \n\t", "one two", "ONE  two", "x" * 9000, "x" * 9000 + "y", "word " * 5000]
    for b in base[:25]:
        w = b.split(" ")
        w[rng.randrange(len(w))] = "changed"
        out += [b.upper() if b.isascii() else b, " ".join(w)]
    star = " ".join(f"s{k}" for k in range(200))
    for k in range(0, 200, 4):  # near copies of one text that are not near copies of each other
        w = star.split(" ")
        for j in range(5):
            w[(k + 37 * j) % 200] = f"e{k}-{j}"
        out.append(" ".join(w))
    return out + [star]


def table(spark, some=None):
    some = texts() if some is None else some
    rows = [(i, t, "en", None if i % 9 == 0 else f"src{min(i % 7, 3)}", len(t or ""), *CLASH) for i, t in enumerate(some)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def reach(n, pairs):
    up = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    return up


def test_packing(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_tokenizer())
    want = {i: [*model.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts())}
    got = {}
    place = Counter()
    for r in packing.pack(table(spark), window=256).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == want[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(want[r.doc_id]) and r.offset + r.length <= 256
        assert (r.continued, r.continues) == (r.start > 0, r.start + r.length < r.doc_tokens)
        got.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
        for k in range(r.offset, r.offset + r.length):
            place[r.sequence_id, k] += 1
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(len(v))) for k, v in want.items()}
    total = sum(map(len, want.values()))
    assert place == Counter((k // 256, k % 256) for k in range(total))
    assert packing.pack(empty(spark)).count() == 0
    assert packing.sequences(packing.pack(table(spark), window=256)).count() == -(-total // 256)


def test_pii(spark):
    some = [None, "", "a@b.c a@b@c.d x.y+z@d-e.f.g", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255", "4111 1111 1111 1111 and 4111111111111112", "+1 (555) 123-4567 +12 34", "é+1 (555) 123-4567"] + [f"mail me@x{k}.org now" for k in range(9)] + ["mail joe (at) site.org now"]
    spans = [[(r.base, r.added) for r in pii.find_pii(table(spark, some)).orderBy("doc_id").collect()]][0]
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def good(k, s):
        d = re.sub("[^0-9]", "", s)
        return [True, all(int(x) <= 255 for x in s.split(".")) if k == 1 else True, 16 <= len(d) <= 19 and pii._luhn(d), 8 <= len(d) <= 15][k]

    for t, (base, _) in zip(some, spans, strict=True):
        want = [(k, m.start(), m.end()) for k, p in enumerate(kinds) for m in re.finditer(p, t or "") if good(k, m[0])]
        assert [tuple(x) for x in base] == want, t
    assert [len(a) for _, a in spans] == [0] * (len(some) - 1) + [1]
    d = by_id(pii.pii_digest(table(spark, some)))
    assert d[2].n_email == 3 and d[2].base_sha256 == hashlib.sha256(d[2].spans.encode()).hexdigest()
    assert d[len(some) - 1].spans == "email:5:22" and d[len(some) - 1].n_added == 1
    assert pii.pii_digest(empty(spark)).count() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("<p>a<p>b", "a\n\nb"), ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "* a\n* b\n  * c\n\nd"), ("<ol start=3><li>a<li>b", "3. a\n4. b"),
        ("<style>x</style><script>'</p>'</script><div hidden>h</div><b>v</b> w<i style='display: none'>n</i>", "v w"),
        ("<table><tr><td>a<td>bb<tr><th>ccc<td>d</table>x", "a    bb\nccc  d\n\nx"), ("a<br>b &amp; c", "a\nb & c"), ("<pre> a\n  b</pre>", " a\n  b".strip("\n")), ("<div>" * 5000 + "deep", "deep"),
        ("</p></td>x<table><td>y</table></b>", "x\n\ny"),
    ],
)
def test_html(page, want):
    assert html_text.render(page) == want


def test_html_and_warc_tables(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x<p>y", 3), (1, "http://a/", "<p>x<p>y", 3), (2, None, None, 3), (None, "u", "<b>z", 3)], "page_id long, url string, html string, block long")
    assert sorted(r.text for r in html_text.html_text(pages).collect()) == ["", "x\n\ny", "x\n\ny", "z"]
    assert html_text.html_text(pages.limit(0)).count() == 0
    src = warc.responses(pages)
    made = src.unionByName(warc.derivatives(src))
    raw = b"".join(r.member for r in warc.members(made).collect())
    back = list(warc.parse(io.BytesIO(raw)))
    key = lambda r: (r["record_id"], r["warc_type"], r["refers_to"] or "", bytes(r["block"]), r["block_digest"], r["payload_digest"])
    assert sorted(map(key, back)) == sorted(key(r.asDict()) for r in made.collect()) and len(back) == 12
    by = {r["record_id"]: r for r in back}
    for r in back:
        if r["warc_type"] != "response":
            assert by[r["refers_to"]]["warc_type"] == "response"
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"]).hexdigest()
        if r["warc_type"] == "metadata":
            assert b"Content-Type: text/html" in r["block"] and by[r["refers_to"]]["payload_digest"].encode() in r["block"]
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


@pytest.mark.parametrize("block", [7, 4096])
def test_exact_dedup(spark, block):
    some = texts()
    groups = {}
    for i, t in enumerate(some):
        groups.setdefault(lower(t), []).append(i)
    got = by_id(exact_dedup.exact_dedup(table(spark), block=block))
    assert len(got) == len(some)
    for i, t in enumerate(some):
        g = groups[lower(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(g), len(g), i == max(g), hashlib.sha256(lower(t).encode()).hexdigest())
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    twice = exact_dedup.exact_dedup(table(spark, ["a"]).unionByName(table(spark, ["A"])))
    assert [(r.group_size, r.kept) for r in twice.collect()] == [(2, True)] * 2


def test_mixing(spark):
    some = texts()
    got = [r for r in mixing.mixed_counts(table(spark), block_words=8).collect()]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(some)}
    assert {r.doc_id: r.size for r in got} == size and all(r.taken <= 2 * r.size for r in got)
    source = {i: None if i % 9 == 0 else f"src{min(i % 7, 3)}" for i in size}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    total = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, left, free = {}, 1.5 * sum(total.values()), set(names)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > 2 * total[s]}
        if not full:
            want |= {s: unit * weight[s] for s in free}
            break
        want |= {s: 2.0 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        free -= full
    for s in names:
        mine = [r for r in got if source[r.doc_id] == s]
        assert all(math.isclose(r.target, want[s]) and r.source_size == total[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 8
    assert {r.doc_id: r.taken for r in mixing.mixed_counts(table(spark).repartition(2), block_words=8).collect()} == {r.doc_id: r.taken for r in got}
    _, _, draws = mixing.mix(table(spark), block_words=8, shards=4)
    per = draws.groupBy("shard").count().collect()
    assert len(per) == 4 and max(r["count"] for r in per) - min(r["count"] for r in per) <= 2
    assert mixing.mixed_counts(empty(spark)).count() == 0
    q = np.array([2_000_000_000, 3, 0])
    assert (mixing.split_tree(q, 8, 1).sum(1) == q).all()


def test_ngram_join(spark):
    some = texts()

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(t) for t in some]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    up = reach(len(sets), pairs)
    got = by_id(ngram_join.ngram_join(table(spark)))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), up[i]) for i, s in enumerate(sets)}
    assert len({up[i] for i in range(len(some) - 51, len(some))}) == 1  # the star is found whole
    assert ngram_join.ngram_join(empty(spark)).count() == 0


def test_ngram_join_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "MAP_BLOCK", 8)
    want = {r.doc_id: r.component_id for r in ngram_join.ngram_join(table(spark)).collect()}
    monkeypatch.undo()
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_join(table(spark)).collect()} == want


def test_ngram_join_chunks(spark, monkeypatch):
    """Small chunks and few or many buckets, rows that repeat an id with the same and with other texts, rows without an id."""
    some = texts()
    rows = [(i, t) for i, t in enumerate(some)] + [(i, some[i]) for i in range(20)] + [(i, some[i + 60]) for i in range(5)] + [(i, some[90]) for i in range(30, 33)] + [(None, t) for t in some[:9]]

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [(i, shingles(t)) for i, t in rows]
    pairs = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if a is not None and b is not None and x and 100 * len(x & y) >= 75 * len(x | y)]
    up = reach(len(some), pairs)
    want = sorted(((i, len(x), None if i is None else up[i]) for i, x in sets), key=str)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for chunk, chunk_rows, bits in ((50, 1 << 16, 2), (1 << 21, 7, 9)):
        monkeypatch.setattr(ngram_join, "CHUNK", chunk)
        monkeypatch.setattr(ngram_join, "CHUNK_ROWS", chunk_rows)
        monkeypatch.setattr(ngram_join, "BUCKET_BITS", (bits, bits))
        got = ngram_join.ngram_join(df).select("doc_id", "n_shingles", "component_id")
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_ngram_join_rare_first(spark, monkeypatch):
    """Texts that share a passage with their neighbours, and are else their own, are no candidates, however many other shingles there are."""
    some = [" ".join([f"p{i}-{k}" for k in range(6)] + [f"w{i}-{k}" for k in range(60)] + [f"p{i + 1}-{k}" for k in range(6)]) for i in range(300)]
    monkeypatch.setattr(ngram_join, "SKETCH_BITS", 8, raising=False)  # as full as a large corpus makes a sketch of fixed size
    monkeypatch.setattr(ngram_join, "_slot", lambda h: (h >> np.uint64(56)).astype(np.int64), raising=False)
    seen, was = [], ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda edges: seen.append(edges.count()) or was(edges))
    got = ngram_join.ngram_join(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(4))
    assert got.where("component_id != doc_id").count() == 0 and seen[0] == 0


def test_vector_dedup(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(80, 12)).tolist()
    for k in range(40):
        v.append((np.array(v[k]) + rng.normal(0, 0.12, 12)).tolist())
    v += [v[3], v[3], None, [], [0.0] * 12, [float("nan")] * 12, [1.0, None] * 6, [1e200] * 12, [1e-200] * 12, [1.0] * 5]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    ok = [x is not None and len(x) == 12 and None not in x and np.isfinite(x).all() and any(x) for x in v]
    unit = {i: np.array(v[i]) / max(map(abs, v[i])) for i in range(len(v)) if ok[i]}
    cos = lambda a, b: a @ b / math.sqrt((a @ a) * (b @ b))
    pairs = [(i, j) for i in unit for j in unit if j < i and cos(unit[i], unit[j]) >= 0.95]
    n, up = Counter(x for p in pairs for x in p), reach(len(v), pairs)
    for block in (4096, 16):
        monkeypatch.setattr(vector_dedup, "BLOCK", block)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.vector_dedup(df).collect()}
        assert got == {i: (n[i], up[i], up[i] == i) for i in range(len(v))}
    assert vector_dedup.vector_dedup(df.limit(0)).count() == 0 and len(pairs) > 20


def test_components(spark):
    rng = random.Random(5)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)]
    up = reach(170, pairs)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: up[i] for i in {x for p in pairs if p[0] != p[1] for x in p}}


def test_language_model(spark):
    some = texts()[:90]
    train = [t for i, t in enumerate(some) if zlib.crc32(str(i).encode()) % 5 != 1]
    depth = 2
    got = by_id(language_model.lm_scores(table(spark, some), depth=depth))
    words = Counter(w for t in train for w in [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None])
    total = sum(words.values())
    counts = [{} for _ in range(depth + 1)]  # node -> [zeros, ones], by depth

    def steps(t):
        data = bytes(depth) + lower(t).encode() + b"\0"
        for at in range(depth, len(data)):
            bits = 1
            for s in range(7, -1, -1):
                bit = data[at] >> s & 1
                yield [(data[at - d : at], bits) for d in range(depth + 1)], bit
                bits = bits << 1 | bit

    for t in train:
        for nodes, bit in steps(t):
            for d, node in enumerate(nodes):
                counts[d].setdefault(node, [0, 0])[bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    logs, own = [{} for _ in counts], [{} for _ in counts]
    for d in range(depth, -1, -1):
        below = Counter()
        if d < depth:
            for (ctx, bits), x in logs[d + 1].items():
                below[ctx[1:], bits] += x
        for node, (a, b) in counts[d].items():
            e = kt(a, b)
            logs[d][node] = e if d == depth else float(np.logaddexp(e, below[node])) - math.log(2)
            own[d][node] = 1.0 if d == depth else math.exp(e - math.log(2) - logs[d][node])
    for i, t in enumerate(some):
        tokens = [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
        base = sum(math.log10((words[w] + 0.5) / (total + 0.5 * (len(words) + 1))) for w in tokens)
        score = 0.0
        for nodes, bit in steps(t):
            q = 0.5
            for d in range(depth, -1, -1):
                if nodes[d] in counts[d]:
                    a, b = counts[d][nodes[d]]
                    q = own[d][nodes[d]] * ((b if bit else a) + 0.5) / (a + b + 1) + (1 - own[d][nodes[d]]) * q
                else:
                    q = 0.5
            score += math.log10(q)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(words[w] > 0 for w in tokens), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-6) and math.isclose(r.score, score, rel_tol=1e-4, abs_tol=1e-4)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
    split = by_id(language_model.lm_scores(table(spark, some), depth=depth, chunk_bits=1))
    assert all(math.isclose(split[i].score, got[i].score, rel_tol=1e-6) and split[i].n_known == got[i].n_known and math.isclose(split[i].base_score, got[i].base_score) for i in got)
    assert language_model.lm_scores(empty(spark)).count() == 0


def test_language_model_gets_small_batches(spark, monkeypatch):
    name, real = "spark.sql.execution.arrow.maxRecordsPerBatch", language_model._scorer
    was = spark.conf.get(name)

    def watched(base_of, depth):
        score = real(base_of, depth)

        def checked(batches):
            def few():
                for batch in batches:
                    assert batch.num_rows <= 64, batch.num_rows
                    yield batch

            yield from score(few())

        return checked

    monkeypatch.setattr(language_model, "_scorer", watched)
    some = [f"word{i % 7} " * 700 for i in range(300)]
    got = language_model.lm_scores(table(spark, some), depth=1)
    assert spark.conf.get(name) == was
    assert {r.doc_id: r.n_tokens for r in got.collect()} == dict.fromkeys(range(300), 701)
    try:
        with common.batches_of(spark, 5):
            assert spark.conf.get(name) == "5"
            with common.batches_of(spark, 9):
                assert spark.conf.get(name) == "5"
            raise KeyError
    except KeyError:
        assert spark.conf.get(name) == was


def test_quality(spark):
    rng = random.Random(6)
    some, labels = [], []
    for i in range(400):
        w = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(40)]
        labels.append(int(i % 3 > 0))
        some.append(" ".join(w) if labels[-1] else " ".join(x + rng.choice(["###", "%%%"]) for x in w))
    lab = spark.createDataFrame([(i, q) for i, q in enumerate(labels)] + [(None, 1), (5, None), (9999, 0)], "doc_id long, quality int")
    docs = table(spark, [*some, None, ""])
    got = by_id(quality.quality_scores(docs, lab))
    held = [i for i in range(400) if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(got[i].predicted == labels[i] for i in held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert quality.accepted(docs, lab).columns == docs.columns
    assert {r.predicted for r in quality.quality_scores(docs, lab.limit(0)).collect()} == {1}
    assert quality.quality_scores(empty(spark), lab).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for k, (name, stage) in enumerate(p.STAGES[:4]):
        docs = common.stored(stage(spark, docs, sf), "stage")
        assert docs.columns == list(p.COLUMNS)
        rows = docs.collect()
        seen.append({r.doc_id: r.text for r in rows})
        assert set(seen[-1]) <= set(seen[-2])
        if k in (0, 1, 2):
            assert len(rows) == len(seen[-1])
    low = Counter(lower(t) for t in seen[1].values())
    assert Counter(lower(t) for t in seen[2].values()) == Counter(dict.fromkeys(low, 1))
    assert max(Counter(r.doc_id for r in rows).values()) <= 2
    assert p.pack_sequences(spark, docs, sf).agg({"length": "sum"}).first()[0] > 0


def test_pipeline_decides_by_row(spark, tmp_path):
    """Null and repeated ids: what is decided for one row holds for no other."""
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"

    def docs(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], schema).repartition(3)

    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(500)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    marks = lambda t: " ".join(w + rng.choice(["###", "%%%"]) for w in t.split())

    lab = [(i, say(40) if i % 3 else marks(say(40)), "a") for i in range(300)]
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    good, bad = [say(40) for _ in range(3)], [marks(say(40)) for _ in range(3)]
    odd = [(None, good[0], "a"), (None, good[1], "a"), (None, bad[0], "a"), (None, bad[1], "a"), (900, good[2], "a"), (900, bad[2], "a")]
    kept = {r.text for r in p.keep_quality(spark, docs(lab + odd), str(tmp_path)).collect()}
    assert kept & {*good, *bad} == set(good)

    copies = [(7, "same text", "a"), (7, "SAME text", "a"), (None, "x", "a"), (None, "X", "a"), (None, "y", "a"), (3, "same TEXT", "a")]
    assert Counter((r.doc_id, lower(r.text)) for r in p.drop_copies(spark, docs(copies), "").collect()) == Counter([(7, "same text"), (None, "x"), (None, "y")])

    base, other, third = say(60), say(60), say(60)
    near = [(None, base, "a"), (None, base + " tail", "a"), (5, other, "a"), (5, third, "a"), (4, other + " tail", "a")]
    left = Counter((r.doc_id, r.text) for r in p.drop_near_copies(spark, docs(near), "").collect())
    assert left[5, third] == 1 and left[4, other + " tail"] == 1 and left[None, base] + left[None, base + " tail"] == 1 and left.total() == 3

    many = [(None, say(30), "a") for _ in range(40)] + [(8, say(30), "a") for _ in range(40)]
    drawn = Counter(r.text for r in p.mix_sources(spark, docs(many), "").collect())
    assert set(drawn) <= {t for _, t, _ in many} and max(drawn.values()) <= 2 and abs(drawn.total() - 120) <= 1


def test_pipeline_mixes_in_shuffled_order(spark):
    """The stage's rows, as written and read, come by (shard, position), and copies of a document don't stand side by side."""
    import corpus_pipeline as p

    rows = [(i, f"w{i} and some more words", "en", f"src{i % 2}", 9) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    keyed = docs.selectExpr("doc_id as row_", "source", "text", "struct(doc_id, xxhash64(text)) as key_")
    _, _, draws = mixing.mix(keyed, block_words=None, id_col="key_", row_col="row_")
    want = [r.uid for r in draws.orderBy("shard", "position").collect()]
    out = p.mix_sources(spark, docs, "")
    got = [r.doc_id for r in out.collect()]
    assert got == want and len(got) == 600
    assert sum(a == b for a, b in zip(got, got[1:], strict=False)) < 10 and max(Counter(got).values()) == 2
    files = {}
    for r in common.stored(out, "mixed").selectExpr("doc_id", "input_file_name() as f").collect():
        files.setdefault(r.f, []).append(r.doc_id)
    assert sum((files[f] for f in sorted(files)), []) == want


def test_numbered(spark, tmp_path):
    spark.range(5000).selectExpr("id % 7 as v", "id").repartition(3).write.parquet(f"{tmp_path}/t")
    read = spark.read.parquet(f"{tmp_path}/t")
    for df, scanned in ((read.select("v", "id"), True), (read.selectExpr("v", "explode(array(id, id)) as id"), False), (spark.range(9), False)):
        assert common._scanned(df) == scanned
        rows = common.numbered(df)
        assert rows.columns == ["row_", *df.columns] and rows.select("row_").distinct().count() == df.count()
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, rows.repartition(2).collect()))


@pytest.mark.parametrize(
    "page, want",
    [
        ("<head><title>T</title><p>Hello</p>you", "Hello\n\nyou"), ("<html><head><meta charset=x><title>T</title>Hello <b>you", "Hello you"), ("<head> <style>x</style>\n<script>y</script> <div>a</div></head>b", "a\nb"),
        ("<head><title>T</title></head><body>a", "a"), ("<head><head><title>T</title><img src=x>a", "a"), ("<body>a<head>b", "ab"),
        ("<p>a <svg/>b</p>c", "a b\n\nc"), ("<div>a <math/> b</div>", "a b"), ("a <svg><title>t</title><defs><text>no</text></defs> x <path d=1/><text x=1>one</text><text>two</text></svg> b", "a one two b"),
        ("a <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> b", "a x=1 b"), ("note <textarea>\nfirst\n second</textarea>", "note first\n second"),
        ("<p>pick<select><option>one<option selected>two</select></p>z", "pick\none\ntwo\n\nz"), ("<select><optgroup label=G><option>a</optgroup><optgroup label=H><option>b</select>", "G\na\nH\nb"),
        ("<datalist><option>a</datalist>b<template><p>c</template>", "b"),
    ],
)
def test_html_visible_text(page, want):
    assert html_text.render(page) == want


def test_warc_query_gives_whole_records(spark):
    """The blocks, which digests and lengths are of, come with them: metadata fields, and the page's text."""
    from copyloom.llm import queries

    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = queries.op7_warc(spark, sf).collect()
    texts = Counter(html_text.render(r.html) for r in pages)
    assert Counter(bytes(r.block).decode() for r in got if r.warc_type == "conversion") == texts and len(got) == 2 * len(pages)
    assert all(r.block_digest == "sha256:" + hashlib.sha256(r.block).hexdigest() and r.content_length == len(r.block) for r in got)
    assert all(f"source-record-id: {r.refers_to}".encode() in bytes(r.block) for r in got if r.warc_type == "metadata")


def test_pii_found_instances_induce_patterns(spark):
    """Numbers that follow a word which no seed follows, four words away from the seeds, are found; those after a word of strangers aren't."""
    number = lambda i: f"{200 + i // 1000}-{i % 1000:03d}-{1000 + i}"
    some, old, i = [f"phone: +1 555 {k // 100:03d} {1000 + k}" for k in range(1080)], [], 0
    for word, new in (("phone:", 180), ("tel", 30), ("call", 5), ("ring", 1), ("code", 9)):
        if word == "code":
            old = []
        fresh = [number(i + k) for k in range(new)]
        some += [f"{word} {x}" for x in old + fresh]
        old, i = fresh, i + new
    got = pii.find_pii(table(spark, some)).collect()
    assert all(len(r.base) == 1 and not r.added for r in got if r.doc_id < 1080)
    assert {r.doc_id: len(r.added) for r in got if r.doc_id >= 1080} == {k: int(not some[k].startswith("code")) for k in range(1080, len(some))}
