"""Pages and records: rendering against a plain walk over generated trees, hostile pages, encodings, the reader."""

import gzip
import random
import time
import zlib

import pytest
import zstandard

from copyloom.llm import html_text, warc

INLINE, BLOCKS = ("b", "i", "span", "a"), ("div", "section", "p", "blockquote")


def tree(rng, depth, hidden, words, out):
    """Appends to out the markup of a random piece, and to words those that can be seen."""
    kind = rng.random()
    if depth == 0 or kind < 0.35:
        word = f"w{rng.randrange(10**6)}"
        out.append(f" {word} ")
        if not hidden:
            words.append(word)
        return
    how = rng.random()
    mark, dark = ("", hidden) if how > 0.2 else rng.choice([(" hidden", True), (' style="display : none"', True), (' style="color:red;display:none"', True), (" class=hidden", hidden)])
    if kind < 0.5:
        tag = rng.choice(INLINE)
        out.append(f"<{tag}{mark}>")
        for _ in range(rng.randrange(3)):
            tree(rng, 0, dark, words, out)
        out.append(f"</{tag}>")
    elif kind < 0.75:
        tag = rng.choice(BLOCKS)
        out.append(f"<{tag}{mark}>")
        for _ in range(rng.randrange(4)):
            tree(rng, 0 if tag == "p" else depth - 1, dark, words, out)
        out.append(f"</{tag}>" if tag != "p" or rng.random() < 0.5 else "<hr>")
    elif kind < 0.88:
        out.append(f"<ul{mark}>")
        for _ in range(rng.randrange(4)):
            out.append("<li>")
            tree(rng, depth - 1, dark, words, out)
            out.append("</li>" * rng.randrange(2))
        out.append("</ul>")
    else:
        out.append(f"<table{mark}>")
        for _ in range(rng.randrange(3)):
            out.append("<tr>")
            for _ in range(rng.randrange(1, 4)):
                out.append("<td>")
                tree(rng, 0, dark, words, out)  # a word a cell, so that lines keep the order
                out.append("</td>" * rng.randrange(2))
            out.append("</tr>" * rng.randrange(2))
        out.append("</table>")


@pytest.mark.parametrize("seed", range(40))
def test_generated_trees(seed):
    rng, words, out = random.Random(seed), [], []
    for _ in range(12):
        tree(rng, 4, False, words, out)
    for page in ("".join(out), "<html><head><title>t</title>" + "".join(out), "<!doctype html><body>" + "".join(out) + "</body>"):
        assert [x for x in html_text.render(page).split() if x != "*"] == words


def test_columns_align():
    rng = random.Random(3)
    rows = [["".join(rng.choices("abcxyz", k=rng.randrange(1, 12))) for _ in range(4)] for _ in range(20)]
    lines = html_text.render("<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in rows) + "</table>").split("\n")
    starts = [sum(max(len(r[i]) for r in rows) + 2 for i in range(k)) for k in range(4)]
    assert all(line[s:].startswith(cell) for line, r in zip(lines, rows, strict=True) for s, cell in zip(starts, r, strict=True))


@pytest.mark.parametrize(
    "page, want",
    [
        ("<table><tr><td colspan=2>wide cell<td>c<tr><td>a<td>b<td>d</table>", "wide cell  c\na  b       d"), ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
        ("<ol><li>a<li value=9>b<li>c</ol>", "1. a\n9. b\n10. c"), ("<details><summary>s</summary>no<p>no</details>x", "s\nx"), ("<details open><summary>s</summary>y</details>x", "s\ny\nx"),
        ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"), ("<p style='display:\tnone'>no</p>ok", "ok"), ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("a<p>b <a href='x", "a\n\nb"), ("a <!-- b", "a"), ("a < b <c>d", "a < b d"), ("<table><tr><td>same<td>x<tr><td>same<td>x</table>", "same  x\nsame  x"),
    ],
)
def test_rules(page, want):
    assert html_text.render(page) == want


@pytest.mark.parametrize("piece", ["<section>", "<b>x</i>", "<a ", "<i>x</i>", "<div>", "<tr>", "<table><tr><td>", "</p>", "<!--", "<li>", "<td colspan=1000 rowspan=60000>x", "<table><tr><td>x", "<tr><td rowspan=60000>x", "<tr><td rowspan=3>x<td>y", "<table><tr><td>x<td>y<br>z", "<dt>x", "<p><button><b><div>"])
def test_long_pages_take_time_in_proportion(piece):
    def took(n):
        at = time.process_time()
        html_text.render("<table>" * ("<t" in piece) + piece * n + "x")
        return time.process_time() - at

    small = min(took(4_000) for _ in range(3))
    assert small < 1 and took(16_000) < 6 * max(small, 0.1)


def test_deep_tables_and_spans_keep_all_words():
    page = "".join(f"<table><tr><td>a{k}<td>b{k}" for k in range(50)) + " end"
    assert sorted(html_text.render(page).split()) == sorted([*(f"{c}{k}" for k in range(50) for c in "ab"), "end"])
    rows = "".join(f"<tr><td rowspan={k % 5 + 1}>r{k}<td>s{k}" for k in range(60))
    assert sorted(html_text.render(f"<table>{rows}</table>").split()) == sorted(f"{c}{k}" for k in range(60) for c in "rs")


def brute_columns(rows):
    """The first column of each cell, by marking all places that cells cover."""
    covered, out = set(), []
    for r, row in enumerate(rows):
        col, at = 0, []
        for across, down in row:
            while (r, col) in covered:
                col += 1
            covered |= {(r + d, c) for d in range(1, down) for c in range(col, col + across)}
            at.append(col)
            col += across
        out.append(at)
    return out


@pytest.mark.parametrize("seed", range(15))
def test_spans_stand_where_they_are_free(seed):
    rng = random.Random(seed)
    rows = [[(1, rng.choice([1, 1, 2, 3, 9])) for _ in range(rng.randint(1, 5))] for _ in range(12)]
    page = "".join("<tr>" + "".join(f"<td rowspan={d}>{r:02}{c:02}" for c, (_, d) in enumerate(row)) for r, row in enumerate(rows))
    lines = html_text.render(f"<table>{page}</table>").split("\n")
    at = brute_columns(rows)
    assert [[line.index(f"{r:02}{c:02}") for c in range(len(rows[r]))] for r, line in enumerate(lines)] == [[6 * c for c in x] for x in at]


@pytest.mark.parametrize(
    "head, body, want",
    [
        ("Content-Type: text/html; charset=ISO-8859-1", "<p>café".encode("latin1"), "café"), ("Content-Type: text/html", b"<meta charset='windows-1251'>" + "<p>мир".encode("cp1251"), "мир"),
        ("Content-Type: text/html", b"\xef\xbb\xbf<p>x", "x"), ("Content-Type: text/html; charset=nonsense", "<p>é".encode(), "é"), ("Content-Encoding: gzip", gzip.compress(b"<p>z"), "z"),
        ("Content-Encoding: deflate", zlib.compress(b"<p>z"), "z"), ("Transfer-Encoding: chunked", b"3\r\n<p>\r\n2;a=b\r\nok\r\n0\r\n\r\n", "ok"), ("Content-Type: text/plain", b"a  <b>", "a  <b>"),
        ("Content-Type: image/png", b"\x89PNG", None), ("Content-Type: application/json", b"{}", None), ("Content-Encoding: gzip", b"<p>not packed", "not packed"), ("", b"", ""),
        ("Content-Encoding: gzip", gzip.compress(b"<p>one") + gzip.compress(b" two"), "one two"), ("Content-Encoding: gzip", gzip.compress(b"<p>one") + b"\0\0rest", "one"), ("Content-Encoding: br", b"\x0b\x02\x80<p>x\x03", None),
        ("Content-Encoding: zstd", zstandard.compress(b"<p>one") + zstandard.compress(b" two"), "one two"), ("Content-Encoding: zstd", b"\x28\xb5\x2f\xfd\x00\x01broken", None), ("Content-Encoding: gzip", b"\x1f\x8b\x08broken", None),
        ("Content-Encoding: br, gzip", gzip.compress(b"x"), None), ("Content-Encoding: identity", b"<p>i", "i"),
    ],
)
def test_bodies(head, body, want):
    assert warc.page_text(f"HTTP/1.1 200 OK\r\n{head}\r\n", body) == want


def test_read_takes_files_as_they_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BATCH", 100)
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<p>page {k} " + "x" * (k * 7)) for k in range(30)] + [(99, None, None)], "page_id long, url string, html string")
    made = warc.responses(pages)
    members = [bytes(r.member) for r in warc.members(made).collect()]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members[:20]))
    (tmp_path / "b.warc").write_bytes(b"".join(gzip.decompress(x) for x in members[20:]))
    (tmp_path / "c.warc").write_bytes(b"")
    key = lambda r: (r.record_id, r.warc_type, r.target_uri or "", bytes(r.block), r.http_headers)
    assert sorted(map(key, warc.read(spark, str(tmp_path)).collect())) == sorted(map(key, made.collect()))


def test_other_types_have_metadata_alone(spark):
    made = warc.responses(spark.createDataFrame([(1, "u", "<p>x")], "page_id long, url string, html string")).toPandas()
    made.at[0, "block"] = b"HTTP/1.1 200 OK\r\nContent-Type: image/gif\r\n\r\nGIF89a"
    got = warc.derivatives(spark.createDataFrame(made, warc.RECORD)).collect()
    assert [r.warc_type for r in got] == ["metadata"] and b"text-length: 0" in bytes(got[0].block)
