"""The training-data operators against brute force, libraries, round trips and held-out labels, with odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwatch.llm import audio, chat, html_text, language_id, mixing, near_dedup, piece_bpe, url_filter, vector_search, warc

from ..conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def duck(sql, tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name, df.toArrow())
    rel = c.execute(sql)
    return sorted(([d[0] for d in rel.description], rel.fetchall())[1], key=str)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def odd_docs(spark):
    return spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "de", None, 0), (3, "  12 34 ", None, "b", 3), (None, "no id here at all", "en", "b", 5), (5, "the one", "en", "a", 7),
                                  (5, "the one", "en", "a", 7), (6, "THE  one\n", "en", "a", 9), (7, "x " * 20000, "en", "c", 40000)], DOCS)


# 1 language identification


def test_language_of_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_code_lengths_equal_slow_ppm():
    texts = {"a": [b"abracadabra " * 4, b"abba"], "b": [b"banana bandana " * 4]}
    model = language_id.train(texts, min_count=1)
    seen = sorted({b for t in texts.values() for x in t for b in x})

    def slow(lang, text):
        counts = {}
        for t in texts[lang]:
            s = [-1] * language_id.ORDER + list(t)
            for i in range(language_id.ORDER, len(s)):
                for d in range(language_id.ORDER + 1):
                    counts.setdefault(tuple(s[i - d:i]), {}).setdefault(s[i], 0)
                    counts[tuple(s[i - d:i])][s[i]] += 1
        total, s = 0.0, [-1] * language_id.ORDER + list(text)
        for i in range(language_id.ORDER, len(s)):
            p, excluded = 1.0, set()
            for d in range(language_id.ORDER, -1, -1):
                c = {k: v for k, v in counts.get(tuple(s[i - d:i]), {}).items() if k not in excluded}
                if not c:
                    continue
                n, q = sum(c.values()), len(c)
                if s[i] in c:
                    p *= c[s[i]] / (n + q)
                    break
                p *= q / (n + q)
                excluded |= set(c)
            else:
                p /= 256 - len(excluded)
            total += round(-np.log2(p) * language_id.UNIT)
        return total

    for text in (b"abra", b"bandana abba", b"zzz", b"a"):
        got = model.code_lengths(np.array([0, len(text)]), np.frombuffer(text, np.uint8))[0]
        assert [abs(g - slow(lang, text)) <= len(text) for g, lang in zip(got, model.langs, strict=True)] == [True, True]
    assert seen


def test_every_language_is_learned(spark):
    """More languages than a group has, one of them rare, one of very long texts only; what is kept doesn't shrink."""
    rnd = random.Random(6)
    words = {f"l{k:02}": ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 5))) for _ in range(12)] for k in range(9)}
    table = [(1000 * k + n, " ".join(rnd.choice(w) for _ in range(40)), lang, "s", 1) for k, (lang, w) in enumerate(words.items()) for n in range(1 if lang == "l07" else 12) if lang != "l03"]
    table.append((5, " ".join(rnd.choice(words["l03"]) for _ in range(20000)), "l03", "s", 1))
    docs = spark.createDataFrame(table, DOCS)
    model = language_id.fit(docs, F.lit(True), sample_bytes=20000)
    assert model.langs == sorted(words) and len(model.groups) == 3
    tests = [(k, " ".join(rnd.choice(words[lang]) for _ in range(30)), lang, "s", 1) for k, lang in enumerate(words)]
    got = language_id.predict(spark.createDataFrame(tests, DOCS), model).collect()
    assert all(r.lang_pred == r.lang for r in got)
    one, many = (language_id.train({f"x{k}": [b"abcdefgh hgfedcba " * 20] for k in range(n)}) for n in (4, 40))
    assert len(one.groups[0].cost) == len(many.groups[9].cost)


def test_code_lengths_do_not_depend_on_chunks(monkeypatch):
    model = language_id.train({"a": [b"abc abd abe " * 9], "b": [b"xyz xyw " * 9]})
    parts = [b"abc", b"", b"xyz abc " * 50, b"q"]
    data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    whole = model.code_lengths(offsets, data)
    monkeypatch.setattr(language_id, "CHUNK", 7)
    assert (model.code_lengths(offsets, data) == whole).all() and (whole[1] == 0).all()


def test_language_of_odd_rows(spark):
    docs = odd_docs(spark).withColumn("Score", F.lit(9))
    model = language_id.fit(docs, ~language_id.held_out())
    got = {(r.doc_id, r.lang_pred) for r in language_id.predict(docs, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and len(got) == 7
    assert language_id.fit(docs.limit(0), F.lit(True)) is None
    assert language_id.predict(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}


# 2 archives


def test_archives_against_sql(spark, tmp_path):
    html = [(1, "http://a b/", "<p>x"), (2, None, "<p>x"), (3, "http://c", None), (4, "http://d", "\r\n\r\nWARC/1.1\r\n\r\né"), (5, "http://e", ""), (6, "http://f", "<p>x"), (7, "http://g", "z" * 300000)]
    spark.createDataFrame(html, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = rows(warc.query(spark, str(tmp_path)), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == duck(warc.ORACLE_SQL, {"pages": spark.read.parquet(str(tmp_path / "pages.parquet"))})
    assert [r[4] for r in got] == [None, 1, None, None, 3, 1, None]


def test_archive_files_are_bounded_and_a_member_a_record(spark, tmp_path, monkeypatch):
    import glob
    import zlib as z

    monkeypatch.setattr(warc, "SEGMENT_BYTES", 20000)
    monkeypatch.setattr(warc, "SEGMENTS_PER_FILE", 2)
    rnd = random.Random(2)
    pages = spark.createDataFrame([(k, f"http://x/{k}", "".join(chr(rnd.randrange(32, 1000)) for _ in range(5000)), 5) for k in range(40)], "page_id long, url string, html string, Payload int").coalesce(1)
    records = warc.convert_arc(warc.pages_as_arc(pages)).withColumns({"refers_id": F.lit(None).cast("string"), "refers_page": F.lit(None).cast("long")})
    warc.write_warc(records, str(tmp_path / "w"))
    files, n = glob.glob(str(tmp_path / "w" / "part-*")), 0
    assert len(files) > 3
    for name in files:
        data = open(name, "rb").read()
        whole = 0
        while data:
            d = z.decompressobj(31)
            out = d.decompress(data)
            data = d.unused_data
            whole += len(out)
            n += out.startswith(b"WARC/1.1")
            assert out == b"" or (out.count(b"WARC-Type") == 1 and out.endswith(b"\r\n\r\n"))
        assert whole < 2 * (20000 + 20000)
    got = warc.read_warc(spark, str(tmp_path / "w"), with_payload=True)
    assert n == 40 and rows(got, "payload") == rows(pages.select(F.col("html").cast("binary").alias("payload")), "payload")
    nothing = pages.limit(0)
    nothing.write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.query(spark, str(tmp_path)).count() == 0


def test_streams_of_any_cut():
    import gzip

    rnd = random.Random(3)
    raw = bytes(rnd.randrange(3) + 65 for _ in range(50000))
    for data in (raw, gzip.compress(raw), b"".join(gzip.compress(raw[k: k + 7000]) + warc.EMPTY_MEMBER for k in range(0, 50000, 7000))):
        for piece in (100, 3000, 1 << 20):
            old, warc.PIECE = warc.PIECE, piece
            stream = warc.Stream(data)
            one, two, three = stream.before(b"CBA"), stream.take(30000), stream.before(b"ABAB")
            at = raw.index(b"CBA")
            assert one == raw[:at] and two == raw[at + 3: at + 30003] and three == raw[at + 30003: raw.index(b"ABAB", at + 30003)]
            assert len(stream.take(10**6)) == 50000 - raw.index(b"ABAB", at + 30003) - 4 and stream.done() and stream.before(b"A") is None
            warc.PIECE = old
    with pytest.raises(ValueError):
        warc.Stream(gzip.compress(raw)[:-30]).take(10**6)


def test_legacy_headers_of_both_versions():
    for version in (1, 2):
        data = warc.arc_head("x.arc", version, "19990102030405") + b"".join(
            warc.arc_record(version, u, "1.2.3.4", "19990102030405", "text/plain", body) for u, body in (("http://a", b"one\ntwo"), ("http://b c", b""), ("http://d", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nz")))
        import gzip

        for raw in (data, gzip.compress(data[:50]) + gzip.compress(data[50:])):
            got = [warc.converted(f, b) for f, b in warc.arc_records(raw)]
            assert [(g[1], g[2], g[3], g[7]) for g in got] == [("resource", "1999-01-02T03:04:05Z", "http://a", b"one\ntwo"), ("resource", "1999-01-02T03:04:05Z", "http://b%20c", b""),
                                                              ("response", "1999-01-02T03:04:05Z", "http://d", b"z")]
    with pytest.raises(ValueError):
        list(warc.arc_records(data[:-4]))
    with pytest.raises(ValueError):
        list(warc.arc_records(b"http://a 1.2.3.4 1999 text/plain 1\nx\n"))
    assert (warc.iso_date("1999"), warc.iso_date("x")) == ("1999-01-01T00:00:00Z", "1970-01-01T00:00:00Z")


# 3 nearest neighbours


def brute_nearest(x, every=50, top=5):
    ids, vecs = zip(*x, strict=True)
    v = np.array(vecs, np.float64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = set()
    for i, q in enumerate(ids):
        if q % every == 0:
            s = u @ u[i]
            best = sorted((k for k in range(len(ids)) if ids[k] != q), key=lambda k: (-round(s[k], 12), ids[k]))[:top]
            out |= {(q, ids[k]) for k in best}
    return out


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_nearest_recall(spark, sf):
    """At least 0.9 of the exact neighbours, with the index leaving out entries (see the next test)."""
    got = vector_search.query(spark, f"/root/testdata/sf{sf}")
    x = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").collect()]
    want = brute_nearest(x)
    found = {(r.query_id, r.vec_id) for r in got.collect()}
    assert len(found) == len(want) and len(found & want) >= 0.9 * len(want)


def test_nearest_really_leaves_entries_out(spark):
    """With a small share to probe, recall falls: nothing is scanned whole; with the share of 1 it is exact."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute_nearest([(r.vec_id, r.embedding) for r in df.collect()])
    few, every = (len({(r.query_id, r.vec_id) for r in vector_search.search(df, probe=p).collect()} & want) / len(want) for p in (0.02, 1.0))
    assert few < 0.7 and every == 1.0


def test_nearest_with_a_hot_vector_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "MAX_K", 2)  # large cells
    monkeypatch.setattr(vector_search, "MATRIX", 1000)
    monkeypatch.setattr(vector_search, "PART", 5)
    rnd = np.random.default_rng(0)
    x = [(k, [float(v) for v in (np.ones(8) if k % 3 == 0 else rnd.normal(size=8)).astype(np.float32)]) for k in range(600)]
    odd = [(600, None), (650, [0.0] * 8), (700, [float("nan")] + [1.0] * 7), (750, [1.0, 2.0]), (None, [1.0] * 8), (800, [None] + [1.0] * 7), (0, x[0][1])]
    df = spark.createDataFrame(x + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = vector_search.search(df, probe=0.8)
    found = [tuple(r) for r in got.collect()]
    want = brute_nearest(x)
    assert len(found) == 12 * 5 and len({(q, v) for q, _, v, _ in found} & want) >= 0.9 * len(want)
    assert sorted(v for q, _, v, _ in found if q == 0) == [3, 6, 9, 12, 15]
    assert vector_search.search(df.limit(0)).count() == 0
    assert rows(vector_search.search(df.where("vec_id in (0, 1)")), "query_id", "rank", "vec_id") == [(0, 1, 1)]


def test_walk_takes_cells_in_order():
    rnd = np.random.default_rng(1)
    index = vector_search.MultiIndex(rnd.normal(size=(200, 6)), 5)
    index.lay_out({c: 1 for c in range(25)})
    for _ in range(20):
        a, b = rnd.random(5), rnd.random(5)
        for wanted in (1, 7, 25):
            reach, _ = index.walk(a, b, wanted)
            assert abs(reach - sorted((a[:, None] + b).ravel())[wanted - 1]) < 1e-12


# 4 html


def test_layout():
    assert html_text.text_of("<ul><li>a<ul><li>b<li>c</ul><li>d</ul><ol start=3><li>x<p>y</ol>") == "- a\n\n  - b\n  - c\n- d\n\n3. x\n\n   y"
    assert html_text.text_of("<table><caption>t<tr><td>aa<td>b<tr><td colspan=2>wide one<tr><th>c</th><td>ddd</table>after") == "t\naa       | b\nwide one |\nc        | ddd\n\nafter"
    assert html_text.text_of("<head><title>no</title></head><body>a &lt;b&gt;<br>c<script>if (a<b) {}</script><p hidden>no<p style='display:none'>no</p><p>d  e</div>") == "a <b>\nc\n\nd e"
    assert html_text.text_of("<pre>\n x\n  y </pre><blockquote>q</blockquote>") == " x\n  y\n\n  q"
    assert [html_text.text_of(x) for x in (None, "", "<!-- x", "<script>x", "a<b", "<")] == ["", "", "", "", "a", "<"]
    assert html_text.text_of("<div>" * 5000 + "deep") == "deep"


def slow_text(html):
    """Text of a page by the standard library's parser and plain recursion: p, lists, tables and line breaks only."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.top = ("html", [])
            self.stack = [self.top]

        def end(self, names, stop=()):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] in stop:
                    return
                if self.stack[k][0] in names:
                    del self.stack[k:]
                    return

        def handle_starttag(self, tag, attrs):
            if tag in ("p", "ul", "ol", "table", "h1", "div", "nav", "article", "footer", "ul"):
                self.end(("p",), ("td",))
            node = (tag, [])
            self.stack[-1][1].append(node)
            if tag not in ("br", "meta"):
                self.stack.append(node)

        def handle_endtag(self, tag):
            self.end((tag,), ("td",) if tag != "table" and tag not in ("tr", "td") else ())

        def handle_data(self, data):
            self.stack[-1][1].append(data)

    def trimmed(lines):
        while lines and lines[0] is None:
            lines = lines[1:]
        while lines and lines[-1] is None:
            lines = lines[:-1]
        return lines

    def blocks(children):
        lines, inline = [], ""

        def done():
            nonlocal inline
            parts = inline.split("\n")
            parts = parts[:-1] if not parts[-1].strip() else parts
            lines.extend(" ".join(x.split(" ")).strip() if x.strip() else "" for x in [re.sub(" +", " ", x) for x in parts])
            inline = ""

        def walk(children):
            nonlocal inline
            for c in children:
                if isinstance(c, str):
                    inline += re.sub(r"[ \t\n\r\f]+", " ", c)
                    continue
                tag, own = c
                if tag in ("head", "script", "style", "title"):
                    continue
                if tag == "br":
                    inline += "\n"
                elif tag in ("p", "ul", "ol", "table", "h1", "div", "nav", "article", "footer", "body", "html"):
                    done()
                    if tag in ("p", "ul", "ol", "table", "h1"):
                        lines.append(None)
                    if tag in ("ul", "ol"):
                        for k, (_, item) in enumerate([x for x in own if not isinstance(x, str)]):
                            mark = "- " if tag == "ul" else f"{k + 1}. "
                            inner = trimmed(blocks(item)) or [""]
                            lines.extend(None if x is None else ((mark if n == 0 else " " * len(mark)) + x).rstrip() for n, x in enumerate(inner))
                    elif tag == "table":
                        grid = [[trimmed(blocks(cell[1])) for cell in row[1] if not isinstance(cell, str)] for row in own if not isinstance(row, str)]
                        grid = [[["" if x is None else x for x in cell] for cell in row] for row in grid]
                        wide = [max((len(x) for row in grid for x in (row[c] if c < len(row) else [])), default=0) for c in range(max(map(len, grid)))]
                        for row in grid:
                            if len(wide) == 1:
                                lines.extend(row[0])
                                continue
                            for k in range(max(map(len, row))):
                                line = ""
                                for c, cell in enumerate(row):
                                    if k == 0 or len(cell) > k:
                                        at = sum(wide[:c]) + 3 * c
                                        line = (line.ljust(at - 3) + " | " if c and (k == 0 or line.strip()) else line.ljust(at)) + (cell[k] if len(cell) > k else "")
                                lines.append(line.rstrip())
                    else:
                        walk(own)
                    done()
                    if tag in ("p", "ul", "ol", "table", "h1"):
                        lines.append(None)
                else:
                    walk(own)

        walk(children)
        done()
        return lines

    tree = Tree()
    tree.feed(html)
    tree.close()
    out = []
    for x in trimmed(blocks([tree.top])):
        if x is None and out[-1] is None:
            continue
        out.append(x)
    return "\n".join(x or "" for x in out)


def test_text_of_every_page(spark):
    """Order, spacing, lists and line breaks of every page against the plain renderer."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = html_text.query(spark, SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == slow_text(pages[r.page_id])
    assert html_text.extract(spark.createDataFrame([(1, None, 2)], "page_id long, html string, Text int")).collect()[0].text == ""
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_text_of_random_layouts():
    rnd = random.Random(8)

    def block(depth):
        kind = rnd.choice(["p", "div", "text", "br", "ul", "ol", "table"] if depth < 4 else ["p", "div", "text", "br"])
        words = " ".join(rnd.choice(["a", "bb", "c  c", "d\ne", "<b>f</b> g"]) for _ in range(rnd.randint(1, 3)))
        if kind in ("p", "div"):
            return f"<{kind}>{words}</{kind}>"
        if kind in ("ul", "ol"):
            return f"<{kind}>" + "".join(f"<li>{words if rnd.random() < 0.7 else ''}{block(depth + 1)}</li>" for _ in range(rnd.randint(1, 3))) + f"</{kind}>"
        if kind == "table":
            n = rnd.randint(1, 3)
            return "<table>" + "".join("<tr>" + "".join(f"<td>{words if rnd.random() < 0.5 else ''}{block(depth + 2) if rnd.random() < 0.4 else 'x'}</td>" for _ in range(n)) + "</tr>" for _ in range(rnd.randint(1, 3))) + "</table>"
        return f" {words} " if kind == "text" else f"{words}<br>{words}"

    for _ in range(400):
        html = "".join(block(0) for _ in range(rnd.randint(1, 4)))
        assert html_text.text_of(html) == slow_text(html), html


def test_visibility_is_read_from_attributes():
    for shown in ("<div class=\"menu hidden x\">Hello</div>", "<p title=\"a hidden gem\">Hello</p>", "<p data-css=\"display:none\">Hello</p>", "<p style=\"visibility:hidden\">a<b style='visibility: visible'>Hello</b>b</p>",
                  "<p hidden style='display:block'>Hello</p>", "<p style='display:none;display:block'>Hello</p>", "<input type=hidden value=x>Hello", "<a href='?type=hidden'>Hello</a>", "<svg><title>no</title><text>Hello</text></svg>"):
        assert html_text.text_of(shown) == "Hello", shown
    for gone in ("<p hidden>x</p>", "<p HIDDEN=''>x", "<p style='color:red; DISPLAY : None !important; display:block'>x", "<p style='visibility:hidden'>x<b>y", "<body hidden>x", "<dialog>x</dialog>", "<details>x</details>"):
        assert html_text.text_of(gone) == "", gone
    assert html_text.text_of("<table><tr><td style='visibility:hidden'>aaaa<td>b<tr><td>ccc<td>d</table>") == "    | b\nccc | d"


def test_deep_and_wide_pages_keep_their_layout():
    deep = "<div>" * 5000
    assert html_text.text_of(deep + "<p hidden>secret</p>ok") == "ok"
    assert html_text.text_of(deep + "<ul><li>a<li>b</ul><table><tr><td>x<td>yy<tr><td>zzz<td>w</table>") == "- a\n- b\n\nx   | yy\nzzz | w"
    assert html_text.text_of("<ul><li>" * 3000 + "x") == "- " * 3000 + "x"
    for html in ("<table>" + ("<td>" * 100 + "<tr>") * 10 + "<td>" + "x" * 1000 + "</table>", "<table><tr>" + "<td>" * 1000 + "<tr><td colspan=999><td>x" * 1000,
                 "<table><tr>" + "<td>" * 50 + "<td>" + "x<br>" * 1000, "<ul><li>a" * 5000, "<table><tr><td>a<td>b" * 3000, "<table><tr><td rowspan=60000 colspan=1000>a" * 500):
        text = html_text.text_of(html)
        lines = text.count("\n") + 1
        assert len(text) <= 2 * len(html) + 3 * html_text.ALIGN * lines and re.sub(r"[\s|-]", "", text) == re.sub("<[^>]*>", "", html)


# 5 chat


def test_chat_against_sql(spark, tmp_path):
    turns = [(1, 0, "user", "a<|b<||c\\"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>"), (1, 2, "assistant", None), (2, 5, None, "x"), (2, None, "user", "first"), (2, 5, None, "x"), (3, 0, "sy\ns<|", "\n"),
             (None, 0, "assistant", "é𝒳 <"), (None, 1, "user", "|")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = chat.query(spark, str(tmp_path))
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert rows(got, *names) == duck(chat.ORACLE_SQL, {"conversations": spark.read.parquet(str(tmp_path / "conversations.parquet"))})
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().executedPlan().toString())


def test_event_fold(spark):
    log = [(1, 1, 1, "start", "user", None), (1, 2, 1, "delta", None, "he"), (1, 5, 1, "delta", None, "llo"), (1, 3, 2, "start", "assistant", ""), (1, 4, 2, "delta", None, "bad"), (1, 6, 2, "regenerate", None, None),
           (1, 7, 2, "delta", None, "go"), (1, 8, 2, "delta", None, "od"), (1, 9, 1, "edit", None, "hi"), (1, 10, 3, "noise", None, "x"), (2, 1, 1, "delta", None, "y")]
    got = chat.fold(spark.createDataFrame(log, "conv_id int, seq int, message int, kind string, role string, body string"))
    assert rows(got, "conv_id", "message", "role", "text") == [(1, 1, "user", "hi"), (1, 2, "assistant", "good"), (2, 1, None, "y")]
    assert chat.fold(got.sparkSession.createDataFrame([], "conv_id int, seq int, message int, kind string, role string, body string")).count() == 0


# 6 audio


def test_audio_round_trip(spark, tmp_path):
    odd_docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = audio.query(spark, str(tmp_path)).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in odd_docs(spark).collect()}
    for r in got:
        raw = texts[r.doc_id]
        pad = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(pad) + 44, hashlib.sha256(audio.wav_of(pad)).hexdigest())
    assert len({r.feature for r in got if r.doc_id == 5}) == 1 and len(got) == 8


def slow_features(raw, rate):
    """Log-mels and energy segments by their definitions, in double precision: no phases, no fast transform, no blocks."""
    g = np.gcd(rate, audio.TARGET)
    up, down = audio.TARGET // g, rate // g
    most, half = max(up, down), 8
    taps = np.array([np.sinc(k / most) * (0.5 + 0.5 * np.cos(2 * np.pi * k / (2 * half * most + 2))) for k in range(-half * most, half * most + 1)])
    taps *= up / taps.sum()
    x = np.zeros(len(raw) * up)
    x[::up] = (np.frombuffer(raw, np.uint8) - 128.0) / 128
    n = -(-len(raw) * up // down)
    frames = max(1, -(-(n - audio.FRAME) // audio.HOP) + 1)
    y = np.convolve(x, taps)[half * most:][::down]
    y = np.append(y, np.zeros(frames * audio.HOP + audio.FRAME))
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, 2595 * np.log10(1 + audio.TARGET / 2 / 700), audio.MELS + 2)]
    bins = np.arange(audio.FRAME // 2 + 1)
    dft = np.exp(-2j * np.pi * np.outer(bins, np.arange(audio.FRAME)) / audio.FRAME)
    mels, energy = [], []
    for f in range(frames):
        cut = y[f * audio.HOP: f * audio.HOP + audio.FRAME]
        power = np.abs(dft @ (cut * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.FRAME) / audio.FRAME)))) ** 2
        hz = bins * audio.TARGET / audio.FRAME
        mels.append([np.log(1e-6 + sum(p * max(0, min((h - a) / (b - a), (c - h) / (c - b))) for p, h in zip(power, hz, strict=True) if a < h < c)) for a, b, c in zip(edges, edges[1:], edges[2:], strict=False)])
        energy.append(10 * np.log10((cut**2).sum() / audio.FRAME + 1e-9))
    middle, on, segments = np.median(np.float32(energy)), False, []
    for f, e in enumerate(energy):
        if not on and e > middle + audio.ON_DB:
            on, begin = True, f
        elif on and e < middle + audio.OFF_DB:
            on = False
            segments.append((begin, f))
    return np.array(mels), segments + ([(begin, frames)] if on else [])


def test_stored_features_equal_slow_ones(spark):
    """Tensors, spans and segments that were stored and read back, for clips of several rates."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("n_chars").limit(12).collect()}
    clips = [(k, audio.wav_of(audio.payload_of((t or "").encode()), rate)) for k, t in docs.items() for rate in (12000,)]
    clips += [(10**6 + rate, audio.wav_of(bytes(int(128 + 90 * np.sin(k * k / 9000) * (k % 3000 < 1500)) for k in range(9000)), rate)) for rate in (16000, 8000, 11025)] + [(-1, None)]
    got = audio.features(spark.createDataFrame(clips, "doc_id long, media binary"))
    raws = dict(clips)
    for r in got.collect():
        if r.tensors is None:
            assert r.doc_id == -1 and r.segments is None
            continue
        view, rate = audio.samples_of(raws[r.doc_id])
        mels, segments = slow_features(bytes(view), rate)
        spans, stored = audio.tensors_of(r.tensors)
        flat = stored.reshape(-1, audio.MELS)
        assert stored.shape[1:] == (audio.WINDOW_FRAMES, audio.MELS) and np.abs(flat[: len(mels)] - mels).max() < 0.03 and (flat[len(mels):] == np.float16(np.log(1e-6))).all()
        assert spans[0, 0] == 0 and spans[-1, 1] == len(mels) * 16.0 and (spans[1:, 0] == spans[:-1, 1]).all()
        assert [(s.start_ms, s.end_ms) for s in r.segments] == [(a * 16.0, b * 16.0) for a, b in segments]
    told = {r.doc_id: r.feature for r in audio.with_feature(got).collect()}
    assert told[-1] is None and all(t.startswith("logmel ") for k, t in told.items() if k != -1)


def test_audio_of_odd_tables(spark, tmp_path):
    odd = odd_docs(spark).withColumns({"Feature": F.lit(1), "N_Bytes": F.lit(2), "media": F.lit("x")})
    got = audio.with_feature(audio.features(audio.with_media(odd))).collect()
    assert len(got) == 8 and {r.n_bytes for r in got if r.doc_id == 1} == {0} and all(r.feature for r in got)
    odd.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert audio.query(spark, str(tmp_path)).count() == 0


def test_resampling_keeps_a_tone_and_blocks_agree(monkeypatch):
    t = np.arange(16000)
    tone = np.rint(128 + 100 * np.sin(2 * np.pi * 440 * t / 16000)).astype(np.uint8)
    for up, down in ((1, 2), (3, 4), (5, 2)):
        n = 16000 * up // down
        y = audio.resampled(tone, 0, n, up, down)
        want = 100 / 128 * np.sin(2 * np.pi * 440 * np.arange(n) * down / up / 16000)
        assert np.abs(y - want)[200:-200].max() < 0.03
        assert np.array_equal(np.concatenate([audio.resampled(tone, a, min(a + 777, n), up, down) for a in range(0, n, 777)]), y)
    mels, energy = audio.log_mel(tone, 16000)
    centre = audio._mel_bank(8000)[:, mels[30].argmax()].argmax() * 4000 / 128
    assert abs(centre - 440) < 80
    monkeypatch.setattr(audio, "BLOCK_FRAMES", 10)
    again, _ = audio.log_mel(tone, 16000)
    assert np.allclose(again, mels, atol=1e-3)


def test_segments_and_tensors():
    energy = np.array([0, 0, 0, 2, 0.2, 0.1, -1, 0, 0, 5, 5, 0], np.float32)
    assert audio.energy_segments(energy).tolist() == [[3, 6], [9, 12]]
    (batch,) = list(pa.ipc.open_stream(audio.tensor_stream(np.zeros((70, audio.MELS), np.float32))))
    assert batch.schema.field("log_mel").type.shape == [audio.WINDOW_FRAMES, audio.MELS] and batch.num_rows == 2
    assert batch.column("end_ms").to_pylist() == [62 * 16.0, 70 * 16.0]


# 7 sentencepiece


@pytest.fixture(scope="module")
def pieces():
    return piece_bpe.PieceVocabulary(piece_bpe.default_model())


def encoded(v, texts):
    ids, ends = v.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)], v.decode(ids, ends).to_pylist()


def test_ids_equal_the_library(pieces):
    rnd = random.Random(4)
    texts = ["", None, " ", "  a  b\n c▁d <s> <0x0A> é𝒳\x00z", "▁▁▁▁ ▁", "aaaaaaaa" * 90, "abab" * 50, "\n\n", "\t\r\n;\r", "日本語のテキスト" * 9, "=" * 500, "x" + " " * 99 + "y"]
    for _ in range(600):
        letters = rnd.choice(["ab ", "abcde \n", "theraning ", "0123456789.,", "▁ a", "=-*#", "éüößñ en", "一丁日本国 人", "{}();\r\n \t"])
        texts.append("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 150))))
    got, back = encoded(pieces, texts)
    want = [pieces.library.encode(t or "") for t in texts]
    assert got == want and back == [pieces.library.decode(w) for w in want]
    long_word = "".join(rnd.choice("abcdefgh") for _ in range(20000))
    assert encoded(pieces, [long_word])[0] == [pieces.library.encode(long_word)]


def test_decoding_of_any_ids(pieces):
    rnd = random.Random(5)
    for _ in range(400):
        ids = [rnd.randrange(rnd.choice([300, 32000])) for _ in range(rnd.randint(0, 20))]
        assert pieces.decode(np.array(ids, np.int64), np.array([0, len(ids)])).to_pylist() == [pieces.library.decode(ids)]


def test_documents_are_encoded_whole(spark, pieces):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in piece_bpe.query(spark, SMALL).collect():
        ids = pieces.library.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(pieces.library.decode(ids).encode()).hexdigest())
    odd = piece_bpe.digest(piece_bpe.encode_decode(odd_docs(spark).withColumn("IDS", F.lit(1)), piece_bpe.default_model()))
    assert {r.doc_id: r.n_tokens for r in odd.collect()}[1] == 0


# 8 near duplicates


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute_components(docs, words):
    sets = [(i, shingles(t, words)) for i, t in docs]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for k, (i, _) in enumerate(sets):
        groups.setdefault(root(k), []).append(i)
    return sorted(((i, len(s), min(g for g in groups[root(k)])) for k, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("words", [2, 5])
def test_components_of_a_crowd_of_copies(spark, words, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8 * words)  # open buckets are dealt into several blocks
    rnd = random.Random(words)
    vocab = [f"w{k}" for k in range(400)]
    hub = [rnd.choice(vocab) for _ in range(90)]
    docs = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 12)))) for k in range(40)]
    for k in range(40, 160):  # edited copies, many of them too far from the first
        copy = list(hub)
        for _ in range(rnd.randint(0, 7)):
            copy[rnd.randrange(90)] = rnd.choice(vocab)
        docs.append((k, " ".join(copy)))
    docs += [(200, "Hello World"), (201, "hello\tWORLD "), (202, "hello"), (203, None), (204, " \n"), (205, "hello")]
    got = near_dedup.find_components(spark.createDataFrame(docs, "doc_id long, text string"), words)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute_components(docs, words)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_components_of_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert rows(near_dedup.query(spark, SMALL), "doc_id", "n_shingles", "component_id") == brute_components(docs, 2)


def test_components_of_odd_rows(spark):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.find_components(odd_docs(spark), 2).collect()}
    assert got[1, 0] == (1, True) and got[6, 1] == (5, False) and got[5, 1] == (5, True) and got[None, 4] == (None, True)
    assert near_dedup.find_components(odd_docs(spark).limit(0), 2).count() == 0


def test_blocks_lose_no_pair(spark, monkeypatch):
    """Open buckets: every pair of different labels that isn't within the main label meets, however small the blocks."""
    rnd = random.Random(1)
    flat = [0] * near_dedup.PARITY_WORDS
    table = [(b, f"c{k:03}", f"l{rnd.randrange(5)}", f"l{b}", 10, 10, *flat) for b in range(3) for k in range(60) if rnd.random() < 0.8]
    able = spark.createDataFrame(table, "bucket long, cls string, label string, main string, n long, common long, " + ", ".join(f"p{k} long" for k in range(near_dedup.PARITY_WORDS))).withColumn("size", F.lit(48))
    want = {frozenset((x[1], y[1])) for x in table for y in table if x[0] == y[0] and x[2] != y[2] and x[1] < y[1]}
    for block in (1000, 7):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = [frozenset(r) for r in near_dedup._open_pairs(able).collect()]
        assert set(got) == want


def test_dedup_stage_goes_by_id_and_text(spark):
    base = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"v{k}" for k in range(40))
    docs = [(3, base), (7, base), (7, other), (None, base), (None, other + " x"), (9, None), (9, None), (10, ""), (3, base), (11, " ".join(f"u{k}" for k in range(9))), (None, "alone here"), (12, "big " * 30000)]
    df = spark.createDataFrame([(k, t, "en", "a", 1, 2) for k, t in docs], DOCS + ", Digest int")
    got = sorted(((r.doc_id, r.text) for r in near_dedup.stage(spark, df, "").collect()), key=str)
    assert got == sorted([(3, base), (3, base), (7, other), (9, None), (9, None), (10, ""), (11, docs[9][1]), (None, "alone here"), (12, docs[11][1])], key=str)
    assert near_dedup.stage(spark, df.limit(0), "").count() == 0


def test_components_of_many_equal_rows(spark):
    """Rows that repeat id and text don't multiply in the joins."""
    base = [f"w{k}" for k in range(60)]
    near = " ".join([*base[:-1], "z"])
    df = spark.createDataFrame([(1, " ".join(base))] * 3000 + [(2, near)] * 3000, "doc_id long, text string")
    got = near_dedup.find_components(df, 2).groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, got)) == [(1, 1, 3000), (2, 1, 3000)]


def test_sketches_screen_softly():
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 2**63, 400, dtype=np.uint64)
    for same in (0.8, 0.9, 1.0):
        k = round(400 * 2 * same / (1 + same))
        for _ in range(20):
            other = np.concatenate([base[:k], rnd.integers(0, 2**63, 400 - k, dtype=np.uint64)])
            _, _, s = near_dedup.signatures(np.concatenate([np.sort(base), np.sort(other)]), np.array([0, 400, 800]))
            apart = int(np.bitwise_count(s[0] ^ s[1]).sum())
            assert apart <= near_dedup._most_differing_bits()


# 9 urls


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host):], maxsplit=1)[0]


def test_rules(spark):
    urls = [None, "", "nothing", "http://A.Example.NET/en/x?y#z", "http://example.net/en", "https://x.com?q=/a", "http://net/", "http://notexample.net/de/", "http://a.org/fr/1", "http://org/fr/", "http://example.com/de/a://b",
            "http://É.net/x", "a\nb://x.net/\nq", "http://a.net#f", "http://"]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(pages, model=url_filter.UrlModel(None, {}, "allow")).collect()}
    for k, u in enumerate(urls):
        host, path = brute_url(u)
        fits = [(len(r), r, v) for v, r in url_filter.RULES for h, p in [(r.partition("/")[0], "/" + r.partition("/")[2])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, rule, verdict), u


def test_rules_of_a_table_equal_literals(spark):
    rnd = random.Random(9)
    hosts = ["a.b.net", "b.net", "net", "c.net", "xb.net", "org"]
    rules = sorted({(rnd.choice(["block", "allow"]), rnd.choice(hosts) + rnd.choice(["/", "/x", "/x/", "/x/y"])) for _ in range(14)})
    urls = [f"http://{rnd.choice(['', 'w.'])}{rnd.choice(hosts)}{rnd.choice(['', '/', '/x', '/x/yz', '/q'])}" for _ in range(80)] + [None, ""]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    model = url_filter.UrlModel(None, None, "allow")
    table = spark.createDataFrame([(r, v) for v, r in rules], "rule string, verdict string")
    one, two = (url_filter.judge(pages, rules=r, model=model) for r in (tuple(rules), table))
    assert rows(one, "page_id", "host", "path", "rule", "verdict") == rows(two, "page_id", "host", "path", "rule", "verdict")


def test_entropy_of_characters(spark):
    texts = ["", "a", "aab", "Aa", "héé𝒳𝒳", "http://x.y/?q=[a]\\$", "z" * 50000 + "y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", url_filter.entropy_of(F.col("t")).alias("e")).collect():
        shares = [r.t.count(c) / len(r.t) for c in set(r.t)]
        assert abs(r.e + sum(p * np.log2(p) for p in shares)) < 1e-9


def test_url_query_against_sql(spark):
    """Host, path and rule of every page by SQL, whose rules are written out; verdicts follow rule or score; the trees learn what the rules say."""
    got = url_filter.query(spark, SMALL)
    sql = r"""
    WITH p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN regexp_extract(url, '://([^/?#]*)', 1) ELSE '' END AS raw FROM pages),
    h AS (SELECT page_id, translate(coalesce(raw, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, CASE WHEN contains(url, '://') THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM p)
    SELECT page_id, host, coalesce(path, ''), CASE WHEN concat('.', host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/' WHEN concat('.', host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
      WHEN concat('.', host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/' WHEN concat('.', host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END FROM h"""
    assert rows(got, "page_id", "host", "path", "rule") == duck(sql, {"pages": spark.read.parquet(f"{SMALL}/pages.parquet")})
    said = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    table = got.collect()
    assert all(r.verdict == (said[r.rule] if r.rule else "block" if r.score >= 0.5 else "allow") for r in table)
    ruled = [r for r in table if r.rule]
    assert np.mean([(r.score >= 0.5) == (said[r.rule] == "block") for r in ruled]) > 0.9 and len({r.verdict for r in table}) == 2
    odd = spark.createDataFrame([(1, "http://" + "x" * 100000 + ".net/" + "y" * 100000, 0, 1)], "page_id long, url string, Score int, entropy int")
    assert url_filter.judge(odd.unionByName(odd)).select("verdict").distinct().collect()[0][0] == "block"


def test_trees_learn_labels(spark):
    rnd = random.Random(3)
    rows_ = [(f"https://{'spam' if b else 'shop'}{rnd.randrange(99)}.example.{'biz' if b else 'com'}/{'/'.join(str(rnd.randrange(10**6)) for _ in range(5 if b else 1))}", int(b)) for b in (rnd.random() < 0.4 for _ in range(600))]
    df = spark.createDataFrame(rows_, "url string, label int")
    model = url_filter.train(df.limit(400), trees=4, depth=3)
    judged = url_filter.judge(df, rules=(), model=model)
    assert np.mean([(r.verdict == "block") == bool(r.label) for r in judged.collect()]) > 0.95
    assert not re.search("Python|Arrow|Pandas", judged._jdf.queryExecution().executedPlan().toString())
    assert url_filter.judge(df.limit(0)).count() == 0


# 10 mixing


def test_mix_against_sql(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(odd_docs(spark))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.query(spark, str(tmp_path))
    names = ["doc_id", "size", "source_size", "target", "taken", "position"]
    assert rows(got, *names) == duck(mixing.ORACLE_SQL, {"documents": spark.read.parquet(str(tmp_path / "documents.parquet"))})
    assert all(0 <= r.taken <= 2 * r.size for r in got.collect())


def test_targets_reshare_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 400)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 20.0 and got["b"] == 200.0 and got[None] == 800.0 and got["c"] == 1.5 * 1510 - 1020
    assert mixing.source_targets(sizes.limit(0)).count() == 0


def test_positions_follow_the_schedule(spark):
    docs = spark.createDataFrame([(k, "w " * 10, "s", 20) for k in range(400)], "doc_id long, text string, source string, n_chars long")
    got = sorted(r.position for r in mixing.mix(docs, schedules=((2.0, 0.0),), share=1.0).collect())
    for k, t in enumerate(got):
        assert abs((2 * t - t * t) - k / 400) < 1e-6  # the integral of 2 - 2t is the share that came before


def test_takes_come_at_their_own_positions(spark):
    """The order of the stage's takes against a stream built by hand: one source run through again, the last take cut."""
    sizes = {k: 3 + k % 5 for k in range(30)}
    docs = spark.createDataFrame([(k, " ".join(f"d{k}w{n}" for n in range(z)), "s", 1) for k, z in sizes.items()], "doc_id long, text string, source string, n_chars long")
    stream = sorted(sizes, key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
    left, want = int(1.5 * sum(sizes.values()) + 0.5), []
    for k in stream * 2:
        if left > 0:
            want.append((k, min(left, sizes[k])))
            left -= sizes[k]
    got = [(r.doc_id, len(r.text.split())) for r in mixing.stage(spark, docs, "").collect()]
    assert got == want


def test_rows_of_one_key_are_taken_by_number(spark):
    rows_ = [(None, f"text {k} of none", "s", 1) for k in range(40)] + [(7, "same words here", "s", 1)] * 10
    out = mixing.stage(spark, spark.createDataFrame(rows_, "doc_id long, text string, source string, n_chars long").withColumn("Take", F.lit(1)).withColumn("m_size", F.lit(2)), "")
    got = out.collect()
    assert sum(len(r.text.split()) for r in got) == round(1.5 * (160 + 30)) and out.columns == ["doc_id", "text", "source", "n_chars", "Take", "m_size"]
    assert {r.text for r in got if r.doc_id is None and len(r.text.split()) == 4} == {t for _, t, _, _ in rows_[:40]}


def test_mix_stage_repeats_and_cuts(spark):
    docs = spark.createDataFrame([(k, f"a{k} b c d", s, 8) for k in range(20) for s in ("x",)], "doc_id long, text string, source string, n_chars long")
    out = mixing.stage(spark, docs, "").collect()
    assert sum(len(r.text.split()) for r in out) == 120 and len(out) == 30
    assert mixing.stage(spark, docs.limit(0), "").count() == 0
