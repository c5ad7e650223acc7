"""JSON of any depth, product pages, chat messages, payload states and replaced snapshots."""

import datetime as dt
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators import messages, snapshots
from shelfwatch.sources import category, nested, product_page


def test_stack_reads_what_the_library_reads():
    rnd = random.Random(6)

    def value(depth):
        kind = rnd.randint(0, 8) if depth else rnd.randint(3, 8)
        if kind == 0:
            return [value(depth - 1) for _ in range(rnd.randint(0, 4))]
        if kind <= 2:
            return {rnd.choice(["a", "b", "", "\\", "é\n"]): value(depth - 1) for _ in range(rnd.randint(0, 4))}
        return rnd.choice([None, True, False, 0, -1.5e10, "x", 'q"\\/   🙂', ""])

    for _ in range(400):
        v = value(5)
        for text in (json.dumps(v), json.dumps(v, indent=1, ensure_ascii=False), f" {json.dumps(v)}\r\n"):
            assert nested._by_stack(text) == v == nested.loads(text)


@pytest.mark.parametrize("text", ["", " ", "[", "]", "[1,]", "[,1]", "{\"a\"}", "{\"a\":}", "{\"a\":1,}", "{,}", "{1:2}", "[1 2]", "1 2", "[1}", "{\"a\":1]", "[:1]", "NaN", "[01]", "'a'", "\"a", "[\"a\tb\"]", "{\"a\":1 \"b\":2}", ",", "tru"])
def test_stack_refuses_what_is_no_json(text):
    with pytest.raises(ValueError):
        nested._by_stack(text)
    with pytest.raises(ValueError):
        nested.loads(text)


def test_depth_of_ten_thousand():
    deep = '{"x":[' * 10000 + '{"@type":"Product","name":"deep"}' + "]}" * 10000
    assert nested.first(["no json", deep], lambda n: n.get("@type") == "Product") == {"@type": "Product", "name": "deep"}
    page = f'<script type="application/ld+json">{deep}</script>'
    assert product_page.parse(page)[2:4] == (True, "deep")
    assert category.parse_category('<script type="application/json">' + '{"x":[' * 10000 + '{"products":[{"handle":"a"}]}' + "]}" * 10000 + "</script>", "https://a.example/c")[:2] == (1, ["https://a.example/products/a"])


def seen(html, header=None):
    return dict(zip([n for n, _ in product_page.FIELDS], product_page.parse(html, header), strict=True))


def test_first_match_wins_and_sources_follow_each_other():
    linked = '<script type="application/ld+json">{"@graph":[{"@type":["Thing","Product"],"name":["P"],"offers":[[{"price":79.0,"sale_price":"70","priceCurrency":"EUR"}]]},{"@type":"Product","name":"second"}]}</script>'
    embedded = '<script type="application/json">[{"k":{"type":"Product","title":"E","price":5,"availability":" sold out "}}]</script>'
    got = seen(embedded + linked)
    assert (got["strategy"], got["title"], got["base_price"], got["sale_price"], got["currency"], got["schema_present"]) == ("json_ld", "P", "79", "70", "EUR", True)
    got = seen('<script type="application/ld+json">{"@type":"Other"}</script>' + embedded)
    assert (got["strategy"], got["title"], got["base_price"], got["availability"], got["schema_present"]) == ("embedded_json", "E", "5", "sold out", False)
    tags = '<title>T</title><h1> Head <b>line</b></h1><meta property="og:image" content="/i.png"><img src="x"><b data-price="9">8</b><span class="a price">7</span><meta itemprop="priceCurrency" content="USD"><a href="x"></a>'
    got = seen(tags)
    assert (got["strategy"], got["title"], got["image_raw"], got["base_price"], got["currency"], got["links"]) == ("html", "Head line", "/i.png", "9", "USD", 1)
    assert seen('<meta name="robots" content="NoIndex">')["noindex"] and seen("", "noindex, follow")["noindex"] and not seen('<meta name="other" content="noindex">')["noindex"]
    assert seen(None) == seen("") and seen(None)["strategy"] == "html" and seen(None)["title"] is None


def test_observations_and_items(spark):
    rows = [(1, "https://A.example/p/?b=1", "https://a.example/p", 200, None, '<link rel="canonical" href="/p#x"><script type="application/ld+json">{"@type":"Product","name":"N"}</script>'),
            (2, "https://a.example/q", "https://a.example/q", 404, "noindex", '<link rel="canonical" href="https://b.example/">'), (3, "https://a.example/r", "https://a.example/r", None, None, None), (4, "https://a.example/s", "https://a.example/s", 500, None, "")]
    got = product_page.observations(spark.createDataFrame(rows, "id int, url string, final_url string, http_status int, robots_header string, html string"))
    assert {r.id: (r.indexability, r.canonical_state, r.schema_valid) for r in got.collect()} == {1: ("indexable", "self", True), 2: ("noindex", "different", False), 3: ("unknown", "missing", False), 4: ("unknown", "missing", False)}
    items = {r.id: r for r in product_page.page_items(got).collect()}
    want = '{"finalUrl":"https://a.example/p","httpStatus":200,"indexability":"indexable","canonicalUrl":"https://a.example/p#x","canonicalState":"self","schemaPresent":true,"schemaValidEnough":true}'
    assert items[1].raw_hash == hashlib.sha256(want.encode()).hexdigest() and items[1].stable_key == "url:" + items[1].url
    assert items[3].raw_hash == hashlib.sha256(b'{"finalUrl":"https://a.example/r","indexability":"unknown","canonicalState":"missing","schemaPresent":false,"schemaValidEnough":false}').hexdigest()


def test_lines_are_never_cut(spark):
    cases = [["a"], ["x" * 3896], ["x" * 3897], ["x" * 3000, "y" * 895], ["x" * 3000, "y" * 896], ["🔴" * 1948], ["🔴" * 1949], [], ["", ""], ["a"] * 2500]
    got = [r.t for r in spark.createDataFrame(list(enumerate(cases)), "k int, lines array<string>").select("k", messages.fitted(F.col("lines")).alias("t")).orderBy("k").collect()]
    for lines, text in zip(cases, got, strict=True):
        kept, size = [], lambda s: len(s.encode("utf-16-be")) // 2
        for line in lines:
            if size("\n".join([*kept, line])) + 4 > 3900:
                kept = ["\n".join(kept) + "\n..."]
                break
            kept.append(line)
        assert text == "\n".join(kept) and size(text) <= 3900


def test_units_of_shortened_texts(spark):
    texts = ["a" * 10, "a" * 11, "aaaaaa🙂bbbb", "🙂🙂🙂🙂🙂", "🙂🙂🙂🙂🙂🙂", "aaaaaaé" + "b" * 9, ""]
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "k int, v string").select("k", messages.bounded_units(F.col("v"), 10).alias("t")).orderBy("k").collect()]
    assert got == ["a" * 10, "a" * 7 + "...", "aaaaaa...", "🙂🙂🙂🙂🙂", "🙂🙂🙂...", "aaaaaaé...", ""]


def payload(**more):
    body = {"version": "v1", "alertType": "incident_opened", "store": {"id": "s", "name": "A & <B>", "domain": "d"},
            "incident": {"id": "i", "type": "source_health", "severity": "warning", "title": "t", "summary": "It's down", "status": "open", "affectedCount": 3, "likelySource": "feed", "confidenceScore": 0.875, "firstDetectedAt": "x"},
            "metrics": [{"name": "source_check_failure_count", "beforeValue": None, "afterValue": "2", "unit": "checks"}], "evidence": ["Feed source check returned parse_failed "], "samples": [{"url": "u"}], "event": {"id": "e", "type": "t", "reason": None, "occurredAt": "x"}}
    return json.dumps({k: {**v, **more[k]} if isinstance(v, dict) and k in more else more.get(k, v) for k, v in body.items()})


def test_templates(spark):
    rows = [("health", payload()), ("drop", payload(incident={"type": "catalog_drop"})), ("worse", payload(alertType="incident_worsened", incident={"type": "seo_regression", "likelySource": None, "confidenceScore": None})),
            ("done", payload(alertType="incident_resolved", event={"reason": "two good checks"})), ("bad", "no json"), ("null", None)]
    got = {r.event_id: r.text for r in messages.chat_texts(spark.createDataFrame(rows, "event_id string, payload string")).collect()}
    store, proof = "<b>Store:</b> A &amp; &lt;B&gt; (d)", "\n\n<b>Evidence</b>\n• Feed source check returned parse_failed \n\n<b>Examples</b>\n• u — u"
    metric = "<b>Source Check Failure Count:</b> unknown → 2 checks"
    assert got["health"] == f"<b>⚠️ Feed monitoring failure</b>\n{store}\nIt&#39;s down\n<b>Products are not confirmed missing.</b>\n<b>Status:</b> parse_failed\n<b>Consecutive failures:</b> 2{proof}"
    assert got["drop"] == f"<b>🔴 Catalog drop detected</b>\n{store}\n<b>Affected:</b> 3\n{metric}\n<b>Confidence:</b> 88%\n<b>Likely source:</b> feed{proof}"
    assert got["worse"] == f"<b>🔴 Incident worsened: SEO regression</b>\n{store}\n<b>Affected:</b> 3\n{metric}{proof}"
    assert got["done"] == f"<b>✅ Incident resolved</b>\n{store}\n<b>Incident:</b> Feed monitoring failure\nIt&#39;s down\n{metric}\n<b>Recovery:</b> two good checks"
    assert got["bad"] is None and got["null"] is None


def test_replacing_leaves_other_snapshots_files(spark, tmp_path):
    path = str(tmp_path / "matches")
    rows = spark.createDataFrame([(s, f"k{n}", n) for s in ("a", "b", "c") for n in range(5)], "snapshot_id string, matched_key string, n int")
    snapshots.replace_snapshots(rows, rows.select("snapshot_id"), path)

    def files(s):
        return {(f, os.stat(f"{path}/snapshot_id={s}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/snapshot_id={s}") if f.endswith(".parquet")}

    before = {s: files(s) for s in "abc"}
    asked = spark.createDataFrame([("b",), ("c",), ("new",)], "snapshot_id string")
    some = rows.where("snapshot_id <> 'c' and n < 2")  # a is in the rows, but nobody asks for it
    for _ in range(2):  # a rerun changes nothing
        snapshots.replace_snapshots(some, asked, path)
        got = sorted((r.snapshot_id, r.n) for r in snapshots.read_snapshots(spark, path).collect())
        assert got == [("a", n) for n in range(5)] + [("b", 0), ("b", 1)]
    assert files("a") == before["a"] and not files("b") & before["b"]


def test_first_confirmation_of_a_ready_baseline(spark):
    t = dt.datetime(2026, 1, 1)
    metrics = spark.createDataFrame([(k, "s", 1, status, end, None, None) for k, (status, end) in enumerate([("ready_for_confirmation", None), ("ready_for_confirmation", t), ("learning", None), ("ready_for_confirmation", None)])],
                                    "baseline_id int, store_id string, version int, status string, valid_to timestamp, confirmed_by string, confirmed_at timestamp")
    asked = spark.createDataFrame([(0, "late", t + dt.timedelta(1)), (0, "first", t), (1, "x", t), (2, "x", t)], "baseline_id int, by string, at timestamp")
    assert {r.baseline_id: (r.status, r.confirmed_by) for r in snapshots.confirmed_baseline(metrics, asked).collect()} == {0: ("active", "first"), 1: ("ready_for_confirmation", None), 2: ("learning", None), 3: ("ready_for_confirmation", None)}
