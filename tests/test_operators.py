"""Golden cases of functions and operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwatch.functions import columns as C
from shelfwatch.operators import baseline, identity, lifecycle, store
from shelfwatch.sources import landed


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], f"k int, x {kind}")
    return [r.y for r in df.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_text(spark):
    assert values(spark, C.offer_key, [" SKU \t 1 ", "", None, "A b"]) == ["sku 1", None, None, "a b"]
    assert values(spark, C.token, ["Price Mismatch!", "__a--b__", None]) == ["price_mismatch", "a_b", None]
    assert values(spark, C.url_key, ["HTTPS://Shop.Example:443/a/b/?q=1#f", "http://x.example", "ftp://x", "nothing", None]) == [
        "https://shop.example/a/b", "http://x.example/", None, None, None]
    assert values(spark, C.price_number, ["12,50 EUR", "1.234,50", "abc", "79.00 USD", None]) == [12.5, None, 0.0, 79.0, None]
    assert values(spark, C.availability, ["In Stock", "out-of-stock", "pre-order", "preorder", "https://schema.org/OutOfStock", None]) == [
        "in_stock", "out_of_stock", "unknown", "preorder", "out_of_stock", "unknown"]
    assert [tuple(x) for x in values(spark, C.money, ["12,50 eur", "7", "x 7"])] == [(12.5, "EUR"), (7.0, None), (None, None)]
    assert values(spark, C.escaped_html, ["<a & 'b'>"]) == ["&lt;a &amp; &#39;b&#39;&gt;"]
    assert values(spark, lambda x: C.shortened(x, 5), ["abcdef", "abcde"]) == ["ab...", "abcde"]
    assert C.like_pattern("a_b%c\\") == "a\\_b\\%c\\\\"


def test_baseline_of_seven(spark):
    rows = [("s", dt.date(2026, 7, n), 639 + n, True, "c") for n in range(1, 8)] + [("s", dt.date(2026, 7, 8), 5, False, "c"), ("t", dt.date(2026, 7, 1), 3, True, "c")]
    df = spark.createDataFrame(rows, "k string, at date, value long, comparable boolean, config string")
    got = {r.k: r for r in baseline.latest(df, ["k"]).collect()}
    assert (got["s"].median_value, got["s"].min_value, got["s"].max_value, got["s"].sample_count, got["s"].status) == (643.0, 640, 646, 7, "ready")
    assert round(got["s"].p10_value, 6) == 640.6 and round(got["s"].p90_value, 6) == 645.4
    assert got["t"].status == "learning"


def test_baseline_starts_again_with_a_new_configuration(spark):
    rows = [("s", dt.date(2026, 7, n), 640, True, "old") for n in range(1, 8)] + [("s", dt.date(2026, 7, 8), 800, True, "new")]
    df = spark.createDataFrame(rows, "k string, at date, value long, comparable boolean, config string")
    (r,) = baseline.latest(df, ["k"]).collect()
    assert (r.config, r.median_value, r.sample_count) == ("new", 800.0, 1)


@pytest.mark.parametrize(("median", "now", "drop"), [(1000.0, 790, True), (1000.0, 801, False), (50.0, 35, False), (0.0, 0, False)])
def test_drop(spark, median, now, drop):
    assert spark.range(1).select(baseline.is_drop(F.lit(median), F.lit(now)).alias("x")).first().x is drop


def test_mapping_joins_by_offer_before_key(spark):
    """Offers win over keys, white space and case don't count, and an offer that one side has twice is ambiguous."""
    feed = [("1", "Pear  Tree", "p"), ("2", "plum", "q"), ("3", "PLUM ", "r"), ("4", None, "ÄPFEL"), ("5", "fig", "s")]
    merchant = [("1", "pear tree", "other"), ("2", "Plum", "q"), ("3", None, " äpfel "), ("4", "kiwi", "t")]
    got = identity.cross_source_mapping(*(spark.createDataFrame(x, "id string, offer_id string, stable_key string") for x in (feed, merchant)))
    assert {r.status: r["count"] for r in got.groupBy("status").count().collect()} == {"matched": 2, "ambiguous": 1, "feed_only": 1, "merchant_only": 1}


def test_unlike_offers_of_one_key_stay_apart(spark):
    schema = "id string, offer_id string, stable_key string"
    got = identity.cross_source_mapping(spark.createDataFrame([("1", "a", "k"), ("2", None, None)], schema), spark.createDataFrame([("1", "b", "k")], schema))
    assert sorted((r.identity, r.status) for r in got.collect()) == [("offer:a", "feed_only"), ("offer:b", "merchant_only"), ("unidentified:2", "ambiguous")]


def test_recovery(spark):
    steps = [("s1", True, True), ("s1", True, True), ("s2", False, True), ("s3", True, False), ("s4", True, True), ("s5", True, True), ("s6", True, True)]
    rows = [("i", n, s, c, h) for n, (s, c, h) in enumerate(steps)]
    df = spark.createDataFrame(rows, "incident_id string, at int, snapshot string, comparable boolean, healthy boolean")
    got = [(r.status, r.event) for r in lifecycle.recovery_fold(df, "incident_id", "at").orderBy("at").collect()]
    assert got == [("recovering", "recovery_started"), ("recovering", ""), ("recovering", ""), ("open", "reopened"), ("recovering", "recovery_started"), ("resolved", "resolved"), ("resolved", "")]


def test_streamed_recovery_equals_the_fold(spark, tmp_path):
    from shelfwatch.streaming.recovery import recovery_stream

    schema = "incident_id string, at int, snapshot string, comparable boolean, healthy boolean"
    rows = [(f"i{n % 3}", n, f"s{n // 4}", n % 5 != 0, n % 7 < 4) for n in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k * 20: k * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = (recovery_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("memory")
         .queryName("recovered").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    streamed = sorted(tuple(r) for r in spark.table("recovered").collect())
    assert streamed == sorted(tuple(r) for r in lifecycle.recovery_fold(spark.createDataFrame(rows, schema), "incident_id", "at").collect())


def test_pages_and_cursors(spark):
    df = spark.createDataFrame([(n % 4, n) for n in range(60)], "a int, b int")
    seen, after = [], None
    while True:
        rows = [tuple(r) for r in store.page(df, [("a", True), ("b", False)], 25, after).collect()]
        seen += rows[:25]
        if len(rows) <= 25:
            break
        after = store.decode_cursor(store.encode_cursor(rows[24]))
    assert seen == sorted(((n % 4, n) for n in range(60)), key=lambda r: (-r[0], r[1]))


def test_merge_keeps_what_the_newer_version_lacks(spark):
    df = spark.createDataFrame([("k", 1, "t", 5.0), ("k", 2, "u", None)], "k string, seq int, title string, price double")
    assert [tuple(r) for r in store.merge_latest(df, ["k"], "seq", ["price"]).collect()] == [("k", 2, "u", 5.0)]


def test_feed(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(
        '<?xml version="1.0"?><rss xmlns:g="http://base.google.com/ns/1.0"><channel>'
        "<item><g:id> SKU-1 </g:id><title>One</title><link>https://a.example/1?x=1</link><g:price>99.00 USD</g:price><g:sale_price>79.00 USD</g:sale_price></item>"
        "<item><g:id>sku-1</g:id><title>One</title><link>https://a.example/1?x=1</link><g:price>99.00 USD</g:price><g:sale_price>79.00 USD</g:sale_price></item>"
        "<item><g:id>sku-1</g:id><title>Other</title></item><item><title>none</title></item><item><link>https://a.example/2/</link></item></channel></rss>")
    got = {r.stable_key: r for r in landed.feed_items(landed.read_feed(spark, str(tmp_path))).collect()}
    assert set(got) == {"offer:sku-1", "url:https://a.example/2"}
    assert got["offer:sku-1"].skipped == 1
    assert landed.unsafe_files(spark, str(tmp_path)).count() == 0


def test_merchant_status(spark):
    import json

    body = json.dumps({"aggregateProductStatuses": [{"stats": {"activeCount": "10", "pendingCount": "2", "disapprovedCount": 1}}, {"stats": {"activeCount": "4", "pendingCount": "1", "disapprovedCount": "0"}}, {"stats": {"activeCount": "x"}}]})
    (r,) = landed.merchant_status(spark.createDataFrame([("s", body)], "store_id string, body string")).collect()
    assert (r.total, r.approved, r.pending, r.disapproved, r.skipped, r.status) == (18, 14, 3, 1, 1, "partial")
