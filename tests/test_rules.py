"""Rules on small fixtures."""

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators import rules

CHECKS = "snapshot_id string, source string, status string, finished_at int"


@pytest.mark.parametrize(("missing", "category", "want"), [(82, "success", [(360, 82, True)]), (8, "success", [(360, 8, False)]), (82, "partial", [])])
def test_divergence(spark, missing, category, want):
    matches = spark.createDataFrame([("s", f"i{n}", f"f{n}" if n >= missing else None) for n in range(360)] + [("s", "i359", None)], "snapshot_id string, storefront_item_id string, feed_item_id string")
    checks = spark.createDataFrame([("s", "feed", "timeout", 1), ("s", "feed", "success", 2), ("s", "category", category, 1), ("t", "feed", "success", 1)], CHECKS)
    assert [tuple(r)[1:4] for r in rules.source_divergence(matches, checks).collect()] == want


SIDE = "item_id string, url string, title string, price string, currency string, availability string"
MATCH = "snapshot_id string, feed_item_id string, storefront_item_id string, match_method string, match_confidence double"


def price_tables(spark, pairs):
    """matches and items of (snapshot, feed side, shop side, method, confidence); a side is (url, title, price, currency, availability)."""
    items = [(f"f{k}", *f) for k, (_, f, _, _, _) in enumerate(pairs)] + [(f"s{k}", *s) for k, (_, _, s, _, _) in enumerate(pairs)]
    matches = [(snapshot, f"f{k}", f"s{k}", method, confidence) for k, (snapshot, _, _, method, confidence) in enumerate(pairs)]
    return spark.createDataFrame([*matches, ("a", "f0", None, "offer_id", 1.0)], MATCH), spark.createDataFrame(items, SIDE)


def pair(snapshot, n, price="11.00", feed="EUR", shop="EUR", state="in stock", method="offer_id", confidence=0.98, url=None):
    return (snapshot, (f"u{n}", "t", "10.00", feed, "available"), (url, None, price, shop, state), method, confidence)


def passed(spark, snapshots):
    return spark.createDataFrame([(s, x, "success", 1) for s in snapshots for x in ("feed", "product_page")], CHECKS)


def test_prices_and_availability(spark):
    def some(snapshot, bad, **more):
        return [pair(snapshot, n, "11.00" if n < bad else "10", state="sold out" if n == 0 else "in_stock", **more) for n in range(25)]

    checks = passed(spark, "abc").unionByName(spark.createDataFrame([("d", "feed", "success", 1)], CHECKS))
    tables = price_tables(spark, some("a", 5) + some("b", 4) + some("c", 25, confidence=0.5) + some("d", 9) + some("a", 25, method="fallback"))
    got = {r.snapshot_id: (r.compared, r.price_bad, r.availability_bad, r.total_affected, r.is_open) for r in rules.price_availability(*tables, checks).collect()}
    assert got == {"a": (25, 5, 1, 5, True), "b": (25, 4, 1, 0, False)}


def test_match_rows_count_and_names_are_distinct(spark):
    """A product that is matched three times counts three times; what is affected counts by address and title."""
    rows = [pair("a", n % 2, url="same" if n < 3 else None) for n in range(6)] + [pair("a", 9, "10.00") for _ in range(14)]
    got = rules.price_availability(*price_tables(spark, rows), passed(spark, "a")).collect()
    assert [(r.compared, r.price_bad, r.signals, r.total_affected, r.is_open) for r in got] == [(20, 6, ["price_mismatch_count"], 3, False)]
    apart = rows[:6] + [pair("a", 20 + n) for n in range(2)] + [pair("a", 9, "10.00") for _ in range(12)]
    got = rules.price_availability(*price_tables(spark, apart), passed(spark, "a")).collect()
    assert [(r.price_bad, r.total_affected, r.is_open) for r in got] == [(8, 5, True)]


def test_currencies_and_signals_apart(spark):
    """Currencies compare upper-cased, a missing one doesn't; each signal needs its own count."""
    data = [pair("a", n, "11.00" if n < 5 else "10.00", "eur") for n in range(20)] + [pair("b", n, feed=None, shop=None) for n in range(20)]
    data += [pair("c", n, "11.00" if n < 4 else "10.00", state="unavailable" if 4 <= n < 8 else "in stock") for n in range(20)] + [pair("d", n, "11.00" if n < 4 else "10.00") for n in range(19)]
    got = {r.snapshot_id: (r.price_bad, r.availability_bad, r.signals, r.total_affected, r.is_open) for r in rules.price_availability(*price_tables(spark, data), passed(spark, "abcd")).collect()}
    assert got == {"a": (5, 0, ["price_mismatch_count"], 5, True), "b": (0, 0, [], 0, False), "c": (4, 4, [], 0, False), "d": (4, 0, [], 0, False)}


def test_thresholds_of_the_rows(spark):
    rows = rules.match_rows(*price_tables(spark, [pair("a", n, "10.05" if n < 3 else "10.00") for n in range(10)]), passed(spark, "a"))
    asked = spark.createDataFrame([(1, 3, 0.3, 10, 0.05), (2, 3, 0.31, 10, 0.05), (3, 3, 0.3, 11, 0.05), (4, 3, 0.3, 10, 0.06), (5, None, None, None, None)], "set int, minimum_affected_count int, minimum_affected_ratio double, minimum_comparable_matches int, price_absolute double")
    got = {r.set: (r.enough, r.is_open, r.price_bad) for r in rules.price_signals(rows.crossJoin(asked), ["set"]).collect()}
    assert got == {1: (True, True, 3), 2: (True, False, 3), 3: (False, False, 3), 4: (True, False, 0), 5: (False, False, 3)}


def test_seo(spark):
    rows = [(s, f"u{n}", ("noindex" if n < 6 else None) if s == "s2" else None, "different" if s == "s2" and n < 5 else "missing" if s == "s2" and n == 5 else "self", None if s == "s2" and n < 2 else True, 404 if s == "s2" and n == 0 else 200)
            for s in ("s1", "s2", "s3", "s5") for n in range(25 if s != "s3" else 10)]
    items = spark.createDataFrame(rows, "snapshot_id string, stable_key string, indexability string, canonical_state string, schema_valid boolean, http_status int")
    same = tuple(rules.SAMPLE.values())
    table = [("s1", "a", 1, "m", *same, 25, 25, 0), ("s2", "a", 2, "m", *same, 25, 25, 0), ("s3", "a", 3, "m", *same, 25, 25, 0), ("s4", "a", 4, "other", *same, 25, 25, 0), ("s5", "a", 5, "m", *same, 25, 10, 15), ("s6", "b", 1, "m", *same, 25, 25, 0)]
    snapshots = spark.createDataFrame(table, "snapshot_id string, store_id string, finished_at int, urls_hash string, " + ", ".join(f"{c} string" for c in rules.SAMPLE) + ", selected_count int, comparable_checks int, failed_checks int")
    (r,) = rules.seo_regression(items, snapshots).collect()
    assert (r.snapshot_id, r.previous_id, r.common, r.noindex, r.canonical_away, r.schema_missing, r.http_error) == ("s2", "s1", 25, 6, 5, 2, 1)
    assert (r.signals, r.affected, r.confidence, r.is_open) == (["noindex", "canonical_away"], 6, 0.7, True)


def test_wordings(spark):
    from shelfwatch.functions import columns as C

    want = {"unavailable": "out_of_stock", "not_in_stock": "unknown", "In Stock": "in_stock", " in stock": "unknown", "http://schema.org/InStock": "in_stock", "": "unknown", None: "unknown", "on_backorder": "backorder", "pre-order": "unknown", "PreOrder": "preorder"}
    df = spark.createDataFrame([(w,) for w in want], "w string")
    assert {r.w: r.a for r in df.select("w", C.availability(df["w"]).alias("a")).collect()} == want
    prices = {"": None, "EUR": 0.0, "1,50": 1.5, "1.2.3": None, "-": None, None: None, "12.": 12.0}
    df = spark.createDataFrame([(w,) for w in prices], "w string")
    assert {r.w: r.a for r in df.select("w", C.price_number(df["w"]).alias("a")).collect()} == prices


def test_two_strikes_of_comparable_snapshots(spark):
    from shelfwatch.operators import lifecycle

    said = [("s1", True, True), ("s1", True, True), ("s2", True, False), ("s3", True, True), ("s3", True, True), ("s4", False, True), ("s5", True, True)]
    df = spark.createDataFrame([(1, n, *x) for n, x in enumerate(said)], "k int, at int, snapshot string, bad boolean, can boolean")
    got = lifecycle.two_strikes(df, ["k"], "at", F.col("bad"), F.col("can"), "snapshot").orderBy("at").collect()
    assert [r.debounce for r in got] == ["pending", "pending", "not_comparable", "confirmed", "confirmed", "healthy", "pending"]


def test_malformed_cursors():
    from shelfwatch.operators import store

    assert store.decode_cursor(store.encode_cursor((1, "ä"))) == (1, "ä")
    for cursor in ("", "%%%", "e30", "x" * 5000, store.encode_cursor((1,))[:-2]):
        with pytest.raises(ValueError):
            store.decode_cursor(cursor)


def test_triage_limits(spark):
    from shelfwatch.operators import reports

    kinds = f"incident_id int, position int, stable_key string, offer_id string, title string, issues array<{reports.ISSUE}>"
    many = [(f"c{k:03}", "Warning", f"a{k}") for k in range(120)]
    table = [(1, 1, None, " o1 ", None, [("x", "error", None), ("x", "ERROR", "unknown"), (" ", "error", "b"), ("y", None, "b")]), (1, 2, "k2", None, None, many), (1, 3, None, None, None, [("x", "error", "z")]), (1, 4, "k4", None, "t", None), (2, 1, "k", None, None, [])]
    df = spark.createDataFrame(table, kinds)
    groups = {(r.incident_id, r.code): (r.rank, r.issue_count, r.product_count, r.priority, r.severities, r.attributes) for r in reports.issue_groups(df).collect()}
    assert len(groups) == 100 and groups[1, "x"] == (1, 1, 1, "critical", ["error"], ["unknown"]) and groups[1, "y"] == (100, 1, 1, "normal", ["unknown"], ["b"]) and (1, "c098") not in groups
    shown = reports.issue_products(df).orderBy("rank").collect()
    assert [(r.stable_key, r.offer_id, r.priority, r.issue_count, len(r.issue_codes)) for r in shown] == [(None, "o1", "critical", 2, 2), ("k2", None, "high", 100, 16)]
    totals = {r.incident_id: tuple(r)[1:] for r in reports.issue_totals(df).collect()}
    assert totals == {1: (2, 102, False, True, True), 2: (0, 0, False, False, False)}
    queue = reports.remediation_rows(df.withColumn("item_id", F.col("position")), code="c001").collect()
    assert [(r.item_id, r.issue_count, r.priority_rank, r.truncated) for r in queue] == [(2, 100, 2, True)]


def test_feed_health(spark):
    said = ["timeout", "blocked", "authentication_failed", "success", "parse_failed", "parse_failed", "partial", "timeout"]
    df = spark.createDataFrame([("s", "u", n, x) for n, x in enumerate(said)] + [("s", "new", 9, "timeout")], "store_id string, url string, at int, status string")
    got = [(r.streak, r.action) for r in rules.feed_health(df, ["store_id", "url"], ["at"]).orderBy("at").collect()]
    assert got == [(1, "wait"), (2, "open"), (3, "open"), (0, "recover"), (1, "open"), (2, "wait"), (0, "ignore"), (1, "wait"), (1, "wait")]


def test_merchant_issues_and_outcomes(spark):
    df = spark.createDataFrame([("s", "p", [("ERROR",)]), ("s", "q", []), ("s", "r", None), ("t", "p", [("info",)])], "snapshot_id string, product string, issues array<struct<severity:string>>")
    got = {r.snapshot_id: tuple(r)[1:] for r in rules.merchant_item_issues(df).collect()}
    assert got == {"s": (3, 1, "critical", True), "t": (1, 1, "warning", True)}
    bands = spark.createDataFrame([(0.3, 30), (0.05, 5), (0.3, 5)], "x double, n int").select(rules.recovery_outcome(F.col("x"), F.col("n"), 0.1, 20).alias("o"))
    assert [r.o for r in bands.collect()] == ["unhealthy", "healthy", "not_comparable"]
