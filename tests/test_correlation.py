"""Correlation of feed and merchant account, baseline versions, merchant products, feeds and addresses."""

import json

import pytest

from shelfwatch.functions import columns as C
from shelfwatch.operators import alerts, baseline, correlation
from shelfwatch.sources import category, landed, merchant

GOOD = {"type": "catalog_drop", "candidate": "confirmed", "incident": "open", "recorded": False, "pct": 0.2, "snapshot": "completed", "config": "c", "feed": 500, "identity": True, "approved": 480,
        "history": 8, "comparable": True, "ambiguous": 0, "truncated": False, "matched": 480, "merchant_only": 120}
CASES = [({}, "correlated"), ({"type": "other"}, "candidate_context_unavailable"), ({"candidate": "expired"}, "candidate_context_unavailable"), ({"incident": "resolved"}, "incident_unavailable"),
         ({"recorded": True, "pct": 7.0}, "already_recorded"), ({"pct": 1.5}, "captured_thresholds_invalid"), ({"pct": None}, "captured_thresholds_invalid"),
         ({"snapshot": "partial"}, "snapshot_or_configuration_unavailable"), ({"config": None}, "snapshot_or_configuration_unavailable"), ({"identity": False}, "source_checks_incomplete"),
         ({"approved": -1}, "snapshot_or_configuration_unavailable"), ({"feed": 700, "matched": 680}, "feed_drop_not_confirmed"), ({"history": 6}, "merchant_baseline_unavailable"),
         ({"approved": 640}, "merchant_approved_drop_not_confirmed"), ({"comparable": None}, "mapping_incompatible"), ({"ambiguous": 1}, "mapping_ambiguous"), ({"truncated": True}, "mapping_truncated"),
         ({"matched": 479}, "mapping_feed_count_mismatch"), ({"merchant_only": 0}, "mapping_has_no_merchant_only_products"), ({"merchant_only": 30}, "mapping_identity_loss_not_confirmed")]


def test_correlation_ladder(spark):
    candidates, incidents, recorded, snapshots, checks, mapping = [], [], [], [], [], []
    for k, (change, _) in enumerate(CASES):
        x, store, snap = GOOD | change, f"s{k}", f"n{k}"
        candidates.append((f"k{k}", f"i{k}", store, x["type"], x["candidate"], snap, "later", 700.0, x["pct"], 20.0))
        incidents.append((f"i{k}", x["incident"]))
        recorded += [(f"i{k}",)] * x["recorded"]
        snapshots.append((snap, store, x["snapshot"], x["config"], x["feed"], 100))
        own = x["config"] or "c"
        checks += [(f"a{k}", snap, "feed", "success", None, None, None, None, None, None, 100),
                   (f"b{k}", snap, "merchant_status", "success", own, None, x["approved"], 10, 10, x["approved"] + 20, 101),
                   (f"c{k}", snap, "merchant_identity", "success", own, x["identity"], None, None, None, None, 102)]
        for h in range(x["history"] + 1):  # the last comes after the candidate's and doesn't count
            at = 10 + h if h < x["history"] else 200
            snapshots.append((f"{snap}-{h}", store, "completed", "c", 700, at))
            checks += [(f"b{k}-{h}", f"{snap}-{h}", "merchant_status", "success", "c", None, 660 + h, 0, 0, 660 + h, at), (f"c{k}-{h}", f"{snap}-{h}", "merchant_identity", "success", "c", True, None, None, None, None, at)]
        mapping.append((snap, x["comparable"], x["matched"], 20, x["merchant_only"], x["ambiguous"], x["truncated"]))
    got = correlation.feed_merchant_correlation(
        spark.createDataFrame(candidates, "candidate_id string, incident_id string, store_id string, type string, status string, first_snapshot_id string, confirmation_snapshot_id string, baseline_median double, percent_threshold double, absolute_threshold double"),
        spark.createDataFrame(incidents, "incident_id string, status string"), spark.createDataFrame(recorded, "incident_id string"),
        spark.createDataFrame(snapshots, "snapshot_id string, store_id string, status string, config string, feed_count long, created_at int"),
        spark.createDataFrame(checks, "check_id string, snapshot_id string, source string, status string, config string, complete boolean, approved long, pending long, disapproved long, total long, finished_at int"),
        spark.createDataFrame(mapping, "snapshot_id string, comparable boolean, matched long, feed_only long, merchant_only long, ambiguous long, truncated boolean"))
    rows = {r.candidate_id: r for r in got.collect()}
    assert [rows[f"k{k}"].reason for k in range(len(CASES))] == [want for _, want in CASES]
    assert rows["k0"].merchant_median == 663.5 and rows["k0"].confidence_floor == 0.95 and rows["k4"].correlated and not rows["k1"].correlated


def test_baseline_versions(spark):
    stats = (500.0, 490.0, 510.0, 491.0, 509.0, 8, 0, 8)
    current = spark.createDataFrame([("near", 3, "active", "c", 1, *stats), ("held", 1, "active", "c", 1, *stats), ("turned", 2, "active", "old", 1, *stats), ("short", 2, "ready", "old", None, *stats), ("quiet", 5, "ready", "c", None, *stats)],
                                    "store string, version int, status string, config string, confirmed_at int, median_value double, min_value double, max_value double, p10_value double, p90_value double, sample_count long, window_start int, window_end int")
    seen = [(s, n, v, True, "c") for s in ("near", "held", "turned", "new") for n, v in enumerate([500.0] * 7 + [600.0 - 20 * (s == "near"), 100.0])] + [("short", 1, 5.0, True, "c"), ("null", 1, None, True, "c")]
    got = baseline.revised(current, spark.createDataFrame(seen, "store string, at int, value double, comparable boolean, config string"), spark.createDataFrame([("held",), ("held",)], "store string"), ["store"])
    rows = sorted((r.store, r.version, r.status, r.action, r.sample_count, r.min_value) for r in got.collect())
    assert rows == [("held", 1, "active", "unchanged", 8, 490.0), ("near", 3, "active", "updated", 8, 500.0), ("new", 1, "ready", "inserted", 9, 100.0), ("quiet", 5, "ready", "unchanged", 8, 490.0),
                    ("short", 2, "stale", "stale", 8, 490.0), ("short", 3, "relearning", "inserted", 1, 5.0), ("turned", 2, "stale", "stale", 8, 490.0), ("turned", 3, "ready", "inserted", 9, 100.0)]


def test_merchant_products(spark):
    issue = {"code": "Missing GTIN!", "severity": "ERROR", "attribute": " gtin ", "applicableCountries": ["us", "US", "x"], "documentation": "ftp://a"}
    one = {"name": "accounts/1/products/en~A", "offerId": " A ", "productAttributes": {"title": "First"}, "productStatus": {"destinationStatuses": [{"approvedCountries": ["US"]}, {"pendingCountries": ["DE"]}], "itemLevelIssues": [issue, issue, {"severity": "x"}]}}
    two = {"name": "accounts/1/products/en~A", "offerId": "B", "productStatus": {"itemLevelIssues": [{"code": "other"}]}}
    pages = spark.createDataFrame([("s", 1, json.dumps({"products": [one, {"name": "products/1"}]})), ("s", 2, json.dumps({"products": [two]})), ("t", 1, None), ("t", 2, "{")], "store_id string, page int, body string")
    (r,) = merchant.merchant_products(pages).collect()
    assert (r.store_id, r.offer_id, r.title, r.status) == ("s", "a", "First", "pending") and r.stable_key.startswith("merchant_product:")
    assert [(i.code, i.severity, i.attribute, i.documentation, i.countries) for i in r.issues] == [("missing_gtin", "error", "gtin", None, ["US"]), ("other", "unknown", "unknown", None, [])]
    assert {(h.store_id, h.seen, h.skipped, h.invalid_issues, h.status) for h in merchant.scan_health(pages).collect()} == {("s", 3, 1, 1, "partial"), ("t", 0, 0, 0, "success")}


def test_atom_and_sitemap_index(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:g="http://base.google.com/ns/1.0"><entry><g:id>A1</g:id><title>T</title><link rel="self" href="https://x.org/self"/><link href="https://x.org/p/1?u=2"/><g:price>5 EUR</g:price></entry>'
                                    "<entry><title>U</title><link>https://x.org/p/2/</link></entry></feed>")
    rows = {r.stable_key: (r.url, r.price, r.currency) for r in landed.feed_items(landed.read_atom_feed(spark, str(tmp_path / "a.xml"))).collect()}
    assert rows == {"offer:a1": ("https://x.org/p/1", 5.0, "EUR"), "url:https://x.org/p/2": ("https://x.org/p/2", None, None)}
    (tmp_path / "i.xml").write_text('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc> https://X.org/a.xml </loc></sitemap><sitemap><loc>https://x.org/a.xml</loc></sitemap><sitemap><loc>no</loc></sitemap></sitemapindex>')
    assert [r.url for r in landed.read_sitemap_index(spark, str(tmp_path / "i.xml")).collect()] == ["https://x.org/a.xml"]


@pytest.mark.parametrize(("url", "want"), [("https://example.org/a", True), ("http://8.8.8.8:80/", True), ("ftp://example.org", False), (None, False), ("", False), ("http://localhost/x", False), ("http://LOCALHOST:8080", False), ("http://172.16.0.1/", False),
                                           ("http://172.32.0.1/", True), ("http://100.64.1.1", False), ("http://u:p@10.0.0.1/", False), ("http://[::1]/", False), ("http://[fd00::1]/", False), ("http://[2001:db8::1]/", True), ("http://10.example.org/", True)])
def test_public_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(C.is_public_url(C.F.col("u"))).first()[0] is want


def test_category_pages(spark):
    product = {"@type": "Product", "url": "/products/x"}
    script = lambda kind, value: f'<script type="{kind}">{json.dumps(value)}</script>'
    base = "https://Shop.org/c"
    pages = [("shop", 1, base, json.dumps({"products": [{"handle": "a"}, {"handle": "a"}, {"handle": "b"}, {"x": 1}, None], "products_count": 3})),
             ("embedded", 1, base, script("application/json", {"state": [{"total": 1, "items": [{"url": "/products/a?v=1"}]}]}) + script("application/ld+json", product)),
             ("linked", 1, base, script("application/json", {"a": 1}) + "<script type='application/ld+json'>{</script>" + script("application/ld+json", {"@graph": [product, product]})),
             ("links", 1, base, '<a href="/products/a">A</a><a href="/about">x</a><a rel="next" href="?page=2">n</a>'), ("links", 2, base, '<a href="/products/b#f">B</a><a href="/products/a/">A</a>'),
             ("open", 1, base, '<a href="/products/a">A</a><link rel="next" href="?page=2">'), ("endless", 1, base, '<a href="/products/a">A</a><button data-next-url="/x">Load more</button>'),
             ("empty", 1, base, "<p>No products found</p>"), ("null", 1, None, None), ("bad", 1, "http://[", '<a href="/products/a">A</a>')]
    parsed = category.category_pages(spark.createDataFrame(pages, "category string, page int, url string, body string"))
    got = {r.category: tuple(r)[1:] for r in category.category_observations(parsed).collect()}
    assert got == {"shop": ("shopify_json", 2, 3, False, False, 0.95), "embedded": ("embedded_json", 1, 1, True, False, 0.92), "linked": ("json_ld", 1, None, False, False, 0.55),
                   "links": ("html_links", 2, None, True, False, 0.7), "open": ("html_links", 1, None, False, True, 0.4), "endless": ("html_links", 1, None, False, False, 0.4),
                   "empty": ("html_links", 0, None, True, False, 0.7), "null": ("html_links", 0, None, True, False, 0.7), "bad": ("html_links", 0, None, True, False, 0.7)}
    assert {r.url for r in category.category_products(parsed).where("category = 'links'").collect()} == {"https://shop.org/products/a", "https://shop.org/products/b"}


def test_alert_texts(spark):
    rows = [('["a", " ", {"reason": "r"}, {"reason": 5, "message": "m"}, {"x": 1}, {}, 7, null]', "z", ["a", "r", "m", '{"x":1}']), ("{", " z ", ["z"]), (None, "", []), ('"text"', None, []), ('{"a": [1]}', None, []), (json.dumps(["e"] * 30), None, ["e"] * 10)]
    df = spark.createDataFrame([(j, m) for j, m, _ in rows], "j string, m string")
    assert [r.e for r in df.select(alerts.evidence_texts(C.F.col("j"), C.F.col("m")).alias("e")).collect()] == [want for _, _, want in rows]
    codes = spark.createDataFrame([("timeout: x",), ("Bad thing",), (None,), ("",), (":",)], "e string")
    assert [r[0] for r in codes.select(alerts.delivery_error(C.F.col("e"))).collect()] == ["timeout", "delivery_failed", None, None, "delivery_failed"]


def test_merchant_baseline_equals_a_slow_one(spark):
    """Snapshots with one check or many, ties of time, checks of a candidate's own moment; buffers from tiny to large."""
    import random

    from shelfwatch.operators import correlation

    rnd = random.Random(11)
    snaps = [(f"s{k}", rnd.choice("ab"), "completed" if k % 9 else "partial", k) for k in range(70)]
    checks, n = [], 0
    for s, _, _, k in snaps:
        if rnd.random() < 0.9:
            checks.append((n, s, "merchant_identity", "success", "c", True, None, k))
        for _ in range(rnd.choice([1, 1, 1, 12])):
            n += 1
            checks.append((n, s, "merchant_status", "success" if rnd.random() < 0.95 else "timeout", "c", None, rnd.choice([None, rnd.randint(50, 99)]), rnd.randint(0, 60)))
        n += 1
    status = [c for c in checks if c[2] == "merchant_status"]
    marks = []
    for k in range(50):
        own = rnd.choice(status)
        store, created = next((st, cr) for s, st, _, cr in snaps if s == own[1])
        marks.append((k, store, "c", own[1], own[7], created, own[0]))
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    candidates = df(marks, "candidate_id int, store_id string, config string, first_snapshot_id string, at int, created_at int, check_id int")
    s = df(snaps, "snapshot_id string, store_id string, status string, created_at int")
    c = df(checks, "check_id int, snapshot_id string, source string, status string, config string, complete boolean, approved_count int, finished_at int")
    known = {x[1] for x in checks if x[2] == "merchant_identity"}
    want = {}
    for k, store, _, first, at, created, check in marks:
        newest = {}
        for i, snap, _, fine, _, _, value, t in status:
            st, state, cr = next((x[1], x[2], x[3]) for x in snaps if x[0] == snap)
            if fine == "success" and snap in known and state == "completed" and st == store and snap != first and (t, cr, i) < (at, created, check) and ((t, cr, i) > newest.get(snap, ((-1,),))[0]):
                newest[snap] = ((t, cr, i), value)
        last = [v for _, v in sorted(newest.values(), key=lambda x: x[0])[-14:]]
        if last:
            sound = sorted(v for v in last if v is not None)
            median = (sound[(len(sound) - 1) // 2] + sound[len(sound) // 2]) / 2 if sound else None
            want[k] = (len(last), len(last) - len(sound), median)
    assert len(want) > 30
    for buffer in (3, 20, 64, 1000):
        got = {r.candidate_id: (r.samples, r.broken, r.median) for r in correlation.merchant_baseline(candidates, s, c, buffer).collect()}
        assert got == want
