"""Recovery by rule, authoritative replacement, lists and small functions on fixtures of their own."""

import json
import random
import time

from pyspark.sql import functions as F

from shelfwatch.functions import columns as C
from shelfwatch.operators import lifecycle, recovery, reports, rules, store

HASH = "ab" * 32
INCIDENT = "incident_id string, store_id string, status string, config string, opened_at int, percent_threshold double, absolute_threshold int"


def judged(df):
    return {(r.incident_id, r.snapshot_id): (r.comparable, r.healthy, r.reason) for r in df.collect()}


def test_catalog_drop_recovery(spark):
    rows = [("a", "s", "open", "c", 0, None, None, "b", 1, 100.0), ("gone", "s", "open", "c", 0, None, None, "b", 2, 100.0), ("bare", "s", "open", "c", 0, None, None, "b", 1, None),
            ("done", "s", "resolved", "c", 0, None, None, "b", 1, 100.0), ("late", "s", "open", "c", 99, None, None, "b", 1, 100.0), ("strict", "s", "recovering", "c", 0, 0.5, 20, "b", 1, 100.0)]
    some = spark.createDataFrame(rows, INCIDENT + ", baseline_id string, baseline_version int, baseline_median double")
    snaps = [("s1", "s", 1, "c", "scheduled", "success", 95), ("s2", "s", 2, "c", "scheduled", "success", 60), ("s3", "s", 3, "d", "scheduled", "success", 95), ("s4", "s", 4, "c", "confirmation_check", "success", 95),
             ("s5", "s", 5, "c", "scheduled", "partial", 95), ("s6", "s", 6, "c", "scheduled", "success", None), ("s7", "t", 7, "c", "scheduled", "success", 95), ("s8", "s", 8, "c", "scheduled", "success", 130)]
    snapshots = spark.createDataFrame(snaps, "snapshot_id string, store_id string, at int, config string, role string, feed_status string, feed_count int")
    baselines = spark.createDataFrame([("b", "s", 1, "c", "active", None, 100.0)], "baseline_id string, store_id string, version int, config string, status string, valid_to int, median double")
    got = judged(recovery.catalog_drop(some, snapshots, baselines))
    assert {k[0] for k in got} == {"a", "gone", "bare", "strict"} and {k[1] for k in got} == {"s1", "s2", "s3", "s8"}
    assert got["a", "s1"] == (True, True, "inside_guardrails") and got["a", "s2"] == (True, False, "drop_returned")
    assert got["a", "s3"] == (False, False, "configuration_changed") and got["a", "s8"] == (False, False, "between_thresholds")
    assert got["gone", "s1"] == (False, False, "baseline_not_in_force") and got["bare", "s1"] == (False, False, "no_baseline_context") and got["strict", "s2"] == (False, False, "between_thresholds")


def test_divergence_recovery(spark):
    some = spark.createDataFrame([("a", "s", "open", "c", 0, None, None)], INCIDENT)
    snaps = [("low", 1, "c", "success", 2, True, 400, 19), ("back", 2, "c", "success", 2, True, 200, 20), ("between", 3, "c", "success", 2, True, 400, 30), ("none", 4, "c", "success", 2, True, 0, 0), ("part", 5, "c", "partial", 2, True, 400, 1),
             ("no_categories", 6, "c", "success", 0, None, 400, 1), ("other", 7, None, "success", 2, True, 400, 1)]
    snapshots = spark.createDataFrame([(i, "s", *rest) for i, *rest in snaps], "snapshot_id string, store_id string, at int, config string, feed_status string, category_checks int, categories_ok boolean, matched int, missing int")
    got = {k[1]: v for k, v in judged(recovery.source_divergence(some, snapshots)).items()}
    assert got == {"low": (True, True, "below_thresholds"), "back": (True, False, "divergence_returned"), "between": (False, False, "between_thresholds"), "none": (False, False, "checks_incomplete"),
                   "part": (False, False, "checks_incomplete"), "no_categories": (False, False, "checks_incomplete"), "other": (False, False, "configuration_changed")}


def test_price_recovery(spark):
    """An incident's own counts, ratio, coverage, tolerance and ways of matching decide."""
    rows = [(s, "offer_id" if n < 20 else "canonical_url", f"u{n}", "t", "10", "EUR", "in stock", None, None, "10.03" if n < bad else "10", "EUR", "in stock")
            for s, total, bad in (("1", 20, 0), ("2", 30, 9), ("3", 19, 9), ("5", 30, 9)) for n in range(total)]
    matched = spark.createDataFrame(rows, "snapshot_id string, match_method string, feed_url string, feed_title string, feed_price string, feed_currency string, feed_availability string, "
                                          "shop_url string, shop_title string, shop_price string, shop_currency string, shop_availability string")
    snapshots = spark.createDataFrame([(str(n), "s", n, "c" if n < 5 else "d") for n in range(1, 6)], "snapshot_id string, store_id string, at int, config string")
    own = {"plain": (None, None, None, None, None), "many": (10, None, None, None, None), "share": (None, 0.31, None, None, None), "few": (None, None, 19, None, None), "wide": (None, None, None, 0.04, None), "offers": (None, None, None, None, ["offer_id"])}
    some = spark.createDataFrame([(i, "s", "open", "c", 0, *v) for i, v in own.items()],
                                 "incident_id string, store_id string, status string, config string, opened_at int, minimum_affected_count int, minimum_affected_ratio double, minimum_comparable_matches int, price_absolute double, methods array<string>")
    some = some.withColumn("price_relative", F.lit(None).cast("double"))
    outcomes = recovery.price_availability(some, snapshots, matched).collect()
    got = {(r.incident_id, r.snapshot_id): r.reason for r in outcomes}
    good, bad, few, other = "below_thresholds", "mismatch_returned", "too_few_matches", "configuration_changed"
    assert {i: [got[i, s] for s in "12345"] for i in own} == {"plain": [good, bad, few, few, other], "many": [good, good, few, few, other], "share": [good, good, few, few, other], "few": [good, bad, bad, few, other],
                                                             "wide": [good, good, few, few, other], "offers": [good, bad, few, few, other]}
    assert {tuple(r.unhealthy) for r in outcomes if r.reason == bad} == {("price_mismatch_count",)} and {tuple(r.unhealthy) for r in outcomes if r.reason != bad} == {()}


def test_page_recovery_compares_with_the_sample_before(spark):
    """Pages stay noindex from s2 on: against s2 nothing changes, against s1 the signal is still there."""
    fine, bad = ("index", "self", True, 200), ("noindex", "self", True, 200)
    states = {"s1": fine, "s2": bad, "s3": bad, "s4": fine}
    items = spark.createDataFrame([(s, f"p{k}", *v) for s, v in states.items() for k in range(25)], "snapshot_id string, stable_key string, indexability string, canonical_state string, schema_valid boolean, http_status int")
    rows = [(s, "s", n, "h", 25, 25 if s != "s5" else 3, 0, "c", *rules.SAMPLE.values()) for n, s in enumerate([*states, "s5"])]
    snapshots = spark.createDataFrame(rows, "snapshot_id string, store_id string, finished_at int, urls_hash string, selected_count int, comparable_checks int, failed_checks int, config string, " + ", ".join(f"{c} string" for c in rules.SAMPLE))
    some = spark.createDataFrame([("a", "s", "open", "c", 1, None, None, "s2"), ("first", "s", "open", "c", 0, None, None, "s1")], INCIDENT + ", opened_snapshot_id string")
    got = judged(recovery.page_signals(some.withColumn("coverage_minimum", F.lit(None).cast("double")), items, snapshots))
    assert got["a", "s3"] == (True, False, "signals_returned") and got["a", "s4"] == (True, True, "below_thresholds") and got["a", "s5"] == (False, False, "sample_not_comparable")
    assert got["first", "s2"] == (False, False, "no_reference_sample")


def test_page_recovery_takes_an_unfit_reference_and_the_incidents_coverage(spark):
    """The sample before the opening one needs no successful checks of its own; coverage is the incident's."""
    items = [(s, f"p{k}", "noindex" if s == "s2" and k < 9 else "index", "self", True, 200) for s, n in (("s1", 30), ("s2", 30), ("s3", 27)) for k in range(n)]
    items = spark.createDataFrame(items, "snapshot_id string, stable_key string, indexability string, canonical_state string, schema_valid boolean, http_status int").withColumn("stable_key", F.when((F.col("snapshot_id") == "s3") & (F.col("stable_key") == "p0"), "other").otherwise(F.col("stable_key")))
    rows = [(s, "s", n, "h", 30, 30 if s != "s1" else 2, 0 if s != "s1" else 28, "c", *rules.SAMPLE.values()) for n, s in enumerate(("s1", "s2", "s3"))]
    snapshots = spark.createDataFrame(rows, "snapshot_id string, store_id string, finished_at int, urls_hash string, selected_count int, comparable_checks int, failed_checks int, config string, " + ", ".join(f"{c} string" for c in rules.SAMPLE))
    some = spark.createDataFrame([("a", "s", "open", "c", 1, "s2", None), ("b", "s", "open", "c", 1, "s2", 0.97)], "incident_id string, store_id string, status string, config string, opened_at int, opened_snapshot_id string, coverage_minimum double")
    got = judged(recovery.page_signals(some, items, snapshots))
    assert got == {("a", "s3"): (True, True, "below_thresholds"), ("b", "s3"): (False, False, "coverage_too_low")}


def test_signals_recover_and_return(spark):
    active = spark.createDataFrame([("i", ["noindex", "http_error", "noindex"]), ("j", ["canonical_away"])], "incident_id string, signals array<string>")
    seen = [("s1", 1, True, ["noindex", "http_error"]), ("s2", 2, True, ["noindex", "schema_missing"]), ("s3", 3, False, []), ("s4", 4, True, ["http_error"]), ("s5", 5, True, [])]
    outcomes = spark.createDataFrame([("i", *x) for x in seen] + [("j", "s0", 0, False, []), ("k", "s0", 0, True, [])], "incident_id string, snapshot_id string, at int, comparable boolean, unhealthy array<string>")
    rows = recovery.recovered_signals(active, outcomes, ranges=3)
    got = {(r.incident_id, r.snapshot_id): (r.recovered, r.remaining, r.returned) for r in rows.collect()}
    both = ["http_error", "noindex"]
    assert got == {("i", "s1"): ([], both, []), ("i", "s2"): (["http_error"], ["noindex"], []), ("i", "s3"): (["http_error"], ["noindex"], []), ("i", "s4"): (["noindex"], ["http_error"], ["http_error"]), ("i", "s5"): (both, [], []),
                   ("j", "s0"): ([], ["canonical_away"], [])}
    some = spark.createDataFrame([("i", ["opened"]), ("j", None)], "incident_id string, evidence array<string>")
    kept = {r.incident_id: r.evidence for r in recovery.appended_evidence(some, rows).collect()}
    assert kept["j"] == [] and kept["i"][:3] == ["opened", "snapshot s1: recovered none; remaining http_error, noindex", "snapshot s2: recovered http_error; remaining noindex"] and len(kept["i"]) == 5


def test_feed_and_issue_recovery(spark):
    some = spark.createDataFrame([("a", "s", "open", "c", 0, "u"), ("b", "s", "ignored", "c", 0, "u"), ("d", "s", "open", "d", 0, "v")], "incident_id string, store_id string, status string, config string, opened_at int, feed_url string")
    checks = spark.createDataFrame([("s0", "s", 0, "u", "success"), ("s1", "s", 1, "u", "timeout"), ("s2", "s", 2, "u", "partial"), ("s3", "s", 3, "u", "success")], "snapshot_id string, store_id string, at int, feed_url string, status string")
    assert judged(recovery.feed_health(some, checks)) == {("a", "s1"): (True, False, "feed_check_failed"), ("a", "s2"): (False, False, "feed_check_partial"), ("a", "s3"): (True, True, "feed_check_succeeded")}
    snapshots = spark.createDataFrame([(f"s{n}", "s", n, "c") for n in range(1, 4)], "snapshot_id string, store_id string, at int, config string")
    observed = spark.createDataFrame([("s1", 2), ("s2", 0)], "snapshot_id string, affected int")
    got = judged(recovery.item_issues(some, snapshots, observed))
    assert {k[1]: v for k, v in got.items() if k[0] == "a"} == {"s1": (True, False, "item_issues_remain"), "s2": (True, True, "no_item_issues"), "s3": (False, False, "scan_incomplete")}
    assert {v for k, v in got.items() if k[0] == "d"} == {(False, False, "configuration_changed")}


def test_drive_equals_the_steps(spark):
    rng = random.Random(5)
    firsts = ["open", "investigating", "acknowledged", "recovering"]
    some = spark.createDataFrame([(f"i{n}", firsts[n % 4]) for n in range(40)], "incident_id string, status string")
    seen = [(f"i{n}", f"s{k}", k, rng.random() < 0.7, rng.random() < 0.5, "r") for n in range(40) for k in range(12)]
    outcomes = spark.createDataFrame(seen, "incident_id string, snapshot_id string, at int, comparable boolean, healthy boolean, reason string")
    got = {(r.incident_id, r.snapshot_id): (r.status, r.event) for r in recovery.drive(some, outcomes).collect()}
    want, status = {}, {f"i{n}": firsts[n % 4] for n in range(40)}
    for i, s, _, comparable, healthy, _ in seen:
        if comparable:
            status[i], event = lifecycle.recovery_step(status[i], True, healthy)
            want[i, s] = (status[i], event)
    assert got == want


ISSUE = "struct<code:string,severity:string,resolution:string,attribute:string,reporting_context:string,applicable_countries:array<string>,text:string>"


def issue(code, countries=None, text="t"):
    return (code, "error", None, None, None, countries, text)


def test_replaced_inventory(spark):
    kinds = f"snapshot_id string, stable_key string, issues array<{ISSUE}>"
    old = [(s, k, [issue(k, ["DE", "FR"])]) for s in ("whole", "part", "fenced", "malformed", "first", "untouched") for k in ("x", "y")]
    new = [(s, k, v) for s in ("whole", "part", "fenced", "malformed", "first") for k, v in (("x", [issue("x", ["FR", "DE"], "again"), issue("n")]), ("z", []), ("w", [issue("w")]))]
    scans = [("whole", HASH, HASH, "success", True), ("part", HASH, None, "partial", False), ("fenced", HASH, "cd" * 32, "success", True), ("malformed", "AB", None, "success", True), ("first", HASH, None, "success", False)]
    df = store.replaced_inventory(spark.createDataFrame(old, kinds), spark.createDataFrame(new, kinds), spark.createDataFrame(scans, "snapshot_id string, config string, held_config string, status string, complete boolean"))
    got = {}
    for r in df.collect():
        got.setdefault(r.snapshot_id, {})[r.stable_key] = [(i.code, i.text) for i in r.issues]
    same = {"x": [("x", "t")], "y": [("y", "t")]}
    assert got["fenced"] == got["malformed"] == got["untouched"] == same
    assert got["whole"] == {"x": [("x", "again"), ("n", "t")], "z": [], "w": [("w", "t")]}
    assert got["part"] == {"x": [("x", "t"), ("n", "t")], "y": [("y", "t")], "w": [("w", "t")]}
    assert got["first"] == {"x": [("x", "again"), ("n", "t")], "y": [("y", "t")], "w": [("w", "t")]}


def test_absent(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1), (None, 1)], "k string, v int")
    assert sorted(map(tuple, store.absent(rows, rows.where("k = 'b' or k is null"), ["k"]).collect()), key=str) == [("a", 1), (None, 1)]


def test_lists(spark):
    stores = spark.createDataFrame([("s", "Shop"), ("t", "Other")], "store_id string, name string")
    some = spark.createDataFrame([("i", "s", "open", "critical"), ("j", "s", "resolved", "critical"), ("k", "x", "open", "critical")], "incident_id string, store_id string, status string, severity string").withColumn("updated_at", F.lit("2024-05-06 07:08:09.123456").cast("timestamp"))
    assert [(r.incident_id, r.store_name, r.updated_at_cursor) for r in reports.incident_list(some, stores, status="open", severity=None).collect()] == [("i", "Shop", "2024-05-06T07:08:09.123456Z")]
    snapshots = spark.createDataFrame([("s", "p", 1, "failed"), ("s", "q", 2, "completed")], "store_id string, snapshot_id string, created_at int, status string")
    categories = spark.createDataFrame([("s", "c"), ("s", "d"), ("s", "d")], "store_id string, category_id string")
    assert sorted(map(tuple, reports.store_list(stores, snapshots, some, categories).collect())) == [("s", "Shop", "completed", 2, 1, 2), ("t", "Other", None, None, 0, 0)]


def test_small_functions(spark):
    df = spark.createDataFrame([("0.5", "12"), ("12.345", "0.5"), ("007", "50"), ("1e3", "-1"), (None, "")], "a string, b string")
    got = df.select(C.shifted(F.col("a"), 2), C.shifted(F.col("b"), -2)).collect()
    assert [tuple(r) for r in got] == [("50", "0.12"), ("1234.5", "0.005"), ("700", "0.50"), (None, None), (None, None)]
    df = spark.createDataFrame([("HTTPS://Shop.Example:443/a/?q#f",), ("http://x.example:8080",), ("nothing",), (None,)], "u string")
    assert [r[0] for r in df.select(C.domain_key(F.col("u"))).collect()] == ["https://shop.example", "http://x.example:8080", None, None]
    df = spark.createDataFrame([("success", "partial", 1, 2, None, True), ("success", "timeout", 1, 2, None, None), ("success", "success", 1, 2, False, None), ("success", "success", None, 2, None, None), (None, "success", 1, 2, None, None)],
                               "s string, t string, a int, b int, x boolean, y boolean")
    assert [r[0] for r in df.select(C.comparable(*[F.col(c) for c in df.columns])).collect()] == [True, False, False, False, False]
    assert spark.range(1).select(C.fingerprint(F.lit("s"), F.lit("k"), F.lit(None), F.lit(3))).first()[0] == "s:k::3"


def test_merged_metadata(spark):
    rows = [('{"a": 1, "b": "x", "discoveredFrom": ["p", {"q": 1}], "sourceHashes": {"u": "1", "v": "2"}}', '{"b": null, "c": [1.5], "discoveredFrom": [{"q":1}, "r"], "sourceHashes": {"v": "3"}}'),
            ('{"discoveredFrom": "text", "sourceHashes": [1]}', '{"a": true}'), (None, '{"discoveredFrom": ["p", "p"]}'), ("[1]", None)]
    df = spark.createDataFrame(rows, "o string, n string").coalesce(1)
    got = [json.loads(r[0]) for r in df.select(C.merged_metadata(F.col("o"), F.col("n"))).collect()]
    assert got == [{"a": 1, "b": None, "c": [1.5], "discoveredFrom": ["p", {"q": 1}, "r"], "sourceHashes": {"u": "1", "v": "3"}},
                   {"discoveredFrom": "text", "sourceHashes": [1], "a": True}, {"discoveredFrom": ["p"]}, {}]


def test_merged_item_metadata_in_time(spark):
    """Each part of a merge is computed once: 20,000 rows took some 40 seconds of a core before; the bound is wide."""
    o = F.col("id")
    old = F.concat(F.lit('{"old":1,"discoveredFrom":["feed"],"sourceHashes":{"feed":"x"},"merchantDataKind":"product_identity","n":'), o.cast("string"), F.lit("}"))
    new = F.lit('{"a":2,"discoveredFrom":["page","feed"],"sourceHashes":{"page":"y"},"merchantDataKind":"item_issues"}')
    rows = spark.range(0, 20000, 1, 1).select(C.merged_item_metadata(old, new, o % 2 == 0).alias("m"))
    began = time.time()
    got = rows.agg(F.count_distinct("m"), F.count_if(F.get_json_object("m", "$.merchantDataKind") == "product_identity"), F.count_if(F.get_json_object("m", "$.discoveredFrom[1]") == "page")).first()
    assert tuple(got) == (20000, 10000, 20000) and time.time() - began < 20


def test_pairs_of_a_large_store_are_spread(spark):
    """Every pair once, none of them in a partition that holds a whole store."""
    some = spark.range(0, 60, 1, 1).select(F.col("id").alias("incident_id"), F.when(F.col("id") < 50, "big").otherwise("small").alias("store_id"), F.lit("open").alias("status"), F.lit("c").alias("config"), (F.col("id") % 7).alias("opened_at"))
    snapshots = spark.range(0, 80, 1, 1).select(F.col("id").alias("snapshot_id"), F.when(F.col("id") < 70, "big").otherwise("small").alias("store_id"), (F.col("id") % 11).alias("at"), F.lit("c").alias("config"))
    got = recovery._later(some, snapshots, side=8)
    want = sorted((i, s) for i in range(60) for s in range(80) if (i < 50) == (s < 70) and s % 11 > i % 7)
    assert sorted((r.incident_id, r.snapshot_id) for r in got.select("incident_id", "snapshot_id").collect()) == want
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 20 and max(sizes) < len(want) / 4
    assert sorted((r.incident_id, r.snapshot_id) for r in recovery._later(some, snapshots).select("incident_id", "snapshot_id").collect()) == want


def test_what_a_large_store_shuffles_grows_with_its_rows(spark):
    """Four times the rows have sixteen times the pairs, and about four times the shuffled bytes."""
    context = spark.sparkContext._jsc.sc()

    def shuffled(n):
        some = spark.range(0, n, 1, 1).select(F.col("id").alias("incident_id"), F.lit("s").alias("store_id"), F.lit("open").alias("status"), F.lit("c").alias("config"), F.lit(-1).alias("opened_at"))
        snapshots = spark.range(0, n, 1, 1).select(F.col("id").alias("snapshot_id"), F.lit("s").alias("store_id"), F.col("id").alias("at"), F.when(F.col("id") % 3 > 0, "c").alias("config"))
        written = lambda: (context.listenerBus().waitUntilEmpty(), context.statusStore().executorList(True).apply(0).totalShuffleWrite())[1]
        before = written()
        got = recovery._later(some, snapshots, side=8).agg(F.count("*"), F.sum("incident_id"), F.sum("snapshot_id"), F.count("config")).first()
        assert tuple(got) == (n * n, n * n * (n - 1) // 2, n * n * (n - 1) // 2, n * (n - (n + 2) // 3))
        return written() - before

    assert shuffled(800) < 6 * shuffled(200)


def test_price_signals_of_another_configuration_count_for_nothing(spark):
    """An incident that shares its terms with one that is judged, but not its configuration, has no unhealthy signals."""
    rows = [("1", "offer_id", f"u{n}", "t", "10", "EUR", "in stock", None, None, "12", "EUR", "in stock") for n in range(30)]
    matched = spark.createDataFrame(rows, "snapshot_id string, match_method string, feed_url string, feed_title string, feed_price string, feed_currency string, feed_availability string, "
                                          "shop_url string, shop_title string, shop_price string, shop_currency string, shop_availability string")
    snapshots = spark.createDataFrame([("1", "s", 1, "c")], "snapshot_id string, store_id string, at int, config string")
    some = spark.createDataFrame([("same", "s", "open", "c", 0), ("other", "s", "open", "d", 0), ("none", "s", "open", None, 0)], "incident_id string, store_id string, status string, config string, opened_at int")
    some = some.withColumns({n: F.lit(None).cast("double") for n in rules.PRICE_THRESHOLDS} | {"methods": F.lit(None).cast("array<string>")})
    got = {r.incident_id: (r.reason, r.unhealthy) for r in recovery.price_availability(some, snapshots, matched).collect()}
    assert got == {"same": ("mismatch_returned", ["price_mismatch_count"]), "other": ("configuration_changed", []), "none": ("configuration_changed", [])}
