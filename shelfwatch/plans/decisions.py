"""Queries of candidates, settings, canonical forms and recovered signals over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json
from ..operators import candidates, identity, messages, recovery, rules, settings, snapshots, store
from ..sources import product_page
from .base import query, table

#: Seconds since the start of 2024, time running forty times as fast, so that a user's events come minutes apart.
FAST = "CAST(date_diff('second', TIMESTAMP '2024-01-01', ts) // 40 AS BIGINT)"


def _fast(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("s", F.floor(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 40).cast("long"))


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, {FAST} AS s, event_type NOT IN ('signup', 'error') AS is_drop, lpad(CAST(event_id AS VARCHAR), 12, '0') AS snapshot, event_id AS id FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, NOT is_drop, snapshot) AS n FROM e),
f AS (
  SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS opened, CAST(NULL AS BIGINT) AS until, CAST(NULL AS BIGINT) AS ids, CAST(NULL AS BIGINT) AS last, CAST(0 AS BIGINT) AS drops,
         CAST(NULL AS BIGINT) AS done_opened, CAST(NULL AS BIGINT) AS done_until, CAST(NULL AS BIGINT) AS done_first, CAST(NULL AS BIGINT) AS done_last, CAST(0 AS BIGINT) AS done_drops, CAST(NULL AS BIGINT) AS done_ender FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT o.user_id, o.n,
         CASE WHEN is_drop THEN CASE WHEN f.until > o.s THEN f.opened ELSE o.s END END, CASE WHEN is_drop THEN o.s + 1800 END, CASE WHEN is_drop THEN CASE WHEN f.until > o.s THEN f.ids ELSE o.id END END,
         CASE WHEN is_drop THEN o.id END, CASE WHEN is_drop THEN CASE WHEN f.until > o.s THEN f.drops + 1 ELSE 1 END ELSE 0 END,
         CASE WHEN is_drop AND f.until > o.s THEN NULL ELSE f.opened END, f.until, f.ids, f.last, f.drops, CASE WHEN NOT is_drop AND f.until > o.s THEN o.id END
  FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1),
z AS (SELECT user_id, max(n) AS n FROM f GROUP BY 1),
d AS (SELECT user_id, done_opened AS opened, done_until AS until, done_first AS first, done_last AS last, done_drops AS drops, done_ender AS ender FROM f WHERE done_opened IS NOT NULL
      UNION ALL SELECT f.user_id, f.opened, f.until, f.ids, f.last, f.drops, NULL FROM f JOIN z USING (user_id, n) WHERE f.opened IS NOT NULL),
v AS (SELECT *, 100 + first % 3 AS median, 60 + last % 15 AS seen, CASE WHEN ender % 4 = 0 THEN 95 ELSE 50 END AS got, ender % 7 = 0 AS other, ender % 5 = 0 AS broken FROM d),
w AS (SELECT *, CASE WHEN ender IS NULL THEN 'confirmation_window_expired' WHEN other THEN 'baseline_stale_or_replaced' WHEN broken THEN 'confirmation_source_check_failed' WHEN got <= median * (1 - 0.2::DOUBLE) AND median - got >= 20 THEN 'confirmation_matched_drop' ELSE 'confirmation_recovered' END AS reason FROM v),
x AS (SELECT *, CASE WHEN reason IN ('confirmation_matched_drop', 'confirmation_recovered') THEN got ELSE seen END AS observed FROM w)
SELECT CAST(user_id AS VARCHAR) AS store_id, opened AS opened_s, until AS expires_s, drops, CAST(median AS DOUBLE) AS baseline_median, CAST(observed AS DOUBLE) AS observed_value, (median - observed) / CAST(median AS DOUBLE) AS change_pct,
       lpad(CAST(last AS VARCHAR), 12, '0') AS first_snapshot_id, CASE WHEN ender IS NOT NULL THEN lpad(CAST(ender AS VARCHAR), 12, '0') END AS confirmation_snapshot_id,
       CASE reason WHEN 'confirmation_matched_drop' THEN 'confirmed' WHEN 'confirmation_recovered' THEN 'dismissed' WHEN 'confirmation_source_check_failed' THEN 'source_failure' ELSE 'expired' END AS status, reason AS status_reason FROM x""")
def drop_candidates(spark, sf_dir):
    """Candidates with a deadline: a user's views, clicks and purchases as drops, sign-ups and errors as confirming snapshots. The SQL steps through each user's events."""
    e = _fast(spark, sf_dir)
    new, k, none = ~F.col("event_type").isin("signup", "error"), F.col("event_id"), F.lit(None)
    log = e.select(
        F.col("user_id").cast("string").alias("store_id"), F.lit("c").alias("config"), F.timestamp_seconds("s").alias("at"), F.when(new, "drop").otherwise("confirm").alias("kind"), F.lpad(k.cast("string"), 12, "0").alias("snapshot_id"),
        F.when(new, 60 + k % 15).when(k % 4 == 0, 95).otherwise(50).cast("double").alias("observed"), F.when(new, "b").alias("baseline_id"), F.when(new, 1).alias("baseline_version"), F.when(new, 100 + k % 3).cast("double").alias("baseline_median"),
        F.when(new, 0.2).alias("percent_threshold"), F.when(new, 20.0).alias("absolute_threshold"), F.when(new, 1).alias("threshold_version"), none.cast("string").alias("threshold_hash"),
        F.when(~new, F.when(k % 7 == 0, "x").otherwise("b")).alias("active_baseline_id"), F.when(~new, "c").alias("active_config"), F.when(~new, "c").alias("snapshot_config"), F.when(~new, F.when(k % 5 == 0, "timeout").otherwise("success")).alias("source_status"))
    found = candidates.candidates(log)
    return found.select("store_id", F.unix_seconds("opened_at").alias("opened_s"), F.unix_seconds("expires_at").alias("expires_s"), "drops", "baseline_median", "observed_value", "change_pct", "first_snapshot_id", "confirmation_snapshot_id", "status", "status_reason")


@query("""
WITH n AS (SELECT l_orderkey, string_agg('{"part":' || l_partkey || ',"quantity":' || regexp_replace(CAST(l_quantity AS VARCHAR), '[.]0$', '') || '}', ',' ORDER BY l_linenumber, l_quantity, l_partkey) AS lines FROM lineitem GROUP BY 1),
t AS (SELECT o_orderkey, '{"lines":[' || coalesce(lines, '') || '],"Meta":{"2":"' || o_orderpriority || '","10":{"at":"' || strftime(o_orderdate, '%Y-%m-%d') || '","says":"a \\"quote\\""},"customer":' || o_custkey || '},"total":'
        || regexp_replace(CAST(o_totalprice AS VARCHAR), '[.]0$', '') || '}' AS j FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)
SELECT o_orderkey, length(j) AS size, sha256(j) AS config_hash FROM t""")
def canonical_config(spark, sf_dir):
    """Canonical JSON of nested objects and arrays: orders with their lines, keys out of order, numbers and texts as JSON may spell them."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct(F.col("l_quantity").alias("quantity"), F.col("l_partkey").alias("part")).alias("line"))
    lines = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "line"))), lambda x: x["line"]).alias("lines"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    meta = F.struct(F.struct(F.lit('a "quote"').alias("says"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at")).alias("10"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("2"))
    text = F.to_json(F.struct(F.col("o_totalprice").alias("total"), meta.alias("Meta"), F.coalesce("lines", F.array()).alias("lines")), {"pretty": "true"})
    told = rows.select("o_orderkey", text.alias("text")).select("o_orderkey", canonical_json(F.col("text")).alias("j"))
    return told.select("o_orderkey", F.length("j").cast("long").alias("size"), F.sha2(F.col("j").cast("binary"), 256).alias("config_hash"))


#: Fields of a store's alert preferences, and the updates that events stand for.
FIELDS = {"alertsEnabled": "boolean", "minimumSeverity": "string", "mutedIncidentTypes": "array<string>"}
UPDATES_SQL = """u AS (SELECT user_id % 10 AS store, ts, event_id, CASE event_type WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END END AS a, CASE WHEN event_type = 'view' THEN 'level' || event_id % 2 END AS b,
             CASE WHEN event_type = 'purchase' THEN CASE event_id % 3 WHEN 0 THEN '[]' WHEN 1 THEN '["catalog_drop","seo_regression"]' ELSE '["catalog_drop"]' END END AS c FROM events WHERE event_type <> 'error'),
n AS (SELECT store, ts, event_id, row_number() OVER w AS version, last_value(a IGNORE NULLS) OVER w AS a, last_value(b IGNORE NULLS) OVER w AS b, last_value(c IGNORE NULLS) OVER w AS c FROM u WINDOW w AS (PARTITION BY store ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
h AS (SELECT *, sha256('{"preferences":{' || concat_ws(',', '"alertsEnabled":' || a, '"minimumSeverity":"' || b || '"', '"mutedIncidentTypes":' || c) || '},"version":"alert_preferences_v1"}') AS hash FROM n)"""


def _preferences(spark, sf_dir) -> DataFrame:
    k, kind = F.col("event_id"), F.col("event_type")
    muted = F.when(k % 3 == 0, "[]").when(k % 3 == 1, '["seo_regression", "catalog_drop"]').otherwise('["catalog_drop"]')
    patch = (F.when(kind == "click", F.concat(F.lit('{"alertsEnabled": '), (k % 2 == 0).cast("string"), F.lit("}"))).when(kind == "view", F.concat(F.lit('{"minimumSeverity": "level'), (k % 2).cast("string"), F.lit('"}')))
             .when(kind == "purchase", F.concat(F.lit('{"mutedIncidentTypes": '), muted, F.lit("}"))).otherwise("{}"))
    updates = table(spark, sf_dir, "events").where("event_type <> 'error'").select((F.col("user_id") % 10).alias("store"), "ts", "event_id", patch.alias("patch"))
    return settings.versions(updates, ["store"], "ts", ["event_id"], FIELDS, "preferences", ["mutedIncidentTypes"])


@query(f"""WITH {UPDATES_SQL}, g AS (SELECT *, coalesce(hash <> lag(hash) OVER w, true) AS fresh FROM h WINDOW w AS (PARTITION BY store ORDER BY ts, event_id))
SELECT event_id, store, version, CAST(count(*) FILTER (fresh) OVER (PARTITION BY store ORDER BY ts, event_id) AS BIGINT) AS state, hash FROM g""")
def preference_versions(spark, sf_dir):
    """Versions of preferences out of partial updates: the events of ten user groups as updates, some of them empty."""
    return _preferences(spark, sf_dir).select("event_id", "store", F.col("version").cast("long").alias("version"), F.col("state").cast("long").alias("state"), "hash")


@query(f"""WITH {UPDATES_SQL},
f AS (SELECT user_id % 10 AS store, CAST(ts AS DATE) AS day, min(ts) AS frozen_at, count(*) AS evaluations FROM events WHERE event_type = 'error' GROUP BY 1, 2),
v AS (SELECT store, ts, max(version) AS version, arg_max(hash, version) AS hash FROM h GROUP BY 1, 2)
SELECT f.store, strftime(f.day, '%Y-%m-%d') AS snapshot, v.version, v.hash FROM f ASOF LEFT JOIN v ON v.store = f.store AND v.ts <= f.frozen_at""")
def frozen_settings(spark, sf_dir):
    """Settings frozen at a snapshot's first evaluation: a group's errors of a day as the evaluations of one snapshot, with updates between them."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select((F.col("user_id") % 10).alias("store"), F.date_format("ts", "yyyy-MM-dd").alias("snapshot"), "ts")
    found = settings.frozen(e, _preferences(spark, sf_dir), "store", "snapshot", "ts", "ts", ["version", "hash"])
    return found.select("store", "snapshot", F.col("version").cast("long").alias("version"), "hash")


SIGNALS = ("canonical_away", "http_error", "noindex", "schema_missing")


@query("""
WITH i AS (SELECT c_custkey AS incident_id, list_filter(['canonical_away', CASE WHEN c_custkey % 3 = 0 THEN 'http_error' END, CASE WHEN c_nationkey % 2 = 0 THEN 'noindex' END], lambda x: x IS NOT NULL) AS active FROM customer),
o AS (SELECT o_custkey AS incident_id, o_orderkey AS snapshot_id, o_orderdate AS t, o_orderkey % 4 <> 0 AS comparable, list_filter([CASE WHEN o_orderkey % 5 < 2 THEN 'canonical_away' END, CASE WHEN o_orderkey % 3 = 0 THEN 'http_error' END,
        CASE WHEN o_orderkey % 2 = 0 THEN 'noindex' END, CASE WHEN o_orderkey % 7 = 0 THEN 'schema_missing' END], lambda x: x IS NOT NULL) AS bad FROM orders),
m AS (SELECT o.*, active, CASE WHEN comparable THEN list_filter(active, lambda x: NOT list_contains(bad, x)) END AS gone FROM o JOIN i USING (incident_id)),
w AS (SELECT *, coalesce(last_value(gone IGNORE NULLS) OVER (PARTITION BY incident_id ORDER BY t, snapshot_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), []) AS recovered,
             coalesce(last_value(gone IGNORE NULLS) OVER (PARTITION BY incident_id ORDER BY t, snapshot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS before FROM m)
SELECT incident_id, snapshot_id, comparable, array_to_string(recovered, ',') AS recovered, array_to_string(list_filter(active, lambda x: NOT list_contains(recovered, x)), ',') AS remaining,
       CASE WHEN comparable THEN array_to_string(list_filter(active, lambda x: NOT list_contains(recovered, x) AND list_contains(before, x)), ',') ELSE '' END AS returned FROM w""")
def recovered_signals(spark, sf_dir):
    """Which signals of an incident have recovered at each snapshot: customers as incidents, their orders as outcomes, a quarter of them not comparable."""
    some = lambda *pairs: F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]), lambda x: x.isNotNull())
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    active = table(spark, sf_dir, "customer").select(k.alias("incident_id"), some(("noindex", F.col("c_nationkey") % 2 == 0), ("canonical_away", F.lit(True)), ("http_error", k % 3 == 0)).alias("signals"))
    outcomes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("incident_id"), o.alias("snapshot_id"), F.col("o_orderdate").alias("at"), (o % 4 != 0).alias("comparable"),
                                                     some(("canonical_away", o % 5 < 2), ("http_error", o % 3 == 0), ("noindex", o % 2 == 0), ("schema_missing", o % 7 == 0)).alias("unhealthy"))
    got = recovery.recovered_signals(active, outcomes)
    return got.select("incident_id", "snapshot_id", "comparable", *[F.array_join(c, ",").alias(c) for c in ("recovered", "remaining", "returned")])


@query("""
WITH e AS (SELECT user_id, event_id, ts, 'feed' || user_id % 3 AS url, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'partial' ELSE 'success' END AS status FROM events),
i AS (SELECT c_custkey AS incident_id, c_custkey AS store, 'feed' || CASE WHEN c_custkey % 4 = 0 THEN 9 ELSE c_custkey % 3 END AS url, TIMESTAMP '2024-01-10' + INTERVAL 1 HOUR * (c_custkey % 99) AS opened FROM customer WHERE c_custkey % 5 <> 0)
SELECT incident_id, event_id AS snapshot_id, status <> 'partial' AS comparable, status = 'success' AS healthy, CASE status WHEN 'success' THEN 'feed_check_succeeded' WHEN 'partial' THEN 'feed_check_partial' ELSE 'feed_check_failed' END AS reason
FROM i JOIN e ON e.user_id = store AND e.url = i.url AND e.ts > opened""")
def feed_health_recovery(spark, sf_dir):
    """Feed-health incidents against later checks of their address: customers as incidents, events as checks."""
    checks, some = _feed_health(spark, sf_dir)
    return recovery.feed_health(some, checks).select("incident_id", "snapshot_id", "comparable", "healthy", "reason")


def _feed_health(spark, sf_dir):
    kind, k = F.col("event_type"), F.col("c_custkey")
    checks = table(spark, sf_dir, "events").select(F.col("event_id").alias("snapshot_id"), F.col("user_id").alias("store_id"), F.col("ts").cast("timestamp_ntz").alias("at"), F.concat(F.lit("feed"), (F.col("user_id") % 3).cast("string")).alias("feed_url"),
                                                   F.when(kind == "error", "timeout").when(kind == "click", "partial").otherwise("success").alias("status"))
    some = table(spark, sf_dir, "customer").select(k.alias("incident_id"), k.alias("store_id"), F.concat(F.lit("feed"), F.when(k % 4 == 0, 9).otherwise(k % 3).cast("string")).alias("feed_url"), F.when(k % 5 == 0, "ignored").otherwise("open").alias("status"),
                                                   (F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'") + F.expr("INTERVAL 1 HOUR") * (k % 99)).alias("opened_at"))
    return checks, some


@query("""
WITH o AS (SELECT l_suppkey AS snapshot_id, count(DISTINCT CASE WHEN l_returnflag = 'R' AND l_quantity > 49 AND l_shipdate < DATE '1993-06-01' THEN l_partkey END) AS affected FROM lineitem GROUP BY 1),
i AS (SELECT c_custkey AS incident_id, c_custkey % 50 AS store, CASE WHEN c_custkey % 7 = 0 THEN 'd' ELSE 'c' END AS config, c_custkey % 40 AS opened FROM customer WHERE c_mktsegment <> 'BUILDING'),
s AS (SELECT s_suppkey AS snapshot_id, s_suppkey % 50 AS store, affected FROM supplier LEFT JOIN o ON snapshot_id = s_suppkey AND s_suppkey % 10 <> 1),
r AS (SELECT incident_id, snapshot_id, CASE WHEN config = 'd' THEN 'configuration_changed' WHEN affected IS NULL THEN 'scan_incomplete' WHEN affected = 0 THEN 'no_item_issues' ELSE 'item_issues_remain' END AS reason FROM i JOIN s ON s.store = i.store AND snapshot_id > opened)
SELECT incident_id, snapshot_id, reason, reason IN ('no_item_issues', 'item_issues_remain') AS comparable, reason = 'no_item_issues' AS healthy FROM r""")
def item_issue_recovery(spark, sf_dir):
    """Item-issue incidents against later scans: customers as incidents of fifty stores, a supplier's lines as the products of its scan, early returns of many pieces as issues."""
    k = F.col("c_custkey")
    some = table(spark, sf_dir, "customer").select(k.alias("incident_id"), (k % 50).alias("store_id"), F.when(F.col("c_mktsegment") == "BUILDING", "resolved").otherwise("open").alias("status"), F.when(k % 7 == 0, "d").otherwise("c").alias("config"), (k % 40).alias("opened_at"))
    s = F.col("s_suppkey")
    snapshots = table(spark, sf_dir, "supplier").select(s.alias("snapshot_id"), (s % 50).alias("store_id"), F.lit("c").alias("config"), s.alias("at"))
    bad = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49) & (F.col("l_shipdate") < F.lit("1993-06-01").cast("date"))
    products = table(spark, sf_dir, "lineitem").where("l_suppkey % 10 <> 1").select(F.col("l_suppkey").alias("snapshot_id"), F.col("l_partkey").alias("product"), F.when(bad, F.array(F.struct(F.lit("error").alias("severity")))).alias("issues"))
    return recovery.item_issues(some, snapshots, rules.merchant_item_issues(products)).select("incident_id", "snapshot_id", "reason", "comparable", "healthy")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'partial' ELSE 'success' END AS status FROM events),
i AS (SELECT c_custkey AS incident_id, TIMESTAMP '2024-01-10' + INTERVAL 1 HOUR * (c_custkey % 99) AS opened FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 4 <> 0),
p AS (SELECT 'feed' || incident_id AS incident_id, event_id, ts, status = 'success' AS healthy FROM i JOIN e ON user_id = incident_id AND ts > opened WHERE status <> 'partial'
      UNION ALL SELECT 'order' || o_custkey, o_orderkey, o_orderdate, o_orderkey % 3 <> 0 FROM orders WHERE o_orderkey % 4 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY ts, event_id) AS n FROM p),
f AS (SELECT incident_id, CAST(0 AS BIGINT) AS n, 'open' AS status, '' AS event FROM (SELECT DISTINCT incident_id FROM n)
      UNION ALL
      SELECT n.incident_id, n.n, CASE WHEN healthy THEN CASE status WHEN 'open' THEN 'recovering' ELSE 'resolved' END WHEN status = 'recovering' THEN 'open' ELSE status END,
             CASE WHEN healthy THEN CASE status WHEN 'open' THEN 'recovery_started' WHEN 'recovering' THEN 'resolved' ELSE '' END WHEN status = 'recovering' THEN 'reopened' ELSE '' END FROM f JOIN n ON n.incident_id = f.incident_id AND n.n = f.n + 1)
SELECT f.incident_id, event_id AS snapshot_id, status, event FROM f JOIN n USING (incident_id, n)""")
def driven_recovery(spark, sf_dir):
    """The recovery driver over the outcomes of two rules at once: feed-health incidents, and customers' orders as comparable outcomes of another."""
    checks, some = _feed_health(spark, sf_dir)
    one = recovery.feed_health(some, checks).withColumn("incident_id", F.concat(F.lit("feed"), F.col("incident_id").cast("string")))
    o = F.col("o_orderkey")
    two = table(spark, sf_dir, "orders").select(F.concat(F.lit("order"), F.col("o_custkey").cast("string")).alias("incident_id"), o.alias("snapshot_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"), (o % 4 != 0).alias("comparable"), (o % 3 != 0).alias("healthy"), F.lit("order").alias("reason"))
    every = one.unionByName(two)
    known = every.select("incident_id").distinct().withColumn("status", F.lit("open"))
    return recovery.drive(known, every).select("incident_id", "snapshot_id", "status", "event")


@query("""
WITH w AS (SELECT o_orderkey AS id, o_custkey % 97 AS key, o_orderdate AS a, o_orderdate + INTERVAL 1 SECOND * CAST(pow(4, o_orderkey % 14) AS BIGINT) AS b FROM orders),
e AS (SELECT l_orderkey AS id, min(l_suppkey) % 97 AS key, min(l_shipdate) AS t FROM lineitem GROUP BY 1)
SELECT e.id, max_by(w.id, (w.a, w.id)) AS window_id FROM e LEFT JOIN w ON w.key = e.key AND w.a <= e.t AND w.b > e.t GROUP BY 1""")
def long_windows(spark, sf_dir):
    """Windows of seconds to years by bins of time: orders as windows, orders' first shipments as events; the latest start wins."""
    w = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("window_id"), (F.col("o_custkey") % 97).alias("key"), F.col("o_orderdate").alias("starts_at"),
                                              (F.col("o_orderdate") + F.expr("make_dt_interval(0, 0, 0, pow(4, o_orderkey % 14))")).alias("ends_at"), F.lit(None).cast("timestamp").alias("cancelled_at"))
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.min("l_suppkey") % 97).alias("key"), F.min("l_shipdate").alias("t"))
    return store.active_window(e, w, "t", ["key"], ["id"]).select("id", "window_id")


@query("""
WITH m AS (SELECT l_orderkey, list('<b>' || upper(l_returnflag) || ' Size' || repeat('x', CAST(l_partkey % 40 * 25 AS INTEGER)) || ':</b> ' || CASE WHEN l_suppkey % 3 = 0 THEN 'unknown' ELSE '' || l_suppkey END || ' → ' || l_partkey || CASE WHEN l_linenumber % 2 = 0 THEN ' a&amp;b' ELSE '' END
             ORDER BY l_linenumber, l_partkey, l_suppkey) AS metrics, list('• Title ' || l_partkey || CASE WHEN l_linenumber % 2 = 1 THEN ' — https://a.example/' || l_suppkey ELSE '' END ORDER BY l_linenumber, l_partkey, l_suppkey) AS samples FROM lineitem GROUP BY 1),
o AS (SELECT *, '<b>Store:</b> ' || c_name || ' &lt;&#39;&amp;&quot; (' || CASE WHEN o_orderkey % 4 = 0 THEN repeat('d', 197) || '...' ELSE 'https://shop.example' END || ')' AS store, coalesce(metrics, [])[1:6] AS ms, coalesce(samples, [])[1:5] AS ss,
             ['<b>Evidence</b>', '• at ' || o_orderpriority, '• 🙂' || CASE WHEN o_orderkey % 2 = 0 THEN repeat('é', 275) || '...' ELSE '' END, '• third'] AS es FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN m ON l_orderkey = o_orderkey),
x AS (SELECT *, [''] || es || CASE WHEN len(ss) > 0 THEN ['', '<b>Examples</b>'] || ss ELSE [] END AS proof FROM o),
l AS (SELECT o_orderkey, CASE
    WHEN o_orderkey % 5 = 4 THEN ['<b>✅ Incident resolved</b>', store, '<b>Incident:</b> ' || CASE WHEN o_orderkey % 3 = 0 THEN 'Feed monitoring failure' WHEN o_orderkey % 3 = 1 THEN 'Catalog drop' ELSE 'SEO regression' END, 'S' || o_orderstatus] || ms || CASE WHEN o_orderkey % 2 = 1 THEN ['<b>Recovery:</b> because'] ELSE [] END
    WHEN o_orderkey % 3 = 0 THEN ['<b>⚠️ Feed monitoring failure' || CASE WHEN o_orderkey % 5 = 3 THEN ' worsened' ELSE '' END || '</b>', store, 'S' || o_orderstatus, '<b>Products are not confirmed missing.</b>'] || CASE WHEN o_orderkey % 2 = 1 THEN ['<b>Status:</b> because'] ELSE [] END || proof
    ELSE ['<b>🔴 ' || CASE WHEN o_orderkey % 5 = 3 THEN 'Incident worsened: ' || CASE WHEN o_orderkey % 3 = 1 THEN 'Catalog drop' ELSE 'SEO regression' END WHEN o_orderkey % 3 = 1 THEN 'Catalog drop detected' ELSE 'T' || o_orderpriority END || '</b>', store, '<b>Affected:</b> ' || o_custkey] || ms
      || CASE WHEN o_orderkey % 2 = 0 THEN ['<b>Confidence:</b> ' || CAST(floor((o_orderkey % 101) / 100.0::DOUBLE * 100 + 0.5) AS INTEGER) || '%'] ELSE [] END || ['<b>Likely source:</b> feed'] || proof END AS lines FROM x),
u AS (SELECT o_orderkey, unnest(lines) AS line, generate_subscripts(lines, 1) AS i, len(lines) AS n FROM l),
w AS (SELECT *, sum(length(line) + CASE WHEN contains(line, '🔴') OR contains(line, '🙂') THEN 1 ELSE 0 END + 1) OVER (PARTITION BY o_orderkey ORDER BY i) - 1 AS reach FROM u)
SELECT o_orderkey AS event_id, string_agg(line, chr(10) ORDER BY i) FILTER (reach + 4 <= 3900) || CASE WHEN bool_and(reach + 4 <= 3900) THEN '' ELSE chr(10) || '...' END AS text FROM w GROUP BY 1""")
def chat_messages(spark, sf_dir):
    """Chat messages of three templates out of payloads, cut at whole lines: orders as incidents, their lines as metrics with long names and as samples."""
    o, n, none = F.col("o_orderkey"), F.col("l_linenumber"), F.lit(None).cast("string")
    li = table(spark, sf_dir, "lineitem")
    name = F.concat(F.lower("l_returnflag"), F.lit("_size"), F.repeat(F.lit("x"), (F.col("l_partkey") % 40 * 25).cast("int")))
    metric = F.struct(name.alias("name"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey").cast("string")).alias("beforeValue"), F.col("l_partkey").cast("string").alias("afterValue"), F.when(n % 2 == 0, "a&b").alias("unit"))
    sample = F.struct(F.concat(F.lit("Title "), F.col("l_partkey").cast("string")).alias("title"), F.lit("o").alias("offerId"), F.when(n % 2 == 1, F.concat(F.lit("https://a.example/"), F.col("l_suppkey").cast("string"))).alias("url"))
    per = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(n, "l_partkey", "l_suppkey", metric.alias("m"), sample.alias("s")))).alias("x"))
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(per, F.col("l_orderkey") == o, "left")
    kind = F.when(o % 3 == 0, "source_health").when(o % 3 == 1, "catalog_drop").otherwise("seo_regression")
    incident = F.struct(kind.alias("type"), F.concat(F.lit("T"), "o_orderpriority").alias("title"), F.concat(F.lit("S"), "o_orderstatus").alias("summary"), F.col("o_custkey").alias("affectedCount"), F.lit("feed").alias("likelySource"),
                        F.when(o % 2 == 0, (o % 101) / F.lit(100.0)).alias("confidenceScore"))
    body = F.struct(F.when(o % 5 == 4, "incident_resolved").when(o % 5 == 3, "incident_worsened").otherwise("incident_opened").alias("alertType"),
                    F.struct(F.concat("c_name", F.lit(" <'&\"")).alias("name"), F.when(o % 4 == 0, F.repeat(F.lit("d"), 300)).otherwise("https://shop.example").alias("domain")).alias("store"), incident.alias("incident"),
                    F.coalesce(F.transform("x", lambda r: r["m"]), F.array()).alias("metrics"), F.array(F.concat(F.lit("at "), "o_orderpriority"), F.concat(F.lit("🙂"), F.repeat(F.lit("é"), F.when(o % 2 == 0, 400).otherwise(0))), F.lit("third"), F.lit("no more")).alias("evidence"),
                    F.coalesce(F.transform("x", lambda r: r["s"]), F.array()).alias("samples"), F.struct(F.when(o % 2 == 1, "because").otherwise(none).alias("reason")).alias("event"))
    return messages.chat_texts(rows.select(o.alias("event_id"), F.to_json(body).alias("payload")))


@query("""
SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 7 = 0 THEN 'unsupported_payload_version' WHEN o_orderkey % 23 IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13) OR o_orderkey % 5 = 1 THEN 'payload_validation_failed' ELSE 'valid' END AS state FROM orders""")
def payload_validity(spark, sf_dir):
    """Whether payloads hold what their version asks for: orders as deliveries, thirteen kinds of faults in some and other alert types in others."""
    o = F.col("o_orderkey")
    fault = o % 23
    uuid = F.format_string("00000000-0000-4000-8000-%012d", o)
    moment, null = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("null")
    word = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    parts = [
        '{"version":"v1","alertType":"incident_opened","store":{"id":', word(F.when(fault == 1, "x").otherwise(uuid)), ',"name":"n","domain":', F.when(fault == 2, null).otherwise('"d"'), '},"incident":{"id":', word(uuid), ',"type":', word(F.when(fault == 3, "other").otherwise("catalog_drop")),
        ',"severity":"warning","title":"t","summary":"s","status":"open","affectedCount":', F.when(fault == 4, "1.5").when(fault == 5, "-1").otherwise("3"), ',"likelySource":', F.when(fault == 6, '"moon"').when(o % 2 == 0, '"feed"').otherwise(null), ',"confidenceScore":',
        F.when(fault == 7, "1.01").when(o % 2 == 0, "0.5").otherwise(null), ',"firstDetectedAt":', word(F.when(fault == 8, "yesterday").otherwise(moment)), F.when(fault == 9, ',"more":1').otherwise(""), '},"metrics":[{"name":"m","beforeValue":null,"afterValue":"1"', F.when(fault == 10, "").otherwise(',"unit":null'),
        '}],"evidence":["e"', F.when(fault == 11, ",7").otherwise(""), '],"samples":[', F.when(fault == 12, F.array_join(F.array_repeat(F.lit('{"url":"u"}'), 11), ",")).when(fault == 13, '{"url":null}').otherwise('{},{"title":"t"}'), '],"event":{"id":', word(uuid), ',"type":"x","reason":null,"occurredAt":', word(moment), "}}"]
    text = F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    rows = table(spark, sf_dir, "orders").select(o.alias("key"), F.when(o % 7 == 0, "v2").otherwise("v1").alias("payload_version"), text.alias("payload"), F.when(o % 5 == 1, "incident_resolved").otherwise("incident_opened").alias("alert_type"),
                                                 uuid.alias("event_id"), uuid.alias("incident_id"), uuid.alias("store_id"))
    return messages.payload_states(rows).select(F.col("key").alias("event_id"), "state")


@query("""
WITH p AS (SELECT page_id, html, page_id % 6 AS k, 'https://shop.example/p/' || page_id AS u FROM pages),
o AS (SELECT *, CASE WHEN contains(lower(html), 'noindex') THEN 'noindex' ELSE 'indexable' END AS indexability, CASE k WHEN 1 THEN 'self' WHEN 2 THEN 'different' WHEN 5 THEN 'invalid' ELSE 'missing' END AS canonical_state, k = 3 AS schema_present,
             CASE k WHEN 3 THEN 'json_ld' WHEN 4 THEN 'embedded_json' ELSE 'html' END AS strategy, CASE k WHEN 3 THEN page_id || '.5' WHEN 4 THEN '7' WHEN 5 THEN '9.99 EUR' END AS price, CASE k WHEN 3 THEN 'EUR' END AS currency FROM p)
SELECT page_id, CAST(len(regexp_extract_all(html, '<a href')) AS BIGINT) AS links, indexability, canonical_state, schema_present, strategy, price, currency, 'url:' || u AS stable_key,
       CASE WHEN k IN (3, 4) THEN sha256('{"finalUrl":"' || u || '","httpStatus":200,"indexability":"' || indexability || '","canonicalState":"missing","schemaPresent":' || schema_present || ',"schemaValidEnough":' || schema_present
         || ',"effectivePrice":"' || price || '"' || CASE WHEN k = 3 THEN ',"currency":"EUR","availability":"in \\"stock\\"","imageUrl":"https://shop.example/i.png"' ELSE '' END || '}') END AS raw_hash FROM o""")
def page_links(spark, sf_dir):
    """Product pages as observations and items: a head before every page says nothing, a canonical address of three kinds, linked data, embedded JSON, or a price in the text."""
    k, page = F.col("page_id") % 6, F.col("page_id").cast("string")
    url = F.concat(F.lit("https://Shop.example/p/"), page)
    linked = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"Thing"},{"x":{"@type":["A","Product"],"name":" N ","image":["/i.png"],"offers":[{"price":'), page, F.lit('.50,"priceCurrency":"EUR","availability":"in \\"stock\\""}]}}]}</script>'))
    embedded = F.lit('<script type="application/ld+json">{no json</script><script type="application/json">{"a":[{"b":{"type":"Product","title":"E","price":7.0}}]}</script>')
    head = (F.when(k == 1, F.concat(F.lit('<link rel="canonical" href="'), url, F.lit('/?x=1">'))).when(k == 2, F.lit('<link rel="canonical" href="/other">')).when(k == 3, linked).when(k == 4, embedded)
            .when(k == 5, F.lit('<link rel="canonical" href="mailto:a"><b class="x price"> 9.99 EUR</b>')).otherwise(""))
    rows = table(spark, sf_dir, "pages").select("page_id", url.alias("url"), url.alias("final_url"), F.lit(200).alias("http_status"), F.lit(None).cast("string").alias("robots_header"), F.concat(head, F.coalesce("html", F.lit(""))).alias("html"))
    seen = product_page.observations(rows)
    items = product_page.page_items(seen.select("*", F.col("strategy").alias("how"), F.col("links").alias("n"), F.col("canonical_state").alias("state")))
    return items.select("page_id", F.col("n").cast("long").alias("links"), "indexability", F.col("state").alias("canonical_state"), "schema_present", F.col("how").alias("strategy"), "price", "currency", "stable_key",
                        F.when(F.col("how") != "html", F.col("raw_hash")).alias("raw_hash"))


@query("""
WITH i AS (SELECT l_orderkey % 9 AS snapshot_id, l_partkey % 700 AS k, l_linenumber % 2 AS side, min(l_orderkey * 10 + l_linenumber) AS id FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT snapshot_id, k, min(id) FILTER (side = 0) AS feed, min(id) FILTER (side = 1) AS shop FROM i GROUP BY 1, 2)
SELECT snapshot_id, 'offer:p' || k AS matched_key, feed AS feed_id, shop AS storefront_id FROM m WHERE snapshot_id NOT IN (3, 4) UNION ALL SELECT snapshot_id, 'offer:p' || k, feed, shop FROM m WHERE snapshot_id = 3 AND k % 2 = 0""")
def replaced_matches(spark, sf_dir):
    """Matches written by snapshot and replaced: all nine snapshots, then one again with half of its products and one without any, read back."""
    li = table(spark, sf_dir, "lineitem")
    none = F.lit(None).cast("string")
    items = li.groupBy((F.col("l_orderkey") % 9).alias("snapshot_id"), (F.col("l_partkey") % 700).alias("k"), (F.col("l_linenumber") % 2).alias("side")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    items = items.select("id", "snapshot_id", "k", F.when(F.col("side") == 0, "feed").otherwise("storefront").alias("source"), F.concat(F.lit(" P"), F.col("k").cast("string")).alias("offer_id"), none.alias("url"), none.alias("canonical_url"), none.alias("final_url"))
    path = snapshots.shared_folder(spark, "matches")
    every = identity.source_matches(items)
    snapshots.replace_snapshots(every, items.select("snapshot_id"), path)
    again = identity.source_matches(items.where("snapshot_id = 3 and k % 2 = 0 or snapshot_id = 5"))
    asked = items.where("snapshot_id in (3, 4, 5)").select("snapshot_id")
    snapshots.replace_snapshots(again, asked, path)
    return snapshots.read_snapshots(spark, path).select(F.col("snapshot_id").cast("long").alias("snapshot_id"), "matched_key", "feed_id", "storefront_id")


@query("""
WITH c AS (SELECT event_id, user_id % 40 * 100 + day(ts) AS snapshot_id, CASE event_id % 3 WHEN 0 THEN 'sitemap' WHEN 1 THEN 'feed' ELSE 'merchant_center' END AS source, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'partial' ELSE 'success' END AS status, event_id % 100 AS n, ts FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, source ORDER BY ts DESC, event_id DESC) AS r FROM c),
m AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY ts DESC, event_id DESC) AS r FROM c WHERE source = 'merchant_center' AND event_id % 4 <> 0)
SELECT c.snapshot_id, CASE WHEN bool_and(c.status = 'success') THEN 'completed' WHEN count(*) FILTER (c.status IN ('success', 'partial')) > 0 THEN 'partial' ELSE 'failed' END AS status,
       (SELECT n FROM k WHERE k.snapshot_id = c.snapshot_id AND source = 'sitemap' AND r = 1) AS sitemap_url_count, (SELECT n FROM k WHERE k.snapshot_id = c.snapshot_id AND source = 'feed' AND r = 1) AS feed_product_count,
       (SELECT n FROM m WHERE m.snapshot_id = c.snapshot_id AND r = 1) AS merchant_total FROM c GROUP BY 1""")
def snapshot_rollup(spark, sf_dir):
    """State and counts of snapshots out of their checks: the events of a user group's day as checks of three sources, the parts of some counts not adding up."""
    k = F.col("event_id")
    checks = table(spark, sf_dir, "events").select(
        k.alias("check_id"), (F.col("user_id") % 40 * 100 + F.dayofmonth("ts")).alias("snapshot_id"), F.when(k % 3 == 0, "sitemap").when(k % 3 == 1, "feed").otherwise("merchant_center").alias("source"),
        F.when(F.col("event_type") == "error", "timeout").when(F.col("event_type") == "click", "partial").otherwise("success").alias("status"), (k % 100).alias("items_observed"), (k % 100).alias("total"),
        (k % 100 + F.when(k % 4 == 0, 5).otherwise(0)).alias("approved"), F.lit(0).alias("pending"), F.lit(0).alias("disapproved"), F.col("ts").alias("finished_at"))
    return snapshots.rollup(checks).select("snapshot_id", "status", "sitemap_url_count", "feed_product_count", "merchant_total")


@query("""
WITH d AS (SELECT DISTINCT user_id % 7 AS store, 'https://a.example/' || CASE WHEN event_id % 3 = 0 THEN 'Products/' WHEN event_id % 3 = 1 THEN 'x/' ELSE 'product/' END || event_id % 400 AS url FROM events WHERE event_type <> 'error' AND (event_id % 3 <> 1 OR event_type = 'view')),
r AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY md5(store || ':' || url), url) AS n FROM d),
u AS (SELECT store, list(url ORDER BY n) AS urls FROM r WHERE n <= 25 GROUP BY 1)
SELECT store AS store_id, CAST(len(urls) AS BIGINT) AS selected_count, sha256('["' || array_to_string(urls, '","') || '"]') AS urls_hash FROM u""")
def sample_manifest(spark, sf_dir):
    """Sample manifests (a top-k by hash is the feature): events as the items of seven stores, those of shops by source, others by address."""
    k = F.col("event_id")
    part = F.when(k % 3 == 0, "Products/").when(k % 3 == 1, "x/").otherwise("product/")
    items = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("store_id"), F.lit(1).alias("snapshot_id"), F.when(F.col("event_type") == "view", "feed").otherwise("sitemap").alias("source"),
                                                  F.when(F.col("event_type") != "error", F.concat(F.lit("https://a.example/"), part, (k % 400).cast("string"))).alias("url"))
    return snapshots.sample_manifests(items).select("store_id", F.col("selected_count").cast("long").alias("selected_count"), "urls_hash")


@query("""
WITH c AS (SELECT l_suppkey AS snapshot_id, CASE WHEN l_quantity < 26 THEN l_shipmode ELSE 'q' || CAST(l_quantity AS BIGINT) END AS code, l_partkey FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) WHERE l_linenumber <> 2),
g AS (SELECT snapshot_id, code, CAST(count(*) AS BIGINT) AS issues, CAST(count(DISTINCT l_partkey) AS BIGINT) AS products FROM c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY issues DESC, lower(code)) AS rank FROM g)
SELECT snapshot_id, rank, code, issues, products FROM r WHERE rank <= 10""")
def issue_codes(spark, sf_dir):
    """The ten most frequent issue codes of each scan (a top-k report): suppliers as scans, lines as issues of their parts."""
    li = table(spark, sf_dir, "lineitem")
    code = F.when(F.col("l_quantity") < 26, F.concat("l_returnflag", "l_linestatus")).otherwise(F.concat(F.lit("q"), F.col("l_quantity").cast("long").cast("string")))
    products = li.select(F.col("l_suppkey").alias("snapshot_id"), F.col("l_partkey").alias("product"), F.when(F.col("l_linenumber") != 2, F.array(F.struct(code.alias("code")))).alias("issues"))
    got = rules.issue_codes(products)
    return got.select("snapshot_id", F.col("rank").cast("long").alias("rank"), "code", "issues", "products")


@query("""
SELECT c_custkey AS baseline_id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 <> 0 AND o.at IS NOT NULL THEN 'active' ELSE CASE c_custkey % 3 WHEN 0 THEN 'ready_for_confirmation' WHEN 1 THEN 'active' ELSE 'learning' END END AS status,
       CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 <> 0 THEN o.who END AS confirmed_by
FROM customer LEFT JOIN (SELECT o_custkey, min((o_orderdate, o_orderkey))[1] AS at, min((o_orderdate, o_orderkey))[2] AS who FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o_custkey = c_custkey""")
def baseline_confirmation(spark, sf_dir):
    """Baselines after their confirmations: customers as baselines, some replaced already, finished orders as confirmations; the first one counts."""
    k = F.col("c_custkey")
    metrics = table(spark, sf_dir, "customer").select(k.alias("baseline_id"), F.lit("s").alias("store_id"), F.lit(1).alias("version"), F.when(k % 3 == 0, "ready_for_confirmation").when(k % 3 == 1, "active").otherwise("learning").alias("status"),
                                                      F.when(k % 5 == 0, F.lit("2020-01-01").cast("date")).alias("valid_to"), F.lit(None).cast("long").alias("confirmed_by"), F.lit(None).cast("timestamp_ntz").alias("confirmed_at"))
    asked = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("baseline_id"), F.col("o_orderkey").alias("by"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    return snapshots.confirmed_baseline(metrics, asked).select("baseline_id", "status", "confirmed_by")
