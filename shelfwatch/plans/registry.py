"""Queries of this library over the driver's tables, and their SQL.

The tables are star-schema, event and text tables, not catalogs: each query applies an operator of the library to the
nearest analogue, named in its docstring.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.canonical import canonical_hash
from ..operators import alerts, baseline, correlation, identity, incidents, lifecycle, recovery, reports, rules, store, timeline
from ..sources import category, merchant
from . import decisions, values  # noqa: F401 (their queries register themselves)
from .base import ORACLE_SQL, QUERIES  # noqa: F401
from .base import query as _query
from .base import table as _table

def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a type in a day as the observations of a source."""
    events = _table(spark, sf_dir, "events")
    return events.groupBy("event_type", F.to_date("ts").alias("at")).agg(F.count("*").alias("value"))


DAILY = 'daily AS (SELECT event_type, CAST(ts AS DATE) AS "at", count(*) AS value FROM events GROUP BY 1, 2)'


@_query(f"""
WITH {DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY "at" DESC) AS n FROM daily)
SELECT event_type, quantile_cont(value, 0.5) AS median_value, min(value) AS min_value, max(value) AS max_value, quantile_cont(value, 0.1) AS p10_value,
       quantile_cont(value, 0.9) AS p90_value, count(*) AS sample_count, CASE WHEN count(*) < 7 THEN 'learning' ELSE 'ready' END AS status
FROM r WHERE n <= 14 GROUP BY event_type""")
def baseline_last14(spark, sf_dir):
    """Baseline of the last 14 comparable observations: daily counts by event type."""
    rows = _daily(spark, sf_dir).withColumn("comparable", F.lit(True)).withColumn("config", F.lit("c"))
    return baseline.latest(rows, ["event_type"]).select("event_type", "median_value", "min_value", "max_value", "p10_value", "p90_value", "sample_count", "status")


@_query(f"""
WITH {DAILY}
SELECT event_type, "at", value, quantile_cont(value, 0.5) OVER w AS median_before, count(value) OVER w AS samples_before
FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY "at" ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)""")
def baseline_rolling(spark, sf_dir):
    """Median of the 14 observations before each."""
    return baseline.rolling(_daily(spark, sf_dir), ["event_type"])


@_query(f"""
WITH {DAILY}, r AS (
  SELECT event_type, "at", value, quantile_cont(value, 0.5) OVER w AS median_before, count(value) OVER w AS samples_before
  FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY "at" ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
SELECT event_type, "at", value, median_before, samples_before, median_before - value AS change_abs,
       CASE WHEN median_before = 0 THEN 0 ELSE (median_before - value) / median_before END AS change_pct,
       value <= median_before * (1 - 0.2::DOUBLE) AND median_before - value >= 1 AS is_drop
FROM r WHERE samples_before >= 7""")
def catalog_drop(spark, sf_dir):
    """Catalog drop against the rolling baseline: by 20 % and by 1 event at least."""
    return baseline.catalog_drops(_daily(spark, sf_dir), ["event_type"], abs_=1)


@_query("""
WITH m AS (SELECT o_custkey, count(*) AS matched, count(*) FILTER (NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)) AS missing FROM orders GROUP BY 1)
SELECT o_custkey, matched, missing, matched > 0 AND missing / greatest(matched, 1) >= 0.1 AND missing >= 2 AS is_loss FROM m""")
def matched_loss(spark, sf_dir):
    """Matched items that another source has lost: a customer's orders without a line above 25 pieces."""
    orders = _table(spark, sf_dir, "orders")
    seen = _table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("seen", F.lit(True))
    rows = orders.select("o_orderkey", "o_custkey").join(seen, "o_orderkey", "left").groupBy("o_custkey").agg(F.count("*").alias("matched"), F.count_if(F.col("seen").isNull()).alias("missing"))
    return rows.withColumn("is_loss", baseline.is_matched_loss(F.col("matched"), F.col("missing"), abs_=2))


@_query("""
SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS checks, count(*) FILTER (event_type <> 'error') AS good,
       CASE WHEN bool_and(event_type <> 'error') THEN 'completed' WHEN bool_or(event_type <> 'error') THEN 'partial' ELSE 'failed' END AS status
FROM events GROUP BY 1, 2""")
def source_status_rollup(spark, sf_dir):
    """Snapshot status from its checks: a user's events of a day."""
    ok = F.col("event_type") != "error"
    return _table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("checks"), F.count_if(ok).alias("good"), F.when(F.bool_and(ok), "completed").when(F.bool_or(ok), "partial").otherwise("failed").alias("status"))


@_query("""
WITH r AS (SELECT user_id, event_type = 'error' AS failed, coalesce(sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC), 0) AS newer_ok FROM events)
SELECT user_id, count(*) FILTER (failed AND newer_ok = 0) AS streak FROM r GROUP BY 1""")
def failure_streak(spark, sf_dir):
    """Consecutive failures up to the newest check, by user."""
    events = _table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return lifecycle.newest_streak(events, ["user_id"], "at", F.col("event_type") == "error")


@_query("""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2),
s AS (SELECT *, errors >= 0.25 * n AS significant FROM d)
SELECT user_id, day, n, errors, significant, CASE WHEN significant AND coalesce(lag(significant) OVER (PARTITION BY user_id ORDER BY day), false) THEN 'confirmed'
       WHEN significant THEN 'pending' ELSE 'healthy' END AS debounce FROM s""")
def debounce_two_strike(spark, sf_dir):
    """Two-strike debounce: days on which a quarter of a user's events are errors."""
    rows = _table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return lifecycle.two_strikes(rows, ["user_id"], "day", F.col("errors") >= 0.25 * F.col("n"))


@_query("""
WITH RECURSIVE d AS (
  SELECT user_id, CAST(ts AS DATE) AS "at", row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS n, count(*) >= 2 AS comparable, count(*) FILTER (event_type = 'error') = 0 AS healthy
  FROM events GROUP BY 1, 2),
f AS (
  SELECT user_id, CAST(0 AS BIGINT) AS n, 'open' AS status, '' AS event FROM (SELECT DISTINCT user_id FROM d)
  UNION ALL
  SELECT d.user_id, d.n,
    CASE WHEN NOT comparable THEN status WHEN healthy AND status = 'open' THEN 'recovering' WHEN healthy AND status = 'recovering' THEN 'resolved' WHEN NOT healthy AND status = 'recovering' THEN 'open' ELSE status END,
    CASE WHEN NOT comparable THEN '' WHEN healthy AND status = 'open' THEN 'recovery_started' WHEN healthy AND status = 'recovering' THEN 'resolved' WHEN NOT healthy AND status = 'recovering' THEN 'reopened' ELSE '' END
  FROM f JOIN d ON d.user_id = f.user_id AND d.n = f.n + 1)
SELECT f.user_id, "at", status, event FROM f JOIN d ON d.user_id = f.user_id AND d.n = f.n""")
def recovery_fsm(spark, sf_dir):
    """Recovery of an incident over the days of a user: a day without errors is healthy, of one event not comparable."""
    rows = _table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("at")).agg(
        (F.count("*") >= 2).alias("comparable"), (F.count_if(F.col("event_type") == "error") == 0).alias("healthy")).withColumn("snapshot", F.col("at").cast("string"))
    return lifecycle.recovery_fold(rows, "user_id", "at")


@_query("""
WITH g AS (SELECT u.user_id, t.event_type FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) t(event_type)),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT g.user_id, g.event_type, l.event_id, l.ts, l.value FROM g LEFT JOIN l ON l.user_id = g.user_id AND l.event_type = g.event_type AND l.n = 1""")
def latest_per_source(spark, sf_dir):
    """Latest check of each source of a fixed list, by user, sources without one included."""
    events = _table(spark, sf_dir, "events")
    grid = events.select("user_id").distinct().withColumn("event_type", F.explode(F.array(*[F.lit(t) for t in ("click", "error", "purchase", "signup", "view")])))
    last = events.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("l"))
    return grid.join(last, ["user_id", "event_type"], "left").select("user_id", "event_type", "l.event_id", "l.ts", "l.value")


@_query("""
SELECT c_custkey, c_name, count(o_orderkey) AS orders_, count(*) FILTER (o_orderstatus = 'O') AS open_, count(*) FILTER (o_orderstatus = 'F') AS done, max(o_orderdate) AS last_
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def store_summary(spark, sf_dir):
    """Summary of each store with conditional counts, stores without any included: customers and their orders."""
    o = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders_"), F.count_if(F.col("o_orderstatus") == "O").alias("open_"),
                                                                 F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.max("o_orderdate").alias("last_"))
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", "c_name", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("orders_", "open_", "done")], "last_")


@_query("""
WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderpriority || ':' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS n FROM orders)
SELECT o_orderpriority, o_orderkey, n FROM r WHERE n <= 25""")
def stable_sample(spark, sf_dir):
    """Deterministic sample of 25 a group, by md5 of group and id (a sampling operator)."""
    orders = _table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey")
    h = F.md5(F.concat_ws(":", "o_orderpriority", F.col("o_orderkey").cast("string")).cast("binary"))
    w = Window.partitionBy("o_orderpriority").orderBy("h", "o_orderkey")
    return orders.withColumn("h", h).withColumn("n", F.row_number().over(w)).where("n <= 25").select("o_orderpriority", "o_orderkey", "n")


@_query("""
SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1997-01-01 00:00:00', 500) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51""")
def keyset_page(spark, sf_dir):
    """The page after a cursor, newest first, and one row more (a top-k report)."""
    import datetime as dt

    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return store.page(rows, [("o_orderdate", True), ("o_orderkey", True)], 50, (dt.datetime(1997, 1, 1), 500))


@_query("""
SELECT user_id, count(*) AS issues, count(DISTINCT json_extract_string(props, '$.k')) AS codes, count(DISTINCT concat_ws(chr(31), event_type, json_extract_string(props, '$.k'))) AS pairs,
       max(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END) AS priority FROM events GROUP BY 1""")
def queue_rollup(spark, sf_dir):
    """Remediation queue: issues out of JSON, rolled up by product with distinct composite keys and priority."""
    code = F.get_json_object("props", "$.k")
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("issues"), F.countDistinct(code).alias("codes"), F.countDistinct(F.concat_ws("\x1f", "event_type", code)).alias("pairs"),
        F.max(F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(1)).alias("priority"))


@_query("""
SELECT event_type, count(*) AS occurrences, count(DISTINCT user_id) AS products, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' ELSE 'normal' END AS priority
FROM (SELECT DISTINCT event_type, user_id, json_extract_string(props, '$.k') AS k FROM events) GROUP BY 1""")
def triage_groups(spark, sf_dir):
    """Issue triage: groups of deduplicated issues with the products they touch."""
    rows = _table(spark, sf_dir, "events").select("event_type", "user_id", F.get_json_object("props", "$.k").alias("k")).distinct()
    return rows.groupBy("event_type").agg(F.count("*").alias("occurrences"), F.countDistinct("user_id").alias("products")).withColumn(
        "priority", F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "high").otherwise("normal"))


SIDES = """
f AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN lower(trim(p_name)) END AS offer, CAST(p_partkey AS VARCHAR) AS stable FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 10 <> 0),
m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN lower(trim(p_name)) END AS offer, CAST(p_partkey AS VARCHAR) AS stable FROM part WHERE p_partkey % 7 <> 0),
a AS (SELECT 'feed' AS side, * FROM f UNION ALL SELECT 'merchant', * FROM m),
o AS (SELECT offer, CASE WHEN count(*) FILTER (side = 'feed') > 1 OR count(*) FILTER (side = 'merchant') > 1 THEN 'ambiguous'
                         WHEN count(*) FILTER (side = 'feed') = 1 AND count(*) FILTER (side = 'merchant') = 1 THEN 'matched' END AS status FROM a WHERE offer IS NOT NULL GROUP BY offer),
g AS (SELECT stable, count(*) FILTER (side = 'feed') AS nf, count(*) FILTER (side = 'merchant') AS nm, min(offer) AS offer FROM a
      WHERE offer IS NULL OR offer NOT IN (SELECT offer FROM o WHERE status IS NOT NULL) GROUP BY stable),
r AS (SELECT 'offer:' || offer AS identity, status FROM o WHERE status IS NOT NULL
      UNION ALL SELECT coalesce('offer:' || offer, 'key:' || stable), CASE WHEN nf > 1 OR nm > 1 THEN 'ambiguous' WHEN nf = 1 AND nm = 1 THEN 'matched' WHEN nf = 1 THEN 'feed_only' ELSE 'merchant_only' END FROM g)
"""


def _mapping(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("offer_id"), F.col("p_partkey").cast("string").alias("stable_key"))
    return identity.cross_source_mapping(rows.where("id % 9 <> 0 AND id % 10 <> 0"), rows.where("id % 7 <> 0"))


@_query(f"WITH {SIDES} SELECT identity, status FROM r")
def cross_source_mapping(spark, sf_dir):
    """Two-stage product identity between two inventories made of parts."""
    return _mapping(spark, sf_dir)


@_query(f"""WITH {SIDES}, n AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY identity) AS rank, count(*) OVER (PARTITION BY status) > 50 AS truncated FROM r)
SELECT identity, status, rank, truncated FROM n WHERE rank <= 50""")
def mapping_samples(spark, sf_dir):
    """The first 50 identities of each status (a top-k report)."""
    return identity.samples(_mapping(spark, sf_dir))


@_query("""
SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit, p_retailprice, abs(l_extendedprice / l_quantity - p_retailprice) AS diff
FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE abs(l_extendedprice / l_quantity - p_retailprice) >= 0.02 AND abs(l_extendedprice / l_quantity - p_retailprice) / greatest(abs(l_extendedprice / l_quantity), abs(p_retailprice), 1) >= 0.5""")
def price_mismatch(spark, sf_dir):
    """Prices of matched items beyond an absolute and a relative tolerance: unit prices of lines and retail prices."""
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    rows = li.join(part, li["l_partkey"] == part["p_partkey"]).withColumn("diff", F.abs(F.col("unit") - F.col("p_retailprice")))
    return rows.where((F.col("diff") >= 0.02) & (F.col("diff") / F.greatest(F.abs("unit"), F.abs("p_retailprice"), F.lit(1)) >= 0.5)).select("l_orderkey", "l_linenumber", "unit", "p_retailprice", "diff")


@_query("""
WITH w AS (SELECT user_id, ts AS starts_at, ts + INTERVAL 1 HOUR AS ends_at, event_id AS window_id FROM events WHERE event_type = 'signup')
SELECT e.event_id, e.user_id, arg_max(w.window_id, (w.starts_at, w.window_id)) AS window_id FROM events e LEFT JOIN w ON w.user_id = e.user_id AND w.starts_at <= e.ts AND w.ends_at > e.ts GROUP BY 1, 2""")
def maintenance_join(spark, sf_dir):
    """The maintenance window that holds each event, the latest start winning: an hour from each signup of a user."""
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    w = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("window_id"), F.col("ts").alias("starts_at"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ends_at"), F.lit(None).cast("timestamp").alias("cancelled_at"))
    return store.active_window(events, w, "ts", ["user_id"], ["event_id"]).select("event_id", "user_id", "window_id")


@_query("""
SELECT event_id, channel, CASE WHEN user_id % 11 = 0 THEN 'alerts_disabled' WHEN channel = 'telegram' AND user_id % 2 = 0 THEN 'channel_disabled' WHEN event_type = 'click' THEN 'incident_type_muted'
  WHEN event_type = 'view' AND user_id % 3 = 0 THEN 'open_notifications_disabled' WHEN event_type = 'signup' THEN 'recovery_notifications_disabled' WHEN event_id % 13 = 0 THEN 'maintenance_window' END AS suppression
FROM events CROSS JOIN (VALUES ('email'), ('telegram')) c(channel)""")
def delivery_decision(spark, sf_dir):
    """Alert decisions for two channels, the first reason winning."""
    rows = _table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "signup", "resolved").when(F.col("event_type") == "error", "worsened").otherwise("opened").alias("alert_type"), F.col("event_type").alias("incident_type"),
        (F.col("user_id") % 11 != 0).alias("enabled"), F.lit(True).alias("email_enabled"), (F.col("user_id") % 2 != 0).alias("telegram_enabled"), F.array(F.lit("click")).alias("muted"),
        (~((F.col("event_type") == "view") & (F.col("user_id") % 3 == 0))).alias("notify_on_open"), F.lit(True).alias("notify_on_worsening"), F.lit(False).alias("notify_on_recovery"),
        F.when(F.col("event_id") % 13 == 0, F.col("event_id")).alias("window_id"))
    return alerts.decisions(rows).select("event_id", "channel", "suppression")


@_query("""
SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN least(greatest(event_id, 1), 86400) ELSE CASE least(event_id % 6 + 1, 4) WHEN 1 THEN 60 WHEN 2 THEN 300 WHEN 3 THEN 900 ELSE 3600 END END AS BIGINT) AS delay FROM events""")
def retry_schedule(spark, sf_dir):
    """Delay before the next attempt: a ladder, or the server's wish within a day."""
    return _table(spark, sf_dir, "events").select("event_id", C.retry_seconds((F.col("event_id") % 6 + 1), F.when(F.col("event_id") % 5 == 0, F.col("event_id"))).cast("long").alias("delay"))


@_query("""
WITH v AS (SELECT c_custkey, 1 AS seq, c_name, c_acctbal, c_mktsegment FROM customer
           UNION ALL SELECT c_custkey, 2, c_name || '*', CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal + 1 END, CASE WHEN c_custkey % 4 = 0 THEN 'NEW' END FROM customer WHERE c_custkey % 2 = 0)
SELECT c_custkey, max(seq) AS seq, arg_max(c_name, seq) AS c_name, arg_max(c_acctbal, seq) FILTER (c_acctbal IS NOT NULL) AS c_acctbal, arg_max(c_mktsegment, seq) FILTER (c_mktsegment IS NOT NULL) AS c_mktsegment FROM v GROUP BY 1""")
def merge_coalesce(spark, sf_dir):
    """Upsert in which nulls of the newer version don't overwrite: two versions of customers."""
    old = _table(spark, sf_dir, "customer").select("c_custkey", F.lit(1).alias("seq"), "c_name", "c_acctbal", "c_mktsegment")
    new = old.where("c_custkey % 2 = 0").select("c_custkey", F.lit(2).alias("seq"), F.concat("c_name", F.lit("*")).alias("c_name"),
                                                F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") + 1).alias("c_acctbal"), F.when(F.col("c_custkey") % 4 == 0, "NEW").alias("c_mktsegment"))
    return store.merge_latest(old.unionByName(new), ["c_custkey"], "seq", ["c_acctbal", "c_mktsegment"])


@_query(r"""
WITH k AS (SELECT lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]+)', 1)) AS head, regexp_replace(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '/+$', '') AS path FROM pages)
SELECT head || CASE WHEN path = '' THEN '/' ELSE path END AS url_key, count(*) AS n FROM k GROUP BY 1""")
def url_normalize(spark, sf_dir):
    """Distinct normalised addresses, with the pages of each."""
    return _table(spark, sf_dir, "pages").groupBy(C.url_key(F.col("url")).alias("url_key")).agg(F.count("*").alias("n"))


@_query("SELECT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS offer, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1")
def offer_normalize(spark, sf_dir):
    """Offer ids normalised and grouped: part names."""
    return _table(spark, sf_dir, "part").groupBy(C.offer_key(F.col("p_name")).alias("offer")).agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands"))


@_query("""SELECT s_suppkey, sha256('{"name":"' || s_name || '","nation":' || s_nationkey || '}') AS config_hash FROM supplier""")
def config_hash(spark, sf_dir):
    """Hash of a configuration's canonical JSON (keys in order)."""
    return _table(spark, sf_dir, "supplier").select("s_suppkey", canonical_hash(F.to_json(F.struct(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name")))).alias("config_hash"))


@_query(r"SELECT doc_id FROM documents WHERE text ILIKE '%license%' ESCAPE '\' OR source ILIKE '%c1\_%' ESCAPE '\' OR lang ILIKE 'es' ESCAPE '\'")
def escaped_search(spark, sf_dir):
    """Search without case over three columns, the wildcards of the words escaped."""
    hit = F.lit(False)
    for column, word in (("text", f"%{C.like_pattern('license')}%"), ("source", f"%{C.like_pattern('c1_')}%"), ("lang", "es")):
        hit = hit | F.col(column).ilike(word)
    return _table(spark, sf_dir, "documents").where(hit).select("doc_id")


@_query("""
WITH v AS (SELECT o_custkey, o_orderdate AS valid_from, max(o_totalprice) AS level FROM orders GROUP BY 1, 2),
r AS (SELECT event_id, user_id, TIMESTAMP '1992-01-01' + INTERVAL 1 DAY * (event_id % 2500) AS at_ FROM events)
SELECT r.event_id, r.user_id, v.level FROM r ASOF LEFT JOIN v ON v.o_custkey = r.user_id AND v.valid_from <= r.at_""")
def threshold_asof(spark, sf_dir):
    """The version in force at each row's time: a customer's last order as a version of its thresholds."""
    v = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("valid_from")).agg(F.max("o_totalprice").alias("level"))
    r = _table(spark, sf_dir, "events").select("event_id", "user_id", (F.expr("TIMESTAMP_NTZ '1992-01-01 00:00:00'") + F.expr("INTERVAL 1 DAY") * (F.col("event_id") % 2500)).alias("at"))
    return timeline.as_of(r, v, "user_id", "at", "valid_from", ["level"]).select("event_id", "user_id", "level")


@_query("""
WITH m AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1, 2),
l AS (SELECT *, lag(f) OVER w AS pf, lag(o) OVER w AS po, lag(month) OVER w AS pm FROM m WINDOW w AS (PARTITION BY o_custkey ORDER BY month))
SELECT month, count(*) FILTER (pf > 0 AND f = 0) AS lost_f, count(*) FILTER (po > 0 AND o = 0) AS lost_o, count(*) AS pairs FROM l WHERE pm IS NOT NULL GROUP BY 1""")
def seo_transitions(spark, sf_dir):
    """Transitions between a snapshot and its predecessor, counted by signal: order states of customers' months."""
    orders = _table(spark, sf_dir, "orders")
    m = orders.groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("month")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))
    w = Window.partitionBy("o_custkey").orderBy("month")
    rows = m.select("*", F.lag("f").over(w).alias("pf"), F.lag("o").over(w).alias("po"), F.lag("month").over(w).alias("pm")).where("pm is not null")
    return rows.groupBy("month").agg(F.count_if((F.col("pf") > 0) & (F.col("f") == 0)).alias("lost_f"), F.count_if((F.col("po") > 0) & (F.col("o") == 0)).alias("lost_o"), F.count("*").alias("pairs"))


#: Wordings of availability that the queries below take in turn.
WORDINGS = ("in stock", "InStock", "available", "https://schema.org/InStock", "http://schema.org/OutOfStock", "Out-of-Stock", "sold out", "unavailable", "not_in_stock", "PreOrder", "pre-order", "on backorder", "", "soon", "In  -Stock", " in stock")


def _worded(n):
    return F.element_at(F.array(*[F.lit(w) for w in WORDINGS]), (n % len(WORDINGS) + 1).cast("int"))


def _worded_sql(n):
    """The wording and its meaning, by plain rules."""
    said = f"list_extract([{', '.join(repr(w) for w in WORDINGS)}], CAST({n} % {len(WORDINGS)} AS INTEGER) + 1)"
    word = f"regexp_replace(regexp_replace(lower({said}), 'https?://schema[.]org/', ''), '[ -]+', '_', 'g')"
    return (f"CASE WHEN {word} IN ('in_stock', 'instock', 'available') THEN 'in_stock' WHEN {word} IN ('out_of_stock', 'outofstock', 'sold_out', 'unavailable') THEN 'out_of_stock' "
            f"WHEN contains({word}, 'preorder') THEN 'preorder' WHEN contains({word}, 'backorder') THEN 'backorder' ELSE 'unknown' END")


@_query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'unknown' ELSE {_worded_sql('o_orderkey')} END AS availability FROM orders")
def availability_norm(spark, sf_dir):
    """Wordings of availability, normalised: the order's number chooses one, none for some."""
    said = F.when(F.col("o_orderkey") % 97 != 0, _worded(F.col("o_orderkey")))
    return _table(spark, sf_dir, "orders").select("o_orderkey", C.availability(said).alias("availability"))


#: Match rows of the price rule: order lines as matches of a feed and a shop item; the third of a part's lines have its name, the others one of their own.
PRICE_ROWS = f"""l AS (SELECT l_suppkey % 20 AS snapshot_id, l_linenumber AS n, l_orderkey AS o, l_partkey AS k, p_size, l_linenumber % 3 AS way FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) JOIN part ON p_partkey = l_partkey WHERE l_linenumber <> 7 AND l_suppkey % 20 % 7 <> 3),
j AS (SELECT snapshot_id, way, CASE WHEN o % 11 <> 0 AND o % 13 NOT IN (0, 1) THEN abs((p_size + 0.5) - (p_size + CASE WHEN (o + n) % 4 = 0 THEN 1 ELSE 0 END + 0.51)) END AS diff, p_size + CASE WHEN (o + n) % 4 = 0 THEN 1 ELSE 0 END + 0.51 AS most,
             {_worded_sql('o')} AS x, {_worded_sql('(k + 1)')} AS y, CASE WHEN o % 3 = 0 THEN 'u' || k ELSE 'u' || o || '-' || n END || ':' || CASE WHEN o % 3 = 0 THEN '' ELSE 't' END AS named FROM l),
f AS (SELECT snapshot_id, way, coalesce(diff >= 0.02 AND diff / most >= 0.001, false) AS p, x <> 'unknown' AND y <> 'unknown' AND x <> y AS v, named FROM j)"""


def _price_tables(spark, sf_dir):
    """(matches, items, checks) as rules.match_rows takes them."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    li = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"))  # line numbers repeat
    li = li.join(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    line = F.concat_ws("-", o.cast("string"), n.cast("string"))
    way = F.element_at(F.array(*[F.lit(m) for m in rules.METHODS]), (n % 3 + 1).cast("int"))
    matches = li.select((F.col("l_suppkey") % 20).alias("snapshot_id"), F.concat(F.lit("f"), line).alias("feed_item_id"), F.concat(F.lit("s"), line).alias("storefront_item_id"), way.alias("match_method"),
                        F.when(n == 7, 0.5).otherwise(0.98).alias("match_confidence"))
    feed = li.select(F.concat(F.lit("f"), line).alias("item_id"), F.concat(F.lit("u"), line).alias("url"), F.lit("t").alias("title"), F.concat(F.col("p_size").cast("string"), F.lit(",50 EUR")).alias("price"),
                     F.when(o % 11 != 0, F.when(o % 2 == 0, "eur").otherwise("EUR")).alias("currency"), _worded(o).alias("availability"))
    shop = li.select(F.concat(F.lit("s"), line).alias("item_id"), F.when(o % 3 == 0, F.concat(F.lit("u"), F.col("l_partkey").cast("string"))).alias("url"), F.when(o % 3 == 0, "").alias("title"),
                     F.concat((F.col("p_size") + F.when((o + n) % 4 == 0, 1).otherwise(0)).cast("string"), F.lit(".51")).alias("price"), F.when(o % 13 == 0, "").when(o % 13 == 1, "USD").otherwise("EUR").alias("currency"),
                     _worded(F.col("l_partkey") + 1).alias("availability"))
    checks = _table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 20).alias("snapshot_id"), F.explode(F.array(F.lit("feed"), F.lit("product_page"))).alias("source"))
    return matches, feed.unionByName(shop), checks.withColumn("status", F.when((F.col("snapshot_id") % 7 == 3) & (F.col("source") == "feed"), "partial").otherwise("success"))


@_query(f"""
WITH {PRICE_ROWS},
c AS (SELECT snapshot_id, count(*) AS compared, count(*) FILTER (p) AS price_bad, count(*) FILTER (v) AS availability_bad, count(DISTINCT named) FILTER (p) AS pn, count(DISTINCT named) FILTER (v) AS vn, count(DISTINCT named) FILTER (p OR v) AS bn FROM f GROUP BY 1),
g AS (SELECT *, price_bad >= 5 AND price_bad >= 0.2 * compared AS ps, availability_bad >= 5 AND availability_bad >= 0.2 * compared AS vs FROM c),
t AS (SELECT *, CASE WHEN ps AND vs THEN bn WHEN ps THEN pn WHEN vs THEN vn ELSE 0 END AS total_affected FROM g)
SELECT snapshot_id, compared, price_bad, availability_bad, concat_ws(',', CASE WHEN ps THEN 'price_mismatch_count' END, CASE WHEN vs THEN 'availability_mismatch_count' END) AS signals, total_affected,
       compared >= 20 AND (ps OR vs) AND total_affected >= 5 AND total_affected >= 0.2 * compared AS is_open FROM t""")
def price_availability(spark, sf_dir):
    """Price and availability rule from matches and items by id; some lack a currency or have different ones, one line number is a doubtful match, products match several times."""
    got = rules.price_availability(*_price_tables(spark, sf_dir))
    return got.select("snapshot_id", "compared", "price_bad", "availability_bad", F.array_join("signals", ",").alias("signals"), "total_affected", "is_open")


@_query(f"""
WITH {PRICE_ROWS},
i AS (SELECT s_suppkey AS incident_id, s_suppkey % 5 AS store, s_suppkey % 10 AS opened, CASE WHEN s_suppkey % 3 = 0 THEN 700 ELSE 5 END AS least, CASE WHEN s_suppkey % 4 = 0 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS ratio, CASE WHEN s_suppkey % 7 = 0 THEN 1000000 ELSE 20 END AS enough,
             s_suppkey % 2 = 0 AS one_way, s_suppkey % 11 = 0 AS other FROM supplier WHERE s_suppkey % 6 <> 5),
s AS (SELECT DISTINCT s_suppkey % 20 AS snapshot_id FROM supplier),
e AS (SELECT incident_id, s.snapshot_id, least, ratio, enough, other, one_way FROM i JOIN s ON s.snapshot_id % 5 = store AND s.snapshot_id > opened),
u AS (SELECT snapshot_id, w AS one_way, count(*) AS compared, count(*) FILTER (p) AS a, count(*) FILTER (v) AS b, count(DISTINCT named) FILTER (p) AS pn, count(DISTINCT named) FILTER (v) AS vn, count(DISTINCT named) FILTER (p OR v) AS bn
      FROM f JOIN (VALUES (true), (false)) t(w) ON NOT w OR way = 0 GROUP BY 1, 2),
g AS (SELECT e.*, compared, a, b, pn, vn, bn, coalesce(a >= least AND a / compared >= ratio, false) AS ps, coalesce(b >= least AND b / compared >= ratio, false) AS vs FROM e LEFT JOIN u USING (snapshot_id, one_way)),
t AS (SELECT *, CASE WHEN ps AND vs THEN bn WHEN ps THEN pn WHEN vs THEN vn ELSE 0 END AS total FROM g),
r AS (SELECT *, coalesce(compared >= enough, false) AS fine, (ps OR vs) AND total >= least AND total / compared >= ratio AS bad FROM t)
SELECT incident_id, snapshot_id, CASE WHEN other THEN 'configuration_changed' WHEN NOT fine THEN 'too_few_matches' WHEN bad THEN 'mismatch_returned' ELSE 'below_thresholds' END AS reason, NOT other AND fine AS comparable, NOT other AND fine AND NOT bad AS healthy,
       CASE WHEN NOT other AND fine AND bad THEN concat_ws(',', CASE WHEN ps THEN 'price_mismatch_count' END, CASE WHEN vs THEN 'availability_mismatch_count' END) ELSE '' END AS unhealthy FROM r""")
def price_recovery(spark, sf_dir):
    """Price incidents against later snapshots under their own thresholds and ways of matching: suppliers as incidents of five stores."""
    k = F.col("s_suppkey")
    some = _table(spark, sf_dir, "supplier").select(
        k.alias("incident_id"), (k % 5).alias("store_id"), F.when(k % 6 == 5, "resolved").otherwise("open").alias("status"), F.when(k % 11 == 0, "d").otherwise("c").alias("config"), (k % 10).alias("opened_at"),
        F.when(k % 3 == 0, 700).alias("minimum_affected_count"), F.when(k % 4 == 0, 0.5).alias("minimum_affected_ratio"), F.when(k % 7 == 0, 1000000).alias("minimum_comparable_matches"),
        F.lit(None).cast("double").alias("price_absolute"), F.lit(None).cast("double").alias("price_relative"), F.when(k % 2 == 0, F.array(F.lit("offer_id"))).alias("methods"))
    s = _table(spark, sf_dir, "supplier").select((k % 20).alias("snapshot_id")).distinct()
    snapshots = s.select("snapshot_id", (F.col("snapshot_id") % 5).alias("store_id"), F.col("snapshot_id").alias("at"), F.lit("c").alias("config"))
    got = recovery.price_availability(some, snapshots, rules.match_rows(*_price_tables(spark, sf_dir)))
    return got.select("incident_id", "snapshot_id", "reason", "comparable", "healthy", F.array_join("unhealthy", ",").alias("unhealthy"))


@_query("""
WITH i AS (SELECT l_suppkey % 5 AS store, CAST(year(l_shipdate) AS BIGINT) AS y, l_partkey % 150 AS k, CAST(sum(l_linenumber) AS BIGINT) + l_partkey % 150 AS q FROM lineitem WHERE l_suppkey % 5 <> 3 OR l_partkey % 7 <> year(l_shipdate) % 7 GROUP BY 1, 2, 3),
s AS (SELECT store, y, count(*) AS size, count(*) FILTER (q % 10 <> 1) AS good, store <> 4 AND count(*) >= 20 AND count(*) FILTER (q % 10 <> 1) >= 20 AND count(*) FILTER (q % 10 <> 1) >= 0.8 * count(*) AS fit FROM i GROUP BY 1, 2),
p AS (SELECT *, lag(y) OVER w AS py, lag(fit) OVER w AS pfit, lag(size) OVER w AS psize FROM s WHERE size >= 20 WINDOW w AS (PARTITION BY store ORDER BY y)),
b AS (SELECT p.store, p.y, p.py, least(p.size, p.psize) AS most, n.q, o.q AS oq FROM p JOIN i n ON n.store = p.store AND n.y = p.y JOIN i o ON o.store = p.store AND o.y = p.py AND o.k = n.k WHERE p.fit AND p.pfit),
c AS (SELECT store, y, py, count(*) AS common, count(*) / max(most) AS coverage, count(*) FILTER (q % 9 = 0 AND oq % 9 <> 0) AS noindex, count(*) FILTER (oq % 8 > 1 AND q % 8 = 0) AS canonical_away,
             count(*) FILTER (oq % 6 > 1 AND q % 6 <= 1) AS schema_missing, count(*) FILTER (q % 10 = 0 AND oq % 10 > 1) AS http_error FROM b GROUP BY 1, 2, 3 HAVING count(*) >= 20 AND count(*) / max(most) >= 0.8),
g AS (SELECT *, CASE WHEN noindex >= 5 AND noindex >= 0.05 * common THEN noindex END AS a, CASE WHEN canonical_away >= 5 AND canonical_away >= 0.05 * common THEN canonical_away END AS b,
             CASE WHEN schema_missing >= 5 AND schema_missing >= 0.1 * common THEN schema_missing END AS c, CASE WHEN http_error >= 5 AND http_error >= 0.1 * common THEN http_error END AS d FROM c)
SELECT store * 10000 + y AS snapshot_id, store * 10000 + py AS previous_id, common, coverage, noindex, canonical_away, schema_missing, http_error,
       concat_ws(',', CASE WHEN a IS NOT NULL THEN 'noindex' END, CASE WHEN b IS NOT NULL THEN 'canonical_away' END, CASE WHEN c IS NOT NULL THEN 'schema_missing' END, CASE WHEN d IS NOT NULL THEN 'http_error' END) AS signals,
       greatest(coalesce(a, 0), coalesce(b, 0), coalesce(c, 0), coalesce(d, 0)) AS affected, coalesce(a, b, c, d) IS NOT NULL AS is_open FROM g""")
def seo_regression(spark, sf_dir):
    """Page-signal rule: parts shipped in a year as the pages of a supplier group's snapshot; one group's parser differs, another's pages change from year to year."""
    got = rules.seo_regression(*_pages(spark, sf_dir))
    return got.select("snapshot_id", "previous_id", "common", "coverage", *rules.SEO_SIGNALS, F.array_join("signals", ",").alias("signals"), "affected", "is_open")


def _pages(spark, sf_dir):
    """(items, snapshots) of the page-signal rule."""
    li = _table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("store"), F.year("l_shipdate").cast("long").alias("y"), "l_partkey", "l_linenumber")
    q = F.col("q")
    items = (li.where((F.col("store") != 3) | (F.col("l_partkey") % 7 != F.col("y") % 7)).groupBy("store", "y", (F.col("l_partkey") % 150).alias("stable_key")).agg(F.sum("l_linenumber").alias("q")).withColumn("q", q + F.col("stable_key"))
             .select("store", "y", (F.col("store") * 10000 + F.col("y")).alias("snapshot_id"), "stable_key", F.when(q % 9 == 0, "noindex").when(q % 9 > 1, "index").alias("indexability"),
                     F.when(q % 8 == 0, "different").when(q % 8 == 1, "missing").otherwise("self").alias("canonical_state"), F.when(q % 6 != 1, q % 6 > 1).alias("schema_valid"), F.when(q % 10 == 0, 404).when(q % 10 == 2, 301).when(q % 10 > 2, 200).alias("http_status")))
    snapshots = items.groupBy("snapshot_id", F.col("store").alias("store_id"), F.col("y").alias("finished_at")).agg(
        F.count("*").alias("selected_count"), F.count("http_status").alias("comparable_checks"), F.count_if(F.col("http_status").isNull()).alias("failed_checks")).withColumn("urls_hash", F.lit("h"))
    for name, value in rules.SAMPLE.items():
        snapshots = snapshots.withColumn(name, F.when((F.col("store_id") == 4) & (name == "parser_version"), "other").otherwise(value))
    return items, snapshots


@_query("""
WITH i AS (SELECT l_suppkey % 5 AS store, CAST(year(l_shipdate) AS BIGINT) AS y, l_partkey % 150 AS k, CAST(sum(l_linenumber) AS BIGINT) + l_partkey % 150 AS q FROM lineitem WHERE l_suppkey % 5 <> 3 OR l_partkey % 7 <> year(l_shipdate) % 7 GROUP BY 1, 2, 3),
s AS (SELECT store, y, count(*) AS size, count(*) FILTER (q % 10 <> 1) AS good, store <> 4 AND count(*) >= 20 AND count(*) FILTER (q % 10 <> 1) >= 20 AND count(*) FILTER (q % 10 <> 1) >= 0.8 * count(*) AS fit FROM i GROUP BY 1, 2),
p AS (SELECT *, lag(y) OVER w AS py FROM s WHERE size >= 20 WINDOW w AS (PARTITION BY store ORDER BY y)),
c AS (SELECT store * 10 + e AS incident_id, p.store, p.y AS oy, p.py, p.fit AS ofit, CASE WHEN e = 1 THEN 0.95::DOUBLE ELSE 0.8::DOUBLE END AS least FROM p, (VALUES (0), (1)) t(e) WHERE p.y = 1993 + e),
x AS (SELECT c.*, s.y, s.size, coalesce(s.size >= 20 AND s.fit, false) AS fit FROM c JOIN s ON s.store = c.store AND s.y > c.oy),
b AS (SELECT x.incident_id, x.y, count(*) AS common, count(*) / min(least(x.size, z.size)) AS coverage, count(*) FILTER (n.q % 9 = 0 AND o.q % 9 <> 0) AS e1, count(*) FILTER (o.q % 8 > 1 AND n.q % 8 = 0) AS e2,
             count(*) FILTER (o.q % 6 > 1 AND n.q % 6 <= 1) AS e3, count(*) FILTER (n.q % 10 = 0 AND o.q % 10 > 1) AS e4
      FROM x JOIN s z ON z.store = x.store AND z.y = x.py JOIN i n ON n.store = x.store AND n.y = x.y JOIN i o ON o.store = x.store AND o.y = x.py AND o.k = n.k GROUP BY 1, 2 HAVING count(*) >= 20),
g AS (SELECT *, concat_ws(',', CASE WHEN e1 >= 5 AND e1 >= 0.05 * common THEN 'noindex' END, CASE WHEN e2 >= 5 AND e2 >= 0.05 * common THEN 'canonical_away' END, CASE WHEN e3 >= 5 AND e3 >= 0.1 * common THEN 'schema_missing' END,
             CASE WHEN e4 >= 5 AND e4 >= 0.1 * common THEN 'http_error' END) AS signals FROM b),
r AS (SELECT x.incident_id, x.store * 10000 + x.y AS snapshot_id, CASE WHEN NOT x.fit THEN 'sample_not_comparable' WHEN NOT ofit THEN 'opening_sample_not_comparable' WHEN py IS NULL THEN 'no_reference_sample'
             WHEN coverage >= least AND signals = '' THEN 'below_thresholds' WHEN coverage >= least THEN 'signals_returned' ELSE 'coverage_too_low' END AS reason, signals, x.fit AND ofit AS known FROM x LEFT JOIN g USING (incident_id, y))
SELECT incident_id, snapshot_id, reason, reason IN ('below_thresholds', 'signals_returned') AS comparable, reason = 'below_thresholds' AS healthy, CASE WHEN known THEN coalesce(signals, '') ELSE '' END AS unhealthy FROM r""")
def page_recovery(spark, sf_dir):
    """Page incidents of two years in each group, one with a stricter coverage, against all later snapshots."""
    items, snapshots = _pages(spark, sf_dir)
    snapshots = snapshots.withColumn("config", F.lit("c"))
    e = F.col("finished_at") - 1993
    some = snapshots.where("finished_at in (1993, 1994)").select((F.col("store_id") * 10 + e).alias("incident_id"), "store_id", F.lit("open").alias("status"), "config", F.col("finished_at").alias("opened_at"),
                                                                 F.col("snapshot_id").alias("opened_snapshot_id"), F.when(e == 1, 0.95).alias("coverage_minimum"))
    got = recovery.page_signals(some, items, snapshots)
    return got.select("incident_id", "snapshot_id", "reason", "comparable", "healthy", F.array_join("unhealthy", ",").alias("unhealthy"))


@_query("""
WITH c AS (SELECT store_id, source, max(k) AS k FROM (SELECT user_id AS store_id, CASE event_type WHEN 'click' THEN 'sitemap' WHEN 'error' THEN 'feed' WHEN 'purchase' THEN 'category' WHEN 'signup' THEN 'product_page' ELSE 'merchant_center' END AS source,
             (ts, event_id) AS k FROM events) GROUP BY 1, 2),
d AS (SELECT store_id, source, e.ts, e.event_id FROM c JOIN events e ON e.ts = c.k[1] AND e.event_id = c.k[2]),
i AS (SELECT o_custkey, CASE o_orderkey % 6 WHEN 0 THEN 'open' WHEN 1 THEN 'investigating' WHEN 2 THEN 'acknowledged' WHEN 3 THEN 'recovering' ELSE 'resolved' END AS status, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'critical' ELSE 'warning' END AS severity, o_orderdate FROM orders),
n AS (SELECT o_custkey, count(*) FILTER (status IN ('open', 'investigating', 'acknowledged')) AS a, count(*) FILTER (status <> 'resolved' AND severity = 'critical') AS b, count(*) FILTER (status <> 'resolved' AND severity = 'warning') AS c, count(*) FILTER (status = 'recovering') AS d, max(o_orderdate) AS u FROM i GROUP BY 1)
SELECT c_custkey AS store_id, c_name AS name, g.source, n.u AS baseline_updated_at, coalesce(n.a, 0) AS open_incidents, coalesce(n.b, 0) AS critical_incidents, coalesce(n.c, 0) AS high_incidents, coalesce(n.d, 0) AS recovering_incidents,
       l.t AS last_checked_at, CASE WHEN d.event_id % 3 = 0 THEN 'partial' WHEN d.event_id IS NOT NULL THEN 'success' END AS source_status, d.event_id % 100 AS source_items, d.ts AS source_checked_at
FROM customer CROSS JOIN (VALUES ('sitemap'), ('feed'), ('category'), ('product_page'), ('merchant_center')) g(source) LEFT JOIN d ON d.store_id = c_custkey AND d.source = g.source LEFT JOIN n ON n.o_custkey = c_custkey
LEFT JOIN (SELECT user_id, max(ts) AS t FROM events GROUP BY 1) l ON l.user_id = c_custkey""")
def store_grid(spark, sf_dir):
    """Summary of every store and source: customers as stores, events as checks, orders as incidents and baselines."""
    return _summary(spark, sf_dir).drop("domain", "baseline_status")


def _summary(spark, sf_dir):
    kind = F.col("event_type")
    source = F.when(kind == "click", "sitemap").when(kind == "error", "feed").when(kind == "purchase", "category").when(kind == "signup", "product_page").otherwise("merchant_center")
    checks = _table(spark, sf_dir, "events").select(F.col("user_id").alias("store_id"), source.alias("source"), F.when(F.col("event_id") % 3 == 0, "partial").otherwise("success").alias("status"), (F.col("event_id") % 100).alias("items_observed"),
                                                    F.col("ts").alias("finished_at"), F.col("ts").alias("created_at"), F.col("event_id").alias("check_id"))
    orders = _table(spark, sf_dir, "orders")
    six = F.col("o_orderkey") % 6
    incident = orders.select(F.col("o_custkey").alias("store_id"), F.when(six == 0, "open").when(six == 1, "investigating").when(six == 2, "acknowledged").when(six == 3, "recovering").otherwise("resolved").alias("status"),
                             F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "critical").otherwise("warning").alias("severity"))
    stores = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("store_id"), F.col("c_name").alias("name"), F.lit("d").alias("domain"), F.lit("active").alias("baseline_status"))
    return reports.store_summary(stores, checks, incident, orders.select(F.col("o_custkey").alias("store_id"), F.col("o_orderdate").alias("updated_at")))


@_query("""
WITH c AS (SELECT user_id AS store_id, CASE event_type WHEN 'click' THEN 'sitemap' WHEN 'error' THEN 'feed' WHEN 'purchase' THEN 'category' WHEN 'signup' THEN 'product_page' ELSE 'merchant_center' END AS source, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events),
g AS (SELECT c_custkey AS store_id, s AS source, event_id FROM customer CROSS JOIN (VALUES ('sitemap'), ('feed'), ('category'), ('product_page'), ('merchant_center')) t(s) LEFT JOIN c ON c.store_id = c_custkey AND c.source = s AND r = 1),
n AS (SELECT store_id, string_agg(source || '=' || coalesce(CASE WHEN event_id % 3 = 0 THEN 'partial' ELSE 'success' END || ':' || event_id % 100, '-'), ',' ORDER BY source) FILTER (event_id IS NOT NULL OR true) AS sources FROM (SELECT store_id, source, event_id FROM g) GROUP BY 1),
i AS (SELECT o_custkey, count(*) FILTER (o_orderkey % 6 < 3) AS a, count(*) FILTER (o_orderkey % 6 = 3) AS d FROM orders GROUP BY 1)
SELECT store_id, regexp_replace(sources, '=(partial|success)?:?$', '=-') AS sources, coalesce(a, 0) AS open, coalesce(d, 0) AS recovering FROM n LEFT JOIN i ON o_custkey = store_id""")
def store_dashboard(spark, sf_dir):
    """The summary with a store's sources nested in one row: what store_grid says, as lists."""
    nested = reports.nested_summary(_summary(spark, sf_dir))
    said = F.transform("sources", lambda s: F.concat(s["source"], F.lit("="), F.coalesce(F.concat(s["status"], F.lit(":"), s["items"].cast("string")), F.lit("-"))))
    return nested.select("store_id", F.array_join(said, ",").alias("sources"), F.col("incidents.open").alias("open"), F.col("incidents.recovering").alias("recovering"))


@_query("""
WITH i AS (SELECT CASE o_orderkey % 6 WHEN 0 THEN 'open' WHEN 1 THEN 'open' WHEN 2 THEN 'open' WHEN 3 THEN 'recovering' ELSE 'resolved' END AS status, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'critical' ELSE 'warning' END AS severity FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT (SELECT count(*) FROM customer) AS stores, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status <> 'resolved' AND severity = 'critical') AS critical, count(*) FILTER (status = 'recovering') AS recovering FROM i""")
def header_sums(spark, sf_dir):
    """Sums over all stores' summaries."""
    return reports.header_sums(reports.nested_summary(_summary(spark, sf_dir)))


ISSUES = """
e AS (SELECT event_type AS scope, user_id, event_id, nullif(trim(json_extract_string(props, '$.k')), '') AS code, CASE event_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'info' ELSE 'unknown' END AS severity,
             CASE WHEN event_id % 20 = 0 THEN 'unknown' ELSE 'a' || (event_id % 20) END AS attribute, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS k FROM events),
u AS (SELECT scope, user_id, row_number() OVER (PARTITION BY scope ORDER BY user_id) AS n FROM (SELECT DISTINCT scope, user_id FROM e)),
i AS (SELECT e.scope, e.user_id, u.n, code, severity, attribute, min(u.n * 1000 + k) AS came, CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END AS urgency
      FROM e JOIN u ON u.scope = e.scope AND u.user_id = e.user_id WHERE k <= 100 AND n <= 500 AND code IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6)"""


def _issue_products(spark, sf_dir):
    """Events of a type and user as the issues of a product, types as incidents."""
    e = F.col("event_id")
    row = F.struct("event_id", F.get_json_object("props", "$.k").alias("code"), F.when(e % 4 == 0, "ERROR").when(e % 4 == 1, " warning").when(e % 4 == 2, "info").alias("severity"), F.when(e % 20 != 0, F.concat(F.lit("a"), (e % 20).cast("string"))).alias("attribute"))
    per = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("incident_id"), F.col("user_id").alias("position")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    issues = F.transform("r", lambda i: F.struct(i["code"].alias("code"), i["severity"].alias("severity"), i["attribute"].alias("attribute")))
    return per.select("incident_id", "position", F.concat(F.lit("u"), F.col("position").cast("string")).alias("stable_key"), F.lit(None).cast("string").alias("offer_id"), F.lit("t").alias("title"), issues.alias("issues"))


@_query(f"""
WITH {ISSUES},
c AS (SELECT scope, code, count(*) AS issue_count, count(DISTINCT user_id) AS product_count, max(urgency) AS urgency, row_number() OVER (PARTITION BY scope ORDER BY min(came)) AS r FROM i GROUP BY 1, 2),
s AS (SELECT scope, code, severity, row_number() OVER (PARTITION BY scope, code ORDER BY min(came)) AS r FROM i GROUP BY 1, 2, 3), a AS (SELECT scope, code, attribute, row_number() OVER (PARTITION BY scope, code ORDER BY min(came)) AS r FROM i GROUP BY 1, 2, 3),
s2 AS (SELECT scope, code, string_agg(severity, ',' ORDER BY severity) AS severities FROM s WHERE r <= 8 GROUP BY 1, 2), a2 AS (SELECT scope, code, string_agg(attribute, ',' ORDER BY attribute) AS attributes FROM a WHERE r <= 16 GROUP BY 1, 2)
SELECT c.scope AS incident_id, row_number() OVER (PARTITION BY c.scope ORDER BY urgency DESC, issue_count DESC, c.code) AS rank, c.code, issue_count, product_count, CASE urgency WHEN 3 THEN 'critical' WHEN 2 THEN 'high' ELSE 'normal' END AS priority, severities, attributes
FROM c JOIN s2 ON s2.scope = c.scope AND s2.code = c.code JOIN a2 ON a2.scope = c.scope AND a2.code = c.code WHERE c.r <= 100""")
def issue_groups(spark, sf_dir):
    """Issue triage by code: limits on products, issues, codes, severities and attributes apply in order of arrival."""
    got = reports.issue_groups(_issue_products(spark, sf_dir))
    return got.withColumn("severities", F.array_join("severities", ",")).withColumn("attributes", F.array_join("attributes", ","))


@_query(f"""
WITH {ISSUES}, p AS (SELECT scope, user_id, max(urgency) AS urgency, count(*) AS issue_count FROM i GROUP BY 1, 2),
o AS (SELECT scope, user_id, code, row_number() OVER (PARTITION BY scope, user_id ORDER BY min(came)) AS r FROM i GROUP BY 1, 2, 3), o2 AS (SELECT scope, user_id, string_agg(code, ',' ORDER BY code) AS issue_codes FROM o WHERE r <= 16 GROUP BY 1, 2),
r AS (SELECT p.scope AS incident_id, row_number() OVER (PARTITION BY p.scope ORDER BY urgency DESC, issue_count DESC, 'u' || p.user_id) AS rank, 'u' || p.user_id AS stable_key, CASE urgency WHEN 3 THEN 'critical' WHEN 2 THEN 'high' ELSE 'normal' END AS priority, issue_count, issue_codes
      FROM p JOIN o2 ON o2.scope = p.scope AND o2.user_id = p.user_id)
SELECT * FROM r WHERE rank <= 50""")
def issue_products(spark, sf_dir):
    """The most urgent products of each incident (a top-k report)."""
    got = reports.issue_products(_issue_products(spark, sf_dir))
    return got.select("incident_id", "rank", "stable_key", "priority", "issue_count", F.array_join("issue_codes", ",").alias("issue_codes"))


@_query("""
WITH e AS (SELECT event_type, user_id, event_id, nullif(trim(json_extract_string(props, '$.k')), '') AS code, CASE event_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'info' ELSE 'unknown' END AS severity,
             CASE WHEN event_id % 20 = 0 THEN 'unknown' ELSE 'a' || (event_id % 20) END AS attribute, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY event_type, user_id) > 100 AS truncated FROM events)
SELECT event_type AS incident_id, 'u' || user_id AS stable_key, count(DISTINCT (code, severity, attribute)) AS issue_count, max(CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) AS priority_rank, bool_or(truncated) AS truncated
FROM e WHERE k <= 100 AND code IS NOT NULL AND contains('u' || user_id, '1') GROUP BY 1, 2 HAVING bool_or(severity = 'warning') AND NOT bool_or(severity = 'error')""")
def remediation_queue(spark, sf_dir):
    """The remediation queue of all incidents under filters on severity, priority and a search."""
    items = _issue_products(spark, sf_dir).withColumn("item_id", F.col("stable_key"))
    return reports.remediation_rows(items, severity="Warning", priority="high", search="1").select("incident_id", "stable_key", "issue_count", "priority_rank", "truncated")


@_query("""
WITH r AS (SELECT c_custkey AS id, 'k' || c_custkey % 100 AS key, c_mktsegment AS title, 1 + c_custkey % 3 AS n, CASE c_nationkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS p FROM customer),
o AS (SELECT id, row_number() OVER (ORDER BY p DESC, n DESC, key, id) AS a, row_number() OVER (ORDER BY n DESC, p DESC, key, id) AS b, row_number() OVER (ORDER BY key, p DESC, n DESC, id) AS c, row_number() OVER (ORDER BY title, p DESC, n DESC, key, id) AS d FROM r)
SELECT 'priority' AS sort, id AS item_id FROM o WHERE a BETWEEN 21 AND 41 UNION ALL SELECT 'issue_count', id FROM o WHERE b BETWEEN 21 AND 41 UNION ALL SELECT 'stable_key', id FROM o WHERE c BETWEEN 21 AND 41 UNION ALL SELECT 'title', id FROM o WHERE d BETWEEN 21 AND 41""")
def remediation_pages(spark, sf_dir):
    """The second page of the remediation queue in each of its four orders, after the cursor of the first (top-k reports): customers as items."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey") % 3
    severity = F.when(nation == 0, "error").when(nation == 1, "warning").otherwise("info")
    issue = lambda n: F.struct(F.lit(f"c{n}").alias("code"), severity.alias("severity"), F.lit("a").alias("attribute"))
    items = _table(spark, sf_dir, "customer").select(F.lit("i").alias("incident_id"), k.alias("item_id"), F.concat(F.lit("k"), (k % 100).cast("string")).alias("stable_key"), F.lit("o").alias("offer_id"), F.col("c_mktsegment").alias("title"),
                                                     F.slice(F.array(*[issue(n) for n in range(3)]), F.lit(1), (k % 3 + 1).cast("int")).alias("issues"))
    rows, pages = reports.remediation_rows(items), []
    for name, order in reports.REMEDIATION_ORDERS.items():
        last = store.page(rows, order, 19).select(*[c for c, _ in order]).collect()[-1]  # the last of a page of twenty
        after = store.decode_cursor(store.encode_cursor(tuple(last)))
        pages.append(store.page(rows, order, 20, after).select(F.lit(name).alias("sort"), "item_id"))
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3])


@_query("""
WITH l AS (SELECT l_suppkey % 30 AS snapshot_id, l_partkey, CASE WHEN l_discount > 0.09 THEN l_returnflag || l_linestatus END AS code, l_returnflag = 'R' AS severe FROM lineitem),
p AS (SELECT snapshot_id, l_partkey, coalesce(bool_or(severe) FILTER (code IS NOT NULL), false) AS severe, count(code) AS n FROM l WHERE snapshot_id % 7 NOT IN (2, 3, 4) GROUP BY 1, 2),
g AS (SELECT snapshot_id, count(*) AS products, count(*) FILTER (n > 0) AS affected, CAST(sum(n) AS BIGINT) AS issue_count, count(*) FILTER (severe) AS critical FROM p GROUP BY 1),
c AS (SELECT snapshot_id, code, count(*) AS n FROM l WHERE code IS NOT NULL GROUP BY 1, 2),
t AS (SELECT snapshot_id, string_agg(code || ' (' || n || ')', ', ' ORDER BY n DESC, code) AS codes FROM c GROUP BY 1)
SELECT g.snapshot_id, affected, critical, CASE WHEN critical > 0 THEN 'critical' ELSE 'warning' END AS severity,
       'Merchant Center reported ' || affected || CASE WHEN affected = 1 THEN ' product' ELSE ' products' END || ' with item-level issues.|Collected ' || issue_count || ' normalized ' || CASE WHEN issue_count = 1 THEN 'issue' ELSE 'issues' END || ' from a complete successful check.|Products with critical-severity issues: '
       || critical || '.|Products with warning-severity issues: ' || affected - critical || '.|' || CASE WHEN codes IS NULL THEN 'No normalized issue codes were available.' ELSE 'Most common issue codes: ' || codes || '.' END AS evidence
FROM g LEFT JOIN t USING (snapshot_id)""")
def item_issue_rule(spark, sf_dir):
    """Item issues of scans with their evidence: supplier groups as scans, discounted lines as issues of their parts; some scans failed, are of another account, or have two checks."""
    li = _table(spark, sf_dir, "lineitem")
    issue = F.when(F.col("l_discount") > 0.09, F.struct(F.concat("l_returnflag", "l_linestatus").alias("code"), F.when(F.col("l_returnflag") == "R", "Error").otherwise("warning").alias("severity")))
    products = li.groupBy((F.col("l_suppkey") % 30).alias("snapshot_id"), F.col("l_partkey").alias("product")).agg(F.collect_list(issue).alias("issues"))
    k = F.col("snapshot_id") % 7
    checks = li.select((F.col("l_suppkey") % 30).alias("snapshot_id")).distinct().withColumn("n", F.explode(F.sequence(F.lit(1), F.when(k == 4, 2).otherwise(1))))
    checks = checks.select("snapshot_id", F.when(k == 2, "partial").otherwise("success").alias("status"), F.lit("c").alias("config"), F.when(k == 3, "d").otherwise("c").alias("account_config"))
    got = rules.item_issue_evaluations(products, checks)
    return got.select("snapshot_id", "affected", "critical", "severity", F.array_join("evidence", "|").alias("evidence"))


@_query("""
WITH k AS (SELECT 'part' AS side, p_partkey AS id, 'offer:' || lower(p_name) AS key FROM part
           UNION ALL SELECT 'storefront', p_partkey, 'offer:' || lower(p_name) FROM part WHERE p_partkey % 3 = 0)
SELECT key AS matched_key, min(id) FILTER (side = 'part') AS feed_id, min(id) FILTER (side = 'storefront') AS storefront_id, 0.98 AS confidence, 'offer_id' AS method FROM k GROUP BY 1""")
def product_matching(spark, sf_dir):
    """Matches of items of two sources by shared keys: parts as feed items, every third also in the storefront."""
    part = _table(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    item = lambda df, s: df.select(F.col("p_partkey").alias("id"), F.lit("s").alias("snapshot_id"), F.lit(s).alias("source"), F.col("p_name").alias("offer_id"), none.alias("url"), none.alias("canonical_url"), none.alias("final_url"))
    got = identity.source_matches(item(part, "feed").unionByName(item(part.where("p_partkey % 3 = 0"), "storefront")))
    return got.select("matched_key", "feed_id", "storefront_id", "confidence", "method")


@_query("""
WITH e AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'partial' WHEN 'purchase' THEN 'parse_failed' WHEN 'signup' THEN 'authentication_failed' ELSE 'timeout' END AS status FROM events),
r AS (SELECT *, sum(CASE WHEN status IN ('success', 'partial') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM e),
s AS (SELECT *, CAST(sum(CASE WHEN status IN ('success', 'partial') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM r)
SELECT event_id, user_id, status, streak, CASE WHEN status = 'success' THEN 'recover' WHEN status = 'partial' THEN 'ignore' WHEN status = 'authentication_failed' THEN 'open'
       WHEN status = 'parse_failed' THEN CASE WHEN before = 'success' THEN 'open' ELSE 'wait' END WHEN streak >= 2 THEN 'open' ELSE 'wait' END AS action FROM s""")
def feed_health(spark, sf_dir):
    """Health of a source from its checks: a user's events as the statuses of its feed."""
    kind = F.col("event_type")
    status = F.when(kind == "view", "success").when(kind == "click", "partial").when(kind == "purchase", "parse_failed").when(kind == "signup", "authentication_failed").otherwise("timeout")
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", status.alias("status"))
    return rules.feed_health(rows, ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "status", F.col("streak").cast("long").alias("streak"), "action")


@_query(f"""
WITH {DAILY}, o AS (SELECT *, CASE WHEN event_type = 'error' THEN 'b' ELSE 'a' END AS config FROM daily),
h AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY "at" DESC) AS n FROM o WHERE "at" < DATE '2024-01-16'),
c AS (SELECT event_type, quantile_cont(value, 0.5) AS median_value, count(*) AS sample_count FROM h WHERE n <= 14 GROUP BY 1),
e AS (SELECT o.*, row_number() OVER (PARTITION BY o.event_type ORDER BY "at" DESC) AS n FROM o JOIN c USING (event_type)
      WHERE o.event_type = 'error' OR abs(median_value - value) < 20 OR CASE WHEN median_value = 0 THEN 0 ELSE abs(median_value - value) / median_value END < 0.2),
s AS (SELECT event_type, quantile_cont(value, 0.5) AS median_value, count(*) AS sample_count FROM e WHERE n <= 14 GROUP BY 1)
SELECT event_type, 1 AS version, 'active' AS status, median_value, sample_count, 'unchanged' AS action FROM c WHERE event_type = 'click'
UNION ALL SELECT event_type, 1, 'active', median_value, sample_count, 'updated' FROM s WHERE event_type NOT IN ('click', 'error') AND sample_count >= 7
UNION ALL SELECT event_type, 1, 'learning', median_value, sample_count, 'updated' FROM s WHERE event_type NOT IN ('click', 'error') AND sample_count < 7
UNION ALL SELECT event_type, 1, 'stale', median_value, sample_count, 'stale' FROM c WHERE event_type = 'error'
UNION ALL SELECT event_type, 2, CASE WHEN sample_count < 7 THEN 'relearning' ELSE 'ready' END, median_value, sample_count, 'inserted' FROM s WHERE event_type = 'error'""")
def baseline_revision(spark, sf_dir):
    """A run over baselines in force: those of the first half month, clicks frozen, errors with another configuration now."""
    rows = _daily(spark, sf_dir).withColumn("comparable", F.lit(True))
    old = baseline.latest(rows.where("at < DATE '2024-01-16'").withColumn("config", F.lit("a")), ["event_type"]).drop("status")
    old = old.withColumns({"version": F.lit(1), "status": F.lit("active"), "confirmed_at": F.lit(1)})
    now = rows.withColumn("config", F.when(F.col("event_type") == "error", "b").otherwise("a"))
    got = baseline.revised(old, now, old.where("event_type = 'click'"), ["event_type"])
    return got.select("event_type", "version", "status", "median_value", "sample_count", "action")


@_query(r"""
WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'http://10.0.0.' || (page_id % 250) || '/' WHEN 2 THEN 'http://172.' || (page_id % 64) || '.0.1/x' ELSE replace(url, 'http', 'ftp') END AS url FROM pages)
SELECT page_id, page_id % 4 = 0 OR page_id % 4 = 2 AND page_id % 64 NOT BETWEEN 16 AND 31 AS is_public FROM u""")
def public_address(spark, sf_dir):
    """Addresses that may be fetched: of pages, some of them with private hosts or another scheme instead."""
    k = F.col("page_id") % 4
    url = (F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("http://10.0.0."), F.col("page_id") % 250, F.lit("/"))).when(k == 2, F.concat(F.lit("http://172."), F.col("page_id") % 64, F.lit(".0.1/x")))
           .otherwise(F.replace("url", F.lit("http"), F.lit("ftp"))))
    return _table(spark, sf_dir, "pages").select("page_id", C.is_public_url(url).alias("is_public"))


@_query("""
WITH l AS (SELECT l_orderkey, list({name: CASE l_linenumber % 2 WHEN 0 THEN 'noindex' ELSE 'product_count' END, beforeValue: l_partkey, afterValue: l_suppkey, unit: CASE l_linenumber % 2 WHEN 0 THEN 'pages' ELSE 'products' END} ORDER BY l_linenumber, l_partkey, l_suppkey) AS metrics,
                  list({offerId: 'p' || l_partkey} ORDER BY l_linenumber, l_partkey, l_suppkey) AS samples FROM lineitem GROUP BY 1)
SELECT o_orderkey AS event_id, CAST(to_json({version: 'v1', alertType: 'opened', store: {id: o_custkey, name: c_name, domain: NULL},
  incident: {id: o_orderkey, type: o_orderpriority, severity: 'warning', title: c_name, summary: o_orderstatus, status: 'open', affectedCount: o_custkey, likelySource: NULL, confidenceScore: NULL, firstDetectedAt: strftime(o_orderdate, '%Y-%m-%d')},
  metrics: coalesce(metrics, []), evidence: [o_orderstatus, o_orderpriority], samples: coalesce(samples, [])[1:8],
  event: {id: o_orderkey, type: 'opened', reason: NULL, occurredAt: strftime(o_orderdate, '%Y-%m-%d')}}) AS VARCHAR) AS payload
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN l ON l_orderkey = o_orderkey""")
def alert_payload(spark, sf_dir):
    """Canonical alert payloads: orders as incidents, their lines as signals with a sample each."""
    none, day = F.lit(None).cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    events = rows.select(
        F.col("o_orderkey").alias("event_id"), F.lit("opened").alias("alert_type"), F.col("o_custkey").alias("store_id"), F.col("c_name").alias("store_name"), none.alias("store_domain"),
        F.col("o_orderkey").alias("incident_id"), F.col("o_orderpriority").alias("type"), F.lit("warning").alias("severity"), F.col("c_name").alias("title"), F.col("o_orderstatus").alias("summary"),
        F.lit("open").alias("status"), F.col("o_custkey").alias("affected_count"), none.alias("likely_source"), none.alias("confidence_score"), day.alias("first_detected_at"),
        F.concat(F.lit('[" '), "o_orderstatus", F.lit('", {"x": 1, "status": "'), "o_orderpriority", F.lit('"}, 7, {}]')).alias("evidence_json"), F.lit("opened").alias("event_type"), none.alias("reason"), F.lit("m").alias("message"),
        day.alias("occurred_at"))
    signals = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("incident_id"), F.col("l_linenumber").alias("position"), F.when(F.col("l_linenumber") % 2 == 0, "noindex").otherwise("product_count").alias("metric"), F.col("l_partkey").alias("before_value"),
        F.col("l_suppkey").alias("after_value"), F.concat(F.lit('[{"offer_id": "p'), "l_partkey", F.lit('"}, {"title": " "}, 3]')).alias("sample_items_json"))
    return alerts.payloads(events, signals)


@_query("""
WITH n AS (SELECT s_nationkey AS category, count(*) AS discovered, max(s_suppkey % 3) < 2 AS more FROM supplier GROUP BY 1)
SELECT category, 'html_links' AS strategy, discovered, NOT more AS complete, more AS truncated, CASE WHEN more THEN 0.4 ELSE 0.7 END AS confidence FROM n""")
def category_scan(spark, sf_dir):
    """Category pages as product counts: nations as categories of three pages, suppliers as linked products, each twice."""
    part = (F.col("s_suppkey") % 3).cast("int")
    links = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("category"), part.alias("page"), F.format_string('<a href="/products/%d">x</a><a href="https://shop.org/products/%d/?v=1">y</a>', "s_suppkey", "s_suppkey").alias("a"))
    pages = links.groupBy("category", "page").agg(F.array_join(F.collect_list("a"), "").alias("a"))
    pages = pages.select("category", "page", F.lit("https://shop.org/c").alias("url"), F.concat("a", F.when(F.col("page") < 2, '<a rel="next" href="?p">n</a>').otherwise("")).alias("body"))
    return category.category_observations(category.category_pages(pages)).drop("reported_total")


@_query("""
SELECT o_custkey AS store_id, 'accounts/' || o_custkey || '/products/' || o_orderkey AS name, CASE o_orderstatus WHEN 'F' THEN 'disapproved' WHEN 'O' THEN 'pending' ELSE 'approved' END AS status,
       count(DISTINCT l_linenumber) AS issues FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def merchant_inventory(spark, sf_dir):
    """Merchant products of landed pages: customers as accounts with two pages each, orders as products, lines as issues."""
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.concat(F.lit("Line #"), "l_linenumber").alias("code"))).alias("itemLevelIssues"))
    state = F.col("o_orderstatus")
    places = lambda name, when: F.when(when, F.array(F.lit("US"))).alias(name)
    place = F.struct(F.array(F.lit("DE")).alias("approvedCountries"), places("pendingCountries", state == "O"), places("disapprovedCountries", state == "F"))
    rows = _table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select(
        F.col("o_custkey").alias("store_id"), (F.col("o_orderkey") % 2).cast("int").alias("page"),
        F.struct(F.concat(F.lit("accounts/"), "o_custkey", F.lit("/products/"), "o_orderkey").alias("name"), F.struct(F.array(place).alias("destinationStatuses"), "itemLevelIssues").alias("productStatus")).alias("p"))
    pages = rows.groupBy("store_id", "page").agg(F.to_json(F.struct(F.collect_list("p").alias("products"))).alias("body"))
    return merchant.merchant_products(pages).select("store_id", "name", "status", F.when(F.col("issues").isNull(), 0).otherwise(F.size("issues")).cast("long").alias("issues"))


@_query("""
WITH d AS (SELECT event_type AS store, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_id % 3 > 0) AS approved FROM events GROUP BY 1, 2),
m AS (SELECT *, quantile_cont(n, 0.5) OVER w AS feed_median, quantile_cont(approved, 0.5) OVER w AS median, count(*) OVER w AS samples FROM d
      WINDOW w AS (PARTITION BY store ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, CASE WHEN n % 10 = 0 THEN 'incident_unavailable' WHEN NOT coalesce(n <= feed_median * 0.95::DOUBLE AND feed_median - n >= 1, FALSE) THEN 'feed_drop_not_confirmed' WHEN samples < 7 THEN 'merchant_baseline_unavailable'
      WHEN NOT (approved <= median * 0.95::DOUBLE AND median - approved >= 1) THEN 'merchant_approved_drop_not_confirmed' WHEN n % 7 = 0 THEN 'mapping_ambiguous' ELSE 'correlated' END AS reason FROM m)
SELECT store || ' ' || CAST(day AS VARCHAR) AS candidate_id, reason, reason = 'correlated' AS correlated, median AS merchant_median, approved AS merchant_approved FROM r""")
def merchant_correlation(spark, sf_dir):
    """Whether a drop shows in both sources: days of an event type as snapshots, two thirds of its events as what a merchant approved."""
    events = _table(spark, sf_dir, "events")
    d = events.groupBy(F.col("event_type").alias("store_id"), F.to_date("ts").alias("at")).agg(F.count("*").alias("value"), F.count_if(F.col("event_id") % 3 > 0).alias("approved"))
    d = baseline.rolling(d, ["store_id"]).withColumn("snapshot_id", F.concat_ws(" ", "store_id", F.col("at").cast("string")))
    candidates = d.select(F.col("snapshot_id").alias("candidate_id"), F.col("snapshot_id").alias("incident_id"), "store_id", F.lit("catalog_drop").alias("type"), F.lit("confirmed").alias("status"), F.col("snapshot_id").alias("first_snapshot_id"),
                          F.lit("next").alias("confirmation_snapshot_id"), F.col("median_before").alias("baseline_median"), F.lit(0.05).alias("percent_threshold"), F.lit(1).alias("absolute_threshold"))
    incidents = d.select(F.col("snapshot_id").alias("incident_id"), F.when(F.col("value") % 10 == 0, "ignored").otherwise("open").alias("status"))
    snapshots = d.select("snapshot_id", "store_id", F.lit("completed").alias("status"), F.lit("c").alias("config"), F.col("value").alias("feed_count"), F.col("at").alias("created_at"))
    checks = d.withColumn("source", F.explode(F.array(*[F.lit(s) for s in correlation.SOURCES]))).select(
        F.concat_ws(" ", "snapshot_id", "source").alias("check_id"), "snapshot_id", "source", F.lit("success").alias("status"), F.lit("c").alias("config"), F.lit(True).alias("complete"), "approved",
        F.lit(0).alias("pending"), F.lit(0).alias("disapproved"), F.col("approved").alias("total"), F.col("at").alias("finished_at"))
    mapping = d.select("snapshot_id", F.lit(True).alias("comparable"), F.col("value").alias("matched"), F.lit(0).alias("feed_only"), F.col("value").alias("merchant_only"), (F.col("value") % 7 == 0).cast("int").alias("ambiguous"), F.lit(False).alias("truncated"))
    got = correlation.feed_merchant_correlation(candidates, incidents, candidates.where("false"), snapshots, checks, mapping)
    return got.select("candidate_id", "reason", "correlated", "merchant_median", "merchant_approved")


@_query("""
WITH i AS (SELECT c_custkey AS incident_id, CASE c_custkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'recovering' ELSE 'resolved' END AS status FROM customer),
a AS (SELECT user_id AS incident_id, ts, event_id, CASE event_type WHEN 'click' THEN 'acknowledge' WHEN 'purchase' THEN 'ignore' ELSE 'comment' END AS action FROM events),
s AS (SELECT a.*, status, count(*) FILTER (action = 'ignore') OVER w > 0 AND status <> 'resolved' AS ignored, count(*) FILTER (action = 'acknowledge') OVER w > 0 AND status = 'open' AS seen
      FROM a LEFT JOIN i USING (incident_id) WINDOW w AS (PARTITION BY incident_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT event_id, incident_id, action, CASE WHEN ignored THEN 'ignored' WHEN seen THEN 'acknowledged' ELSE status END AS before FROM s)
SELECT event_id, incident_id, action, before,
       CASE WHEN action = 'acknowledge' AND before = 'open' THEN 'acknowledged' WHEN action = 'ignore' AND before IN ('open', 'acknowledged', 'recovering') THEN 'ignored' ELSE before END AS after,
       CASE WHEN before IS NULL THEN 'refused' WHEN action = 'comment' THEN 'done' WHEN action = 'acknowledge' THEN CASE before WHEN 'acknowledged' THEN 'repeated' WHEN 'open' THEN 'done' ELSE 'refused' END
            WHEN before = 'ignored' THEN 'repeated' WHEN before = 'resolved' THEN 'refused' ELSE 'done' END AS outcome
FROM b""")
def user_actions(spark, sf_dir):
    """What users do to incidents: customers as incidents, events as acknowledgements, ignoring and comments."""
    k = F.col("c_custkey") % 3
    some = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("incident_id"), F.when(k == 0, "open").when(k == 1, "recovering").otherwise("resolved").alias("status"))
    kind = F.col("event_type")
    asked = _table(spark, sf_dir, "events").select(F.col("user_id").alias("incident_id"), F.col("ts").alias("at"), F.col("event_id").alias("action_id"),
                                                   F.when(kind == "click", "acknowledge").when(kind == "purchase", "ignore").otherwise("comment").alias("action"))
    return incidents.user_actions(some, asked).select(F.col("action_id").alias("event_id"), "incident_id", "action", "before", "after", "outcome")


@_query("""
WITH d AS (SELECT user_id % 20 AS store, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY day) AS r FROM d),
b AS (SELECT store, quantile_cont(n, 0.5) AS median FROM k WHERE r <= 14 GROUP BY 1),
i AS (SELECT k.store, k.store * 1000 + r AS incident_id, k.day, CASE WHEN r % 4 > 0 THEN median * 1.5 END AS m, r % 5 > 0 AS same FROM k JOIN b USING (store) WHERE r % 3 = 0 AND r % 7 <> 0),
p AS (SELECT i.incident_id, k.store * 1000 + k.r AS snapshot_id, k.day AS "at", n, m, same, median, k.r % 6 = 0 AS other FROM i JOIN k ON k.store = i.store AND k.day > i.day JOIN b ON b.store = i.store WHERE k.r % 11 <> 0),
s AS (SELECT *, CASE WHEN m IS NULL THEN 'no_baseline_context' WHEN NOT same THEN 'baseline_not_in_force' WHEN other THEN 'configuration_changed'
      WHEN abs(median - n) / median < 0.2::DOUBLE OR abs(median - n) < 20 THEN 'inside_guardrails' WHEN n <= m * (1 - 0.2::DOUBLE) AND m - n >= 1 THEN 'drop_returned' ELSE 'between_thresholds' END AS reason FROM p)
SELECT incident_id, snapshot_id, "at", reason IN ('inside_guardrails', 'drop_returned') AS comparable, reason = 'inside_guardrails' AS healthy, reason FROM s""")
def recovery_outcomes(spark, sf_dir):
    """Catalog-drop incidents against all later snapshots of their stores: daily events of user groups as feeds, every third day opening an incident."""
    incidents_, snapshots, baselines = _drop_recovery(spark, sf_dir)
    return recovery.catalog_drop(incidents_, snapshots, baselines)


def _drop_recovery(spark, sf_dir):
    d = _table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("store_id"), F.to_date("ts").alias("at")).agg(F.count("*").alias("feed_count"))
    d = d.withColumn("r", F.row_number().over(Window.partitionBy("store_id").orderBy("at"))).withColumn("snapshot_id", F.col("store_id") * 1000 + F.col("r"))
    r = F.col("r")
    base = d.where("r <= 14").groupBy("store_id").agg(F.expr("percentile(feed_count, 0.5)").alias("median"))
    baselines = base.select(F.col("store_id").alias("baseline_id"), "store_id", F.lit(1).alias("version"), F.lit("c").alias("config"), F.lit("active").alias("status"), F.lit(None).cast("date").alias("valid_to"), "median")
    some = d.where("r % 3 = 0").join(base, "store_id").select(
        F.col("snapshot_id").alias("incident_id"), "store_id", F.when(r % 7 == 0, "resolved").when(r % 2 == 0, "open").otherwise("recovering").alias("status"), F.lit("c").alias("config"), F.col("at").alias("opened_at"),
        F.col("store_id").alias("baseline_id"), F.when(r % 5 > 0, 1).otherwise(2).alias("baseline_version"), F.when(r % 4 > 0, F.col("median") * 1.5).alias("baseline_median"), F.lit(None).cast("double").alias("percent_threshold"), F.lit(1).alias("absolute_threshold"))
    snapshots = d.select("snapshot_id", "store_id", "at", F.when(r % 6 == 0, "d").otherwise("c").alias("config"), F.when(r % 11 == 0, "confirmation_check").otherwise("scheduled").alias("role"), F.lit("success").alias("feed_status"), "feed_count")
    return some, snapshots, baselines


@_query("""
WITH p AS (SELECT s_suppkey % 10 AS store, c_custkey AS incident_id, s_suppkey AS snapshot_id, s_suppkey AS "at", CASE c_custkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'recovering' ELSE 'ignored' END AS status,
             CASE WHEN c_custkey % 2 = 0 THEN 20 ELSE 10 END AS least, s_nationkey * 4 AS missing, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 200 END AS matched, s_suppkey % 9 <> 1 AS whole
           FROM supplier JOIN customer ON c_custkey % 10 = s_suppkey % 10 AND s_suppkey > c_custkey % 30),
s AS (SELECT *, CASE WHEN NOT whole OR matched = 0 THEN 'checks_incomplete' WHEN missing < least AND missing / 200 < 0.1::DOUBLE THEN 'below_thresholds' WHEN missing / 200 >= 0.1::DOUBLE AND missing >= least THEN 'divergence_returned' ELSE 'between_thresholds' END AS reason FROM p WHERE status <> 'ignored')
SELECT incident_id, snapshot_id, "at", reason IN ('below_thresholds', 'divergence_returned') AS comparable, reason = 'below_thresholds' AS healthy, reason FROM s""")
def divergence_recovery(spark, sf_dir):
    """Source-divergence incidents against later snapshots: customers as incidents of ten stores, suppliers as snapshots."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    some = _table(spark, sf_dir, "customer").select(k.alias("incident_id"), (k % 10).alias("store_id"), F.when(k % 3 == 0, "open").when(k % 3 == 1, "recovering").otherwise("ignored").alias("status"), F.lit("c").alias("config"),
                                                    (k % 30).alias("opened_at"), F.lit(None).cast("double").alias("percent_threshold"), F.when(k % 2 == 1, 10).alias("absolute_threshold"))
    snapshots = _table(spark, sf_dir, "supplier").select(s.alias("snapshot_id"), (s % 10).alias("store_id"), s.alias("at"), F.lit("c").alias("config"), F.when(s % 9 == 1, "partial").otherwise("success").alias("feed_status"),
                                                         F.lit(2).alias("category_checks"), F.lit(True).alias("categories_ok"), F.when(s % 4 == 0, 0).otherwise(200).alias("matched"), (F.col("s_nationkey") * 4).alias("missing"))
    return recovery.source_divergence(some, snapshots)


@_query("""
WITH l AS (SELECT o_orderkey AS incident_id, c_name AS store_name, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS updated_at_cursor, o_orderdate AS u FROM orders JOIN customer ON c_custkey = o_custkey
           WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH')
SELECT incident_id, store_name, updated_at_cursor FROM l WHERE (u, incident_id) < (DATE '1997-06-01', 0) ORDER BY u DESC, incident_id DESC LIMIT 51""")
def incident_list(spark, sf_dir):
    """A page of the incident list under two filters (a top-k report): orders as incidents, customers as stores."""
    some = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("incident_id"), F.col("o_custkey").alias("store_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("severity"), F.col("o_orderdate").cast("date").alias("updated_at"))
    stores = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("store_id"), F.col("c_name").alias("name"))
    rows = reports.incident_list(some, stores, status="O", severity="2-HIGH", type=None)
    return store.page(rows, [("updated_at", True), ("incident_id", True)], 50, (datetime.date(1997, 6, 1), 0)).select("incident_id", "store_name", "updated_at_cursor")


@_query("""
WITH o AS (SELECT o_custkey, count(*) FILTER (o_orderkey % 5 < 4) AS n FROM orders GROUP BY 1),
e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
s AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1)
SELECT c_custkey AS store_id, event_type AS latest_status, event_id AS latest_id, coalesce(o.n, 0) AS active_incidents, coalesce(s.n, 0) AS categories
FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN e ON user_id = c_custkey AND r = 1 LEFT JOIN s ON s.s_nationkey = c_custkey""")
def store_list(spark, sf_dir):
    """All stores with their newest snapshot and counts: customers as stores, events as snapshots, orders as incidents, suppliers as categories of the first stores."""
    k = F.col("o_orderkey") % 5
    stores = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("store_id"))
    snapshots = _table(spark, sf_dir, "events").select(F.col("user_id").alias("store_id"), F.struct("ts", "event_id").alias("created_at"), F.col("event_id").alias("snapshot_id"), F.col("event_type").alias("status"))
    some = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("store_id"), F.col("o_orderkey").alias("incident_id"), F.when(k == 0, "open").when(k == 1, "investigating").when(k == 2, "acknowledged").when(k == 3, "recovering").otherwise("resolved").alias("status"))
    categories = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("store_id"), F.col("s_suppkey").alias("category_id"))
    got = reports.store_list(stores, snapshots, some, categories)
    return got.select("store_id", "latest_status", F.col("latest_at.event_id").alias("latest_id"), "active_incidents", "categories")


@_query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS recent FROM lineitem),
s AS (SELECT o_orderkey, o_orderkey % 3 AS k, o_orderkey % 5 = 0 AS shut FROM orders)
SELECT o_orderkey AS snapshot_id, 'line ' || l_linenumber AS stable_key, CAST(CASE WHEN shut THEN 1 WHEN k = 1 AND recent THEN 2 ELSE 1 END AS BIGINT) AS issues
FROM s JOIN l ON l_orderkey = o_orderkey WHERE CASE WHEN shut THEN l_linenumber <= 3 WHEN k = 0 THEN recent ELSE recent OR l_linenumber <= 3 END
  AND NOT (k = 1 AND NOT shut AND recent AND l_linenumber > 3)
UNION ALL
SELECT o_orderkey, 'line ' || l_linenumber, 1 FROM s JOIN l ON l_orderkey = o_orderkey WHERE k = 1 AND NOT shut AND recent AND l_linenumber > 3""")
def replaced_inventory(spark, sf_dir):
    """Inventories after a scan: distinct line numbers as items, 1 to 3 of an order are held, the even ones come; an order in five has another configuration."""
    n, o = F.col("l_linenumber"), F.col("o_orderkey")
    text = lambda v: F.lit(v).cast("string")

    def issues(code):
        return F.array(F.struct(text(code).alias("code"), text("error").alias("severity"), text(None).alias("resolution"), text(None).alias("attribute"), text(None).alias("reporting_context"), F.array(F.lit("DE")).alias("applicable_countries"))).alias("issues")

    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("snapshot_id"), "l_linenumber", F.concat(F.lit("line "), n).alias("stable_key")).distinct()
    held, come = lines.where(n <= 3).select("snapshot_id", "stable_key", issues("a")), lines.where(n % 2 == 0).select("snapshot_id", "stable_key", issues("b"))
    scans = _table(spark, sf_dir, "orders").select(o.alias("snapshot_id"), F.lit("ab" * 32).alias("config"), F.when(o % 5 == 0, "cd" * 32).alias("held_config"), F.when(o % 3 == 1, "partial").otherwise("success").alias("status"), (o % 3 == 0).alias("complete"))
    return store.replaced_inventory(held, come, scans).select("snapshot_id", "stable_key", F.size("issues").cast("long").alias("issues"))
