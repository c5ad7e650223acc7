"""Queries of landed files, column functions and smaller reports over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.canonical import canonical_json
from ..operators import baseline, incidents, rules, snapshots, store
from ..sources import landed
from .base import query, table


DOCUMENT = 500  # rows of a landed document


def _landed(rows: DataFrame, number: Column, element: Column, root: str, path: str) -> None:
    """Write an XML document of elements for each DOCUMENT numbers, a file each, at path."""
    text = rows.groupBy(F.floor(number / DOCUMENT)).agg(F.concat(F.lit(f"<{root}>"), F.array_join(F.collect_list(element), ""), F.lit(f"</{root}>")).alias("value"))
    text.select("value").write.option("maxRecordsPerFile", 1).text(path)


@query("""
WITH r AS (SELECT p_brand AS file, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE CASE WHEN p_partkey % 5 = 0 THEN 'https://a.example/' || p_partkey % 50 ELSE 'sku-' || p_partkey % 90 END END AS key FROM part)
SELECT file, count(*) AS seen, count(DISTINCT nullif(key, '')) AS kept, count(*) FILTER (key = '') AS keyless, count(*) FILTER (key <> '') - count(DISTINCT nullif(key, '')) AS repeated FROM r GROUP BY 1""")
def feed_scan(spark, sf_dir):
    """Counts of landed XML feeds: parts as items of a feed a brand, some by address only, some without either, keys that repeat. Written as XML by Spark and read back."""
    k = F.col("p_partkey")
    path = snapshots.shared_folder(spark, "feed")
    said = (F.when(k % 13 == 0, "").when(k % 5 == 0, F.concat(F.lit("<link>https://A.example/"), (k % 50).cast("string"), F.lit("/?ref=x&amp;y</link>"))).otherwise(F.concat(F.lit("<id> SKU-"), (k % 90).cast("string"), F.lit(" </id>"))))
    item = F.concat(F.lit("<item><title>"), C.escaped_html(F.col("p_name")), F.lit("</title>"), said, F.lit("<brand>"), C.escaped_html(F.col("p_brand")), F.lit("</brand></item>"))
    _landed(table(spark, sf_dir, "part"), k, item, "rss", path)
    rows = landed.read_feed(spark, path).withColumn("file", F.col("brand"))
    return landed.feed_counts(rows)


@query("""
SELECT 'offer:part ' || p_partkey AS stable_key, p_retailprice AS price, 'EUR' AS currency, lower(p_brand) AS brand, lpad(p_partkey::VARCHAR, 13, '0') AS gtin, CASE WHEN p_partkey % 2 = 0 THEN 'http://b.example/x' END AS url FROM part""")
def feed_products(spark, sf_dir):
    """Items of a landed XML feed with their prices, brands and numbers: parts, each twice, the second time with another price that doesn't count before the sale price."""
    k = F.col("p_partkey")
    path = snapshots.shared_folder(spark, "feed")
    text = lambda name, v: F.concat(F.lit(f"<{name}>"), v, F.lit(f"</{name}>"))
    link = F.when(k % 2 == 0, text("link", F.lit("http://B.example:80/x/"))).otherwise("")
    item = F.concat(F.lit("<item>"), text("id", F.concat(F.lit("Part  "), k.cast("string"))), link, text("price", F.lit("1.00 USD")), text("sale_price", F.concat(F.format_string("%.2f", "p_retailprice"), F.lit(" eur"))),
                    text("brand", F.lower("p_brand")), text("gtin", F.lpad(k.cast("string"), 13, "0")), F.lit("</item>"))
    _landed(table(spark, sf_dir, "part"), k, F.concat(item, item), "rss", path)
    rows = landed.read_feed(spark, path).withColumn("file", F.lit("all"))
    return landed.feed_items(rows).select("stable_key", F.col("price").cast("double").alias("price"), "currency", "brand", "gtin", "url")


@query(r"""
WITH k AS (SELECT lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]+)', 1)) AS head, regexp_replace(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '/+$', '') AS path FROM pages)
SELECT DISTINCT head || CASE WHEN path = '' THEN '/' ELSE path END AS url FROM k""")
def sitemap_scan(spark, sf_dir):
    """The distinct addresses of landed sitemaps: those of all pages, written as XML by Spark and read back."""
    path = snapshots.shared_folder(spark, "sitemap")
    _landed(table(spark, sf_dir, "pages").where("url is not null"), F.col("page_id"), F.concat(F.lit("<url><loc> "), C.escaped_html(F.col("url")), F.lit(" </loc></url>")), "urlset", path)
    return landed.read_sitemap(spark, path).select("url").distinct()


@query("""
WITH m AS (SELECT o_custkey % 60 AS snapshot_id, o_orderkey, max(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS fed FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
c AS (SELECT snapshot_id, CAST(count(*) AS BIGINT) AS matched, CAST(count(*) FILTER (fed = 0) AS BIGINT) AS missing FROM m WHERE snapshot_id % 7 NOT IN (3, 4) GROUP BY 1)
SELECT snapshot_id, matched, missing, missing / matched >= 0.1::DOUBLE AND missing >= 20 AS is_open FROM c""")
def divergence_rule(spark, sf_dir):
    """Source divergence: orders as a shop's items, their lines of many pieces as feed items; some snapshots lack a feed check or a category's."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    s = F.col("o_custkey") % 60
    matches = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(s.alias("snapshot_id"), F.col("o_orderkey").alias("storefront_item_id"), F.when(F.col("l_quantity") > 45, F.col("l_partkey")).alias("feed_item_id"))
    each = o.select(s.alias("snapshot_id")).distinct().withColumn("x", F.explode(F.array(*[F.struct(F.lit(n).alias("source"), F.lit(t).alias("finished_at")) for n, t in (("feed", 1), ("feed", 2), ("category", 1), ("category", 2))])))
    k, source, late = F.col("snapshot_id") % 7, F.col("x.source"), F.col("x.finished_at") == 2
    bad = ((source == "feed") & ((k == 3) & late | (k == 5) & ~late)) | ((source == "category") & (k == 4) & ~late)  # an earlier feed check doesn't count
    checks = each.select("snapshot_id", "x.*", F.when(bad, "timeout").otherwise("success").alias("status"))
    return rules.source_divergence(matches, checks).select("snapshot_id", "matched", "missing", "is_open")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN floor(o_totalprice) + 0.5 ELSE o_custkey END AS amount, CASE o_orderkey % 4 WHEN 1 THEN 'EUR' END AS currency,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey || '0' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS BIGINT) || '.' || o_orderkey % 10 END AS moved,
       o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AS comparable,
       CASE WHEN o_orderkey % 3 <> 0 THEN 'offer:o ' || o_orderkey % 10 WHEN o_orderkey % 2 = 0 THEN 'url:https://a.example/' || o_custkey WHEN o_orderkey % 5 = 0 THEN 'canonical:https://c.example/'
            ELSE 'hash:' || sha256('t' || o_custkey || '|i|') END AS product_key,
       CASE o_orderkey % 6 WHEN 0 THEN 'timeout' WHEN 1 THEN 'blocked' WHEN 2 THEN 'blocked' WHEN 3 THEN 'success' ELSE 'source_unavailable' END AS fetched,
       CASE o_orderkey % 6 WHEN 0 THEN 'timeout' WHEN 1 THEN 'blocked' WHEN 2 THEN 'blocked' WHEN 3 THEN 'success' WHEN 4 THEN 'source_unavailable' ELSE 'authentication_failed' END AS feed_fetched,
       abs(o_custkey - o_orderkey % 150) / greatest(o_custkey, o_orderkey % 150, 1) >= 0.2::DOUBLE AND abs(o_custkey - o_orderkey % 150) >= 20 AS diverges,
       CASE WHEN o_custkey % 9 = 0 THEN 0 ELSE (o_custkey % 9 - 3) / (o_custkey % 9)::DOUBLE END AS lost FROM orders""")
def value_functions(spark, sf_dir):
    """Money, exact decimal shifts, comparability, product keys, what answers of servers mean, divergence and loss, over orders."""
    o, k, none = F.col("o_orderkey"), F.col("o_custkey"), F.lit(None).cast("string")
    key, four, six = k.cast("string"), o % 4, o % 6
    price = C.money(F.when(four == 0, "12,5,0 EUR").when(four == 1, F.concat(F.col("o_totalprice").cast("long").cast("string"), F.lit(",50eur "))).otherwise(key))
    digits = F.concat(key, F.lit("."), F.lit("0"), F.lpad((o % 1000).cast("string"), 3, "0"), (o % 10).cast("string"))
    product = C.product_key(F.when(o % 3 != 0, F.concat(F.lit(" O  "), (o % 10).cast("string"))), F.when(o % 2 == 0, F.concat(F.lit("https://a.example/"), key, F.lit("/?x"))), F.when(o % 5 == 0, "https://C.example"), F.concat(F.lit(" T"), key), F.lit("I"), none)
    code = F.when(six == 1, 403).when(six == 2, 429).when(six == 3, 204).when(six == 4, 500).when(six == 5, 401)
    useful = F.when(o % 7 == 0, "timeout").otherwise("partial")
    number = o % 150
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", price["amount"].cast("double").alias("amount"), price["currency"].alias("currency"), C.shifted(F.when(o % 5 == 0, "1e3").otherwise(digits), 4).alias("moved"),
        C.comparable(F.lit("success"), useful, F.when(o % 3 != 0, "a"), F.lit("b"), o % 11 != 0, F.lit(None).cast("boolean")).alias("comparable"), product.alias("product_key"),
        C.http_status_class(code).alias("fetched"), C.feed_status_class(code).alias("feed_fetched"), baseline.is_divergence(k, number, 0.2, 20).alias("diverges"),
        C.fraction_lost((k % 9).cast("double"), F.lit(3.0)).alias("lost"))


@query("""
SELECT event_id, upper(left(event_type, 1)) || substr(event_type, 2) || ' Of X' AS label, CAST(floor(value / 100 * 100 + 0.5) AS BIGINT) || '%' AS share, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS minute_s,
       greatest(0, (epoch_us(ts) // 1000) - epoch_ms(TIMESTAMP '2024-01-15')) AS duration_ms FROM events""")
def display_values(spark, sf_dir):
    """Labels, rounded shares, minutes and durations as reports show them, over events."""
    at = F.timestamp_seconds(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / F.lit(1000000).cast("decimal(20,6)"))
    return table(spark, sf_dir, "events").select(
        "event_id", C.labelled(F.concat("event_type", F.lit("_of_x"))).alias("label"), C.rounded_percent(F.col("value") / 100).alias("share"), F.unix_seconds(snapshots.minute(at)).alias("minute_s"),
        snapshots.duration_ms(F.timestamp_seconds(F.lit(1705276800)), at).alias("duration_ms"))


@query("""
WITH o AS (SELECT o_custkey % 900 AS k, min((o_orderkey, o_totalprice)) AS r FROM orders GROUP BY 1)
SELECT k, r[1] AS o_orderkey, r[2] AS o_totalprice FROM o WHERE k NOT IN (SELECT c_custkey % 300 FROM customer)""")
def insert_if_absent(spark, sf_dir):
    """Rows whose key isn't there yet, each key once: orders by customer group, those of the first three hundred groups being there."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 900).alias("k"), "o_orderkey", "o_totalprice")
    there = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 300).alias("k"))
    return store.absent(rows, there, ["k"])


@query("""
WITH e AS (SELECT user_id, string_agg(event_id || ' ' || CASE WHEN event_id % 4 = 0 THEN '-' WHEN event_id % 4 = 1 THEN '{"a":[{"k":' || event_id % 10 || '},2]}' ELSE '{"note":"x \\"y\\"","n":1.5}' END || ' ' || CASE WHEN event_id % 4 = 1 THEN 'because' ELSE '-' END, ';' ORDER BY event_id) AS timeline, count(*) AS n
      FROM events WHERE event_type = 'error' GROUP BY 1),
s AS (SELECT o_custkey, string_agg(o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN ' smtp_down' WHEN o_orderkey % 3 = 1 THEN ' delivery_failed' ELSE '' END, ';' ORDER BY o_orderkey) AS sent FROM orders GROUP BY 1)
SELECT c_custkey AS incident_id, coalesce(timeline, '') AS timeline, coalesce(sent, '') AS sent FROM customer LEFT JOIN e ON user_id = c_custkey LEFT JOIN s ON o_custkey = c_custkey""")
def incident_details(spark, sf_dir):
    """Incidents with timelines whose metadata is redacted at any depth, and deliveries with error codes: customers as incidents, errors as events, orders as deliveries."""
    k, o, none = F.col("event_id"), F.col("o_orderkey"), F.lit(None).cast("string")
    some = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("incident_id"))
    plain = F.concat(F.lit('{ "a": [ {"apiKey": 1, "k": '), (k % 10).cast("string"), F.lit(', "providerDeep": {"x": [], "y": 2}} , 2 ], "user_email": {"q": 1}, "content-reason": 1, "reason": "because" }'))
    metadata = F.when(k % 4 == 0, "[1]").when(k % 4 == 1, plain).otherwise('{"note": "x \\"y\\"", "n": 1.50, "Token": null}')
    events = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("incident_id"), k.alias("at"), "event_id", "event_type", F.lit("m").alias("message"), metadata.alias("metadata_json"))
    signals = some.select("incident_id", F.lit("feed").alias("source"), F.lit("n").alias("metric"), F.lit(1).alias("before_value"), F.lit(2).alias("after_value"), none.alias("sample_items_json"))
    sent = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("incident_id"), o.alias("at"), F.lit("email").alias("channel"), F.lit("failed").alias("status"), F.when(o % 3 == 0, "smtp_down: at x").when(o % 3 == 1, "Oops").alias("error"))
    got = incidents.details(some, events, signals, sent)
    shown = F.transform("timeline", lambda e: F.concat_ws(" ", e["event_id"].cast("string"), F.coalesce(F.replace(e["metadata"], F.lit(',"reason":"because"'), F.lit("")), F.lit("-")), F.coalesce(e["reason"], F.lit("-"))))
    return got.select("incident_id", F.array_join(shown, ";").alias("timeline"), F.array_join(F.transform("deliveries", lambda d: F.concat_ws(" ", d["at"].cast("string"), d["error"])), ";").alias("sent"))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS identity, o_orderkey % 3 = 0 AS issues, o_orderkey % 5 <> 0 AS keep FROM orders)
SELECT k AS o_orderkey, '{"a":2,"discoveredFrom":["feed","page' || k % 4 || '"],"merchantDataKind":"' || CASE WHEN issues AND NOT (identity AND keep) THEN 'item_issues' WHEN identity THEN 'product_identity' ELSE 'other' END
       || '"' || CASE WHEN issues AND identity AND keep THEN ',"merchantItemIssuesConfigurationHash":"old"' WHEN issues THEN ',"merchantItemIssuesConfigurationHash":"new"' WHEN identity THEN ',"merchantItemIssuesConfigurationHash":"old"' ELSE '' END
       || CASE WHEN identity THEN ',"merchantProductIdentityVersion":"v1"' ELSE '' END || ',"old":1,"sourceHashes":{"feed":"x","page":"y"}}' AS metadata FROM o""")
def metadata_merge(spark, sf_dir):
    """Metadata of an item merged with what a later scan says: lists and hashes grow, and an item of an identity scan stays one."""
    o = F.col("o_orderkey")
    old = F.concat(F.lit('{"old":1,"a":1,"discoveredFrom":["feed"],"sourceHashes":{"feed":"x"},"merchantDataKind":"'), F.when(o % 2 == 0, "product_identity").otherwise("other"), F.lit('"'),
                   F.when(o % 2 == 0, ',"merchantProductIdentityVersion":"v1","merchantItemIssuesConfigurationHash":"old"').otherwise(""), F.lit("}"))
    new = F.concat(F.lit('{"a":2,"discoveredFrom":["page'), (o % 4).cast("string"), F.lit('","feed"],"sourceHashes":{"page":"y"}'), F.when(o % 3 == 0, ',"merchantDataKind":"item_issues","merchantItemIssuesConfigurationHash":"new"').otherwise(""), F.lit("}"))
    merged = table(spark, sf_dir, "orders").select("o_orderkey", C.merged_item_metadata(old, new, o % 5 != 0).alias("merged"))
    return merged.select("o_orderkey", canonical_json(F.col("merged")).alias("metadata"))
