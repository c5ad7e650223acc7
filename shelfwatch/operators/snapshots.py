"""What a snapshot comes to: its state and counts out of checks, its sample of pages, and its rows in a table by snapshot."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canonical import quoted
from .rules import SAMPLE

#: Used only where the session names no shared folder and runs on one machine.
LOCAL_SHARED_DIR = "/tmp/checkpoints/shelfwatch"
SAMPLE_SIZE = 25


def rollup(checks: DataFrame) -> DataFrame:
    """(snapshot_id, status, sitemap_url_count, feed_product_count, merchant_total, merchant_approved, merchant_pending, merchant_disapproved, finished_at).

    checks: check_id, snapshot_id, source, status, items_observed, total, approved, pending, disapproved, finished_at.
    completed if all checks succeeded, partial if some succeeded at least in part, else failed. Counts are those of the
    source's last check; merchant counts of the last one that has them and whose parts add up, none of them negative.
    """
    place = F.struct("finished_at", "check_id")
    last = lambda source: F.max_by("items_observed", F.when(F.col("source") == source, place))
    parts = ("approved", "pending", "disapproved")
    whole = (F.col("source") == "merchant_center") & (F.least(*parts) >= 0) & (F.col("total") == F.col("approved") + F.col("pending") + F.col("disapproved"))
    found = checks.groupBy("snapshot_id").agg(
        F.bool_and(F.col("status") == "success").alias("__all"), F.count_if(F.col("status").isin("success", "partial")).alias("__useful"), last("sitemap").alias("sitemap_url_count"), last("feed").alias("feed_product_count"),
        F.max_by(F.struct("total", *parts), F.when(whole, place)).alias("__m"), F.max("finished_at").alias("finished_at"))
    status = F.when(F.col("__all"), "completed").when(F.col("__useful") > 0, "partial").otherwise("failed")
    return found.select("snapshot_id", status.alias("status"), "sitemap_url_count", "feed_product_count", *[F.col(f"__m.{c}").alias(f"merchant_{c}") for c in ("total", *parts)], "finished_at")


def sample_urls(items: DataFrame, size: int = SAMPLE_SIZE) -> DataFrame:
    """(store_id, snapshot_id, rank, url): the first size addresses of each snapshot by the MD5 of store and address, so that samples stay alike.

    items: store_id, snapshot_id, source, url; those of shops and feeds, and any whose address looks like a product's.
    """
    some = items.where(F.col("url").isNotNull() & (F.col("source").isin("storefront", "feed") | F.col("url").rlike("(?i)/products?/"))).select("store_id", "snapshot_id", "url").distinct()
    mark = F.md5(F.concat(F.col("store_id").cast("string"), F.lit(":"), F.col("url")).cast("binary"))
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("store_id", "snapshot_id").orderBy(mark, "url")))
    return ranked.where(F.col("rank") <= size)


def sample_manifests(items: DataFrame, size: int = SAMPLE_SIZE) -> DataFrame:
    """(store_id, snapshot_id, selected_count, urls_hash, urls, requested and the versions of rules.SAMPLE); the hash is that of the addresses' JSON array in their order."""
    urls = sample_urls(items, size).groupBy("store_id", "snapshot_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"]).alias("urls"))
    json = F.concat(F.lit("["), F.array_join(F.transform("urls", quoted), ","), F.lit("]"))
    return urls.select("store_id", "snapshot_id", F.size("urls").alias("selected_count"), F.sha2(json.cast("binary"), 256).alias("urls_hash"), "urls", F.lit(size).alias("requested"), *[F.lit(v).alias(n) for n, v in SAMPLE.items()])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path that no other call uses, in the folder that driver and executors share (spark.checkpoint.dir); a local one only if the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(named or LOCAL_SHARED_DIR).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def replace_snapshots(rows: DataFrame, snapshots: DataFrame, path: str, key: str = "snapshot_id") -> None:
    """Make rows all that the table at path holds of snapshots (key), whatever it held; other snapshots' files aren't touched.

    rows of snapshots that aren't asked for are left out; a snapshot without rows holds nothing afterwards. A rerun
    leaves the same rows. The table is partitioned by key and large snapshots are several files.
    """
    asked = snapshots.select(key).distinct()
    marked = rows.withColumn("__present", F.lit(True))
    asked.join(marked, key, "left").hint("rebalance", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def read_snapshots(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of a table that replace_snapshots has written."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path).where("__present").drop("__present")


def confirmed_baseline(metrics: DataFrame, asked: DataFrame) -> DataFrame:
    """metrics (baseline_id, store_id, version, status, valid_to, confirmed_by, confirmed_at) after confirmations (baseline_id, by, at).

    The first confirmation of a metric that is ready and in force makes it active; any other changes nothing.
    """
    first = asked.groupBy("baseline_id").agg(F.min(F.struct("at", "by")).alias("__c"))
    rows = metrics.join(first, "baseline_id", "left")
    takes = F.col("__c").isNotNull() & (F.col("status") == "ready_for_confirmation") & F.col("valid_to").isNull()
    new = {"status": F.when(takes, "active").otherwise(F.col("status")), "confirmed_by": F.when(takes, F.col("__c.by")).otherwise(F.col("confirmed_by")), "confirmed_at": F.when(takes, F.col("__c.at")).otherwise(F.col("confirmed_at"))}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in metrics.columns])


def minute(at: Column) -> Column:
    """The minute that a time lies in: retries of one minute share a key."""
    return F.date_trunc("minute", at)


def duration_ms(begin: Column, end: Column) -> Column:
    """Milliseconds from begin to end, not below 0."""
    return F.greatest(F.lit(0), F.unix_millis(end) - F.unix_millis(begin))
