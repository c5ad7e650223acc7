"""Landed source files as normalised items.

Fetching isn't part of the engine: files are landed by whatever fetches, and read here, many at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import collapsed, money, offer_key, url_key
from ..operators.store import top_one

UNSAFE_XML = r"(?i)<!DOCTYPE|<!ENTITY"
FEED_SCHEMA = "id string, title string, link string, price string, sale_price string, availability string, image_link string, brand string, gtin string, mpn string"


def read_feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Items of RSS feeds (row_tag item) by Spark's XML reader; namespaces don't matter, gzip is seen through."""
    rows = (spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").option("mode", "PERMISSIVE").schema(FEED_SCHEMA).load(path))
    return rows.withColumn("file", F.input_file_name())


def read_atom_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds in the columns of read_feed(); a link is the address it refers to, else its text."""
    shape = FEED_SCHEMA.replace("link string", "link array<struct<_href: string, _rel: string, _VALUE: string>>")
    rows = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", "true").option("mode", "PERMISSIVE").schema(shape).load(path)
    own = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return rows.withColumn("link", F.get(F.transform(own, lambda x: F.coalesce(x["_href"], x["_VALUE"])), F.lit(0))).withColumn("file", F.input_file_name())


def unsafe_files(spark: SparkSession, path: str) -> DataFrame:
    """Files that declare a document type or entities; their items aren't to be used."""
    text = spark.read.option("wholetext", "true").text(path).withColumn("file", F.input_file_name())
    return text.where(F.col("value").rlike(UNSAFE_XML)).select("file").distinct()


def feed_items(rows: DataFrame) -> DataFrame:
    """(file, stable_key, offer_id, url, title, price, currency, availability, image_url, brand, gtin, mpn, raw_hash, skipped): one row a key.

    Rows with neither id nor link are skipped, and so are rows whose key an unlike row has already; skipped counts them
    on the row that stays. The smallest hash stays where rows differ, for files have no order on a cluster.
    """
    price = money(F.coalesce("sale_price", "price"))
    offer, link = offer_key(F.col("id")), url_key(F.col("link"))
    rows = rows.select("file", F.coalesce(F.concat(F.lit("offer:"), offer), F.concat(F.lit("url:"), link)).alias("stable_key"), offer.alias("offer_id"), link.alias("url"),
                       collapsed(F.col("title")).alias("title"), price["amount"].alias("price"), price["currency"].alias("currency"), "availability", F.col("image_link").alias("image_url"), *[collapsed(F.col(c)).alias(c) for c in ("brand", "gtin", "mpn")])
    rows = rows.where("stable_key is not null")
    rows = rows.withColumn("raw_hash", F.sha2(F.to_json(F.struct(*[c for c in rows.columns if c != "file"])).cast("binary"), 256))
    unlike = rows.groupBy("file", "stable_key").agg((F.countDistinct("raw_hash") - 1).alias("skipped"))
    return top_one(rows, ["file", "stable_key"], [F.asc("raw_hash")]).join(unlike, ["file", "stable_key"])


def feed_counts(rows: DataFrame) -> DataFrame:
    """(file, seen, kept, keyless, repeated) of read_feed()'s rows: items in the file, distinct keys, items with neither id nor link, and items whose key another has."""
    key = F.coalesce(F.concat(F.lit("offer:"), offer_key(F.col("id"))), F.concat(F.lit("url:"), url_key(F.col("link"))))
    per = rows.select("file", key.alias("key")).groupBy("file", "key").agg(F.count("*").alias("n"))
    return per.groupBy("file").agg(F.sum("n").alias("seen"), F.count("key").alias("kept"), F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)).alias("keyless"),
                                   F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("repeated"))


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(file, url): the distinct normalised addresses of sitemaps (urlset)."""
    rows = spark.read.format("xml").option("rowTag", "url").option("ignoreNamespace", "true").schema("loc string").load(path)
    return rows.select(F.input_file_name().alias("file"), url_key(F.trim("loc")).alias("url")).where("url is not null").distinct()


def read_sitemap_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, url): the distinct normalised addresses of the sitemaps that index files (sitemapindex) name."""
    rows = spark.read.format("xml").option("rowTag", "sitemap").option("ignoreNamespace", "true").schema("loc string").load(path)
    return rows.select(F.input_file_name().alias("file"), url_key(F.trim("loc")).alias("url")).where("url is not null").distinct()


def merchant_status(pages: DataFrame) -> DataFrame:
    """Totals of landed status pages (store_id, body JSON): approved, pending, disapproved, skipped, status.

    Counts are non-negative whole numbers, as numbers or text; a resource with another count is skipped and makes the
    result partial.
    """
    shape = "array<struct<stats:struct<activeCount:string,pendingCount:string,disapprovedCount:string>>>"
    rows = pages.select("store_id", F.explode_outer(F.from_json(F.get_json_object("body", "$.aggregateProductStatuses"), shape)).alias("r"))
    count = lambda c: F.when(F.col(f"r.stats.{c}").rlike(r"^\d{1,15}$"), F.col(f"r.stats.{c}").try_cast("long"))
    rows = rows.select("store_id", "r", *[count(c).alias(c) for c in ("activeCount", "pendingCount", "disapprovedCount")])
    good = F.col("activeCount").isNotNull() & F.col("pendingCount").isNotNull() & F.col("disapprovedCount").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0))
    out = rows.groupBy("store_id").agg(total("activeCount").alias("approved"), total("pendingCount").alias("pending"), total("disapprovedCount").alias("disapproved"),
                                       F.count_if(F.col("r").isNotNull() & ~good).alias("skipped"))
    return out.withColumn("total", F.col("approved") + F.col("pending") + F.col("disapproved")).withColumn("status", F.when(F.col("skipped") > 0, "partial").otherwise("success"))
