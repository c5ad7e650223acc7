"""Which items of different sources are one product."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import offer_key, url_key


def source_matches(items: DataFrame) -> DataFrame:
    """(snapshot_id, matched_key, method, confidence, sitemap_id, feed_id, storefront_id, methods) of items that share a key.

    items: id, snapshot_id, source (sitemap, feed, storefront or merchant, which fills the feed's place), offer_id, url,
    canonical_url, final_url. Keys are the offer (0.98) and the addresses (0.95; 0.92 for a url that is its item's
    canonical one). The smallest id of a side stands for it. Only addresses have the sitemap as a side.
    """
    canonical = url_key(F.col("canonical_url"))
    named = [F.struct(F.concat(F.lit("offer:"), offer_key(F.col("offer_id"))).alias("key"), F.lit("offer_id").alias("method"), F.lit(0.98).alias("confidence"))]
    for column in ("url", "canonical_url", "final_url"):
        k = url_key(F.col(column))
        same = (k == canonical) if column != "canonical_url" else F.lit(True)
        named.append(F.struct(F.concat(F.lit("url:"), k).alias("key"), F.when(F.coalesce(same, F.lit(False)), "canonical_url").otherwise("normalized_url").alias("method"),
                              F.when(F.coalesce(same, F.lit(False)), 0.92).otherwise(0.95).alias("confidence")))
    rows = items.select("id", "snapshot_id", F.when(F.col("source") == "merchant", "feed").otherwise(F.col("source")).alias("side"),
                        F.explode(F.filter(F.array(*named), lambda x: x["key"].isNotNull())).alias("k")).select("id", "snapshot_id", "side", "k.*")
    sides = {s: F.min(F.when(F.col("side") == s, F.col("id"))).alias(f"{s}_id") for s in ("sitemap", "feed", "storefront")}
    return rows.groupBy("snapshot_id", F.col("key").alias("matched_key")).agg(
        F.max_by("method", F.struct("confidence", "method")).alias("method"), F.max("confidence").alias("confidence"), *sides.values(),
        F.array_sort(F.collect_set("method")).alias("methods"))


def cross_source_mapping(feed: DataFrame, merchant: DataFrame) -> DataFrame:
    """(identity, status) of the products of two inventories (id, offer_id, stable_key); status is matched, feed_only,
    merchant_only or ambiguous.

    Offers decide first: one on each side match, several on a side are ambiguous. What is left goes by stable key, in the
    same way, but that two rows with different offers don't match. Rows with neither are ambiguous.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("side"), "id", offer_key(F.col("offer_id")).alias("offer"), F.nullif(F.lower(F.trim("stable_key")), F.lit("")).alias("stable"))

    rows = side(feed, "feed").unionByName(side(merchant, "merchant"))
    counts = [F.count_if(F.col("side") == s).alias(f"n_{s}") for s in ("feed", "merchant")]
    offers = rows.where("offer is not null").groupBy("offer").agg(*counts).select(
        "offer", F.when((F.col("n_feed") > 1) | (F.col("n_merchant") > 1), "ambiguous").when((F.col("n_feed") == 1) & (F.col("n_merchant") == 1), "matched").alias("status"))
    decided = offers.where("status is not null")
    left = rows.join(decided.select("offer"), "offer", "left_anti")
    keyed = left.where("stable is not null")
    own = {s: F.min(F.when(F.col("side") == s, F.col("offer"))).alias(f"{s}_offer") for s in ("feed", "merchant")}
    groups = keyed.groupBy("stable").agg(*counts, *own.values())
    differ = F.col("feed_offer").isNotNull() & F.col("merchant_offer").isNotNull() & (F.col("feed_offer") != F.col("merchant_offer"))
    fate = (F.when((F.col("n_feed") > 1) | (F.col("n_merchant") > 1), F.array(F.lit("ambiguous")))
            .when((F.col("n_feed") == 1) & (F.col("n_merchant") == 1) & ~differ, F.array(F.lit("matched")))
            .when((F.col("n_feed") == 1) & (F.col("n_merchant") == 1), F.array(F.lit("feed_only"), F.lit("merchant_only")))
            .when(F.col("n_feed") == 1, F.array(F.lit("feed_only"))).otherwise(F.array(F.lit("merchant_only"))))
    by_stable = groups.select("stable", "feed_offer", "merchant_offer", F.explode(fate).alias("status"))
    shown = F.when(F.col("status") == "feed_only", F.col("feed_offer")).when(F.col("status") == "merchant_only", F.col("merchant_offer")).otherwise(F.coalesce("feed_offer", "merchant_offer"))
    keyless = left.where("stable is null").select(
        F.coalesce(F.concat(F.lit("offer:"), "offer"), F.concat(F.lit("unidentified:"), F.col("id").cast("string"))).alias("identity"),
        F.when(F.col("offer").isNull(), "ambiguous").otherwise(F.concat("side", F.lit("_only"))).alias("status"))
    return (decided.select(F.concat(F.lit("offer:"), "offer").alias("identity"), "status")
            .unionByName(by_stable.select(F.coalesce(F.concat(F.lit("offer:"), shown), F.concat(F.lit("key:"), "stable")).alias("identity"), "status")).unionByName(keyless))


def samples(mapping: DataFrame, most: int = 50) -> DataFrame:
    """The first most identities of each status, and whether there are more."""
    w = Window.partitionBy("status").orderBy("identity")
    ranked = mapping.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most + 1)
    return ranked.withColumn("truncated", F.max("rank").over(Window.partitionBy("status")) > most).where(F.col("rank") <= most)
