"""Landed product pages of merchant accounts as items with normalised issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bounded, countries, offer_key, token

TEXT = 256  # characters of a text that are kept
NAME = r"^accounts/[^/]+/products/[^/]+$"
_ISSUE = "struct<code:string,severity:string,resolution:string,attribute:string,reportingContext:string,description:string,detail:string,documentation:string,applicableCountries:array<string>>"
_PLACES = "struct<approvedCountries:array<string>,pendingCountries:array<string>,disapprovedCountries:array<string>>"
PAGE = f"array<struct<name:string,offerId:string,productAttributes:struct<title:string>,productStatus:struct<destinationStatuses:array<{_PLACES}>,itemLevelIssues:array<{_ISSUE}>>>>"


def normal_issue(issue: Column) -> Column:
    """An issue with tokens for codes and bounded texts; what isn't said is unknown, but descriptions stay null."""
    said = lambda c: F.coalesce(c, F.lit("unknown"))
    link = bounded(issue["documentation"], TEXT)
    return F.struct(token(issue["code"], TEXT).alias("code"), said(token(issue["severity"], TEXT)).alias("severity"), said(token(issue["resolution"], TEXT)).alias("resolution"),
                    said(bounded(issue["attribute"], TEXT)).alias("attribute"), said(token(issue["reportingContext"], TEXT)).alias("context"), bounded(issue["description"], TEXT).alias("description"),
                    bounded(issue["detail"], TEXT).alias("detail"), F.when(link.rlike("^https?://[^/]"), link).alias("documentation"),
                    F.coalesce(countries(issue["applicableCountries"]), F.array().cast("array<string>")).alias("countries"))


def destination_status(places: Column) -> Column:
    """disapproved if any destination is, else pending, else approved if approval is said at all, else unknown."""
    some = lambda name: F.coalesce(F.exists(places, lambda p: F.coalesce(F.size(p[name]) > 0, F.lit(False))), F.lit(False))
    said = F.coalesce(F.exists(places, lambda p: p["approvedCountries"].isNotNull()), F.lit(False))
    return F.when(some("disapprovedCountries"), "disapproved").when(some("pendingCountries"), "pending").when(said, "approved").otherwise("unknown")


def merchant_products(pages: DataFrame) -> DataFrame:
    """(store_id, stable_key, offer_id, name, title, status, issues), one row a product of pages (store_id, page, body JSON).

    Products without a resource name (accounts/x/products/y) are left out. A product on several pages keeps the first
    offer id, the last title and the last status that is known, and the union of its issues. Issues are distinct and
    sorted; those without a code are left out.
    """
    rows = pages.select("store_id", "page", F.posexplode(F.from_json(F.get_json_object("body", "$.products"), PAGE)).alias("at", "p"))
    name = F.trim("p.name")
    rows = rows.where(name.rlike(NAME) & (F.length(name) <= TEXT)).select(
        "store_id", F.struct("page", "at").alias("seq"), name.alias("name"), offer_key(F.col("p.offerId")).alias("offer_id"), bounded(F.col("p.productAttributes.title"), TEXT).alias("title"),
        F.nullif(destination_status(F.col("p.productStatus.destinationStatuses")), F.lit("unknown")).alias("status"),
        F.filter(F.transform("p.productStatus.itemLevelIssues", normal_issue), lambda i: i["code"].isNotNull()).alias("issues"))
    got = rows.groupBy("store_id", "name").agg(
        F.min_by("offer_id", "seq").alias("offer_id"), F.max_by("title", F.when(F.col("title").isNotNull(), F.col("seq"))).alias("title"),
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("status"), F.flatten(F.collect_list("issues")).alias("issues"))
    return got.select("store_id", F.concat(F.lit("merchant_product:"), F.sha2(F.col("name").cast("binary"), 256)).alias("stable_key"), "offer_id", "name", "title",
                      F.coalesce("status", F.lit("unknown")).alias("status"), F.array_sort(F.array_distinct("issues")).alias("issues"))


def scan_health(pages: DataFrame) -> DataFrame:
    """(store_id, seen, skipped, invalid_issues, status): partial where products or issues can't be used, else success."""
    rows = pages.select("store_id", F.explode_outer(F.from_json(F.get_json_object("body", "$.products"), PAGE)).alias("p"))
    name = F.trim("p.name")
    good = F.coalesce(name.rlike(NAME) & (F.length(name) <= TEXT), F.lit(False))
    bad = F.coalesce(F.size(F.filter("p.productStatus.itemLevelIssues", lambda i: token(i["code"], TEXT).isNull())), F.lit(0))
    got = rows.groupBy("store_id").agg(F.count("p").alias("seen"), F.count_if(F.col("p").isNotNull() & ~good).alias("skipped"), F.sum(F.when(good, F.greatest(bad, F.lit(0))).otherwise(0)).alias("invalid_issues"))
    return got.withColumn("status", F.when((F.col("skipped") > 0) | (F.col("invalid_issues") > 0), "partial").otherwise("success"))
