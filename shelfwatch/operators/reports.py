"""Reports over all stores and incidents at once: store summaries, issue triage, the remediation queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bounded, like_pattern

#: Names of sources, of statuses that count as open, of severities, and the limits of a report.
SOURCES = ("sitemap", "feed", "category", "product_page", "merchant_center")
OPEN = ("open", "investigating", "acknowledged")
SEVERE = ("critical", "error", "disapproved", "severe")
MOST_PRODUCTS, MOST_ISSUES, MOST_GROUPS, MOST_SEVERITIES, MOST_ATTRIBUTES, MOST_CODES, MOST_SHOWN, MOST_TEXT = 500, 100, 100, 8, 16, 16, 50, 256
FILTERS = ("store_id", "status", "severity", "type", "likely_source")
ISSUE = "struct<code:string,severity:string,attribute:string>"


def store_summary(stores: DataFrame, checks: DataFrame, incidents: DataFrame, baselines: DataFrame) -> DataFrame:
    """A row for each store and each of SOURCES, whatever the store has: counts of incidents, newest baseline and check, state of the source.

    stores: store_id, name, domain, baseline_status. checks: store_id, source, status, items_observed, finished_at,
    created_at, check_id; the newest by these counts. incidents: store_id, status, severity. baselines: store_id, updated_at.
    """
    of = incidents.groupBy("store_id").agg(
        F.count_if(F.col("status").isin(*OPEN)).alias("open_incidents"),
        F.count_if(F.col("status").isin(*OPEN, "recovering") & (F.col("severity") == "critical")).alias("critical_incidents"),
        F.count_if(F.col("status").isin(*OPEN, "recovering") & (F.col("severity") == "warning")).alias("high_incidents"),
        F.count_if(F.col("status") == "recovering").alias("recovering_incidents"))
    base = baselines.groupBy("store_id").agg(F.max("updated_at").alias("baseline_updated_at"))
    newest = checks.groupBy("store_id", "source").agg(F.max(F.struct("finished_at", "created_at", "check_id", "status", "items_observed")).alias("c"))
    last = newest.groupBy("store_id").agg(F.max("c.finished_at").alias("last_checked_at"))
    grid = stores.select("store_id", "name", "domain", "baseline_status", F.explode(F.array(*[F.lit(s) for s in SOURCES])).alias("source"))
    rows = grid.join(newest, ["store_id", "source"], "left").join(of, "store_id", "left").join(base, "store_id", "left").join(last, "store_id", "left")
    counts = ("open_incidents", "critical_incidents", "high_incidents", "recovering_incidents")
    return rows.select("store_id", "name", "domain", "baseline_status", "baseline_updated_at", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], "last_checked_at", "source",
                       F.col("c.status").alias("source_status"), F.col("c.items_observed").alias("source_items"), F.col("c.finished_at").alias("source_checked_at"))


def nested_summary(summary: DataFrame) -> DataFrame:
    """A row a store of store_summary's: store_id, name, domain, incidents (open, critical, high, recovering), sources (array by name of source, status, items, checked_at), baseline (status, updated_at), last_checked_at."""
    each = F.struct("source", F.col("source_status").alias("status"), F.col("source_items").alias("items"), F.col("source_checked_at").alias("checked_at"))
    same = ["store_id", "name", "domain", "baseline_status", "baseline_updated_at", "open_incidents", "critical_incidents", "high_incidents", "recovering_incidents", "last_checked_at"]
    rows = summary.groupBy(*same).agg(F.array_sort(F.collect_list(each)).alias("sources"))
    counts = F.struct(*[F.col(f"{c}_incidents").alias(c) for c in ("open", "critical", "high", "recovering")])
    return rows.select("store_id", "name", "domain", counts.alias("incidents"), "sources", F.struct(F.col("baseline_status").alias("status"), F.col("baseline_updated_at").alias("updated_at")).alias("baseline"), "last_checked_at")


def header_sums(stores: DataFrame) -> DataFrame:
    """One row: stores, and the sums of their open, critical and recovering incidents."""
    return stores.agg(F.count("*").alias("stores"), *[F.coalesce(F.sum(f"incidents.{c}"), F.lit(0)).alias(c) for c in ("open", "critical", "recovering")])


def priority_rank(severity: Column) -> Column:
    """3 for severe ones, 2 for a warning, else 1."""
    return F.when(severity.isin(*SEVERE), 3).when(severity == "warning", 2).otherwise(1)


def priority_name(rank: Column) -> Column:
    return F.when(rank == 3, "critical").when(rank == 2, "high").otherwise("normal")


def normal_issues(issues: Column, most: int = MOST_ISSUES) -> Column:
    """The distinct issues among the first most of an array of ISSUE, in order: code (those without one go), severity in lower case, attribute; unknown where absent."""
    said = F.transform(F.slice(F.coalesce(issues, F.array().cast(f"array<{ISSUE}>")), 1, most), lambda i: F.struct(
        bounded(i["code"], MOST_TEXT).alias("code"), F.coalesce(F.lower(bounded(i["severity"], MOST_TEXT)), F.lit("unknown")).alias("severity"),
        F.coalesce(bounded(i["attribute"], MOST_TEXT), F.lit("unknown")).alias("attribute")))
    return F.array_distinct(F.filter(said, lambda i: i["code"].isNotNull()))


def _triaged(products: DataFrame, scope: str, order: str) -> DataFrame:
    """The first MOST_PRODUCTS of each scope that have a name and issues, with n, key, issues and flags."""
    rows = products.withColumn("n", F.row_number().over(Window.partitionBy(scope).orderBy(order))).where(F.col("n") <= MOST_PRODUCTS)
    rows = rows.select(F.col(scope).alias("scope"), "n", *[bounded(F.col(c), MOST_TEXT).alias(c) for c in ("stable_key", "offer_id", "title")], normal_issues(F.col("issues")).alias("issues"),
                       (F.coalesce(F.size("issues"), F.lit(0)) > MOST_ISSUES).alias("cut"))
    return rows.withColumn("key", F.coalesce("stable_key", "offer_id", "title")).where(F.col("key").isNotNull() & (F.size("issues") > 0))


def issue_products(products: DataFrame, scope: str = "incident_id", order: str = "position") -> DataFrame:
    """(scope, rank, stable_key, offer_id, title, priority, issue_count, issue_codes, attributes): the MOST_SHOWN most urgent products of each scope (a top-k report).

    products: scope, order (unique in a scope), stable_key, offer_id, title, issues (array of ISSUE). Codes and attributes
    are those that come first, sorted; keys sort by code point.
    """
    rows = _triaged(products, scope, order)
    rank = F.array_max(F.transform("issues", lambda i: priority_rank(i["severity"])))
    first = lambda name, most: F.array_sort(F.slice(F.array_distinct(F.transform("issues", lambda i: i[name])), 1, most))
    rows = rows.select("scope", "key", "n", "stable_key", "offer_id", "title", rank.alias("urgency"), F.size("issues").alias("issue_count"), first("code", MOST_CODES).alias("issue_codes"), first("attribute", MOST_ATTRIBUTES).alias("attributes"))
    w = Window.partitionBy("scope").orderBy(F.desc("urgency"), F.desc("issue_count"), "key", "n")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= MOST_SHOWN).select(
        F.col("scope").alias(scope), "rank", "stable_key", "offer_id", "title", priority_name(F.col("urgency")).alias("priority"), "issue_count", "issue_codes", "attributes")


def issue_groups(products: DataFrame, scope: str = "incident_id", order: str = "position") -> DataFrame:
    """(scope, rank, code, issue_count, product_count, priority, severities, attributes): issues of each scope by code, the most urgent first.

    products as in issue_products. Of a scope's codes the first MOST_GROUPS to come count, of a code's severities and
    attributes the first MOST_SEVERITIES and MOST_ATTRIBUTES.
    """
    each = _triaged(products, scope, order).select("scope", "key", "n", F.posexplode("issues").alias("k", "i")).select("scope", "key", F.struct("n", "k").alias("at"), "i.*")
    codes = each.groupBy("scope", "code").agg(F.count("*").alias("issue_count"), F.countDistinct("key").alias("product_count"), F.max(priority_rank(F.col("severity"))).alias("urgency"))
    came = each.groupBy("scope", "code").agg(F.min("at").alias("at"))
    kept = came.withColumn("r", F.row_number().over(Window.partitionBy("scope").orderBy("at"))).where(F.col("r") <= MOST_GROUPS).select("scope", "code")

    def some(name: str, most: int, alias: str) -> DataFrame:
        seen = each.groupBy("scope", "code", name).agg(F.min("at").alias("at"))
        seen = seen.withColumn("r", F.row_number().over(Window.partitionBy("scope", "code").orderBy("at"))).where(F.col("r") <= most)
        return seen.groupBy("scope", "code").agg(F.array_sort(F.collect_list(name)).alias(alias))

    rows = codes.join(kept, ["scope", "code"]).join(some("severity", MOST_SEVERITIES, "severities"), ["scope", "code"]).join(some("attribute", MOST_ATTRIBUTES, "attributes"), ["scope", "code"])
    w = Window.partitionBy("scope").orderBy(F.desc("urgency"), F.desc("issue_count"), "code")
    return rows.select(F.col("scope").alias(scope), F.row_number().over(w).alias("rank"), "code", "issue_count", "product_count", priority_name(F.col("urgency")).alias("priority"), "severities", "attributes")


def issue_totals(products: DataFrame, scope: str = "incident_id", order: str = "position") -> DataFrame:
    """(scope, products, issues, products_truncated, issues_truncated, groups_truncated) of each scope that has products."""
    rows = _triaged(products, scope, order)
    many = lambda name, most: F.size(F.array_distinct(F.transform("issues", lambda i: i[name]))) > most
    per = rows.groupBy("scope").agg(F.count("*").alias("products"), F.sum(F.size("issues")).alias("issues"), F.max(F.col("cut") | many("code", MOST_CODES) | many("attribute", MOST_ATTRIBUTES)).alias("issues_truncated"))
    each = rows.select("scope", F.explode("issues").alias("i")).select("scope", "i.*")
    of_code = each.groupBy("scope", "code").agg((F.countDistinct("severity") > MOST_SEVERITIES).alias("s"), (F.countDistinct("attribute") > MOST_ATTRIBUTES).alias("a"))
    groups = of_code.groupBy("scope").agg((F.max(F.col("s") | F.col("a")) | (F.count("*") > MOST_GROUPS)).alias("groups_truncated"))
    size = products.groupBy(F.col(scope).alias("scope")).agg((F.count("*") > MOST_PRODUCTS).alias("products_truncated"))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return size.join(per, "scope", "left").join(groups, "scope", "left").select(
        F.col("scope").alias(scope), F.coalesce("products", F.lit(0)).alias("products"), F.coalesce("issues", F.lit(0)).alias("issues"), "products_truncated", no("issues_truncated"), no("groups_truncated"))


#: The orders of the remediation queue's pages, a column and whether it descends.
REMEDIATION_ORDERS = {
    "priority": [("priority_rank", True), ("issue_count", True), ("stable_key_key", False), ("item_id", False)],
    "issue_count": [("issue_count", True), ("priority_rank", True), ("stable_key_key", False), ("item_id", False)],
    "stable_key": [("stable_key_key", False), ("priority_rank", True), ("issue_count", True), ("item_id", False)],
    "title": [("title_key", False), ("priority_rank", True), ("issue_count", True), ("stable_key_key", False), ("item_id", False)],
}


def remediation_rows(items: DataFrame, code: str | None = None, severity: str | None = None, priority: str | None = None, search: str | None = None) -> DataFrame:
    """items (incident_id, item_id, stable_key, offer_id, title, issues) that have issues and pass the filters, with issue_count, priority_rank, stable_key_key, title_key and truncated.

    Of an item's issues the first MOST_ISSUES count. A severity is compared in lower case, a search is contained in key,
    offer or title without case. Sort and cut with store.page by one of REMEDIATION_ORDERS.
    """
    rows = items.select("incident_id", "item_id", "stable_key", "offer_id", "title", normal_issues(F.col("issues")).alias("issues"), (F.size("issues") > MOST_ISSUES).alias("truncated"))
    rows = rows.where(F.size("issues") > 0).select(
        "incident_id", "item_id", "stable_key", "offer_id", "title", F.col("truncated"), "issues", F.size("issues").alias("issue_count"),
        F.array_max(F.transform("issues", lambda i: priority_rank(i["severity"]))).alias("priority_rank"),
        F.left(F.coalesce("stable_key", F.lit("")), F.lit(MOST_TEXT)).alias("stable_key_key"), F.left(F.coalesce("title", F.lit("")), F.lit(MOST_TEXT)).alias("title_key"))
    if code:
        rows = rows.where(F.exists("issues", lambda i: i["code"] == code))
    if severity:
        rows = rows.where(F.exists("issues", lambda i: i["severity"] == severity.lower()))
    if priority:
        rows = rows.where(F.col("priority_rank") == {"critical": 3, "high": 2}.get(priority, 1))
    if search:
        held = f"%{like_pattern(search)}%"
        rows = rows.where(F.col("stable_key_key").ilike(held) | F.left(F.coalesce("offer_id", F.lit("")), F.lit(MOST_TEXT)).ilike(held) | F.col("title_key").ilike(held))
    return rows.drop("issues")


def incident_list(incidents: DataFrame, stores: DataFrame, **filters: object) -> DataFrame:
    """incidents of known stores with store_name and updated_at_cursor (UTC, six digits), those that equal the filters given.

    filters: any of FILTERS; None is no filter, another name raises. Page with store.page, by updated_at and incident_id descending.
    """
    if unknown := set(filters) - set(FILTERS):
        raise ValueError(f"no filters of an incident list: {sorted(unknown)}")
    for name, value in filters.items():
        if value is not None:
            incidents = incidents.where(F.col(name) == F.lit(value))
    stamp = F.date_format(F.to_utc_timestamp(F.col("updated_at").cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")  # whatever the session's zone
    return incidents.join(stores.select("store_id", F.col("name").alias("store_name")), "store_id").withColumn("updated_at_cursor", stamp)


def store_list(stores: DataFrame, snapshots: DataFrame, incidents: DataFrame, categories: DataFrame) -> DataFrame:
    """stores with latest_status and latest_at of the newest snapshot (ties: the larger id), active_incidents and categories, each side counted before it is joined."""
    newest = snapshots.groupBy("store_id").agg(F.max(F.struct("created_at", "snapshot_id", "status")).alias("s")).select("store_id", F.col("s.status").alias("latest_status"), F.col("s.created_at").alias("latest_at"))
    active = incidents.where(F.col("status").isin(*OPEN, "recovering")).groupBy("store_id").agg(F.countDistinct("incident_id").alias("active_incidents"))
    of = categories.groupBy("store_id").agg(F.countDistinct("category_id").alias("categories"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = stores.join(newest, "store_id", "left").join(active, "store_id", "left").join(of, "store_id", "left")
    return rows.select(*stores.columns, "latest_status", "latest_at", none("active_incidents"), none("categories"))
