"""Alert decisions and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import escaped_html, once, shortened

CHANNELS = ("email", "telegram")


def decisions(events: DataFrame) -> DataFrame:
    """A row for each event and channel with suppression: the first reason that applies, or null (send).

    events: event_id, alert_type (opened, worsened, resolved), incident_type, enabled, email_enabled, telegram_enabled,
    muted (array), notify_on_open, notify_on_worsening, notify_on_recovery, window_id.
    """
    rows = events.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in CHANNELS])))
    on = F.when(F.col("channel") == "email", F.col("email_enabled")).otherwise(F.col("telegram_enabled"))
    return rows.withColumn("suppression", (
        F.when(~F.col("enabled"), "alerts_disabled").when(~on, "channel_disabled").when(F.array_contains("muted", F.col("incident_type")), "incident_type_muted")
        .when((F.col("alert_type") == "opened") & ~F.col("notify_on_open"), "open_notifications_disabled")
        .when((F.col("alert_type") == "worsened") & ~F.col("notify_on_worsening"), "worsening_notifications_disabled")
        .when((F.col("alert_type") == "resolved") & ~F.col("notify_on_recovery"), "recovery_notifications_disabled")
        .when(F.col("window_id").isNotNull(), "maintenance_window")))


def email_subject(alert_type: Column, title: Column, store: Column) -> Column:
    prefix = F.when(alert_type == "resolved", "Resolved").when(alert_type == "worsened", "Worsened").otherwise("New incident")
    return shortened(F.concat(prefix, F.lit(": "), title, F.lit(" - "), store), 200)


#: The payload's version, its bounds, and the units of metrics that their names don't tell.
VERSION, MOST_EVIDENCE, MOST_SAMPLES = "v1", 10, 8
PAGE_METRICS = ("noindex", "canonical_away", "schema_missing", "http_error")
PRODUCT_METRICS = ("matched_storefront_missing_from_feed", "merchant_inventory_missing_from_feed")


def metric_unit(metric: Column) -> Column:
    """checks, pages or products by a metric's name; null if it tells nothing."""
    return (F.when(metric == "source_check_failure_count", "checks").when(metric.isin(*PAGE_METRICS), "pages")
            .when(metric.contains("product") | metric.contains("mismatch") | metric.isin(*PRODUCT_METRICS), "products"))


def _elements(json: Column) -> Column:
    """The elements of a JSON array as variants; none if the text is null or something else."""
    return F.coalesce(F.try_parse_json(json).try_cast("array<variant>"), F.array().cast("array<variant>"))


def _said(members: Column, *names: str) -> Column:
    """The first of an object's members (a map of variants) that is a text with something in it."""
    x = lambda n: F.element_at(members, n)
    member = lambda n: F.when(F.schema_of_variant(x(n)) == "STRING", F.nullif(F.trim(x(n).try_cast("string")), F.lit("")))
    return F.coalesce(*[member(n) for n in names])


def _members(v: Column, use) -> Column:
    """use(the object's members as a map of variants, null for what is no object), the map being made once."""
    return once(v.try_cast("map<string,variant>"), use)


def evidence_texts(json: Column, message: Column) -> Column:
    """Ten texts at most: strings, and what objects say by reason, message, description or status, else their JSON; if there are none, message."""
    kind = F.schema_of_variant
    text = lambda v: F.when(kind(v) == "STRING", F.nullif(F.trim(F.try_variant_get(v, "$", "string")), F.lit(""))).when(
        kind(v).startswith("OBJECT"), F.coalesce(_members(v, lambda m: _said(m, "reason", "message", "description", "status")), F.nullif(F.to_json(v), F.lit("{}"))))
    found = F.slice(F.filter(F.transform(_elements(json), text), lambda t: t.isNotNull()), 1, MOST_EVIDENCE)
    return once(found, lambda some: F.when(F.size(some) > 0, some).when(F.trim(message) != "", F.array(F.trim(message))).otherwise(F.array().cast("array<string>")))


def sample_items(json: Column) -> Column:
    """The objects of a JSON array as structs of stableKey, offerId, url and title, those that have one of them."""
    item = lambda m: F.struct(_said(m, "stableKey", "stable_key").alias("stableKey"), _said(m, "offerId", "offer_id").alias("offerId"), _said(m, "url").alias("url"), _said(m, "title").alias("title"))
    objects = F.filter(F.transform(_elements(json), lambda v: v.try_cast("map<string,variant>")), lambda m: m.isNotNull())
    return F.filter(F.transform(objects, item), lambda i: F.coalesce(i["stableKey"], i["offerId"], i["url"], i["title"]).isNotNull())


def payloads(events: DataFrame, signals: DataFrame) -> DataFrame:
    """(event_id, payload): the canonical JSON of each event, with its incident's signals.

    events: event_id, alert_type, store_id, store_name, store_domain, incident_id, type, severity, title, summary, status,
    affected_count, likely_source, confidence_score, first_detected_at, evidence_json, event_type, reason, message,
    occurred_at. signals: incident_id, position, metric, before_value, after_value, sample_items_json; metrics and samples
    follow position, metric and values, eight samples at most. A member that is null stays as null, but for those of samples.
    """
    each = F.struct("position", "metric", F.struct(F.col("metric").alias("name"), F.col("before_value").alias("beforeValue"), F.col("after_value").alias("afterValue"), metric_unit(F.col("metric")).alias("unit")).alias("m"),
                    F.slice(sample_items(F.col("sample_items_json")), 1, MOST_SAMPLES).alias("s"))
    per = signals.select("incident_id", each.alias("x")).groupBy("incident_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    per = per.select("incident_id", F.transform("x", lambda x: x["m"]).alias("metrics"), F.slice(F.flatten(F.transform("x", lambda x: x["s"])), 1, MOST_SAMPLES).alias("samples"))
    rows = events.join(per, "incident_id", "left")
    metric_type = per.schema["metrics"].dataType
    named = lambda **parts: F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in parts.items()])
    body = named(
        version=F.lit(VERSION), alertType="alert_type", store=named(id="store_id", name="store_name", domain="store_domain"),
        incident=named(id="incident_id", type="type", severity="severity", title="title", summary="summary", status="status", affectedCount="affected_count", likelySource="likely_source",
                       confidenceScore="confidence_score", firstDetectedAt="first_detected_at"),
        metrics=F.coalesce("metrics", F.array().cast(metric_type)), evidence=evidence_texts(F.col("evidence_json"), F.col("message")),
        samples=F.coalesce(F.parse_json(F.to_json("samples")), F.parse_json(F.lit("[]"))), event=named(id="event_id", type="event_type", reason="reason", occurredAt="occurred_at"))
    return rows.select("event_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


#: Fixed value: what a delivery error's code looks like.
ERROR_CODE = "^[a-z][a-z0-9_]{0,100}$"


def delivery_error(error: Column) -> Column:
    """The code before a delivery error's first colon if it looks like one, else delivery_failed; null for null or nothing."""
    code = F.trim(F.split(error, ":", 2)[0])
    return F.when(error != "", F.when(code.rlike(ERROR_CODE), code).otherwise("delivery_failed"))
