"""What a user sees of incidents, and what a user does to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import redacted_json
from .alerts import delivery_error, sample_items

# Names of members that aren't shown, and the states that an action starts from.
SENSITIVE = r"(?i)actor|token|secret|password|authorization|api[_-]?key|recipient|email|chat[_-]?id|thread[_-]?id|provider|payload|body|content"
ACTIONS = {"acknowledge": ("acknowledged", ("open", "investigating")), "ignore": ("ignored", ("open", "investigating", "acknowledged", "recovering"))}


def redacted(metadata: Column) -> Column:
    """JSON objects without sensitive members, at any depth; null for null and for what is no object."""
    return redacted_json(metadata, SENSITIVE)


def _sorted(kind: DataFrame, name: str, order: list[str]) -> DataFrame:
    """(incident_id, name): the rows of an incident as an array of structs, by order and then by what they hold."""
    rest = [c for c in kind.columns if c != "incident_id" and c not in order]
    return kind.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))


def details(incidents: DataFrame, events: DataFrame, signals: DataFrame, deliveries: DataFrame) -> DataFrame:
    """incidents (incident_id and others) with timeline, signals, samples and deliveries, arrays that may be empty.

    events: incident_id, at, event_id, event_type, message, metadata_json. signals: incident_id, source, metric,
    before_value, after_value, sample_items_json. deliveries: incident_id, at, channel, status, error. The timeline shows
    metadata redacted, a delivery its error's code only.
    """
    timeline = _sorted(events.withColumn("metadata", redacted(F.col("metadata_json"))).withColumn("reason", F.get_json_object("metadata_json", "$.reason")).drop("metadata_json"), "timeline", ["at", "event_id"])
    each = signals.withColumn("samples", sample_items(F.col("sample_items_json"))).drop("sample_items_json")
    told = _sorted(each, "signals", ["source", "metric"])
    told = told.select("incident_id", F.transform("signals", lambda s: s.dropFields("samples")).alias("signals"), F.flatten(F.transform("signals", lambda s: s["samples"])).alias("samples"))
    sent = _sorted(deliveries.withColumn("error", delivery_error(F.col("error"))), "deliveries", ["at", "channel"])
    out = incidents
    for part in (timeline, told, sent):
        out = out.join(part, "incident_id", "left")
    for part in (timeline, told, sent):
        for f in part.schema.fields[1:]:
            out = out.withColumn(f.name, F.coalesce(f.name, F.array().cast(f.dataType)))
    return out


def _may(status: Column, action: str) -> Column:
    return status.isin(*ACTIONS[action][1])


def user_actions(incidents: DataFrame, actions: DataFrame) -> DataFrame:
    """actions with before, after and outcome (done, repeated or refused), each incident's in order.

    incidents: incident_id, status. actions: incident_id, at, action_id, action (acknowledge, ignore, comment). Comments
    are always done and change nothing. The first acknowledgement counts where the status allows it, and so does the first
    ignoring; after ignoring nothing else does. Actions on unknown incidents are refused.
    """
    rows = actions.join(incidents.select("incident_id", F.col("status").alias("__status")), "incident_id", "left")
    w = Window.partitionBy("incident_id").orderBy("at", "action_id").rowsBetween(Window.unboundedPreceding, -1)
    asked = lambda a: F.coalesce(F.max(F.when(F.col("action") == a, True)).over(w), F.lit(False))
    rows = rows.withColumn("__ignored", asked("ignore") & _may(F.col("__status"), "ignore")).withColumn("__seen", asked("acknowledge") & _may(F.col("__status"), "acknowledge"))
    # an acknowledgement after ignoring changes nothing, so ignored comes first
    before = F.when(F.col("__ignored"), "ignored").when(F.col("__seen"), "acknowledged").otherwise(F.col("__status"))
    rows = rows.withColumn("before", before)
    outcome = F.when(F.col("before").isNull(), "refused").when(F.col("action") == "comment", "done")
    after = F.when(F.lit(False), "")
    for name, (state, _) in ACTIONS.items():
        mine = F.col("action") == name
        outcome = outcome.when(mine & (F.col("before") == state), "repeated").when(mine & _may(F.col("before"), name), "done")
        after = after.when(mine & _may(F.col("before"), name), state)
    return rows.withColumn("after", F.coalesce(after, "before")).withColumn("outcome", outcome.otherwise("refused")).drop("__status", "__ignored", "__seen")
