"""Whether a confirmed feed drop shows in the merchant account too: one ladder of reasons over all candidates at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .baseline import LEAST, MOST, is_drop, is_matched_loss
from .timeline import running

#: A status check and an identity check count if they succeeded under the configuration of the snapshot's account.
SOURCES = ("feed", "merchant_status", "merchant_identity")


def _approved(checks: DataFrame) -> DataFrame:
    """checks with approved_count: null unless the counts are there, none negative, and add up."""
    parts = [F.col(c) for c in ("approved", "pending", "disapproved")]
    fits = (F.col("total") == sum(parts[1:], parts[0])) & (F.least(*parts) >= 0)
    return checks.withColumn("approved_count", F.when(fits, F.col("approved")))


def _own_checks(snapshots: DataFrame, checks: DataFrame) -> DataFrame:
    """(snapshot_id, at, check_id, approved_count) of snapshots with exactly one fitting check of each of SOURCES."""
    rows = checks.join(snapshots.select("snapshot_id", F.col("config").alias("wanted")), "snapshot_id").where("status = 'success'")
    fits = {"feed": F.col("source") == "feed", "merchant_status": (F.col("source") == "merchant_status") & (F.col("config") == F.col("wanted")),
            "merchant_identity": (F.col("source") == "merchant_identity") & (F.col("config") == F.col("wanted")) & F.col("complete")}
    own = F.struct(F.col("finished_at").alias("at"), "check_id", "approved_count")
    got = rows.groupBy("snapshot_id").agg(*[F.count_if(fits[s]).alias(s) for s in SOURCES], F.max(F.when(fits["merchant_status"], own)).alias("own"))
    return got.where(" and ".join(f"{s} = 1" for s in SOURCES)).where("own.at is not null").select("snapshot_id", "own.*")


BUFFER = 64  # of the checks before a candidate that its row carries


def merchant_baseline(candidates: DataFrame, snapshots: DataFrame, checks: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """(candidate_id, samples, broken, median) of the MOST approved counts before each candidate's own.

    candidates: candidate_id, store_id, config, first_snapshot_id, at, created_at, check_id. A completed snapshot of
    store and configuration with an identity check gives its latest status check before (at, created_at, check_id).
    broken counts those whose numbers don't add up.

    Each check of the history carries the last buffer checks up to itself, in one window, and a candidate takes what the
    check before it carries: linear in candidates and history. Only where so many checks come from fewer than MOST
    snapshots while there are earlier ones do a candidate and its store's history meet.
    """
    good = checks.where("status = 'success'")
    known = good.where("source = 'merchant_identity' and complete").select("snapshot_id", "config").distinct()
    history = (good.where("source = 'merchant_status' and finished_at is not null").join(known, ["snapshot_id", "config"])
               .join(snapshots.where("status = 'completed'").select("snapshot_id", "store_id", "created_at"), "snapshot_id")
               .select("store_id", "config", F.col("snapshot_id").alias("h_snapshot"), F.struct(F.col("finished_at").alias("at"), "created_at", "check_id").alias("h"), "approved_count"))
    mark = candidates.select("candidate_id", "store_id", "config", "first_snapshot_id", F.struct("at", "created_at", "check_id").alias("cut"))

    order = Window.partitionBy("store_id", "config").orderBy("h")
    held = history.select("store_id", "config", "h", F.struct(F.collect_list(F.struct("h_snapshot", F.col("approved_count").alias("value"))).over(order.rowsBetween(1 - buffer, 0)).alias("last"), F.row_number().over(order).alias("n")).alias("__held"))
    none = F.lit(None).cast(held.schema["__held"].dataType.simpleString())
    moment = lambda c: [F.col(f"{c}.at").alias("__at"), F.col(f"{c}.created_at").alias("__created"), F.col(f"{c}.check_id").alias("__check")]
    rows = held.select("store_id", "config", *moment("h"), F.lit(1).alias("__kind"), "__held", F.lit(None).cast(mark.schema["candidate_id"].dataType).alias("candidate_id"), F.lit(None).cast(mark.schema["first_snapshot_id"].dataType).alias("first_snapshot_id"))
    rows = rows.unionByName(mark.select("store_id", "config", *moment("cut"), F.lit(0).alias("__kind"), none.alias("__held"), "candidate_id", "first_snapshot_id"))  # a candidate comes before a check of its own moment
    met = running(rows, ["store_id", "config"], "__at", ["__created", "__check", "__kind"], last={"__seen": "__held"}).where("__kind = 0 and __seen is not null")
    last = F.col("__seen.last")
    newest = F.filter(last, lambda x, i: ~F.exists(F.slice(last, i + 2, buffer), lambda y: y["h_snapshot"] == x["h_snapshot"]) & (x["h_snapshot"] != F.col("first_snapshot_id")))
    met = met.withColumn("__newest", newest).withColumn("__whole", (F.size("__newest") >= MOST) | (F.col("__seen.n") <= buffer))
    values = F.transform(F.slice("__newest", F.greatest(F.lit(1), F.size("__newest") - (MOST - 1)), F.lit(MOST)), lambda x: x["value"])
    sound = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(sound)
    middle = lambda k: F.get(sound, F.floor(k / 2).cast("int")).cast("double")
    easy = met.where("__whole").select("candidate_id", F.size(values).cast("long").alias("samples"), (F.size(values) - n).cast("long").alias("broken"), ((middle(n - 1) + middle(n)) / 2).alias("median")).where("samples > 0")

    hard = mark.join(met.where("not __whole").select("candidate_id"), "candidate_id", "left_semi")
    before = hard.join(history, ["store_id", "config"]).where((F.col("h_snapshot") != F.col("first_snapshot_id")) & (F.col("h") < F.col("cut")))
    each = before.groupBy("candidate_id", "h_snapshot").agg(F.max("h").alias("h"), F.max_by("approved_count", "h").alias("value"))
    last = each.withColumn("n", F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc("h")))).where(F.col("n") <= MOST)
    rest = last.groupBy("candidate_id").agg(F.count("*").alias("samples"), F.count_if(F.col("value").isNull()).alias("broken"), F.percentile("value", F.lit(0.5)).alias("median"))
    return easy.unionByName(rest)


def feed_merchant_correlation(candidates: DataFrame, incidents: DataFrame, recorded: DataFrame, snapshots: DataFrame, checks: DataFrame, mapping: DataFrame) -> DataFrame:
    """(candidate_id, incident_id, correlated, reason, merchant_median, merchant_approved, confidence_floor), a row for each candidate.

    candidates: candidate_id, incident_id, store_id, type, status, first_snapshot_id, confirmation_snapshot_id,
    baseline_median, percent_threshold, absolute_threshold. incidents: incident_id, status. recorded: incident_id of
    incidents that have the correlation already. snapshots: snapshot_id, store_id, status, config (null without an
    account), feed_count, created_at. checks: check_id, snapshot_id, source, status, config, complete, approved, pending,
    disapproved, total, finished_at. mapping: snapshot_id, comparable, matched, feed_only, merchant_only, ambiguous,
    truncated. The first reason that applies is given; a null counts as a condition that isn't met.
    """
    checks = _approved(checks)
    own = _own_checks(snapshots, checks)
    rows = (candidates.join(incidents.select("incident_id", F.col("status").alias("i_status")), "incident_id", "left")
            .join(recorded.select("incident_id").distinct().withColumn("recorded", F.lit(True)), "incident_id", "left")
            .join(snapshots.select(F.col("snapshot_id").alias("first_snapshot_id"), "store_id", F.col("status").alias("s_status"), "config", "feed_count", "created_at"), ["first_snapshot_id", "store_id"], "left")
            .join(own.withColumnRenamed("snapshot_id", "first_snapshot_id"), "first_snapshot_id", "left"))
    base = merchant_baseline(rows.where("check_id is not null and config is not null and type = 'catalog_drop'"), snapshots, checks)
    rows = rows.join(base, "candidate_id", "left").join(mapping.withColumnRenamed("snapshot_id", "first_snapshot_id"), "first_snapshot_id", "left")
    pct, abs_ = F.col("percent_threshold"), F.col("absolute_threshold")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    ladder = [  # fixed values: the names of reasons
        ("candidate_context_unavailable", no((F.col("type") == "catalog_drop") & F.col("confirmation_snapshot_id").isNotNull() & F.col("status").isin("pending_confirmation", "confirmed"))),
        ("incident_unavailable", no(~F.col("i_status").isin("ignored", "resolved"))),
        ("already_recorded", F.col("recorded").isNotNull()),
        ("captured_thresholds_invalid", no(pct.between(0, 1) & (abs_ >= 1) & (abs_ == F.floor(abs_)))),
        ("snapshot_or_configuration_unavailable", no((F.col("s_status") == "completed") & F.col("config").isNotNull())),
        ("source_checks_incomplete", F.col("check_id").isNull()),
        ("snapshot_or_configuration_unavailable", no((F.col("feed_count") >= 0) & F.col("approved_count").isNotNull())),
        ("feed_drop_not_confirmed", no(is_drop(F.col("baseline_median"), F.col("feed_count"), pct, abs_))),
        ("merchant_baseline_unavailable", no((F.col("samples") >= LEAST) & (F.col("broken") == 0))),
        ("merchant_approved_drop_not_confirmed", no(is_drop(F.col("median"), F.col("approved_count"), pct, abs_))),
        ("mapping_incompatible", no(F.col("comparable"))),
        ("mapping_ambiguous", no(F.col("ambiguous") == 0)),
        ("mapping_truncated", no(~F.col("truncated"))),
        ("mapping_feed_count_mismatch", no(F.col("matched") + F.col("feed_only") == F.col("feed_count"))),
        ("mapping_has_no_merchant_only_products", no(F.col("merchant_only") > 0)),
        ("mapping_identity_loss_not_confirmed", no(is_matched_loss(F.col("matched"), F.col("merchant_only"), pct, abs_)))]
    reason = F.when(ladder[0][1], ladder[0][0])
    for name, applies in ladder[1:]:
        reason = reason.when(applies, name)
    rows = rows.withColumn("reason", reason.otherwise("correlated"))
    return rows.select("candidate_id", "incident_id", F.col("reason").isin("correlated", "already_recorded").alias("correlated"), "reason", F.col("median").alias("merchant_median"),
                       F.col("approved_count").alias("merchant_approved"), F.when(F.col("reason") == "correlated", 0.95).alias("confidence_floor"))
