"""Drop candidates with a deadline: opened by a drop, refreshed by further drops, ended by a confirmation or by time.

A store and a configuration have one pending candidate at most.  A drop opens one, or refreshes the pending one and puts
its deadline off; a confirming snapshot before the deadline ends it by the first rule that applies; at the deadline it
expires without any event.  So what a row of the log meets depends on the row before it alone, and the batch form needs
no fold: a candidate is a run of drops, each before the deadline that the one before has set.  ``streaming.candidates``
is the same machine with keyed state and timers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import number
from ..functions.columns import fingerprint, fixed
from .baseline import is_drop
from .timeline import RANGES, running

#: Minutes until a candidate is due and until it expires, its rule, its scope, and the names of its states and reasons.
DUE_MINUTES, EXPIRY_MINUTES = 10, 30
KIND, SCOPE = "catalog_drop", "feed.product_count"
PENDING = "pending_confirmation"
REASONS = {
    "confirmation_window_expired": "expired", "baseline_stale_or_replaced": "expired", "baseline_configuration_changed": "expired", "confirmation_configuration_changed": "expired",
    "confirmation_source_check_failed": "source_failure", "confirmation_recovered": "dismissed", "confirmation_matched_drop": "confirmed",
}
#: Of a drop: what a candidate takes from the first one and keeps, and what the latest one replaces.
FIRST = ["baseline_id", "baseline_version", "baseline_median"]
LATEST = ["snapshot_id", "observed", "percent_threshold", "absolute_threshold", "threshold_version", "threshold_hash"]
#: Of a confirming snapshot; the baseline is that in force then.
ASKED = ["snapshot_id", "observed", "active_baseline_id", "active_config", "snapshot_config", "source_status"]
LOG = ("store_id string, config string, at timestamp, kind string, snapshot_id string, observed double, baseline_id string, baseline_version int, baseline_median double, percent_threshold double, "
       "absolute_threshold double, threshold_version int, threshold_hash string, active_baseline_id string, active_config string, snapshot_config string, source_status string")


def drops(snapshots: DataFrame, baselines: DataFrame) -> DataFrame:
    """The log rows (kind drop) of snapshots whose feed count is a drop under the baseline of their store that is in force.

    snapshots: store_id, snapshot_id, at, role, feed_status, observed (feed count), config, percent_threshold,
    absolute_threshold (null: 0.2 and 20), threshold_version, threshold_hash (as captured for the snapshot). baselines:
    store_id, baseline_id, baseline_version, baseline_median, config, status, valid_to. Confirming snapshots, those
    without a successful feed check or a count, and those of another configuration than the baseline's open nothing.
    """
    force = baselines.where("status = 'active' and valid_to is null").groupBy("store_id").agg(
        F.max_by(F.struct(*FIRST, "config"), "baseline_version").alias("b")).select(F.col("store_id").alias("b_store"), "b.*")
    some = snapshots.where("role <> 'confirmation_check' and feed_status = 'success' and observed is not null").withColumnRenamed("config", "s_config")
    pct, abs_ = F.coalesce("percent_threshold", F.lit(0.2)), F.coalesce("absolute_threshold", F.lit(20.0))
    hit = some.join(force, (F.col("store_id") == F.col("b_store")) & (F.col("config") == F.col("s_config"))).where(is_drop(F.col("baseline_median"), F.col("observed"), pct, abs_))
    return hit.select("store_id", "config", "at", F.lit("drop").alias("kind"), "snapshot_id", F.col("observed").cast("double"), *FIRST, pct.alias("percent_threshold"), abs_.alias("absolute_threshold"), "threshold_version", "threshold_hash")


def confirmations(snapshots: DataFrame) -> DataFrame:
    """The log rows (kind confirm) of confirming snapshots: store_id, config (the candidate's), at and ASKED."""
    return snapshots.select("store_id", "config", "at", F.lit("confirm").alias("kind"), *ASKED)


def verdict(q: Column, baseline_id: Column, config: Column, median: Column, pct: Column, abs_: Column) -> Column:
    """The reason by which a confirming snapshot q (a struct of ASKED) ends a candidate in time; the first that applies."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (F.when(no(q["active_baseline_id"] == baseline_id), "baseline_stale_or_replaced").when(no(q["active_config"] == config), "baseline_configuration_changed")
            .when(no(q["snapshot_config"] == config), "confirmation_configuration_changed").when(no(q["source_status"] == "success") | q["observed"].isNull(), "confirmation_source_check_failed")
            .when(no(is_drop(median, q["observed"], pct, abs_)), "confirmation_recovered").otherwise("confirmation_matched_drop"))


def status_of(reason: Column) -> Column:
    """The state that a reason ends in; a null reason is pending."""
    said = F.lit(PENDING)
    for name, state in REASONS.items():
        said = F.when(reason == name, state).otherwise(said)
    return F.when(reason.isNull(), PENDING).otherwise(said)


def described(rows: DataFrame) -> DataFrame:
    """Candidates as rows: rows has store_id, config, opened_at, seen_at, drops, FIRST, LATEST (snapshot_id as
    first_snapshot_id) and confirmation_snapshot_id, confirmed_value, status_reason, ended_at (null while pending)."""
    ended = F.col("status_reason").isin("confirmation_recovered", "confirmation_matched_drop")  # the confirming count replaces the first
    median, observed = F.col("baseline_median"), F.when(ended, F.col("confirmed_value")).otherwise(F.col("observed"))
    share = lambda value: F.when(median == 0, 0.0).otherwise((median - value) / median)
    evidence = F.array(F.concat(F.lit("feed product count dropped "), fixed(share(F.col("observed")) * 100, 1), F.lit("%")), F.concat(F.lit("baseline version "), F.col("baseline_version").cast("string")),
                       F.concat(F.lit("baseline median "), number(median.cast("string"))))
    due, expires = (F.col("seen_at") + F.expr(f"INTERVAL {m} MINUTES") for m in (DUE_MINUTES, EXPIRY_MINUTES))
    return rows.select(
        "store_id", "config", fingerprint(F.col("store_id"), F.lit(KIND), F.lit(SCOPE), F.col("config")).alias("fingerprint"), "opened_at", *FIRST, "first_snapshot_id", median.alias("before_value"),
        observed.alias("observed_value"), (median - observed).alias("change_abs"), share(observed).alias("change_pct"), evidence.alias("evidence"),
        F.struct("percent_threshold", "absolute_threshold", "threshold_version", "threshold_hash").alias("thresholds"), F.col("drops").cast("long").alias("drops"), due.alias("due_at"), expires.alias("expires_at"),
        status_of(F.col("status_reason")).alias("status"), "status_reason", "confirmation_snapshot_id", "ended_at")


def candidates(log: DataFrame, now: Column | None = None, ranges: int = RANGES) -> DataFrame:
    """Every candidate of a log (rows of ``drops`` and ``confirmations``, columns of LOG), ended or pending at now (null: for ever later).

    Rows of one instant count in the order drop, confirm, then by snapshot_id. A confirming row that meets no pending
    candidate, at the deadline itself included, changes nothing.
    """
    expiry = F.expr(f"INTERVAL {EXPIRY_MINUTES} MINUTES")
    is_new = F.col("kind") == "drop"
    rows = log.withColumn("__late", (~is_new).cast("int")).withColumn("__self", F.struct(is_new.alias("drop"), F.col("at").alias("at")))
    rows = running(rows, ["store_id", "config"], "at", ["__late", "snapshot_id"], before={"__prior": "__self"}, ranges=ranges)
    alive = F.coalesce(F.col("__prior.drop") & (F.col("__prior.at") + expiry > F.col("at")), F.lit(False))
    rows = rows.withColumn("__alive", alive).withColumn("__opens", F.when(is_new & ~F.col("__alive"), F.struct("at", "snapshot_id")))
    rows = running(rows, ["store_id", "config"], "at", ["__late", "snapshot_id"], last={"__of": "__opens"}, ranges=ranges).where(is_new | F.col("__alive"))
    place = F.struct("at", "snapshot_id")
    dropped, asked = F.when(is_new, place), F.when(~is_new, place)
    each = rows.groupBy("store_id", "config", "__of").agg(
        F.min_by(F.struct(*FIRST), dropped).alias("f"), F.max_by(F.struct(*LATEST, F.col("at").alias("seen_at")), dropped).alias("l"), F.count_if(is_new).alias("drops"),
        F.max_by(F.struct(*ASKED, "at"), asked).alias("q"))
    reason = F.when(F.col("q").isNotNull(), verdict(F.col("q"), F.col("f.baseline_id"), F.col("config"), F.col("f.baseline_median"), F.col("l.percent_threshold"), F.col("l.absolute_threshold")))
    over = F.lit(True) if now is None else (F.col("l.seen_at") + expiry <= now)
    reason = reason.when(over, "confirmation_window_expired")
    return described(each.select(
        "store_id", "config", F.col("__of.at").alias("opened_at"), "l.seen_at", "drops", "f.*", *[F.col(f"l.{c}").alias("first_snapshot_id" if c == "snapshot_id" else c) for c in LATEST],
        F.col("q.snapshot_id").alias("confirmation_snapshot_id"), F.col("q.observed").alias("confirmed_value"), reason.alias("status_reason"),
        F.when(F.col("q").isNotNull(), F.col("q.at")).when(reason.isNotNull(), F.col("l.seen_at") + expiry).alias("ended_at")))


def incidents(found: DataFrame) -> DataFrame:
    """The incidents that confirmed candidates open."""
    median, after = F.col("baseline_median"), F.col("observed_value")
    shown = lambda c: number(c.cast("string"))
    return found.where("status = 'confirmed'").select(
        "store_id", "fingerprint", F.lit(KIND).alias("type"), F.lit("critical").alias("severity"), F.lit("Feed product catalog drop").alias("title"),
        F.concat(F.lit("Feed product count dropped from "), shown(median), F.lit(" to "), shown(after), F.lit(".")).alias("summary"), F.lit("feed_or_publication").alias("likely_source"), F.lit(0.85).alias("confidence"),
        "baseline_id", "baseline_version", "baseline_median", "config", "before_value", after.alias("after_value"), "thresholds", "evidence", F.col("confirmation_snapshot_id").alias("opened_snapshot_id"),
        F.greatest(F.lit(0.0), median - after).alias("affected_count"), F.col("ended_at").alias("first_detected_at"), F.lit("open").alias("status"))
