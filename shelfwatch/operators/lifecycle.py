"""State machines of candidates and incidents: pure steps, folded in batch or kept as streaming state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: From one status and an observation to the next status and its event.
HEALTHY = {"open": ("recovering", "recovery_started"), "investigating": ("recovering", "recovery_started"), "acknowledged": ("recovering", "recovery_started"),
           "recovering": ("resolved", "resolved")}
UNHEALTHY = {"recovering": ("open", "reopened")}


def recovery_step(status: str, comparable: bool, healthy: bool) -> tuple[str, str]:
    """(next status, event or "")."""
    if not comparable:
        return status, ""
    return (HEALTHY if healthy else UNHEALTHY).get(status, (status, ""))


def recovery_fold(observations: DataFrame, key: str, at: str, initial: str | Column = "open", keep: list[str] = ()) -> DataFrame:
    """(key, at, keep, status, event) of each observation (key, at, snapshot, comparable, healthy) of an incident, in order.

    initial: the status before the first one, a text for all or a column that is the same in all rows of a key.

    A snapshot that comes again changes nothing. Windows only: among the observations that count, a healthy one starts
    recovery, a second healthy one at once resolves for good, an unhealthy one reopens.
    """
    order = Window.partitionBy(key).orderBy(at, "snapshot")
    past, before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    again = (F.row_number().over(order) > 1) & F.col("snapshot").eqNullSafe(F.lag("snapshot").over(order))
    first = F.lit(initial) if isinstance(initial, str) else initial
    rows = observations.withColumns({"__first": first, "__counts": F.when(F.coalesce("comparable", F.lit(False)) & ~again, F.coalesce("healthy", F.lit(False)))})
    begun = F.col("__first") == "recovering"
    rows = rows.withColumns({"__prior": F.coalesce(F.last("__counts", ignorenulls=True).over(before), begun), "__latest": F.coalesce(F.last("__counts", ignorenulls=True).over(past), begun),
                             "__ever": F.coalesce(F.bool_or("__counts").over(past), F.lit(False)) | begun})
    rows = rows.withColumn("__ends", F.coalesce(F.col("__counts") & F.col("__prior"), F.lit(False)))
    rows = rows.withColumns({"__over": F.bool_or("__ends").over(past), "__was_over": F.coalesce(F.bool_or("__ends").over(before), F.lit(False))})
    fixed = ~F.col("__first").isin(*HEALTHY)
    status = F.when(fixed, F.col("__first")).when(F.col("__over"), "resolved").when(F.col("__latest"), "recovering").when(F.col("__ever"), "open").otherwise(F.col("__first"))
    event = F.when(fixed | F.col("__counts").isNull() | F.col("__was_over"), "").when(F.col("__ends"), "resolved").when(F.col("__counts"), "recovery_started").when(F.col("__prior"), "reopened").otherwise("")
    return rows.select(key, at, *keep, status.alias("status"), event.alias("event"))


def two_strikes(observations: DataFrame, keys: list[str], at: str, significant: Column, comparable: Column | None = None, snapshot: str | None = None) -> DataFrame:
    """observations with debounce: confirmed where the comparable one before was significant too, pending where it wasn't, else healthy.

    One that isn't comparable is not_comparable and counts for nothing. Where snapshot is given, an observation of the
    snapshot of the one before is its rerun: it has the same debounce and doesn't count again.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    counts = F.lit(True) if comparable is None else F.coalesce(comparable, F.lit(False))
    if snapshot is not None:
        counts = counts & ~((F.row_number().over(w) > 1) & F.col(snapshot).eqNullSafe(F.lag(snapshot).over(w)))
    rows = observations.withColumn("significant", significant).withColumn("__counts", counts)
    before = F.coalesce(F.last(F.when(F.col("__counts"), F.col("significant")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    said = F.when(F.col("significant") & before, "confirmed").when(F.col("significant"), "pending").otherwise("healthy")
    rows = rows.withColumn("debounce", F.when(F.col("__counts"), said))
    if snapshot is not None:
        run = Window.partitionBy(*keys, snapshot).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("debounce", F.coalesce("debounce", F.last("debounce", ignorenulls=True).over(run)))
    return rows.withColumn("debounce", F.coalesce("debounce", F.lit("not_comparable"))).drop("__counts")


def newest_streak(checks: DataFrame, keys: list[str], at: str, failed: Column) -> DataFrame:
    """(keys, streak): the failures since the last success, up to the newest check."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = checks.withColumn("failed", failed).withColumn("newer_ok", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w))
    return rows.groupBy(*keys).agg(F.count_if(F.col("failed") & (F.col("newer_ok") == 0)).alias("streak"))
