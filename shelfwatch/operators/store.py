"""Keyed merges and read models: upserts as union and latest-wins, keyset pages, interval and as-of joins."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import latest_window


def merge_latest(versions: DataFrame, keys: list[str], seq: str, coalesce: list[str] = ()) -> DataFrame:
    """One row a key: the last by seq, but each of the coalesce columns from the last row where it isn't null."""
    rest = [c for c in versions.columns if c not in (*keys, seq, *coalesce)]
    order = F.struct(seq, *rest)
    held = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(seq, c))).alias(c) for c in coalesce]
    return versions.groupBy(*keys).agg(F.max(order).alias("__last"), *held).select(*keys, f"__last.{seq}", *[f"__last.{c}" for c in rest], *coalesce)


def top_one(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def page(rows: DataFrame, order: list[tuple[str, bool]], limit: int, after: tuple | None = None) -> DataFrame:
    """The next limit + 1 rows after a cursor; order: column and whether it descends. The columns must not be null and be unique together."""
    if after is not None:
        past = F.lit(False)
        same = F.lit(True)
        for (name, down), value in zip(order, after, strict=True):
            past = past | (same & ((F.col(name) < F.lit(value)) if down else (F.col(name) > F.lit(value))))
            same = same & (F.col(name) == F.lit(value))
        rows = rows.where(past)
    return rows.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order]).limit(limit + 1)


def encode_cursor(values: tuple) -> str:
    return base64.urlsafe_b64encode(json.dumps(values, default=str).encode()).rstrip(b"=").decode()


def decode_cursor(cursor: str) -> tuple:
    """The values of a cursor. Raises ValueError for what is none: too long, not base64, not a JSON list."""
    if len(cursor) > 4096:
        raise ValueError("a cursor of more than 4096 characters")
    values = json.loads(base64.b64decode(cursor + "=" * (-len(cursor) % 4), altchars=b"-_", validate=True))
    if not isinstance(values, list):
        raise ValueError("a cursor that holds no list")
    return tuple(values)


def absent(rows: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys are not in present yet, each key once (the smallest row wins); keys with a null never match."""
    rest = [c for c in rows.columns if c not in keys]
    once = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, "__r.*") if rest else rows.distinct()
    return once.join(present.select(*keys), keys, "left_anti").select(*rows.columns)


def merged_issues(old: Column, new: Column) -> Column:
    """Issues of both arrays, old ones first, each once by code, severity, resolution, attribute, context and countries in any order. Null arrays are empty.

    An issue: struct of code, severity, resolution, attribute, reporting_context, applicable_countries (array) and others.
    """
    def identity(i: Column) -> Column:
        return F.struct(*[i[c] for c in ("code", "severity", "resolution", "attribute", "reporting_context")], F.array_sort(F.coalesce(i["applicable_countries"], F.array())))

    def add(kept: Column, i: Column) -> Column:
        return F.when(F.exists(kept, lambda k: identity(k).eqNullSafe(identity(i))), kept).otherwise(F.concat(kept, F.array(i)))

    both = F.concat(F.coalesce(old, F.slice(new, 1, 0), F.array()), F.coalesce(new, F.slice(old, 1, 0), F.array()))
    return F.aggregate(both, F.slice(both, 1, 0), add)


def replaced_inventory(items: DataFrame, incoming: DataFrame, scans: DataFrame) -> DataFrame:
    """Merchant items of all snapshots after their scans: a complete scan replaces what its snapshot holds, a partial one adds and merges issues.

    items and incoming: snapshot_id, stable_key (once a snapshot), issues (see merged_issues). scans: one row a snapshot
    with config and held_config (of an earlier scan, null: none), status and complete. A scan whose config isn't 64
    lower-case hex digits, or differs from the held one, changes nothing. A partial scan brings only items with issues;
    known items keep their old issues and gain the new ones, after a success the new ones alone.
    """
    fence = scans.where(F.col("config").rlike("^[0-9a-f]{64}$") & (F.col("held_config").isNull() | (F.col("held_config") == F.col("config")))).select(
        "snapshot_id", F.coalesce(F.col("complete") & (F.col("status") == "success"), F.lit(False)).alias("whole"), (F.col("status") == "success").alias("fine"))
    kept = items.join(fence.where("whole").select("snapshot_id"), "snapshot_id", "left_anti").select("snapshot_id", "stable_key", F.col("issues").alias("old"), F.lit(True).alias("was"))
    come = incoming.join(fence, "snapshot_id").where(F.col("whole") | (F.size("issues") > 0)).select("snapshot_id", "stable_key", F.col("issues").alias("new"), "fine", F.lit(True).alias("comes"))
    rows = kept.join(come, ["snapshot_id", "stable_key"], "full")
    return rows.select("snapshot_id", "stable_key", F.when(F.col("comes").isNull(), F.col("old")).when(F.col("was").isNull() | F.col("fine"), F.col("new")).otherwise(merged_issues(F.col("old"), F.col("new"))).alias("issues"))


def active_window(events: DataFrame, windows: DataFrame, at: str, keys: list[str], id_: list[str]) -> DataFrame:
    """events (id_ first) with the window of their keys that holds at (starts_at <= at < ends_at, not cancelled), the latest start winning; null if none.

    One pass over the times of both (timeline.latest_window): however many windows hold an event, it doesn't meet them one by one.
    """
    found = latest_window(events, windows.where("cancelled_at is null"), keys, at, "starts_at", "ends_at", "window_id")
    return found.select(*id_, *[c for c in events.columns if c not in id_], "window_id")
