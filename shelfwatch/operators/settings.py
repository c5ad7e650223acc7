"""Versions of settings out of partial updates, and settings frozen for a snapshot at its first evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_hash
from .timeline import RANGES, as_of, range_of

#: What is hashed beside the settings, by their kind.
WRAPS = {"preferences": "alert_preferences_v1", "ruleThresholds": "store_thresholds_v1"}


def versions(updates: DataFrame, keys: list[str], at: str, ties: list[str], fields: dict[str, str], kind: str, unordered: list[str] = (), ranges: int = RANGES) -> DataFrame:
    """A row for each update: keys, at, ties, version, state, settings and hash, of all updates of its keys so far.

    updates: keys, at, ties (which order updates of one instant) and patch, a JSON object with some of fields (name to
    SQL type); a field that is absent or null stays as it was. version counts updates; state counts only those that
    change the hash, so updates of equal settings share a state. settings is a struct of fields. The hash is that of the
    canonical JSON of the settings and the kind's version, arrays named in unordered being sorted first.
    """
    # a row's own range is one window; what ranges end with is carried on, a row for each key and range (as timeline.running
    # does, but all steps share the ranges and what was dealt out)
    order, group = [at, *ties], ["__key", "__range"]
    own = Window.partitionBy(*group).orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    ranges_ = Window.partitionBy("__key").orderBy("__range")
    earlier = ranges_.rowsBetween(Window.unboundedPreceding, -1)
    last = F.struct(*order)

    # updates are dealt out as they come, for they may be few large files; texts are parsed by all tasks then
    rows = updates.select(F.struct(*keys).alias("__key"), range_of(updates, at, ranges).alias("__range"), *order, "patch").repartition(*group)
    parsed = F.from_json("patch", ", ".join(f"`{n}` {t}" for n, t in fields.items()), {"mode": "PERMISSIVE"})  # the default, but with an option a text isn't parsed anew for each field
    rows = rows.select(*group, *order, parsed.alias("__p"))
    rows = rows.select(*group, *order, *[F.last(F.col("__p")[n], ignorenulls=True).over(upto).alias(f"__f{k}") for k, n in enumerate(fields)])
    ends = rows.groupBy(*group).agg(F.max_by(F.struct(*[f"__f{k}" for k in range(len(fields))]), last).alias("__end"))
    carried = ends.select(*group, *[F.last(f"__end.__f{k}", ignorenulls=True).over(earlier).alias(f"__c{k}") for k in range(len(fields))])
    held = {n: F.coalesce(f"__f{k}", f"__c{k}") for k, n in enumerate(fields)}
    now = F.struct(*[v.alias(n) for n, v in held.items()])
    told = F.struct(*[(F.array_sort(v) if n in unordered else v).alias(n) for n, v in held.items()])
    rows = rows.join(carried, group, "left").select(*group, *order, now.alias("settings"), F.to_json(F.struct(told.alias(kind), F.lit(WRAPS[kind]).alias("version"))).alias("__text"))
    rows = rows.select(*group, *order, "settings", canonical_hash(F.col("__text")).alias("hash"))

    rows = rows.repartition(*group).withColumns({"__n": F.row_number().over(own), "__old": F.lag("hash").over(own)})
    rows = rows.withColumn("__changes", F.sum(F.when((F.col("__n") > 1) & ~F.col("hash").eqNullSafe(F.col("__old")), 1).otherwise(0)).over(upto))
    ends = rows.groupBy(*group).agg(F.count("*").alias("__rows"), F.max("__changes").alias("__all"), F.min_by("hash", last).alias("__first"), F.max_by("hash", last).alias("__last"))
    ends = ends.withColumn("__new", F.when(F.lag("__last").over(ranges_).eqNullSafe(F.col("__first")), 0).otherwise(1))
    carried = ends.select(*group, "__new", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__past"), F.coalesce(F.sum(F.col("__all") + F.col("__new")).over(earlier), F.lit(0)).alias("__states"))
    rows = rows.join(carried, group, "left")
    return rows.select(*[F.col("__key")[k].alias(k) for k in keys], *order, (F.col("__past") + F.col("__n")).alias("version"), (F.col("__states") + F.col("__new") + F.col("__changes")).alias("state"), "settings", "hash")


def frozen(evaluations: DataFrame, history: DataFrame, store: str, snapshot: str, at: str, valid_from: str, values: list[str], held: DataFrame | None = None, ranges: int = RANGES) -> DataFrame:
    """(store, snapshot, frozen_at, values) of each snapshot: the version in force at its first evaluation, for good.

    evaluations: store, snapshot, at; later ones of a snapshot, and edits after the first, change nothing. history:
    store, valid_from and values, one row a version. held: rows that an earlier call gave; snapshots in it keep them,
    whatever comes. Snapshots of which the first evaluation comes before any version have null values.
    """
    first = evaluations.groupBy(store, snapshot).agg(F.min(at).alias("frozen_at"))
    if held is not None:
        known = held.select(F.col(store).alias("__store"), F.col(snapshot).alias("__snapshot"))
        first = first.join(known, F.col(store).eqNullSafe(F.col("__store")) & F.col(snapshot).eqNullSafe(F.col("__snapshot")), "left_anti")
    new = as_of(first, history, store, "frozen_at", valid_from, values, ranges)
    return new if held is None else held.select(new.columns).unionByName(new)
