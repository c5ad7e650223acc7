"""Running values along each key's time, spread over many tasks even where one key holds most rows.

A window over a key puts the key into one task.  Here a key's time is cut into ranges that hold about as many rows each
(approximate quantiles of all rows' times); values run within a key's range, and what a range ends with is carried on to
the key's later ranges, a row for each key and range.  Rows of one instant are in one range, so a range grows beyond its
share only by rows of one key and one instant.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGES = 32


def cuts(rows: DataFrame, at: str, ranges: int = RANGES) -> list[Column]:
    """The times, in order, at which a next range begins; times are numbers, dates or timestamps."""
    kind = rows.schema[at].dataType
    shares = [k / ranges for k in range(1, ranges)]
    if not shares:
        return []
    bounds = rows.agg(F.percentile_approx(at, shares, 1000).cast("array<string>")).first()[0]  # ranges - 1 texts
    return [F.lit(b).cast(kind) for b in dict.fromkeys(bounds or [])]  # they come in order


def place(time: Column, edges: list[Column]) -> Column:
    """The number of the range that a time lies in, from 0. Null times are in range 0."""
    def among(low: int, high: int) -> Column:
        middle = (low + high + 1) // 2
        return F.lit(low) if low == high else F.when(time >= edges[middle - 1], among(middle, high)).otherwise(among(low, middle - 1))

    return among(0, len(edges))


def range_of(rows: DataFrame, at: str, ranges: int = RANGES) -> Column:
    """The number of the range that a row's time lies in, of ranges with about as many rows each."""
    return place(F.col(at), cuts(rows, at, ranges))


def running(rows: DataFrame, keys: list[str], at: str, ties: list[str] = (), last: dict[str, str] | None = None, before: dict[str, str] | None = None,
            sums: dict[str, str] | None = None, ranges: int = RANGES) -> DataFrame:
    """rows with running columns, each named by its key and read from the column it maps to, in order of at and ties.

    last: the last value that isn't null, the row's own included; before: that of earlier rows only; sums: the sum, the
    row's own included (null counts as 0). Null keys are a key of their own. Rows that tie in at and ties come in any order.
    """
    last, before, sums = last or {}, before or {}, sums or {}
    order = [at, *ties]
    placed = rows.withColumn("__range", range_of(rows, at, ranges))
    own = Window.partitionBy(*keys, "__range").orderBy(*order)
    upto, past = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    held = sorted({*last.values(), *before.values()})
    place = F.struct(*order)
    ends = placed.groupBy(*keys, "__range").agg(
        *[F.max_by(F.struct(c), F.when(F.col(c).isNotNull(), place)).getField(c).alias(f"__v{k}") for k, c in enumerate(held)],
        *[F.sum(c).alias(f"__s{k}") for k, c in enumerate(sums.values())], F.count("*").alias("__rows"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    carried = ends.select(*[F.col(c).alias(f"__k{k}") for k, c in enumerate(keys)], F.col("__range").alias("__in"),
                          *[F.last(f"__v{k}", ignorenulls=True).over(earlier).alias(f"__c{k}") for k in range(len(held))],
                          *[F.sum(f"__s{k}").over(earlier).alias(f"__t{k}") for k in range(len(sums))])
    placed = placed.withColumns({f"__last_{n}": F.last(c, ignorenulls=True).over(upto) for n, c in last.items()} | {f"__past_{n}": F.last(c, ignorenulls=True).over(past) for n, c in before.items()}
                                | {f"__sum_{n}": F.sum(c).over(upto) for n, c in sums.items()})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{k}")) for k, c in enumerate(keys)], F.col("__range") == F.col("__in"))
    met = placed.join(carried, same, "left")
    found = {n: F.coalesce(f"__last_{n}", f"__c{held.index(c)}") for n, c in last.items()} | {n: F.coalesce(f"__past_{n}", f"__c{held.index(c)}") for n, c in before.items()}
    found |= {n: F.coalesce(f"__sum_{n}", F.lit(0)) + F.coalesce(f"__t{k}", F.lit(0)) for k, n in enumerate(sums)}
    return met.select(*[c for c in rows.columns if c not in found], *[v.alias(n) for n, v in found.items()])


def as_of(rows: DataFrame, versions: DataFrame, key: str, at: str, valid_from: str, values: list[str], ranges: int = RANGES) -> DataFrame:
    """rows with the values of the version of their key in force at their time (valid_from <= at), null if there is none yet.

    Of versions of one instant the largest by values counts. One union; a key's rows are spread over ranges of time.
    """
    v = versions.select(F.col(key).alias("__key"), F.col(valid_from).alias("__t"), F.lit(0).alias("__kind"), F.struct(*values).alias("__v"), F.lit(None).cast(rows.schema.simpleString()).alias("__row"))
    v = v.groupBy("__key", "__t", "__kind").agg(F.max("__v").alias("__v")).select("__key", "__t", "__kind", "__v", F.lit(None).cast(rows.schema.simpleString()).alias("__row"))
    r = rows.select(F.col(key).alias("__key"), F.col(at).alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast(v.schema["__v"].dataType.simpleString()).alias("__v"), F.struct(*rows.columns).alias("__row"))
    both = running(v.unionByName(r), ["__key"], "__t", ["__kind"], last={"__in_force": "__v"}, ranges=ranges).where("__kind = 1")
    return both.select("__row.*", *[F.col(f"__in_force.{c}").alias(c) for c in values])


def _values(column: pa.Array) -> list:
    """A column's values in Python; timestamps as microseconds."""
    column = column.cast(pa.int64()) if pa.types.is_timestamp(column.type) else column
    return column.to_numpy().tolist() if pa.types.is_integer(column.type) and not column.null_count else column.to_pylist()


def _topmost(keys: int, columns: list[str]):
    """A function of batches in order of __k*, __bin, __t, __kind and __window: points with the latest window that still holds them.

    Windows lie on a stack, those that began last on top. One that has ended, or that ends before a later one does, is
    never seen again, so it leaves: each window comes and goes once, and what stays has ends that fall towards the top.
    A point's __until is its time.
    """
    groups = [*[f"__k{k}" for k in range(keys)], "__bin"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ends, open_ = None, [], []
        for batch in batches:
            found = []
            come = iter(batch.filter(pc.equal(batch["__kind"], 0))["__window"].to_pylist())
            for own, is_point, until in zip(zip(*[_values(batch[c]) for c in groups], strict=True), _values(batch["__kind"]), _values(batch["__until"]), strict=True):
                if own != group:
                    group, ends, open_ = own, [], []
                while ends and ends[-1] <= until:
                    ends.pop()
                    open_.pop()
                if is_point:
                    found.append(open_[-1] if open_ else None)
                else:
                    ends.append(until)
                    open_.append(next(come))
            points = batch.filter(pc.equal(batch["__kind"], 1))
            yield pa.RecordBatch.from_arrays([*[points[c] for c in columns], pa.array(found, batch["__window"].type)], names=[*columns, "window_id"])

    return run


def latest_window(points: DataFrame, windows: DataFrame, keys: list[str], at: str, starts: str, ends: str, window: str, ranges: int = RANGES) -> DataFrame:
    """points with window_id: of their keys' windows with starts <= at < ends the one that starts last (of these the largest), null if none.

    No pairs are made: a pass over the sorted times of windows and points keeps the windows that can still be seen. A key's
    time is cut into ranges; a window goes to the range where it starts and to that where it ends. Of the windows that
    cover a range whole only the latest can be seen in it, so each key and range has one row for them.
    """
    live = windows.where(F.col(ends) > F.col(starts)).dropna(subset=keys)
    both = live.select(F.coalesce(starts, ends).alias("__t")).unionByName(points.select(F.col(at).alias("__t")))  # of the type in which they compare
    kind = both.schema["__t"].dataType
    edges = cuts(live.select(F.col(starts).cast(kind).alias("__t")).unionByName(points.select(F.col(at).cast(kind).alias("__t"))), "__t", ranges)
    own = [f"__k{k}" for k in range(len(keys))]
    w = live.select(*[F.col(c).alias(k) for c, k in zip(keys, own, strict=True)], F.col(starts).cast(kind).alias("__t"), F.col(window).alias("__window"), F.col(ends).cast(kind).alias("__until"))
    w = w.withColumns({"__first": place(F.col("__t"), edges), "__final": place(F.col("__until"), edges)})
    parts = w.withColumn("w_bin", F.explode(F.array_distinct(F.array("__first", "__final")))).drop("__first", "__final")
    if len(edges) > 1:
        over = w.where("__final - __first > 1").groupBy(*own, "__first", "__final").agg(F.max(F.struct("__t", "__window", "__until")).alias("__w"))
        over = over.withColumn("w_bin", F.explode(F.sequence(F.col("__first") + 1, F.col("__final") - 1))).groupBy(*own, "w_bin").agg(F.max("__w").alias("__w"))
        parts = parts.unionByName(over.select(*own, "w_bin", "__w.*"))
    p = points.select(*[F.col(c).alias(k) for c, k in zip(keys, own, strict=True)], F.col(at).cast(kind).alias("__t"), *points.columns)
    p = p.withColumns({"__bin": place(F.col("__t"), edges), "__until": F.col("__t"), "__kind": F.lit(1)})
    rows = p.unionByName(parts.withColumnRenamed("w_bin", "__bin").withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    rows = rows.repartition(*own, "__bin").sortWithinPartitions(*own, "__bin", "__t", "__kind", "__window")
    schema = T.StructType([*[rows.schema[c] for c in points.columns], T.StructField("window_id", rows.schema["__window"].dataType)])
    return rows.mapInArrow(_topmost(len(keys), points.columns), schema)
