"""Mixing sources to target weights along a time-varying curriculum.

Targets: each source has a weight schedule, piecewise linear over training time 0..1; its integral is the source's
weight.  The mix takes ``share`` times all words; targets are proportional to the weights, but no source gives more
than ``cap`` times its own size: what would exceed that is shared again among the others by weight until none is above
(solved in closed form: sources in order of cap / weight saturate first).

Selection: a source's documents form a stream in the order of the md5 of their ids; the mix takes the first
``target`` words of the stream repeated ``cap`` times, so every document is taken between floor(target / size) and
that plus one times, and only the last one in part.

Positions: the integral of a source's schedule is its cumulative demand; inverting it at the stream offset of a take
(the k-th time round, k times the source's size further on) gives the training time at which the mix reaches it, and
takes are range-sorted by that.

Prefix sums over a stream are taken in two levels, hash buckets and then rows within a bucket, so a source that holds
most rows is spread over many tasks.  Rows that share source, id and size (null ids, say) are counted before that, so
they are one row of a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialise

#: Weight schedules that repeat over the sources in code-point order: weights at time 0 and 1; the mean is the weight.
SCHEDULES = ((7.5, 2.5), (2.0, 2.0), (0.5, 1.5))
SHARE = 1.5
CAP = 2
BUCKET_ROWS = 4096  # documents of a hash bucket of a source, about


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\t \\n \\v \\f \\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, schedules=SCHEDULES, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, rows, w0, w1, target) of each source of (source, size); null is a source, the last.

    A source without words gets target 0.  The table has a row for each source; its windows run in one task.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.struct(F.lit(float(a)).alias("w0"), F.lit(float(b)).alias("w1"), F.lit((a + b) / 2).alias("weight")) for a, b in schedules])
    ranked = per.withColumn("kind", F.element_at(kinds, ((F.row_number().over(order) - 1) % len(schedules) + 1).cast("int"))).select("source", "source_size", "rows", "kind.*")
    # saturating in order of cap / weight: a source is at its cap if sharing what the ones before it leave would exceed it
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = share * F.sum("source_size").over(every)
    level = ((wanted - cap * F.coalesce(F.sum("source_size").over(by_ratio), F.lit(0)))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))))
    full = ranked.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= cap * F.col("source_size"))
    first_free = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return full.select("source", "source_size", "rows", "w0", "w1",
                       F.when(F.col("full"), (cap * F.col("source_size")).cast("double")).otherwise(first_free * F.col("weight")).alias("target"))


def mix(docs: DataFrame, schedules=SCHEDULES, share: float = SHARE, cap: int = CAP,
        text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, position) of each row of docs.

    Null texts have size 0 and are taken 0 times; null sources are one source, the last; null keys come first in their
    source's stream.  Rows of equal key are ordered by size; equal rows are interchangeable.  position is the training
    time, 0 to 1, at which the document is first met; null if it isn't taken.
    """
    found = _takes(_groups(docs, schedules, share, cap, text, source, key), cap)
    return found.select("doc_id", "size", "source", "source_size", "target",
                        F.aggregate("takes", F.lit(0).cast("long"), lambda s, t: s + t["words"]).alias("taken"), F.get("takes", F.lit(0))["position"].alias("position"))


def _groups(docs: DataFrame, schedules=SCHEDULES, share: float = SHARE, cap: int = CAP, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The rows that share source, key and size: copies of them, and start, the words of their source's stream before them."""
    sizes = materialise(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "mix-sizes")
    targets = materialise(source_targets(sizes, schedules, share, cap), "mix-targets")
    groups = sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies"))
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    placed = groups.withColumn("h", hashed).join(targets, groups["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    # buckets in hash order: the first 32 bits of the hash over the number of buckets of the source
    buckets = F.greatest(F.lit(1), F.ceil(F.col("rows") / BUCKET_ROWS)).cast("long")
    part = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    placed = placed.withColumn("bucket", F.floor(part * buckets / F.lit(float(1 << 32))).cast("long"))
    words = F.col("size") * F.col("copies")
    sums = placed.groupBy("source", "bucket").agg(F.sum(words).alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inner", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    placed = placed.join(starts, placed["source"].eqNullSafe(F.col("s")) & (placed["bucket"] == F.col("b")))
    return placed.select("source", "doc_id", "size", "copies", "source_size", "target", "w0", "w1", (F.col("before") + F.col("inner")).alias("start"))


def _takes(groups: DataFrame, cap: int = CAP) -> DataFrame:
    """A row for each copy of each group, numbered from 0, with takes: an array of (part, words, position), of positive words only."""
    chunk = 1 << 16  # copies of an array
    rows = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(chunk).cast("long"))))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("chunk"), F.least(F.col("chunk") + chunk, F.col("copies")) - 1))).drop("chunk")
    at = F.col("start") + F.col("copy") * F.col("size")
    whole = F.floor(F.col("target") + 0.5).cast("long")
    slope, w0 = F.col("w1") - F.col("w0"), F.col("w0")
    takes = []
    for k in range(cap):
        offset = k * F.col("source_size") + at
        # the share of its demand that the source has given by then, inverted through the schedule's integral
        done = F.least(F.lit(1.0), offset / F.greatest(F.lit(1).cast("long"), whole))
        area = done * (w0 + F.col("w1")) / 2
        time = F.when(F.abs(slope) < 1e-12, done).when(done == 0, 0.0).otherwise((F.sqrt(w0 * w0 + 2 * slope * area) - w0) / F.when(F.abs(slope) < 1e-12, 1.0).otherwise(slope))
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), whole - offset))
        takes.append(F.struct(F.lit(k).alias("part"), words.alias("words"), time.alias("position")))
    return rows.withColumn("takes", F.filter(F.array(*takes), lambda t: t["words"] > 0))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: what the mix takes of each document of ``documents``, range-sorted by training position."""
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = found.select("doc_id", "size", "source_size", "target", "taken", "position")
    return found.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


#: DuckDB: the same targets and the same streams, with plain prefix sums.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind FROM s),
r AS (SELECT source, source_size, CASE kind WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
             CASE kind WHEN 0 THEN 7.5::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS w0, CASE kind WHEN 0 THEN 2.5::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.5::DOUBLE END AS w1 FROM n),
l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - 2 * coalesce(sum(source_size) OVER before, 0)) / ((SELECT sum(w) FROM r) - coalesce(sum(w) OVER before, 0)) AS level
  FROM r WINDOW before AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, w0, w1, CASE WHEN level * w >= 2 * source_size THEN CAST(2 * source_size AS DOUBLE)
         ELSE (SELECT max(level) FROM l WHERE level * w < 2 * source_size) * w END AS target FROM l),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, w0, w1, CAST(floor(t.target + 0.5) AS BIGINT) AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CAST(greatest(0, least(size, whole - pos)) + greatest(0, least(size, whole - source_size - pos)) AS BIGINT) AS taken,
             least(1.0::DOUBLE, CAST(pos AS DOUBLE) / CAST(greatest(1, whole) AS DOUBLE)) AS done FROM c)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE WHEN abs(w1 - w0) < 1e-12 THEN done WHEN done = 0 THEN 0.0::DOUBLE
            ELSE (sqrt(w0 * w0 + 2 * (w1 - w0) * (done * (w0 + w1) / 2)) - w0) / (w1 - w0) END END AS position
FROM k
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents as often as the mix takes them, each take at its own position in the order of training.

    A take of a part of a document is its first words, one space between them.  Rows that share id, source and size are
    told apart by the digest of their text; equal rows are interchangeable.  Null and wordless texts aren't taken.
    """
    names = docs.columns
    groups = materialise(_groups(docs), "mix-groups")
    takes = _takes(groups).where(F.size("takes") > 0).select(*[F.col(c).alias(f"m_{c}") for c in ("doc_id", "source", "size", "copies", "copy")], "takes")
    # the row in a struct, so that no column of docs clashes with what is added
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col("doc_id").alias("id"), F.col("source").alias("origin"), word_count(F.col("text")).alias("n_words"))
    same = F.col("id").eqNullSafe(F.col("m_doc_id")) & F.col("origin").eqNullSafe(F.col("m_source"))
    took = ["doc", "n_words", F.explode("takes").alias("take")]
    # takes grow with the documents: never broadcast
    rows = held.join(takes.where("m_copies = 1").hint("merge"), same & (F.col("n_words") == F.col("m_size"))).select(*took)
    if not groups.where("copies > 1").isEmpty():
        # rows of one id, source and size: numbered, so that each has the takes of its own number
        several = groups.where("copies > 1").select(F.col("doc_id").alias("m_doc_id"), F.col("source").alias("m_source")).distinct()
        alike = Window.partitionBy("id", "origin", "n_words").orderBy(F.md5(F.col("doc.text").cast("binary")))
        numbered = held.join(several, same, "left_semi").withColumn("number", F.row_number().over(alike) - 1)
        again = numbered.join(takes.where("m_copies > 1"), same & (F.col("n_words") == F.col("m_size")) & (F.col("number") == F.col("m_copy")))
        rows = rows.unionByName(again.select(*took))
    words = F.slice(F.regexp_extract_all("doc.text", F.lit(WORD_PATTERN), F.lit(0)), F.lit(1), F.col("take.words").cast("int"))
    rows = rows.withColumn("cut", F.when(F.col("take.words") < F.col("n_words"), F.array_join(words, " ")))
    out = {"text": F.coalesce("cut", "doc.text"), "n_chars": F.when(F.col("cut").isNull(), F.col("doc.n_chars")).otherwise(F.length("cut")).cast("long")}
    order = [F.col("take.position"), F.col("doc.doc_id"), F.col("take.part")]
    return rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select(*[(out[c] if c in out else F.col(f"doc.`{c}`")).alias(c) for c in names])
