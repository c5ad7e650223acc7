"""Near-duplicate detection: MinHash bands propose, odd sketches screen, full shingle sets decide.

A document is the set of its distinct word shingles (64-bit hashes of words, lower-cased in A-Z).  Documents with
equal sets form a class; everything below works on classes, so copies are never expanded into pairs.

* ``BANDS`` bands of ``ROWS`` MinHash values: a pair of similarity 0.8 shares no band with probability
  (1 - 0.8**4)**32 < 5e-8.
* An odd sketch folds the ``BANDS * ROWS`` samples into a parity bitmap of ``SKETCH_BITS`` bits.  The population count
  of the XOR of two sketches estimates how many samples differ; a pair goes on if the estimate is within 5.5 standard
  deviations of the threshold.
* What goes on is confirmed on full sets: 100 * intersection >= 80 * union.

A bucket (documents that share a band) is never expanded into all pairs at first: each class is compared with the
bucket's pivot, the class that shares most of its bands with others, which for a group of copies is their original.
Confirmed links give components.  Only buckets that still hold several components are looked at again, pairing classes
outside a bucket's main component with the rest, but for pairs that two exact bounds rule out: the shingles that nobody
else has, and the odd sketches of the full sets, whose XOR counts at most the shingles that only one of two has.  So no
candidate link is lost, however large the bucket.  Such a bucket is dealt into blocks of about ``BLOCK`` classes, and a
pair of blocks is a key of the join, so no task meets a whole bucket.

Where a bucket or a hub has many rows, Spark's adaptive execution splits its partition; so that it can, what is joined
by bucket is a written table on both sides, not an aggregate of the same stage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, doc_slices, materialise, utf8_view, word_hashes

BANDS = 32
ROWS = 4
SKETCH_BITS = 512
PARITY_WORDS = 16  # of 64 bits, of the parity bitmap of a full set
PERCENT = 80
CHUNK = 1 << 20
BLOCK = 512  # classes of an open bucket that meet another block in a task

_MIX = np.random.default_rng(11).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(offsets: np.ndarray, data: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the distinct shingles of each text, sorted; text k has hashes[ends[k]:ends[k + 1]].

    A text of fewer words than a shingle has its whole sequence as the only one; a text without words has none.
    """
    n = len(offsets) - 1
    low = _LOWER[data]
    inside = ~_SPACE[low]
    before = np.append(False, inside[:-1])
    at_doc = offsets[:-1][np.diff(offsets) > 0]
    before[at_doc] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.append(inside[1:], False)
    after[offsets[1:][np.diff(offsets) > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    word = _mixed(word_hashes(low, starts, ends)[0])
    first = np.searchsorted(starts, offsets)  # of each text's words
    counts = np.diff(first)
    n_shingles = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(n), n_shingles)
    s_first = np.cumsum(n_shingles) - n_shingles
    at = first[:-1][doc] + np.arange(len(doc)) - s_first[doc]
    h = np.zeros(len(doc), np.uint64)
    for k in range(words):
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(at + k < first[1:][doc], word[np.minimum(at + k, len(word) - 1)], np.uint64(k + 1))
        h ^= h >> np.uint64(29)
    h = _mixed(h)
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint32), kind="stable")]
    h, doc = h[order], doc[order]
    fresh = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
    h, doc = h[fresh], doc[fresh]
    return h, np.searchsorted(doc, np.arange(n + 1))


def signatures(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class keys: n x 2, band keys: n x BANDS, odd sketches: n x SKETCH_BITS / 64) of sets, none of them empty."""
    starts, n = ends[:-1], len(ends) - 1
    low = np.empty((BANDS * ROWS, n), np.uint64)
    for k in range(BANDS * ROWS):
        low[k] = np.minimum.reduceat(h * _MIX[k], starts)
    key = np.stack([np.add.reduceat(h, starts), np.add.reduceat(_mixed(h ^ np.uint64(0xA0761D6478BD642F)), starts)], axis=1)
    bands = np.empty((n, BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(n, np.uint64(b + 1))
        for k in range(b * ROWS, b * ROWS + ROWS):
            x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + low[k])
        bands[:, b] = x
    bit = _mixed(low ^ (np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[:, None]) % np.uint64(SKETCH_BITS)
    cells = np.bincount((np.arange(n)[None, :] * SKETCH_BITS + bit.astype(np.int64)).ravel(), minlength=n * SKETCH_BITS)
    sketch = np.packbits((cells & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1).view(np.uint64)
    return key, bands, sketch


def _most_differing_bits() -> int:
    """Largest population count of the XOR of two sketches that still goes on."""
    samples, apart = BANDS * ROWS, 1 - PERCENT / 100
    most = samples * apart + 5.5 * (samples * apart * (1 - apart)) ** 0.5
    expected = SKETCH_BITS / 2 * (1 - np.exp(-4 * most / SKETCH_BITS))
    return int(np.ceil(expected + 3 * np.sqrt(SKETCH_BITS) / 2))


def _lists(values: np.ndarray, width: int) -> pa.Array:
    n = len(values) // width
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.view(np.int64)))


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, digest (of the text), n, cls (null for an empty set), bands, sketch for each row of (doc_id, digest, text)."""

    def run(batches):
        for batch in batches:
            offsets, data = utf8_view(batch.column(2))
            for i, j in doc_slices(offsets, CHUNK):
                part = batch.slice(i, j - i)
                h, ends = shingle_sets(offsets[i: j + 1] - offsets[i], data[offsets[i]: offsets[j]], words)
                sizes = np.diff(ends)
                some = np.flatnonzero(sizes)
                if len(some):
                    key, bands, sketch = signatures(h, np.append(ends[some], ends[-1]))
                else:
                    key, bands, sketch = (np.zeros((0, k), np.uint64) for k in (2, BANDS, SKETCH_BITS // 64))
                place = np.full(len(sizes), -1)
                place[some] = np.arange(len(some))
                take = pa.array(place, mask=place < 0)
                cls = pa.array([x.tobytes() for x in key], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes), cls.take(take), _lists(bands.ravel(), BANDS).take(take), _lists(sketch.ravel(), SKETCH_BITS // 64).take(take)],
                    names=["doc_id", "digest", "n", "cls", "bands", "sketch"])

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, digest string, n long, cls binary, bands array<long>, sketch array<long>")


def _full_sets(docs: DataFrame, words: int) -> DataFrame:
    """cls, n, shingles, parity (bitmap of the whole set) and rows of each row (text, rows) of docs."""

    def run(batches):
        for batch in batches:
            offsets, data = utf8_view(batch.column(0))
            for i, j in doc_slices(offsets, CHUNK):
                h, ends = shingle_sets(offsets[i: j + 1] - offsets[i], data[offsets[i]: offsets[j]], words)
                some = np.flatnonzero(np.diff(ends))
                if not len(some):
                    continue
                ends = np.append(ends[some], ends[-1])
                key = np.stack([np.add.reduceat(h, ends[:-1]), np.add.reduceat(_mixed(h ^ np.uint64(0xA0761D6478BD642F)), ends[:-1])], axis=1)
                bits, n = PARITY_WORDS * 64, len(some)
                cell = np.repeat(np.arange(n), np.diff(ends)) * bits + (h >> np.uint64(20)).astype(np.int64) % bits
                parity = np.packbits((np.bincount(cell, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits), axis=1).view(np.uint64)
                again = batch.column(1).slice(i, j - i).take(pa.array(some))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes() for x in key], pa.binary()), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64))),
                     _lists(parity.ravel(), PARITY_WORDS), again], names=["cls", "n", "shingles", "parity", "rows"])

    return docs.mapInArrow(run, "cls binary, n long, shingles array<long>, parity array<long>, rows long")


def connected_components(edges: DataFrame, keep: Scratch, name: str) -> DataFrame:
    """(node, label) of the nodes of edges (a, b): nodes have one label if and only if a path joins them.

    Each round maps every node to the smallest of itself and its neighbours and contracts the edges; labels are
    hashes, so chains are short and the rounds grow with the logarithm of the nodes.  Rounds are written tables.
    """
    edges = keep.table(edges.where(F.col("a") != F.col("b")).distinct(), f"{name}-edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = keep.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("to")), f"{name}-hooks")
        if labels is None:
            labels = hook.select("node", F.col("to").alias("label"))
        else:
            moved = hook.withColumnsRenamed({"node": "label"})
            labels = keep.table(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), f"{name}-labels")
        a, b = (hook.select(F.col("node").alias(c), F.col("to").alias(f"{c}2")) for c in ("a", "b"))
        edges = keep.table(edges.join(a, "a").join(b, "b").where(F.col("a2") != F.col("b2")).select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct(), f"{name}-edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the threshold."""
    one = sets.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    two = sets.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    return (pairs.join(one, "a").join(two, "b").where(100 * both >= PERCENT * (F.col("n_a") + F.col("n_b") - both)).select("a", "b"))


def _alike(x: str, y: str):
    """Whether the odd sketches in columns x and y are near enough."""
    differing = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    return differing <= _most_differing_bits()


def _open_pairs(able: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes of a bucket and different labels, one at least outside the bucket's main label, that the bounds leave.

    able: bucket, size (rows of the bucket), cls, label, main, n, common (shingles that others have too), p0, p1, ... (parity bitmap).
    """
    words_of = [f"p{k}" for k in range(PARITY_WORDS)]
    dealt = able.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("cls", F.lit(5)), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    x = (dealt.where("label <> main").select("bucket", F.col("block").alias("i"), F.explode(every).alias("j"), *[F.col(c).alias(f"x_{c}") for c in ("cls", "label", "n", "common", *words_of)]))
    # a block outside the main label meets each other such block once
    y = (dealt.withColumn("in_main", F.col("label") == F.col("main"))
         .select("bucket", F.explode(F.when(F.col("in_main"), every).otherwise(F.sequence(F.lit(0), F.col("block")))).alias("i"), F.col("block").alias("j"), "in_main",
                 *[F.col(c).alias(f"y_{c}") for c in ("cls", "label", "n", "common", *words_of)]))
    most = F.least("x_common", "y_common", "x_n", "y_n")
    apart = sum((F.bit_count(F.col(f"x_{p}").bitwiseXOR(F.col(f"y_{p}"))) for p in words_of), F.lit(0))  # shingles that one has, at least
    met = (x["bucket"] == y["bucket"]) & (x["i"] == y["i"]) & (x["j"] == y["j"])
    return (x.join(y, met & (F.col("x_label") != F.col("y_label")) & (F.col("in_main") | (x["i"] < x["j"]) | (F.col("x_cls") < F.col("y_cls")))
                   & (100 * most >= PERCENT * (F.col("x_n") + F.col("y_n") - most))
                   & ((100 + PERCENT) * apart <= (100 - PERCENT) * (F.col("x_n") + F.col("y_n"))))
            .select(F.col("x_cls").alias("a"), F.col("y_cls").alias("b")).distinct())


def _components(docs: DataFrame, words: int, text: str, key: str) -> DataFrame:
    """(doc_id, digest of the text, n_shingles, component_id, first) of each row; first: whether it is its component's first document by id and digest."""
    keep = Scratch(docs.sparkSession, "near")
    plain = docs.select(F.col(key).alias("doc_id"), F.md5(F.col(text).cast("binary")).alias("digest"), F.col(text).alias("text"))
    sig = materialise(_sketched(plain, words), "near-sig")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "rows")
    texts = sig.where("cls is not null").groupBy("cls", "doc_id", "digest").agg(F.count("*").alias("rows"))  # rows that repeat id and text are one
    classes = texts.groupBy("cls").agg(F.min(rank).alias("rep"), F.sum("rows").alias("copies"))
    classes = keep.table(classes, "classes")

    # buckets of several classes; who is in many of them
    rows = sig.where("cls is not null").select("cls", F.explode("bands").alias("bucket")).distinct()
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = keep.table(rows.join(shared, "bucket"), "members")
    popular = members.groupBy("cls").agg(F.sum("size").alias("seen"))
    pivots = (members.join(popular, "cls").groupBy("bucket").agg(F.max(F.struct("seen", "cls")).getField("cls").alias("pivot")))
    pivots = keep.table(pivots, "pivots")
    sketches = sig.where("cls is not null").groupBy("cls").agg(F.first("sketch").alias("sketch")).join(popular.select("cls"), "cls", "left_semi")  # copies meet before the shuffle
    sketches = keep.table(sketches, "sketches")

    stars = members.join(pivots, "bucket").where("cls <> pivot").select(F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct()
    stars = (stars.join(sketches.select(F.col("cls").alias("a"), F.col("sketch").alias("k_a")), "a")
             .join(sketches.select(F.col("cls").alias("b"), F.col("sketch").alias("k_b")), "b").where(_alike("k_a", "k_b")).select("a", "b"))
    stars = keep.table(stars, "stars")

    # full sets of the classes that may have links: one text for each
    wanted = stars.select(F.col("a").alias("cls")).union(stars.select("b")).union(members.where("size > 2").select("cls")).distinct()
    reps = classes.join(wanted, "cls", "left_semi").select(F.col("rep.doc_id").alias("r_id"), F.col("rep.digest").alias("r_digest"), F.col("rep.rows").alias("rows"))
    texts = plain.join(reps, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest"))).select("text", "rows")
    every = keep.table(_full_sets(texts, words), "sets")
    sets = every.where("rows = 1").unionByName(every.where("rows > 1").dropDuplicates(["cls"])).drop("rows")
    links = keep.table(_linked(stars, sets).distinct(), "links")
    labels = connected_components(links, keep, "first")

    # buckets whose classes are not one component yet
    placed = (members.where("size > 2").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
              .select("bucket", "cls", F.coalesce("label", "cls").alias("label")))
    placed = keep.table(placed, "placed")
    counts = placed.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("size"), F.max(F.struct("n", "label")).getField("label").alias("main")).where("parts > 1")
    main = keep.table(main, "main")
    open_ = keep.table(placed.join(main, "bucket").drop("parts"), "open")
    people = open_.select("cls").distinct()
    alone = (sets.join(people, "cls", "left_semi").dropDuplicates(["cls"]).select("cls", F.explode("shingles").alias("s"))
             .groupBy("s").agg(F.count("*").alias("c"), F.first("cls").alias("cls")).where("c = 1").groupBy("cls").agg(F.count("*").alias("alone")))
    words_of = [f"p{k}" for k in range(PARITY_WORDS)]
    can = (sets.select("cls", "n", *[F.col("parity")[k].alias(p) for k, p in enumerate(words_of)]).distinct().join(people, "cls", "left_semi").join(alone, "cls", "left")
           .select("cls", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"), *words_of).where(100 * F.col("common") >= PERCENT * F.col("n")))
    able = keep.table(open_.join(can, "cls"), "able")
    rest = _open_pairs(able)
    more = keep.table(_linked(rest, sets).distinct(), "more")
    labels = connected_components(links.unionByName(more), keep, "last")

    found = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    smallest = found.groupBy("label").agg(F.min("rep").alias("first"), F.sum("copies").alias("all")).where(F.col("all") > 1)
    to = materialise(found.join(smallest, "label").select("cls", F.col("first.doc_id").alias("component"), F.col("first.digest").alias("first_digest")), "near-components")
    keep.drop()
    alone = F.col("first_digest").isNull()
    return sig.join(to, "cls", "left").select(
        "doc_id", "digest", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("component")) & (F.col("digest") == F.col("first_digest")))).alias("first"))


def find_components(docs: DataFrame, words: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs, the whole text counting.

    component_id is the smallest key that links reach, the row's own included; kept is whether it is the row's own.
    Null and wordless texts have no shingles and no links: component_id is their own key.  Rows with a null key link
    like others and take the component's smallest key; where nobody there has a key, kept is whether the row's text is
    the first by digest.  Extra columns of docs, whatever their names, play no part.
    """
    return _components(docs, words, text, key).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & F.col("first")).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: near-duplicate components of ``documents`` on 2-word shingles."""
    return find_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)


def stage(spark, docs: DataFrame, sf_dir: str, words: int = 5) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate component stays, that with the smallest id (null last, then the smallest digest of the text).

    A document is its id and text: other texts under an id that is dropped are judged by themselves, and rows that
    repeat id and text stay or go together.  Null and wordless texts stay.
    """
    gone = _components(docs, words, "text", "doc_id").where(~F.col("first")).select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.md5(F.col("text").cast("binary")) == F.col("gone_digest"))
    return docs.join(gone, same, "left_anti").select(*docs.columns)
