"""Ranked lexical search by a bit-sliced impact index.

The impact of a term in a document is a whole number: the term's weight times a saturated term frequency.  The index
keeps, for each term and each block of documents, the places of the documents that hold the term and their impacts as
bit slices: slice s is a bitmap with bit s of every impact.  A query's scores in a block are a sum of bit-sliced
numbers: terms are added three to two by bitwise carry-save steps on all slices at once, then by one ripple of carries.
The best k of a block are found from the most significant slice down, by keeping those that have the bit as long as
there are k of them; the blocks' best are ranked at last.

A block is a run of documents of a task, ``BLOCK_BYTES`` of text and ``BLOCK_DOCS`` documents at most (a longer text is
a block by itself), so no bitmap grows with the corpus.  Weights need every document's terms: document frequencies are
sums over blocks, joined to the blocks' terms by term, where a frequent term has a row a block and not one a document.
Queries are dealt into batches of about ``BATCH`` items; a task holds a block's rows of one batch's terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, doc_slices, materialise, ranges, utf8_view

BLOCK_BYTES = 16 << 20
BLOCK_DOCS = 1 << 16  # places fit two bytes
SLICE_BYTES = 1 << 20  # text that is cut into terms at once
BATCH = 256  # items that a task answers in a block
TOP = 20
CHUNK = 1 << 18  # postings whose slices are laid out at once

_INSIDE = np.ones(256, bool)  # bytes of terms: digits, letters, and all of other characters
for _low, _high in ((0x00, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x80)):
    _INSIDE[_low:_high] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms_of(offsets: np.ndarray, data: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(terms, codes, text): the distinct terms, and of each occurrence in order its term and its text."""
    inside = _INSIDE[data]
    before = np.append(False, inside[:-1])
    before[offsets[:-1][np.diff(offsets) > 0]] = False
    first = inside & ~before
    at = np.flatnonzero(first)
    places = np.cumsum(inside) - 1
    ends = np.append(places[at], int(inside.sum()))
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(_LOWER[data[inside]])]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), np.searchsorted(offsets, at, side="right") - 1


def term_counts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """How many terms each text has, with repeats."""
    inside = _INSIDE[data]
    before = np.append(False, inside[:-1])
    before[offsets[:-1][np.diff(offsets) > 0]] = False
    return np.diff(np.append(0, np.cumsum(inside & ~before))[offsets])


def corpus_counts(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(N, L): documents with a term at least, and all documents' terms with repeats."""

    def run(batches):
        for batch in batches:
            offsets, data = utf8_view(batch.column(0))
            for i, j in doc_slices(offsets, SLICE_BYTES):
                n = term_counts(offsets[i: j + 1] - offsets[i], data[offsets[i]: offsets[j]])
                yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["docs", "terms"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


def saturated(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What a term's weight is multiplied by: tf occurrences in a document of n terms, of a corpus of so many documents and terms."""
    m = 100 - 25 + (25 * n * docs) // max(terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weights(df, docs: int):
    """Column of the weight of terms that df documents hold."""
    return F.floor(1000 * F.log((F.lit(2.0) * docs + 2) / (2 * df + 1))).cast("long")


def postings(docs: DataFrame, n_docs: int, n_terms: int, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """A row for each block and term, and one for each block with its ids, where term is null.

    data: the places in the block of the documents that hold the term (two bytes each), then their saturated frequencies
    (four bytes each). Places follow the ids' order (null last), so that of equal scores the first place has the smallest id.
    """
    kind = docs.schema[key].dataType

    def run(batches):
        part, held, size, n, count = TaskContext.get().partitionId(), [], 0, 0, 0

        def rows():
            name = (part << 32) | count
            ids, texts = (pa.concat_arrays([x[k] for x in held]) for k in (0, 1))
            order = pc.sort_indices(ids, null_placement="at_end")
            ids, texts = ids.take(order), texts.take(order)
            offsets, data = utf8_view(texts)
            terms, codes, text_of = _spread_terms(offsets, data)
            each = np.bincount(text_of, minlength=len(ids))
            found, tf = np.unique(codes.astype(np.int64) * len(ids) + text_of, return_counts=True)
            term, place = found // max(len(ids), 1), found % max(len(ids), 1)
            value = saturated(tf.astype(np.int64), each[place], n_docs, n_terms)
            starts = np.append(np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else [], len(term)).astype(np.int64)
            per = np.diff(starts)
            names = ["block", "term", "data", "ids"]
            for i in range(0, len(per), 1 << 14):
                some = per[i: i + (1 << 14)]
                a, b = starts[i], starts[i + len(some)]
                begin = 6 * (starts[i: i + len(some)] - a)
                raw = np.empty(6 * (b - a), np.uint8)
                raw[ranges(begin, 2 * some)] = place[a:b].astype("<u2").view(np.uint8)
                raw[ranges(begin + 2 * some, 4 * some)] = value[a:b].astype("<u4").view(np.uint8)
                data_of = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(np.append(begin, len(raw)).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), name)), terms.slice(i, len(some)).cast(pa.binary()), data_of, pa.nulls(len(some), pa.list_(ids.type))], names=names)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], names=names)

        for batch in batches:
            offsets, _ = utf8_view(batch.column(1))
            for i, j in doc_slices(offsets, min(SLICE_BYTES, block_bytes)):
                for a in range(i, j, block_docs):
                    b = min(j, a + block_docs)
                    if held and (size + offsets[b] - offsets[a] > block_bytes or n + b - a > block_docs):
                        yield from rows()
                        held, size, n, count = [], 0, 0, count + 1
                    held.append((batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)))
                    size, n = size + int(offsets[b] - offsets[a]), n + b - a
        if held:
            yield from rows()

    found = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return found.mapInArrow(run, f"block long, term binary, data binary, ids array<{kind.simpleString()}>")


def _spread_terms(offsets: np.ndarray, data: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """terms_of over a whole block, slice by slice."""
    parts = [(i, terms_of(offsets[i: j + 1] - offsets[i], data[offsets[i]: offsets[j]])) for i, j in doc_slices(offsets, SLICE_BYTES)]
    if not parts:
        return pa.array([], pa.large_binary()), np.zeros(0, np.int32), np.zeros(0, np.int64)
    every = pa.concat_arrays([p[0] for _, p in parts]).dictionary_encode()
    to, at, codes = every.indices.to_numpy(), 0, []
    for _, (terms, c, _) in parts:
        codes.append(to[at: at + len(terms)][c])
        at += len(terms)
    return every.dictionary, np.concatenate(codes), np.concatenate([i + p[2] for i, p in parts])


def sliced(impacts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[bytes]]:
    """(depths, slices): impacts ends[k]:ends[k + 1] as bits, slice after slice from the lowest, depths[k] slices of a bit a posting."""
    sizes = np.diff(ends)
    most = np.maximum.reduceat(impacts, ends[:-1])
    depth = np.maximum(1, np.ceil(np.log2(most.astype(np.float64) + 1)).astype(np.int64))
    depth += (most >> depth) > 0
    width = -(-(depth * sizes) // 8) * 8  # bits of a row, whole bytes
    base = np.cumsum(width) - width
    bits = np.zeros(int(width.sum()), np.uint8)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = base[row] + np.arange(len(impacts)) - ends[:-1][row]
    for s in range(int(depth.max(initial=0))):
        bit = ((impacts >> s) & 1).astype(bool)
        bits[(at + s * sizes[row])[bit]] = 1
    raw = np.packbits(bits).tobytes()
    first, last = (base // 8).tolist(), ((base + width) // 8).tolist()
    return depth.tolist(), [raw[a:b] for a, b in zip(first, last, strict=True)]


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The written index of every term of docs: block, term, depth, slices and places, and a row with ids for each block.

    Null and empty texts, and texts without a term, hold nothing; they stay in their block and are never found.  Rows
    that repeat are documents of their own.  Columns of docs but text and key play no part.
    """
    keep = Scratch(docs.sparkSession, "impacts")
    n_docs, n_terms = corpus_counts(docs, text)
    rows = keep.table(postings(docs, n_docs, n_terms, text, key, block_bytes, block_docs), "postings")
    held = rows.where("term is not null")
    df = held.groupBy("term").agg(F.sum((F.octet_length("data") / 6).cast("long")).alias("df"))
    # hashed, not sorted: rows come as their blocks sent them, so a batch mixes frequent and rare terms
    weighed = held.join(df.hint("shuffle_hash"), "term").select("block", "term", "data", weights(F.col("df"), n_docs).alias("weight"))

    def run(batches):
        for batch in batches:
            offsets, raw = utf8_view(batch.column("data"))
            for i, j in doc_slices(offsets, 6 * CHUNK):
                part, begin = batch.slice(i, j - i), offsets[i:j]
                per = np.diff(offsets[i: j + 1]) // 6
                places, values = raw[ranges(begin, 2 * per)], raw[ranges(begin + 2 * per, 4 * per)].view("<u4")
                ends = np.concatenate([[0], np.cumsum(per)])
                depth, slices = sliced(values * np.repeat(part.column("weight").to_numpy(), per), ends)
                where = pa.Array.from_buffers(pa.binary(), len(per), [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(places)])
                yield pa.RecordBatch.from_arrays([part.column("block"), part.column("term"), pa.array(depth, pa.int32()), pa.array(slices, pa.binary()), where], names=["block", "term", "depth", "slices", "places"])

    terms = weighed.mapInArrow(run, "block long, term binary, depth int, slices binary, places binary")
    whole = terms.unionByName(rows.where("term is null").select("block", "ids"), allowMissingColumns=True)
    index = materialise(whole, "impact-index")
    keep.drop()
    return index


def dense(raw: bytes, depth: int, places: np.ndarray, size: int, times: int) -> np.ndarray:
    """Slices over a block's places (a row of bytes each) of a term's impacts, times a whole number."""
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=depth * len(places)).reshape(depth, len(places))
    wide = np.zeros((depth, size), np.uint8)
    wide[:, places] = bits
    one = np.packbits(wide, axis=1)
    parts = [np.concatenate([np.zeros((k, one.shape[1]), np.uint8), one]) for k in range(times.bit_length()) if times >> k & 1]
    return added(parts)


def added(numbers: list[np.ndarray]) -> np.ndarray:
    """The sum of bit-sliced numbers: three become two by carry-save steps, the last two meet in a ripple of carries."""
    depth = max(len(x) for x in numbers) + len(numbers).bit_length() + 1
    deep = [np.concatenate([x, np.zeros((depth - len(x), x.shape[1]), np.uint8)]) for x in numbers]
    while len(deep) > 2:
        rest = deep[len(deep) // 3 * 3:]
        for k in range(0, len(deep) // 3 * 3, 3):
            a, b, c = deep[k: k + 3]
            either = a ^ b
            carry = np.zeros_like(a)
            carry[1:] = ((a & b) | (either & c))[:-1]
            rest += [either ^ c, carry]
        deep = rest
    if len(deep) == 1:
        return deep[0]
    a, b = deep
    out, carry = np.empty_like(a), np.zeros(a.shape[1], np.uint8)
    for s in range(depth):
        either = a[s] ^ b[s]
        out[s] = either ^ carry
        carry = (a[s] & b[s]) | (either & carry)
    return out


def _population(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


def top_places(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k largest scores above 0, largest first, equal ones by place; from the highest slice down."""
    some = np.bitwise_or.reduce(scores, axis=0)
    sure, open_ = np.zeros_like(some), some
    for s in range(len(scores) - 1, -1, -1):
        have = sure | (open_ & scores[s])
        n = _population(have)
        if n >= k:
            open_ &= scores[s]
            if n == k:
                sure, open_ = have, np.zeros_like(some)
                break
        else:
            sure, open_ = have, open_ & ~scores[s]
    chosen = np.flatnonzero(np.unpackbits(sure))
    ties = np.flatnonzero(np.unpackbits(open_))[: k - len(chosen)]  # all of one score
    places = np.append(chosen, ties)
    bits = (scores[:, places // 8] >> (7 - places % 8).astype(np.uint8)) & 1
    value = (bits.astype(np.int64) << np.arange(len(scores))[:, None]).sum(axis=0)
    order = np.lexsort([places, -value])
    return places[order], value[order]


def _answers(k: int, id_type: pa.DataType):
    """Of a block's rows for a batch of items: each item's best documents there."""

    def run(table: pa.Table) -> pa.Table:
        home = table.filter(pc.is_valid(table.column("ids")))
        rows = table.filter(pc.is_valid(table.column("uses")))
        ids = home.column("ids").combine_chunks().flatten()
        size = len(ids)
        uses = rows.column("uses").combine_chunks()
        per = pc.list_value_length(uses).to_numpy()
        flat = uses.flatten()
        item, times, row = flat.field("item").to_numpy(), flat.field("times").to_numpy(), np.repeat(np.arange(len(per)), per)
        raw, depth = rows.column("slices").to_pylist(), rows.column("depth").to_numpy()
        spots = [np.frombuffer(x, "<u2") for x in rows.column("places").to_pylist()]
        order = np.argsort(item, kind="stable")
        edges = np.append(np.flatnonzero(np.append(True, np.diff(item[order]) != 0)), len(order)) if len(order) else np.zeros(1, np.int64)
        kept: dict[int, np.ndarray] = {}
        shared = np.bincount(row, minlength=len(per)) * (np.array([len(x) for x in spots], np.int64) > size // 64)  # terms of several items and many places
        out_item, out_place, out_score = [], [], []
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            numbers = []
            for u in order[i:j].tolist():
                r, t = int(row[u]), int(times[u])
                if t == 1 and r in kept:
                    numbers.append(kept[r])
                    continue
                numbers.append(dense(raw[r], int(depth[r]), spots[r], size, t))
                if t == 1 and shared[r] > 2 and len(kept) < 256:
                    kept[r] = numbers[-1]
            places, scores = top_places(added(numbers), k)
            out_item.append(np.full(len(places), item[order[i]]))
            out_place.append(places)
            out_score.append(scores)
        none = np.zeros(0, np.int64)
        place = np.concatenate([none, *out_place])
        return pa.table({"item": pa.array(np.concatenate([none, *out_item])), "id": ids.take(pa.array(place)).cast(id_type), "score": pa.array(np.concatenate([none, *out_score]))})

    return run


def _item_terms(items: DataFrame, text: str) -> DataFrame:
    """(item, term, times) of items (item, text)."""

    def run(batches):
        for batch in batches:
            offsets, data = utf8_view(batch.column(1))
            for i, j in doc_slices(offsets, SLICE_BYTES):
                terms, codes, text_of = terms_of(offsets[i: j + 1] - offsets[i], data[offsets[i]: offsets[j]])
                found, times = np.unique(text_of * max(len(terms), 1) + codes, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(i + found // max(len(terms), 1))), terms.take(pa.array(found % max(len(terms), 1))).cast(pa.binary()), pa.array(times)], names=["item", "term", "times"])

    return items.select("item", text).mapInArrow(run, "item long, term binary, times long")


def search(index: DataFrame, items: DataFrame, k: int = TOP, text: str = "text", key: str = "item_id", batch: int = BATCH) -> DataFrame:
    """(key, rank, id, score): the k highest-scoring documents of each row of items, scores above 0 only.

    Equal scores go by id (null last).  An item without terms, null and empty texts included, finds nothing.  Rows that
    repeat key and text are one item; other texts under a key are items of their own.
    """
    spark, id_type = index.sparkSession, index.schema["ids"].dataType.elementType
    # an item is named by a hash of its key and text, the hashes' equality being checked where names go back to keys
    named = items.select(F.col(key).alias("key"), F.col(text).alias("text")).distinct().withColumn("item", F.xxhash64("key", "text", F.lit(1)))
    named = materialise(named, "items")
    twice = named.groupBy("item").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError("two items have one hash: give other keys")
    batches = max(1, -(-named.count() // batch))
    wanted = _item_terms(named.withColumnRenamed("text", "said"), "said").withColumn("batch", F.pmod("item", F.lit(batches)).cast("int"))
    uses = wanted.groupBy("batch", "term").agg(F.collect_list(F.struct("item", "times")).alias("uses"))  # a batch's items at most
    hits = index.where("term is not null").join(uses, "term").select("block", "batch", "depth", "slices", "places", "uses")
    homes = index.where("term is null").select("block", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"), "ids")
    both = hits.unionByName(homes, allowMissingColumns=True)
    found = both.groupBy("block", "batch").applyInArrow(_answers(k, to_arrow_type(id_type)), f"item long, id {id_type.simpleString()}, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))).where(F.col("rank") <= k)
    return ranked.join(named.select("item", F.col("key").alias(key)), "item").select(key, F.col("rank").cast("int").alias("rank"), "id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the twenty highest-scoring documents of ``documents`` for each row of ``benchmark``."""
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("id", "doc_id")


ORACLE_SQL = r"""
WITH t AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
           FROM (SELECT *, row_number() OVER () AS r FROM documents)),
p AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
l AS (SELECT r, sum(tf)::BIGINT AS n FROM p GROUP BY r),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM l),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
s AS (SELECT item_id, r, doc_id,
             sum(times * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
      FROM i JOIN p USING (term) JOIN f USING (term) JOIN l USING (r), c GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20
"""
