"""Removal of word passages that other documents have too, by super-k-mer partitioning.

A window is ``words`` consecutive words of a document.  The minimiser of a window is the smallest, by a fixed order, of
its grams of ``GRAM`` words; consecutive windows that share it travel together, as one packed string of their words (a
super-k-mer), to the bucket that the minimiser names.  So equal windows meet in one bucket, and the shuffle carries some
three words for each word of the corpus where windows by themselves would carry thirteen.  In its bucket, windows are
expanded and sorted; equal neighbours are compared word by word, so counting is exact.  A bucket tells each block of
documents which windows also start in a document with a smaller id than some of the block's.

Copies and common grams:

* A block (``BLOCK_BYTES`` of text, but for a single longer document) sends each distinct super-k-mer once, with its
  smallest and largest document id.  A passage that a third of all documents hold is one entry a block.
* Grams that make up more than a ``HOT``-th of all grams come last in the order; there are at most twice ``HOT`` of them,
  which bounds what is collected and sent to tasks.  Windows of such grams only go to a bucket by their whole words,
  each by itself.  So no bucket collects the corpus's windows of a common phrase.

The number of buckets follows the text's size, ``BUCKET_BYTES`` of packed strings each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_slices, materialise, ranges, utf8_view, word_hashes

WORDS = 13
GRAM = 2
HOT = 4096
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
HASH_BYTES = 1 << 20  # text whose words are hashed, or strings that are gathered, at once
RUN = 64  # windows of a super-k-mer, at most
LAST = np.iinfo(np.int64).max  # stands for a null id: larger than every id

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_TOP = np.uint64(1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed_words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, counts): all texts' words, each followed by one space, and the number of words of each text."""
    inside = ~_SPACE[data]
    before = np.append(False, inside[:-1])
    before[offsets[:-1][np.diff(offsets) > 0]] = False
    first = inside & ~before
    word = np.cumsum(first)
    out = np.full(int(inside.sum()) + (int(word[-1]) if len(word) else 0), 32, np.uint8)
    out[np.cumsum(inside)[inside] - 1 + word[inside] - 1] = data[inside]
    at = np.append(0, word)[offsets]
    return out, np.diff(at)


def word_spans(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of packed bytes; an end is the place of the word's space."""
    ends = np.flatnonzero(packed == 32)
    return np.append(0, ends[:-1] + 1)[: len(ends)], ends


def gram_hashes(packed: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the gram of words that begins at each word; the last few lack words and are of no use."""
    word = np.empty(len(starts), np.uint64)
    for i, j in doc_slices(np.append(starts, len(packed)), HASH_BYTES):
        at = starts[i]
        word[i:j] = word_hashes(packed[at: ends[j - 1]], starts[i:j] - at, ends[i:j] - at)[0]
    word = _mixed(word)
    gram = np.zeros(len(word), np.uint64)
    for k in range(GRAM):
        gram = _mixed(gram * np.uint64(0x9E3779B97F4A7C15) + np.append(word[k:], np.zeros(min(k, len(word)), np.uint64)))
    return gram


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each value and the width - 1 next ones (fewer at the end), by doubling."""
    have, low = 1, values
    while have < width:
        step = min(have, width - have)
        low = np.append(np.minimum(low[:-step], low[step:]), low[-step:]) if step < len(low) else low
        have += step
    return low


def super_kmers(packed: np.ndarray, counts: np.ndarray, hot: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, ...]:
    """(first, windows, doc, key) of each super-k-mer: its first word, how many windows, its document, its minimiser's hash.

    hot: sorted hashes of the grams that come last.  A window of hot grams only is by itself, keyed by all of its words.
    """
    starts, ends = word_spans(packed)
    n = np.maximum(counts - words + 1, 0)
    doc = np.repeat(np.arange(len(counts)), n)
    if not len(doc):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    at = ranges((np.cumsum(counts) - counts)[n > 0], n[n > 0])
    gram = gram_hashes(packed, starts, ends)
    order = gram & ~_TOP
    if len(hot):
        place = np.minimum(np.searchsorted(hot, order), len(hot) - 1)
        order = np.where(hot[place] == order, order | _TOP, order)
    low = _smallest(order, words - GRAM + 1)[at]
    alone = low >= _TOP
    if alone.any():
        whole = np.zeros(int(alone.sum()), np.uint64)
        for k in range(0, words - GRAM + 1):
            whole = _mixed(whole * np.uint64(0x9E3779B97F4A7C15) + gram[at[alone] + k])
        low[alone] = whole
    fresh = np.append(True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | alone[1:] | alone[:-1])
    since = np.arange(len(low)) - np.maximum.accumulate(np.where(fresh, np.arange(len(low)), 0))
    heads = np.flatnonzero(fresh | (since % RUN == 0))
    return at[heads], np.diff(np.append(heads, len(low))), doc[heads], _mixed(low[heads])


def distinct_strings(packed: np.ndarray, first: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(codes, strings): the packed strings of so many words from first on, without repetition, in order of appearance."""
    starts, ends = word_spans(packed)
    a, b = starts[first], ends[first + n_words - 1] + 1
    at = np.concatenate([[0], np.cumsum(b - a)])
    raw = np.empty(at[-1], np.uint8)
    for i, j in doc_slices(at, HASH_BYTES):
        raw[at[i]: at[j]] = packed[ranges(a[i:j], b[i:j] - a[i:j])]
    found = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(raw)]).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def _pressed(x: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=3).compress(pa.py_buffer(np.ascontiguousarray(x)), asbytes=True)


def _unpressed(x: bytes, size: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, decompressed_size=size * np.dtype(kind).itemsize, codec="zstd"), kind)


def blocks(docs: DataFrame, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, ids, counts (of words), size and packed (words, compressed) of each block of documents."""

    def run(batches):
        part, held, size, count = TaskContext.get().partitionId(), [], 0, 0

        def row():
            packed = np.concatenate([x[1] for x in held])
            ids, counts = pa.concat_arrays([x[0] for x in held]), np.concatenate([x[2] for x in held])
            whole = pa.array([0, len(ids)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) | count]), pa.ListArray.from_arrays(whole, ids), pa.ListArray.from_arrays(whole, pa.array(counts)),
                                               pa.array([len(packed)]), pa.array([_pressed(packed)], pa.binary())], names=["block", "ids", "counts", "size", "packed"])

        for batch in batches:
            offsets, data = utf8_view(batch.column(1))
            for i, j in doc_slices(offsets, min(HASH_BYTES, block_bytes)):
                if held and size + offsets[j] - offsets[i] > block_bytes:
                    yield row()
                    held, size, count = [], 0, count + 1
                held.append((batch.column(0).slice(i, j - i), *packed_words(offsets[i: j + 1] - offsets[i], data[offsets[i]: offsets[j]])))
                size += int(offsets[j] - offsets[i])
        if held:
            yield row()

    found = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return found.mapInArrow(run, "block long, ids array<long>, counts array<long>, size long, packed binary")


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed words, counts, ids with LAST for null) of a block's row."""
    return (_unpressed(row["packed"], row["size"], np.uint8), np.array(row["counts"], np.int64), np.array([LAST if i is None else i for i in row["ids"]], np.int64))


def hot_grams(stored: DataFrame, hot: int = HOT) -> np.ndarray:
    """Sorted hashes of grams, every one above a hot-th of all grams among them, twice hot at most.

    A block names the grams that are above half that share in it, and they stay if what is named adds up to half that
    share of all: a gram above the share loses less than half of it where it isn't named.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                packed, counts, _ = _opened(row)
                gram = gram_hashes(packed, *word_spans(packed)) & ~_TOP
                left = np.arange(len(gram)) + GRAM <= np.repeat(np.cumsum(counts), counts)
                grams, n = np.unique(gram[left], return_counts=True)
                some = n * 2 * hot >= left.sum()
                yield pa.RecordBatch.from_arrays([pa.array(np.append(grams[some].view(np.int64), 0)), pa.array(np.append(n[some], int(left.sum()))), pa.array(np.append(np.zeros(int(some.sum()), bool), True))],
                                                 names=["gram", "n", "whole"])

    found = stored.mapInArrow(run, "gram long, n long, whole boolean")
    sums = found.groupBy("whole", "gram").agg(F.sum("n").alias("n"))
    total = sums.where("whole").agg(F.sum("n")).first()[0] or 0
    named = sums.where(~F.col("whole") & (F.col("n") * (2 * hot) >= total)).select("gram").toArrow()  # twice hot at most
    return np.sort(named.column("gram").to_numpy()).view(np.uint64)


def _sent(stored: DataFrame, hot: np.ndarray, buckets: int, words: int) -> DataFrame:
    """Each block's distinct super-k-mers, a row for each bucket that it reaches."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                packed, counts, ids = _opened(row)
                first, windows, doc, key = super_kmers(packed, counts, hot, words)
                if not len(first):
                    continue
                codes, strings = distinct_strings(packed, first, windows + words - 1)
                n = len(strings)
                lo, hi, one = np.full(n, LAST), np.full(n, np.iinfo(np.int64).min), np.zeros(n, np.int64)
                np.minimum.at(lo, codes, ids[doc])
                np.maximum.at(hi, codes, ids[doc])
                one[codes] = np.arange(len(codes))  # an occurrence of each
                bucket = (key[one] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.append(np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)), n)
                for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    mine = order[i:j]
                    texts = strings.take(pa.array(mine))
                    offsets, raw = utf8_view(texts)
                    size = int(offsets[-1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(bucket[mine[0]])]), pa.array([row["block"]]), pa.array([len(mine)]), pa.array([size]),
                         *[pa.array([_pressed(x)], pa.binary()) for x in (raw, np.diff(mine, prepend=0).astype(np.int32), windows[one[mine]].astype(np.uint8), lo[mine], hi[mine] - lo[mine])]],
                        names=["bucket", "block", "n", "size", "strings", "steps", "windows", "lo", "span"])

    return stored.mapInArrow(run, "bucket long, block long, n long, size long, strings binary, steps binary, windows binary, lo binary, span binary")


def equal_windows(codes: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, fresh): windows sorted so that equal ones are neighbours, and whether each differs from the one before it.

    A window is the codes at[k] to at[k] + words - 1.  Sorting is by a hash; neighbours of one hash are compared code by
    code, and should any differ, all are sorted by their codes.
    """
    hashed = np.zeros(len(at), np.uint64)
    spread = _mixed(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for k in range(words):
        hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + spread[at + k]
    order = np.argsort(hashed)
    alike = np.flatnonzero(hashed[order][1:] == hashed[order][:-1])
    one, two, same = at[order[alike]], at[order[alike + 1]], np.ones(len(alike), bool)
    for k in range(words):
        same &= codes[one + k] == codes[two + k]
    if not same.all():
        order = np.lexsort([codes[at + k] for k in range(words)])
        fresh = np.zeros(len(at), bool)
        for k in range(words):
            fresh[1:] |= codes[at[order[1:]] + k] != codes[at[order[:-1]] + k]
    else:
        fresh = np.ones(len(at), bool)
        fresh[alike + 1] = False
    fresh[:1] = True
    return order, fresh


def _repeated(words: int):
    """Of a bucket's super-k-mers: for each block, runs of windows that also start in a document smaller than one of the block's."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        raw = np.concatenate([_unpressed(r["strings"], r["size"], np.uint8) for r in rows])
        windows, lo, span = (np.concatenate([_unpressed(r[c], r["n"], t) for r in rows]) for c, t in (("windows", np.uint8), ("lo", np.int64), ("span", np.int64)))
        which, hi = np.concatenate([np.cumsum(_unpressed(r["steps"], r["n"], np.int32), dtype=np.int32) for r in rows]), lo + span
        home, windows = np.repeat(np.arange(len(rows)), [r["n"] for r in rows]), windows.astype(np.int64)
        ends = np.flatnonzero(raw == 32) + 1
        codes = (pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(raw)])
                 .dictionary_encode().indices.to_numpy())
        n_words = windows + words - 1
        whose = np.repeat(np.arange(len(windows)), windows)
        at = ranges(np.cumsum(n_words) - n_words, windows)
        order, fresh = equal_windows(codes, at, words)
        group = np.empty(len(at), np.int64)
        group[order] = np.cumsum(fresh) - 1
        least = np.minimum.reduceat(lo[whose[order]], np.flatnonzero(fresh))[group]
        hit = np.flatnonzero(least < hi[whose])
        out = {"block": [], "n": [], "which": [], "offset": [], "length": [], "least": []}
        if len(hit):
            mine, off, low = whose[hit], (at - (np.cumsum(n_words) - n_words)[whose])[hit], least[hit]
            heads = np.flatnonzero(np.append(True, (mine[1:] != mine[:-1]) | (np.diff(off) != 1) | (low[1:] != low[:-1])))
            length = np.diff(np.append(heads, len(hit)))
            block = home[mine[heads]]
            edges = np.append(np.flatnonzero(np.append(True, np.diff(block) != 0)), len(heads))
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                h = heads[i:j]
                out["block"].append(rows[block[i]]["block"])
                out["n"].append(j - i)
                for name, x in (("which", which[mine[h]]), ("offset", off[h].astype(np.uint8)), ("length", length[i:j].astype(np.uint8)), ("least", low[h])):
                    out[name].append(_pressed(x))
        return pa.table({k: pa.array(v, pa.int64() if k in ("block", "n") else pa.binary()) for k, v in out.items()})

    return run


def _cleaned(hot: np.ndarray, words: int):
    """A block's documents without the words that repeated windows cover."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            packed, counts, ids = _opened(row)
            starts, ends = word_spans(packed)
            change = np.zeros(len(starts) + 1, np.int64)
            if right.num_rows:
                first, windows, doc, _ = super_kmers(packed, counts, hot, words)
                codes, strings = distinct_strings(packed, first, windows + words - 1)
                order = np.argsort(codes, kind="stable")
                per = np.bincount(codes, minlength=len(strings))
                begin = np.cumsum(per) - per
                for hits in right.to_pylist():
                    which, off, length, least = (_unpressed(hits[c], hits["n"], t) for c, t in (("which", np.int32), ("offset", np.uint8), ("length", np.uint8), ("least", np.int64)))
                    hit = np.repeat(np.arange(len(which)), per[which])
                    where = order[ranges(begin[which], per[which])]
                    later = least[hit] < ids[doc[where]]
                    hit, where = hit[later], where[later]
                    a = first[where] + off[hit]
                    change += np.bincount(a, minlength=len(change)) - np.bincount(a + length[hit] + (words - 1), minlength=len(change))
            gone = np.cumsum(change)[:-1] > 0
            edge = np.concatenate([[0], np.cumsum(counts)])
            lost = np.concatenate([[0], np.cumsum(gone)])[edge]
            n_removed = np.diff(lost)
            # the words that stay, one space between them
            sizes = np.where(gone, 0, ends - starts + 1)
            keep = np.repeat(~gone, ends - starts + 1)
            at = np.concatenate([[0], np.cumsum(sizes)])[edge]
            kept = packed[keep]
            some = np.diff(at) > 0
            inner = np.ones(len(kept), bool)
            inner[at[1:][some] - 1] = False
            kept, at = kept[inner], at - np.concatenate([[0], np.cumsum(some)])
            texts = pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(kept)]).cast(pa.string())
            out.append(pa.table({"id": pa.array(row["ids"], pa.int64()), "n_words": pa.array(counts), "n_removed": pa.array(n_removed), "kept": texts}))
        return pa.concat_tables(out) if out else pa.table({"id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})

    return run


def remove_repeats(docs: DataFrame, words: int = WORDS, text: str = "text", key: str = "doc_id", hot: int = HOT, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, n_words, n_removed, kept) of each row of docs: the words that stay, joined by one space.

    A word goes if a window that covers it also starts in a document with a smaller id; the first document with a passage
    keeps it, and so do all rows that repeat that id.  key: a whole number.  A null id counts as larger than every other.
    Null, empty and short texts (fewer than words words) have no windows and keep what they have.
    """
    stored = materialise(blocks(docs, text, key, block_bytes), "passages")
    size = stored.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-3 * size // bucket_bytes))
    last = hot_grams(stored, hot)
    found = _sent(stored, last, buckets, words).groupBy("bucket").applyInArrow(_repeated(words), "block long, n long, which binary, offset binary, length binary, least binary")
    hits = found.select(F.col("block").alias("home"), "n", "which", "offset", "length", "least")
    return stored.groupBy("block").cogroup(hits.groupBy("home")).applyInArrow(_cleaned(last, words), "id long, n_words long, n_removed long, kept string")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: ``documents`` without the 13-word passages that a document with a smaller id has, as counts and a digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: Windows as texts, the smallest document of each; a word goes if a window with a smaller one covers it.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT r, id, s, array_to_string(w[s : s + 12], ' ') AS words FROM (SELECT *, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
f AS (SELECT r, s FROM (SELECT *, min(id) OVER (PARTITION BY words) AS first FROM v) WHERE first < id),
c AS (SELECT DISTINCT r, s + k AS i, true AS gone FROM f, (SELECT unnest(range(0, 13)) AS k)),
p AS (SELECT r, w[i] AS word, i FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
k AS (SELECT r, count(gone) AS lost, string_agg(word, ' ' ORDER BY i) FILTER (gone IS NULL) AS kept FROM p LEFT JOIN c USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
