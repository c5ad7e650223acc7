"""Alignment of two tokenizers' tokens of the same bytes, by byte-owner arrays.

Tokenizer A is a byte-level BPE, B a SentencePiece BPE.  Every byte of a text has an owner in A and one in B:
np.repeat writes token indices over the bytes that the tokens cover.  Along the bytes, each new pair of owners is one
overlap (a link), and each place where both owners change at once is a cut; what lies between two cuts is a group, the
smallest run of A tokens that covers the same bytes as a run of B tokens.

A task works on blocks of documents, about ``BLOCK_BYTES`` of text each.  A block's distinct pairs of ids with their
counts are one row a pair; corpus-wide counts are sums over blocks, and each block gets the counts of its own pairs back.
So what is shuffled is a row for each pair of a block, twice, never a row for each link.  The highest count of each B id
is broadcast: B's vocabulary bounds it (a model of 32,000 pieces: 32,000 rows of two numbers).
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, doc_slices, materialise, ranges, utf8_view
from .piece_bpe import default_model, vocabulary

BLOCK_BYTES = 8 << 20  # text of a block, but for a single longer text
SLICE_BYTES = 1 << 19  # text that is aligned at once, likewise
MAX_ID = 1 << 20  # ids of either tokenizer are below


def byte_of_char() -> dict[str, int]:
    """The bytes that a byte-level vocabulary's characters stand for: printable ones themselves, the others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteVocabulary:
    """A byte-level BPE of a tokenizers JSON file: the bytes of each id, and its encoder without special tokens.

    The file's ids are in the order of its merges, so they are the ranks by which the encoder merges; that and the
    file's pattern are held against the tokenizers library by the tests.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: what "ByteLevel" with use_regex cuts by

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        special = {x["id"] for x in told.get("added_tokens", [])}
        to_byte = byte_of_char()
        entries = {i: bytes(to_byte[c] for c in s) for s, i in told["model"]["vocab"].items() if i not in special}
        self.encoder = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks={b: i for i, b in entries.items()}, special_tokens={})
        n = max(entries) + 1
        self.blob_len = np.array([len(entries.get(i, b"")) for i in range(n)], np.int64)
        self.blob_at = np.cumsum(self.blob_len) - self.blob_len
        self.blob = np.frombuffer(b"".join(entries.get(i, b"") for i in range(n)), np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts; text k has ids[ends[k]:ends[k + 1]]."""
        found = [np.array(x, np.int32) for x in self.encoder.encode_ordinary_batch(texts, num_threads=1)]
        return np.concatenate([np.zeros(0, np.int32), *found]), np.cumsum([0, *map(len, found)])


@lru_cache(maxsize=1)
def byte_vocabulary(path: str) -> ByteVocabulary:
    """One vocabulary for each Python worker."""
    return ByteVocabulary(path)


@lru_cache(maxsize=1)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(blob, starts, sizes) of the decimal digits and a comma of each id below n."""
    each = [b"%d," % i for i in range(n)]
    sizes = np.array([len(x) for x in each], np.int64)
    return np.frombuffer(b"".join(each), np.uint8), np.cumsum(sizes) - sizes, sizes


def owners(sizes: np.ndarray) -> np.ndarray:
    """The index of the token that owns each byte, tokens being of so many bytes."""
    return np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


def links_and_cuts(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cut): token indices of each overlap in byte order, and whether both owners change where it starts.

    Both lists of token sizes cover the same bytes; the first overlap counts as a cut.
    """
    one, two = owners(size_a), owners(size_b)
    new_a, new_b = np.append(True, one[1:] != one[:-1]), np.append(True, two[1:] != two[:-1])
    at = np.flatnonzero(new_a | new_b)
    return one[at], two[at], (new_a & new_b)[at]


def _same_bytes(v, ids: np.ndarray, ends: np.ndarray, want: np.ndarray, want_at: np.ndarray) -> np.ndarray:
    """Whether the joined token bytes of each text equal want[want_at[k]:want_at[k + 1]]."""
    blob, at, size = v.blob, v.blob_at, v.blob_len
    total = np.concatenate([[0], np.cumsum(size[ids])])
    same = np.diff(total[ends]) == np.diff(want_at)
    hit = np.flatnonzero(same & (np.diff(want_at) > 0))
    if len(hit):
        tokens = ids[ranges(ends[hit], ends[hit + 1] - ends[hit])]
        sizes = np.diff(want_at)[hit]
        differ = blob[ranges(at[tokens], size[tokens])] != want[ranges(want_at[hit], sizes)]
        same[hit] = ~np.logical_or.reduceat(differ, np.cumsum(sizes) - sizes)
    return same


def align_texts(texts: pa.Array, a: ByteVocabulary, b) -> dict[str, np.ndarray | list]:
    """n_a, n_b, n_groups, n_links of each text, groups (text) of each, and all links' ids (link_a, link_b) in order.

    A text that is null or empty, or whose tokens' bytes aren't those of a space and the text, has no tokens.
    """
    n = len(texts)
    offsets, data = utf8_view(texts)
    filled = np.diff(offsets) > 0
    some = np.flatnonzero(filled)
    plain = texts.take(pa.array(some)).to_pylist()
    ids_a, ends_a = a.encode([" " + t for t in plain])
    ids_b, ends_b = b.encode(pa.array(plain, pa.string()))
    want_at = np.concatenate([[0], np.cumsum(np.diff(offsets)[some] + 1)])
    want = np.full(want_at[-1], 32, np.uint8)
    inner = np.ones(len(want), bool)
    inner[want_at[:-1]] = False
    want[inner] = data[offsets[0]: offsets[-1]]  # what isn't filled has no bytes
    good = _same_bytes(a, ids_a, ends_a, want, want_at) & _same_bytes(b, ids_b, ends_b, want, want_at)
    n_a, n_b = np.diff(ends_a) * good, np.diff(ends_b) * good
    ids_a, ids_b = ids_a[np.repeat(good, np.diff(ends_a))], ids_b[np.repeat(good, np.diff(ends_b))]
    out = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")} | {"groups": [""] * n, "link_a": ids_a[:0], "link_b": ids_b[:0]}
    out["n_a"][some], out["n_b"][some] = n_a, n_b
    if not len(ids_a):
        return out
    at_a, at_b, cut = links_and_cuts(a.blob_len[ids_a], b.blob_len[ids_b])
    text_of_a = np.repeat(np.arange(len(some)), n_a)
    out["n_links"][some] = np.bincount(text_of_a[at_a], minlength=len(some))
    out["n_groups"][some] = np.bincount(text_of_a[at_a[cut]], minlength=len(some))
    out["link_a"], out["link_b"] = ids_a[at_a], ids_b[at_b]

    # groups as text: each group's A ids, then its B ids
    group = np.cumsum(cut) - 1
    group_a, group_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    group_a[at_a], group_b[at_b] = group, group  # all links of a token are in one group
    per_a, per_b = np.bincount(group_a), np.bincount(group_b)
    place_a = np.arange(len(ids_a)) + (np.cumsum(per_b) - per_b)[group_a]
    place_b = np.arange(len(ids_b)) + np.cumsum(per_a)[group_b]
    token, mark = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
    token[place_a], token[place_b] = ids_a, ids_b
    mark[place_a[np.append(group_a[1:] != group_a[:-1], True)]] = ord("|")
    mark[place_b[np.append(group_b[1:] != group_b[:-1], True)]] = ord(";")
    blob, at, size = _decimals(max(len(a.blob_len), len(b.blob_len)))
    ends = np.cumsum(size[token])
    said = blob[ranges(at[token], size[token])]
    said[ends - 1] = mark
    said, last = said.tobytes().decode("ascii"), np.cumsum(n_a + n_b)
    stop = np.where(n_a > 0, np.append(0, ends)[last], 0)
    start = np.append(0, ends)[last - n_a - n_b]
    for k, i, j, g in zip(some.tolist(), start.tolist(), stop.tolist(), good.tolist(), strict=True):
        if g:
            out["groups"][k] = said[i: j - 1]
    return out


def align(docs: DataFrame, a_file: str, b_file: str, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Aligned documents and the pairs of their blocks, as rows of two kinds.

    A document's row: block, key, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``) and codes, the links' pairs
    in byte order as indices into the block's pairs.  A block's row: block and pairs, array of (a, b, n), n counting
    links of the block; the other columns are null there.  Files are read by each worker, so they must be there on
    every executor.  A text that is null or empty, or whose tokens don't restore it, has zeros, no codes and empty groups.
    """
    kind = docs.schema[key].dataType
    schema = f"block long, id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups string, codes array<int>, pairs array<struct<a:int,b:int,n:long>>"

    def run(batches):
        a, b = byte_vocabulary(a_file), vocabulary(b_file)
        part, held, size, count = TaskContext.get().partitionId(), [], 0, 0
        names = ["block", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "codes", "pairs"]
        pair_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))

        def block_rows():
            keys = np.concatenate([(x["link_a"].astype(np.int64) << 20) | x["link_b"] for _, x in held])
            pairs, codes, n = np.unique(keys, return_inverse=True, return_counts=True)
            name, at = (part << 32) | count, 0
            for ids, x in held:
                ends = at + np.concatenate([[0], np.cumsum(x["n_links"])])
                mine = pa.ListArray.from_arrays(pa.array(ends - at, pa.int32()), pa.array(codes[at: ends[-1]].astype(np.int32)))
                at = int(ends[-1])
                rows = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows, name)), ids, *[pa.array(x[k]) for k in ("n_a", "n_b", "n_groups", "n_links")], pa.array(x["groups"], pa.string()), mine, pa.nulls(rows, pair_type)],
                    names=names)
            items = pa.StructArray.from_arrays([pa.array((pairs >> 20).astype(np.int32)), pa.array((pairs & (MAX_ID - 1)).astype(np.int32)), pa.array(n.astype(np.int64))], names=["a", "b", "n"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.nulls(1, held[0][0].type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())),
                 pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), items)], names=names)

        for batch in batches:
            offsets, _ = utf8_view(batch.column(1))
            for i, j in doc_slices(offsets, min(SLICE_BYTES, block_bytes)):
                if held and size + offsets[j] - offsets[i] > block_bytes:
                    yield from block_rows()
                    held, size, count = [], 0, count + 1
                held.append((batch.column(0).slice(i, j - i), align_texts(batch.column(1).slice(i, j - i), a, b)))
                size += int(offsets[j] - offsets[i])
        if held:
            yield from block_rows()

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _with_counts(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a block with n_best and count_sum; right: code, total and best of the block's pairs."""
    n = right.num_rows
    total, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n:  # else no document of the block has links
        code = right.column("code").to_numpy()
        total[code], best[code] = right.column("total").to_numpy(), right.column("best").to_numpy()
    codes = left.column("codes")
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(codes).to_numpy())])
    mine = pc.list_flatten(codes).to_numpy()
    sums = [np.concatenate([[0], np.cumsum(x[mine])]) for x in (best, total)]
    return left.drop_columns(["block", "codes"]).append_column("n_best", pa.array(np.diff(sums[0][ends]))).append_column("count_sum", pa.array(np.diff(sums[1][ends])))


def link_counts(aligned: DataFrame, columns: list[str]) -> DataFrame:
    """Documents of ``align`` (a written table): columns, n_best and count_sum, counts being over all of its documents."""
    keep = Scratch(aligned.sparkSession, "links")
    pairs = aligned.where("pairs is not null").select("block", F.posexplode("pairs").alias("code", "p")).select("block", "code", "p.*")
    counts = keep.table(pairs.groupBy("a", "b").agg(F.sum("n").alias("total")), "counts")
    highest = counts.groupBy("b").agg(F.max("total").alias("most"))  # a row for each B id at most
    counts = counts.join(F.broadcast(highest), "b").select("a", "b", "total", (F.col("total") == F.col("most")).alias("best"))
    back = pairs.join(counts, ["a", "b"]).select(F.col("block").alias("home"), "code", "total", "best")
    rows = aligned.where("pairs is null").select("block", "codes", *columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in columns)
    return rows.groupBy("block").cogroup(back.groupBy("home")).applyInArrow(_with_counts, f"{schema}, n_best long, count_sum long")


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), default_model()


def query(spark, sf_dir: str) -> DataFrame:
    """op12: tokens of two vocabularies aligned over every document of ``documents``, as counts and a digest of the groups.

    Repeated rows are documents of their own, a null doc_id stays null; a document without tokens has zeros and ''.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = align(docs, *default_files())
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).when(F.col("pairs").isNull(), "").alias("groups_sha256")
    stored = materialise(found.select("block", F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", digest, "codes", "pairs"), "aligned")
    return link_counts(stored, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
