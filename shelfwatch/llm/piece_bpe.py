"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut into words at places that no vocabulary piece spans (before a run of spaces, around line feeds where
no piece holds one), so words merge independently.  The distinct words of a batch are laid out in flat numpy symbol
arrays; each round finds the minimum pair rank of every word (a segmented minimum), merges its leftmost occurrences at
the same time in all words, and compacts the arrays, until no pair remains.  Several occurrences in one word are merged
in one round only up to the first merge that makes a pair of the same or a better rank, for there the one-at-a-time
order of the library would turn off; so the ids equal the library's for every text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_slices, ranges, schema_with, utf8_view, with_columns_replaced, word_hashes

SPACE = "▁"
OUT_BYTES = 1 << 19  # text of an output batch, but for a single longer text
NO_RANK = np.int32(2**31 - 1)
CHAR = 1 << 20  # symbols from here on are code points without a piece of their own


class PieceVocabulary:
    """The pieces of a SentencePiece BPE model as arrays: char symbols and the ranks and results of pairs."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        pieces = {sp.id_to_piece(i): i for i in range(n) if not special[i]}
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        scores = sorted({sp.get_score(i) for i in pieces.values()}, reverse=True)
        rank_of_score = {s: k for k, s in enumerate(scores)}
        self.char_symbol = np.arange(0x110000, dtype=np.int32) + CHAR

        def symbol(s: str) -> int | None:
            return pieces.get(s, CHAR + ord(s) if len(s) == 1 else None)

        keys, ranks, merged = [], [], []
        for s, i in pieces.items():
            if len(s) == 1:
                self.char_symbol[ord(s)] = i
            for k in range(1, len(s)):
                a, b = symbol(s[:k]), symbol(s[k:])
                if a is not None and b is not None:
                    keys.append((a << 22) | b)
                    ranks.append(rank_of_score[sp.get_score(i)])
                    merged.append(i)
        # open addressing with linear probing: the slot of a pair is found in one or two gathers
        self.bits = max(10, int(np.ceil(np.log2(len(keys) * 8 + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NO_RANK, np.int32)
        self.merged = np.zeros(1 << self.bits, np.int32)
        slots = self._slots(np.array(keys, np.int64)).tolist()
        for k, r, m, at in zip(keys, ranks, merged, slots, strict=True):
            while self.keys[at] != -1:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.ranks[at], self.merged[at] = k, r, m
        # decoding: the bytes of each id; a piece's space mark is a space
        blobs = [b"" if special[i] else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_ids.tolist()):
            blobs[i] = bytes([b])
        self.plain = np.array([bool(x) for x in blobs])
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.blob_len = np.array([len(x) for x in blobs], np.int64)
        self.blob_at = np.cumsum(self.blob_len) - self.blob_len
        self.marked = np.array([not special[i] and sp.id_to_piece(i).startswith(SPACE) for i in range(n)])
        self.cut_spaces = not any(a != SPACE and b == SPACE for s in pieces for a, b in zip(s, s[1:], strict=False))
        self.cut_lines = not any("\n" in s for s in pieces)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NO_RANK if they don't merge) and result of each pair of symbols."""
        k = (a.astype(np.int64) << 22) | b
        at = self._slots(k)
        found = self.keys[at]
        on = np.flatnonzero((found != k) & (found != -1))
        while len(on):
            at[on] = (at[on] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[on]]
            on = on[(found != k[on]) & (found != -1)]
        return self.ranks[at], self.merged[at]

    def merge_words(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words given as code points, sizes[k] > 0 of them for word k."""
        sym, words, sizes = self.char_symbol[points], np.arange(len(sizes)), sizes.copy()
        ends = np.cumsum(sizes)
        rank = np.full(len(sym), NO_RANK, np.int32)
        if len(sym) > 1:
            rank[:-1] = self.pairs(sym[:-1], sym[1:])[0]
            rank[ends - 1] = NO_RANK
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(rank, starts)
            at = np.flatnonzero((rank == np.repeat(best, sizes)) & (rank != NO_RANK))
            keep = np.repeat(best != NO_RANK, sizes)
            over = best == NO_RANK
            if over.any():
                done.append((sym[~keep], words[over], sizes[over]))
            if len(at):
                w = np.searchsorted(starts, at, side="right") - 1
                # leftmost of overlapping occurrences: every second one of a run
                run = np.append(True, (np.diff(at) > 1) | (w[1:] != w[:-1]))
                if not run.all():
                    order = np.arange(len(at))
                    take = (order - np.maximum.accumulate(np.where(run, order, 0))) % 2 == 0
                    at, w = at[take], w[take]
                new, r = self.pairs(sym[at], sym[at + 1])[1], best[w]
                # would this merge make a pair of the same or a better rank?
                prev_merged = np.append(False, (np.diff(at) == 2) & (w[1:] == w[:-1]))
                left = np.where(prev_merged, np.append(0, new[:-1]), sym[np.maximum(at - 1, 0)])
                nxt = np.minimum(at + 2, len(sym) - 1)
                left_rank = np.where(at > starts[w], self.pairs(left, new)[0], NO_RANK)
                right_rank = np.where(at + 2 < starts[w] + sizes[w], self.pairs(new, sym[nxt])[0], NO_RANK)
                turns = (left_rank <= r) | (right_rank <= r)
                if turns.any():
                    so_far = np.cumsum(turns) - turns  # turns before this merge
                    ok = so_far == np.maximum.accumulate(np.where(np.append(True, w[1:] != w[:-1]), so_far, 0))
                    at, new, w, left_rank, right_rank = at[ok], new[ok], w[ok], left_rank[ok], right_rank[ok]
                # the pair of a merged symbol with its right neighbour, merged or not, is ranked last
                sym[at] = new
                rank[at] = right_rank
                ahead = at > starts[w]
                rank[at[ahead] - 1] = left_rank[ahead]
                beside = np.flatnonzero((np.diff(at) == 2) & (w[1:] == w[:-1]))
                rank[at[beside]] = self.pairs(new[beside], new[beside + 1])[0]
                keep[at + 1] = False
                sizes = sizes - np.bincount(w, minlength=len(sizes))
            left_over = np.flatnonzero(keep)
            sym, rank = sym[left_over], rank[left_over]
            words, sizes = words[~over], sizes[~over]
        ids, words, sizes = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(words, kind="stable")
        starts = np.cumsum(sizes) - sizes
        ids, sizes = ids[ranges(starts[order], sizes[order])], sizes[order]
        if (ids >= CHAR).any():  # characters without a piece become bytes
            odd = ids >= CHAR
            points = (ids[odd] - CHAR).astype(np.uint32)
            width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            out_size = np.ones(len(ids), np.int64)
            out_size[odd] = width
            out = np.repeat(ids, out_size)
            raw = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            out[np.repeat(odd, out_size)] = self.byte_ids[raw]
            sizes = np.add.reduceat(out_size, np.cumsum(sizes) - sizes)
            ids = out
        return ids.astype(np.int32), sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts, without begin or end ids; text k has ids[ends[k]:ends[k + 1]]."""
        offsets, data = utf8_view(texts)
        if b"\xe2\x96\x81" in data.tobytes():  # the space mark itself is a space
            plain = [(t or "").replace(SPACE, " ").encode() for t in texts.to_pylist()]
            offsets = np.cumsum([0, *map(len, plain)])
            data = np.frombuffer(b"".join(plain), np.uint8)
        filled = np.diff(offsets) > 0
        # one space first in each text that isn't empty
        first = (offsets[:-1] + np.cumsum(filled) - 1)[filled]
        s = np.full(len(data) + len(first), 32, np.uint8)
        inner = np.ones(len(s), bool)
        inner[first] = False
        s[inner] = data
        ends = np.concatenate([[0], np.cumsum(np.diff(offsets) + filled)])
        if not len(s):
            return np.zeros(0, np.int32), ends
        cut = np.zeros(len(s), bool)
        cut[first] = True
        if self.cut_spaces:
            space = s == 32
            cut[1:] |= space[1:] & ~space[:-1]
        if self.cut_lines:
            line = s == 10
            cut |= line
            cut[1:] |= line[:-1]
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, len(s)))
        one, two = word_hashes(s, starts, starts + sizes)
        _, pick, which = np.unique(one, return_index=True, return_inverse=True)
        if not (two[pick][which] == two).all():  # two words of one hash: no sharing
            pick = which = np.arange(len(starts))
        raw = s[ranges(starts[pick], sizes[pick])]
        lead = (raw & 0xC0) != 0x80
        chars = np.add.reduceat(lead, np.cumsum(sizes[pick]) - sizes[pick], dtype=np.int64)
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        ids, n = self.merge_words(np.where(points == 32, ord(SPACE), points), chars)
        at = np.cumsum(n) - n
        sizes = n[which]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids[ranges(at[which], sizes)], total[np.searchsorted(starts, ends)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The library's decode() of each row's ids; row k has ids[ends[k]:ends[k + 1]]."""
        sizes = self.blob_len[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        data = self.blob[ranges(self.blob_at[ids], sizes)]
        starts = total[ends]
        filled = np.flatnonzero(np.diff(ends) > 0)
        strip = filled[self.marked[ids[ends[filled]]]]  # the space that encoding put first
        keep = np.ones(len(data), bool)
        keep[starts[strip]] = False
        data = data[keep]
        cut = np.zeros(len(starts), np.int64)
        cut[strip + 1] = 1
        starts = starts - np.cumsum(cut)
        try:
            data.tobytes().decode("utf-8")
            whole = self.plain[ids].all() and not ((data[starts[:-1][np.diff(starts) > 0]] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if not whole:  # control ids or byte ids that are no UTF-8: the library says what they become
            return pa.array([self.library.decode(ids[a:b].tolist()) for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)], pa.string())
        return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)])


@lru_cache(maxsize=1)
def vocabulary(model_path: str) -> PieceVocabulary:
    """One vocabulary for each Python worker."""
    return PieceVocabulary(model_path)


def encode_decode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """docs with ids (array<int>) and decoded (string) of the whole of each text.

    A null text counts as empty: no ids, an empty decoded text.  Columns of docs by these names are replaced.
    model_path is read by each worker, so it must be there on every executor.
    """
    docs = with_columns_replaced(docs, ["ids", "decoded"])
    at = docs.columns.index(text)

    def run(batches):
        v = vocabulary(model_path)
        for batch in batches:
            offsets, _ = utf8_view(batch.column(at))
            for a, b in doc_slices(offsets, OUT_BYTES):
                part = batch.slice(a, b - a)
                ids, ends = v.encode(part.column(at))
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, column, v.decode(ids, ends)], names=[*part.schema.names, "ids", "decoded"])

    return docs.mapInArrow(run, schema_with(docs, "ids array<int>, decoded string"))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 from the operator's outputs."""
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: ids and decoded text of every document of ``documents``, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(encode_decode(docs.select("doc_id", "text"), default_model()))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the ids of every document kept, beside its id, and their digests."""
    found = encode_decode(docs.select("doc_id", "text"), default_model())
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "ids")
