"""Bit-sliced search, token alignment and passage removal against SQL, libraries and slow versions, with odd inputs."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwatch.llm import lexical_search, substring_dedup, token_alignment

from ..conftest import SMALL
from .test_llm import DOCS, duck, odd_docs, rows

ODD_TEXTS = ["", " ", "a", "  two  spaces ", "line\n\nfeeds\t\ttabs\r\n", "it's they'll 'S", "<|endoftext|> <s> </s> <unk> <0x41>", "naïve café ÀÉ Ünïcode", "日本語 テキスト", "🙂🙂 emoji👩‍👩‍👧", "a▁b ▁",
             "\x00\x01\x7f", "\u0085  x　y", "x" * 3000, "1234567 89٣٤", "a" * 40 + " " * 40 + "b", "é combining", "᠎ ﻿ bom", "mixedعربيtext", "… — “quotes”"]


# 11 ranked lexical search


def test_search_equals_sql_on_small_blocks(spark):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    index = lexical_search.build_index(docs.repartition(3), block_bytes=20_000, block_docs=7)
    found = lexical_search.search(index, items, batch=9).withColumnRenamed("id", "doc_id")
    assert index.where("term is null").count() > 20
    assert rows(found, "item_id", "rank", "doc_id", "score") == duck(f"SELECT item_id, rank, doc_id, score FROM ({lexical_search.ORACLE_SQL})", {"documents": docs, "benchmark": items})


def test_search_of_odd_rows(spark):
    docs = odd_docs(spark).select("*", F.lit("x").alias("Term"), F.lit(1).alias("block"))
    items = spark.createDataFrame([(1, "the the one x", "t"), (1, "the the one x", "t"), (2, None, "t"), (3, "", "t"), (4, "!? ...", "t"), (None, "no ID HERE", "t"), (6, "ÄÖ ä", "t")], "item_id long, text string, term string")
    found = lexical_search.search(lexical_search.build_index(docs, block_docs=2), items)
    want = duck(f"SELECT item_id, rank, doc_id, score FROM ({lexical_search.ORACLE_SQL})", {"documents": docs, "benchmark": items})
    assert rows(found, "item_id", "rank", "id", "score") == want
    assert {r[0] for r in want} == {1, None}
    none = docs.limit(0)
    assert lexical_search.search(lexical_search.build_index(none), items).count() == 0
    assert lexical_search.search(lexical_search.build_index(docs), items.limit(0)).count() == 0


def test_ties_go_by_id_and_all_are_found_if_fewer(spark):
    docs = spark.createDataFrame([(k, "same words here" if k % 2 else "other text", "en", "s", 1) for k in range(100, 0, -1)], DOCS)
    items = spark.createDataFrame([(1, "words"), (2, "other")], "item_id long, text string")
    got = lexical_search.search(lexical_search.build_index(docs.repartition(4), block_docs=5), items, k=7).collect()
    assert sorted((r.item_id, r["rank"], r.id) for r in got) == [(i, k + 1, 2 * k + i) for i in (1, 2) for k in range(7)]
    assert len(lexical_search.search(lexical_search.build_index(docs), items, k=80).collect()) == 100


def test_bit_sliced_arithmetic():
    rnd = np.random.default_rng(3)
    for size, terms in ((1, 1), (9, 2), (200, 3), (1000, 17)):
        total, numbers = np.zeros(size, np.int64), []
        for _ in range(terms):
            places = np.sort(rnd.choice(size, rnd.integers(1, size + 1), replace=False))
            values, times = rnd.integers(0, 1 << 34, len(places)), int(rnd.integers(1, 6))
            depth, raw = lexical_search.sliced(values, np.array([0, len(values)]))
            numbers.append(lexical_search.dense(raw[0], depth[0], places, size, times))
            total[places] += values * times
        places, scores = lexical_search.top_places(lexical_search.added(numbers), 20)
        want = sorted(((-t, k) for k, t in enumerate(total.tolist()) if t))[:20]
        assert [(-s, p) for s, p in zip(scores.tolist(), places.tolist(), strict=True)] == want


def test_slices_of_many_rows():
    values, ends = np.array([5, 0, 0, 1 << 40, 7, 1]), np.array([0, 2, 3, 4, 6])
    depth, raw = lexical_search.sliced(values, ends)
    for k, (d, r) in enumerate(zip(depth, raw, strict=True)):
        n = ends[k + 1] - ends[k]
        bits = np.unpackbits(np.frombuffer(r, np.uint8), count=d * n).reshape(d, n)
        assert (bits.astype(np.int64) << np.arange(d)[:, None]).sum(axis=0).tolist() == values[ends[k]: ends[k + 1]].tolist()


# 12 alignment of tokenizers


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_byte_vocabulary_equals_library(libraries):
    v = token_alignment.byte_vocabulary(token_alignment.default_files()[0])
    rnd = random.Random(8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" " + t for t in ODD_TEXTS] + ["".join(chr(rnd.choice(points)) if rnd.random() < 0.3 else rnd.choice("ab '\n1.,éß") for _ in range(60)) for _ in range(800)]
    ids, ends = v.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [e.ids for e in libraries[0].encode_batch(texts, add_special_tokens=False)]


def slow_alignment(texts, libraries):
    """What the contract says of each text, walked token by token."""
    one, two = libraries
    chars, to_byte = {i: s for s, i in one.get_vocab().items()}, token_alignment.byte_of_char()
    out, counts = [], Counter()
    for t in texts:
        a, b = (one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)) if t else ([], [])
        bytes_a = [bytes(to_byte[c] for c in chars[i]) for i in a]
        bytes_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
            out.append(None)
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in side]).tolist() for side in (bytes_a, bytes_b))
        links, groups, i, j, cut_a, cut_b = [], [], 0, 0, 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            x, y = ends_a[i], ends_b[j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append(",".join(map(str, a[cut_a:i])) + "|" + ",".join(map(str, b[cut_b:j])))
                cut_a, cut_b = i, j
        counts.update(links)
        out.append((len(a), len(b), groups, links))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if x is None else
            (x[0], x[1], len(x[2]), len(x[3]), sum(counts[p] == best[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest()) for x in out]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_query_equals_slow(spark, libraries):
    docs = sorted(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in token_alignment.query(spark, SMALL).collect()}
    assert [got[d.doc_id] for d in docs] == slow_alignment([d.text for d in docs], libraries)


def aligned(docs, **more):
    found = token_alignment.align(docs, *token_alignment.default_files(), **more)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256")
    stored = token_alignment.materialise(found.select("block", "id", "n_a", "n_b", "n_groups", "n_links", digest, "codes", "pairs"), "aligned")
    return token_alignment.link_counts(stored, ["id", *NAMES[:4], "groups_sha256"])


def test_alignment_of_odd_rows(spark, libraries):
    texts = [*ODD_TEXTS, None, "the the", "the the", "long " * 30000]
    docs = spark.createDataFrame([(None if k == 3 else k % 20, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, codes string, Block int")
    want = slow_alignment([t or "" for t in texts], libraries)
    for more in ({}, {"block_bytes": 50}):
        got = aligned(docs.repartition(3), **more)
        assert rows(got, "id", *NAMES) == sorted(((None if k == 3 else k % 20, *w) for k, w in enumerate(want)), key=str)
    assert want[ODD_TEXTS.index("a▁b ▁")][0] == 0  # B's bytes have spaces there
    assert aligned(docs.limit(0)).count() == 0
    assert rows(aligned(docs.where("text is null")), "id", *NAMES) == [(0, 0, 0, 0, 0, 0, 0, "")]


def test_owners():
    a, b, cut = token_alignment.links_and_cuts(np.array([1, 3, 2]), np.array([2, 2, 2]))
    assert (a.tolist(), b.tolist(), cut.tolist()) == ([0, 1, 1, 2], [0, 0, 1, 2], [True, False, False, True])


# 13 substring removal


def removed(docs, **more):
    found = substring_dedup.remove_repeats(docs, **more)
    return rows(found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")), "doc_id", "kept_sha256", "n_removed", "n_words")


def by_sql(docs, words=13):
    sql = substring_dedup.ORACLE_SQL.replace("s + 12]", f"s + {words - 1}]").replace("len(w) - 11", f"len(w) - {words - 2}").replace(">= 13", f">= {words}").replace("range(0, 13)", f"range(0, {words})")
    return duck(f"SELECT doc_id, kept_sha256, n_removed, n_words FROM ({sql})", {"documents": docs})


def test_passages_query_equals_sql(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = by_sql(docs)
    assert rows(substring_dedup.query(spark, SMALL), "doc_id", "kept_sha256", "n_removed", "n_words") == want
    assert removed(docs.repartition(5), hot=3, block_bytes=9000, bucket_bytes=5000) == want  # many blocks and buckets, many hot grams
    assert sum(r[2] for r in want) > 100


def test_passages_of_common_words(spark):
    """Few words, so that windows repeat in all ways, within documents too, and most grams are hot; repeated and null ids."""
    rnd = random.Random(5)
    table = [(rnd.choice([None, *range(30)]), " ".join(rnd.choice("abc" if k % 3 else "abcdefgh") for _ in range(rnd.randint(0, 60))), "en", "s", 1) for k in range(60)]
    table += [(7, "of the " * 300, "en", "s", 1), (8, "of  the\n" * 300, "en", "s", 1), (9, "x " * 5000, "en", "s", 1), (2, None, "en", "s", 1), (50, "a b c d e f g h i j k l m n", "en", "s", 1), (50, "a b c d e f g h i j k l m n", "en", "s", 1)]
    docs = spark.createDataFrame(table, DOCS).select("*", F.lit(1).alias("Block"), F.lit("x").alias("kept"))
    for words, hot in ((13, 4096), (13, 2), (5, 4)):
        assert removed(docs.repartition(4), words=words, hot=hot, block_bytes=700, bucket_bytes=900) == by_sql(docs, words)


def test_passages_of_odd_rows(spark):
    docs = odd_docs(spark)
    assert removed(docs) == by_sql(docs)
    assert removed(docs.limit(0)) == []
    assert removed(docs.where("text is null")) == [(1, hashlib.sha256(b"").hexdigest(), 0, 0)]
    kept = substring_dedup.remove_repeats(spark.createDataFrame([(1, " ".join(map(str, range(20)))), (2, "u\t" + "  ".join(map(str, range(3, 18))) + "\nv")], "doc_id long, text string")).collect()
    assert sorted((r.id, r.n_removed, r.kept) for r in kept) == [(1, 0, " ".join(map(str, range(20)))), (2, 15, "u v")]


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    codes = np.random.default_rng(2).integers(0, 3, 400)
    at = np.arange(396)
    plain = Counter(tuple(codes[k: k + 4]) for k in at)
    for mixed in (substring_dedup._mixed, lambda x: x * np.uint64(0)):  # the second: all hashes are one
        monkeypatch.setattr(substring_dedup, "_mixed", mixed)
        order, fresh = substring_dedup.equal_windows(codes, at, 4)
        starts = np.append(np.flatnonzero(fresh), len(at))
        assert sorted(np.diff(starts).tolist()) == sorted(plain.values())
        assert all(len({tuple(codes[k: k + 4]) for k in order[a:b]}) == 1 for a, b in zip(starts, starts[1:], strict=False))


def test_smallest_of_each_stretch():
    x = np.random.default_rng(1).integers(0, 99, 50)
    for width in (1, 2, 3, 7, 11, 60):
        got = substring_dedup._smallest(x, width)
        assert [int(got[k]) for k in range(50 - width + 1)] == [int(x[k: k + width].min()) for k in range(50 - width + 1)]


def test_packed_words():
    texts = ["a  b", "", "\t", "c", "d\ne "]
    raw = "".join(texts).encode()
    packed, counts = substring_dedup.packed_words(np.cumsum([0, *map(len, texts)]), np.frombuffer(raw, np.uint8))
    assert packed.tobytes() == b"a b c d e " and counts.tolist() == [2, 0, 0, 1, 2]
    strings = substring_dedup.distinct_strings(packed, np.array([0, 2, 0]), np.array([2, 1, 2]))
    assert strings[0].tolist() == [0, 1, 0] and strings[1].to_pylist() == [b"a b ", b"c "]
