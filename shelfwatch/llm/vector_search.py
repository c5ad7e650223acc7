"""Approximate nearest neighbours by an inverted multi-index.

Vectors, scaled to unit length, are cut into two halves; each half has ``k`` centroids of its own (k-means on a bounded
sample of at most ``SAMPLE`` vectors), so a pair of centroids is one of k*k cells.  A query walks the cells in the order
of the sum of its two distances with a heap (the multi-sequence algorithm) until the cells hold ``probe`` of all
entries, and all entries of those cells are reranked by exact cosine in double precision.

The walk leaves a threshold, the sum at which it ended: the cells it has seen are those within it.  Entries lie in
blocks of neighbouring cells (a cell larger than a block is split); queries are sent to the blocks that they reach.  A
task holds one block and streams its queries past it, so memory is bounded by a block; only the best of each pair of
query and block travel on.  Blocks grow with the table up to ``BLOCK`` entries, and a block meets its queries in parts
of ``PART``, for tasks that don't grow with the table: entries are copied once for each ``PART`` queries, queries once
for each block they reach.  With a fixed share of queries and of probed entries the number of comparisons grows with the
square of the table, whatever the layout.

Of equal vectors only the ``top + 1`` smallest ids can be answers, so others leave before indexing; this is exact, and
a vector that many rows share doesn't fill a cell.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ranges

SAMPLE = 8192
BLOCK = 1 << 16  # entries of a block at most
PART = 1 << 18  # queries that meet a copy of a block
WALK = 128  # queries that a task walks the cells for
MATRIX = 1 << 21  # scores held at a time
PROBE = 0.3  # share of the entries that a query reranks at least
MAX_K = 256


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    centres = x[np.random.default_rng(3).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        for c in range(len(centres)):
            own = near == c
            if own.any():
                centres[c] = x[own].mean(0)
    return centres


class MultiIndex:
    """Two codebooks, and where the cells lie: first block and number of blocks of each cell."""

    def __init__(self, sample: np.ndarray, k: int):
        half = sample.shape[1] // 2
        self.half = half
        self.books = [_kmeans(sample[:, :half], k), _kmeans(sample[:, half:], k)]
        self.counts = np.zeros(len(self.books[0]) * len(self.books[1]), np.int64)

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves to their centroids."""
        out = []
        for part, book in ((unit[:, : self.half], self.books[0]), (unit[:, self.half:], self.books[1])):
            out.append((part**2).sum(1)[:, None] + (book**2).sum(1) - 2 * part @ book.T)
        return out[0], out[1]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.distances(unit)
        return a.argmin(1) * b.shape[1] + b.argmin(1)

    def lay_out(self, counts: dict[int, int], most: int = BLOCK) -> None:
        """Deal the cells, in their order, into blocks of at most ``most`` entries."""
        for cell, n in counts.items():
            self.counts[cell] = n
        self.first, self.split = np.zeros(len(self.counts), np.int64), np.ones(len(self.counts), np.int64)
        block, held = 0, 0
        for cell, n in enumerate(self.counts):
            if n > most:
                block += held > 0
                self.first[cell], self.split[cell] = block, -(-n // most)
                block, held = block + self.split[cell], 0
                continue
            if held + n > most:
                block, held = block + 1, 0
            self.first[cell] = block
            held += n
        self.blocks = int(block) + int(held > 0)
        self.counts_list = self.counts.tolist()

    def walk(self, a: np.ndarray, b: np.ndarray, wanted: int) -> tuple[float, set[int]]:
        """(threshold, blocks): cells in the order of a[i] + b[j] until they hold wanted entries."""
        p, q = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b, p, q, width = a[p].tolist(), b[q].tolist(), p.tolist(), q.tolist(), len(b)
        heap, reach = [(a[0] + b[0], 0, 0)], [0] * len(a)  # of each row, the columns that are in the heap or done
        reach[0] = 1
        found, last, seen = 0, 0.0, []
        counts = self.counts_list
        while heap and found < wanted:
            last, i, j = heapq.heappop(heap)
            cell = p[i] * width + q[j]
            if counts[cell]:
                found += counts[cell]
                seen.append(cell)
            if j + 1 < width and reach[i] == j + 1 and (i == 0 or reach[i - 1] > j + 1):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
                reach[i] = j + 2
            if i + 1 < len(a) and reach[i + 1] == j and reach[i] > j:
                heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
                reach[i + 1] = j + 1
        first, split = self.first[seen], self.split[seen]
        return last, set(np.unique(ranges(first, split)).tolist())


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that no square is too large or too small; exact, and no cosine changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """Rows whose vector isn't null or zero and holds finite numbers only."""
    return rows.where(F.col("id").isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vec, lambda x: x != 0))


class _Block:
    """The entries of a block, sorted by cell, and their meeting with queries."""

    def __init__(self, vecs: np.ndarray, ids: np.ndarray, cells: np.ndarray):
        order = np.argsort(cells, kind="stable")
        self.vecs, self.ids = _scaled(vecs[order]), ids[order]
        self.norm = np.sqrt((self.vecs * self.vecs).sum(1))
        self.unit = self.vecs / self.norm[:, None]
        self.cells, self.starts, self.sizes = np.unique(cells[order], return_index=True, return_counts=True)

    def best(self, index: MultiIndex, queries: np.ndarray, q_id: np.ndarray, reach: np.ndarray, top: int):
        """Record batches (query_id, vec_id, score): the top entries of the cells that each query has seen."""
        n, width = len(self.ids), len(index.books[1])
        step = max(1, MATRIX // n)
        for s in range(0, len(queries), step):
            q = _scaled(queries[s: s + step])
            unit = _unit(q)
            a, b = index.distances(unit)
            seen = a[:, self.cells // width] + b[:, self.cells % width] <= reach[s: s + step, None] + 1e-12
            if n >= 64 * len(self.cells):  # large cells: only those that a query has seen
                score = np.full((len(q), n), -np.inf)
                for c, (at, size) in enumerate(zip(self.starts, self.sizes, strict=True)):
                    who = np.flatnonzero(seen[:, c])
                    score[who, at: at + size] = unit[who] @ self.unit[at: at + size].T
            else:
                score = np.where(np.repeat(seen, self.sizes, axis=1), unit @ self.unit.T, -np.inf)
            score[self.ids[None, :] == q_id[s: s + step, None]] = -np.inf
            low = np.partition(score, max(n - top, 0), axis=1)[:, max(n - top, 0)]
            i, j = np.nonzero((score >= low[:, None] - 1e-9) & (score > -np.inf))
            exact = (q[i] * self.vecs[j]).sum(1) / (np.sqrt((q[i] * q[i]).sum(1)) * self.norm[j])  # the same sum for equal vectors
            order = np.lexsort((self.ids[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            kept = np.arange(len(i)) - np.searchsorted(i, np.arange(len(q)))[i] < top
            yield pa.RecordBatch.from_arrays([pa.array(q_id[s + i[kept]]), pa.array(self.ids[j[kept]]), pa.array(exact[kept])], names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, every: int = 50, top: int = 5, probe: float = PROBE, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by every, its top nearest of the others.

    Rows with a null key, and vectors that are null, empty, zero or hold nulls or non-finite numbers, take no part, nor
    do vectors whose length isn't that of most sampled rows.  Equal rows are one row; rows that share a key are never
    each other's answers.  Ties go to the smaller key.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("vec")))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sample:
        return empty
    sizes = np.array([len(r["vec"]) for r in sample])
    dim = int(np.bincount(sizes).argmax())
    x = _unit(np.array([r["vec"] for r in sample if len(r["vec"]) == dim], np.float64))
    rows = rows.where(F.size("vec") == dim)
    same = Window.partitionBy("vec").orderBy("id")
    entries = rows.distinct().withColumn("n", F.row_number().over(same)).where(F.col("n") <= top + 1).drop("n")
    k = int(min(MAX_K, max(1, len(x) // 2)))
    index = MultiIndex(x, k)

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index.cells(_unit(_matrix(batch.column(1))))), batch.column(1)], names=["id", "cell", "vec"])

    kind = rows.schema["vec"].dataType.simpleString()
    placed = materialise(entries.mapInArrow(place, f"id long, cell long, vec {kind}"), "imi-entries")
    counts = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # k * k rows at most
    total = sum(counts.values())
    index.lay_out(counts, min(BLOCK, max(1024, 8 * int(total**0.5))))
    wanted = int(np.ceil(probe * total)) + top + 1

    queries = materialise(rows.where(F.col("id") % every == 0).distinct(), "imi-queries")
    asking = queries.count()
    parts = max(1, -(-asking // PART))
    shared = spark.sparkContext.broadcast(index)

    def walk(batches):
        m: MultiIndex = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows, WALK):
                piece = batch.slice(s, WALK)
                a, b = m.distances(_unit(_matrix(piece.column(1))))
                limits, at, blocks = [], [], []
                for i in range(piece.num_rows):
                    limit, reached = m.walk(a[i], b[i], wanted)
                    at += [i] * len(reached)
                    blocks += sorted(reached)
                    limits += [limit] * len(reached)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), piece.column(0).take(take), pa.array(limits, pa.float64()), piece.column(1).take(take)],
                                                 names=["block", "id", "reach", "vec"])

    dealt = F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")
    walked = queries.repartition(max(1, -(-asking // WALK)), "id").mapInArrow(walk, f"block long, id long, reach double, vec {kind}")
    asked = walked.select("block", dealt, F.lit(1).alias("asks"), "id", F.lit(None).cast("long").alias("cell"), "reach", "vec")

    def block_of(batches):
        m: MultiIndex = shared.value
        for batch in batches:
            cell, mix = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(m.first[cell] + mix % m.split[cell]), *batch.columns[:3]], names=["block", "id", "cell", "vec"])

    stored = placed.withColumn("mix", F.pmod(F.xxhash64("id"), F.lit(1 << 30))).mapInArrow(block_of, f"block long, id long, cell long, vec {kind}")
    stored = stored.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(0).alias("asks"),
                           "id", "cell", F.lit(None).cast("double").alias("reach"), "vec")

    def rerank(batches):
        m: MultiIndex = shared.value
        key, held = None, None
        for batch in batches:
            keys = batch.column(0).to_numpy() * parts + batch.column(1).to_numpy()
            asks = batch.column(2).to_numpy()
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(asks) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if s == e:
                    continue
                if keys[s] != key:
                    key, held = keys[s], []
                piece = batch.slice(s, e - s)
                if asks[s] == 0:
                    held.append((_matrix(piece.column(6)), piece.column(3).to_numpy(), piece.column(4).to_numpy()))
                    continue
                if isinstance(held, list):
                    held = _Block(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else None
                if held is not None:
                    yield from held.best(m, _matrix(piece.column(6)), piece.column(3).to_numpy(), piece.column(5).to_numpy(), top)

    # as many tasks as blocks meet parts, for their work isn't what their bytes say
    met = stored.unionByName(asked).repartition(max(1, min(20_000, index.blocks * parts)), "block", "part").sortWithinPartitions("block", "part", "asks")
    near = met.mapInArrow(rerank, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the 5 nearest rows of ``embeddings`` of every row whose id is divisible by 50."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
