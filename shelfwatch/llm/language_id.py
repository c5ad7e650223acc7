"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order byte context tree of up to ``ORDER`` bytes.  A byte's probability is read from
the longest context that the tree has; what that context has never seen escapes to the next shorter one (escape
method C, with exclusion of the symbols that the longer context has seen) down to a uniform order -1.  Statistics
are frozen after training, so the code length of a byte given its last ``ORDER`` bytes is a constant: the trees are
compiled into one table of code lengths (fixed point, 1/1024 bit) and a text's code length is an exact integer sum of
table entries, whatever the batch or partition it is read in.

Every language of the labels is learned.  Languages are compiled in groups of ``GROUP``, each with an alphabet, contexts
and a table of its own, so what is kept of a language doesn't shrink with the number of languages; a worker holds about
``TABLE_BYTES`` a language.

Training uses a bounded sample: of each language ``sample_rows`` documents in expectation, chosen by a hash of the id, as
far as their texts come to ``sample_bytes`` (texts of more than an eighth of that come last; a language that has no
others is learned from one of them).  Prediction reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_text, doc_slices, schema_with, utf8_view, with_columns_replaced

ORDER = 3
UNIT = 1024  # of a bit
GROUP = 4
TABLE_BYTES = 4 << 20  # of compiled code lengths a language, about
CHUNK = 1 << 19
UNDETERMINED = "und"


@dataclass
class PpmTrees:
    """The compiled trees of a group of languages.

    alphabet: byte -> symbol; pairs, triples: the last symbols -> context row (triples by the place of their first two, -1 if
    the context isn't kept); cost: row, symbol -> code length by language.
    """

    langs: list[str]
    alphabet: np.ndarray
    size: int
    pairs: np.ndarray
    places: np.ndarray
    triples: np.ndarray
    cost: np.ndarray

    def code_lengths(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Exact code lengths, rows x languages, in 1/UNIT bit."""
        out = np.zeros((len(offsets) - 1, len(self.langs)), np.int64)
        for i, j in doc_slices(offsets, CHUNK):
            if j == i + 1 and offsets[j] - offsets[i] > CHUNK:
                before = np.zeros(ORDER, np.int32)
                for a in range(offsets[i], offsets[j], CHUNK):
                    s = np.concatenate([before, self.alphabet[data[a: min(a + CHUNK, offsets[j])]]])
                    out[i] += self._costs(s).sum(axis=0, dtype=np.int64)
                    before = s[-ORDER:]
                continue
            # ORDER boundary symbols (0) before each document; a boundary costs nothing
            starts = offsets[i:j] - offsets[i] + ORDER * np.arange(j - i)
            s = np.zeros(offsets[j] - offsets[i] + ORDER * (j - i), np.int32)
            real = np.ones(len(s), bool)
            for k in range(ORDER):
                real[starts + k] = False
            s[real] = self.alphabet[data[offsets[i]: offsets[j]]]
            costs = np.zeros((len(s), len(self.langs)), np.uint16)
            costs[ORDER:] = self._costs(s)
            out[i:j] = np.add.reduceat(costs, starts, axis=0, dtype=np.int64)
        return out

    def _costs(self, s: np.ndarray) -> np.ndarray:
        long = self.triples[self.places[s[:-3] * self.size + s[1:-2]] * self.size + s[2:-1]]
        rows = np.where(long >= 0, long, self.pairs[s[1:-2] * self.size + s[2:-1]])
        return self.cost[rows * self.size + s[3:]]


@dataclass
class PpmModel:
    """Groups of languages, all of them in the order of their names."""

    groups: list[PpmTrees]

    @property
    def langs(self) -> list[str]:
        return [lang for g in self.groups for lang in g.langs]

    def code_lengths(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Exact code lengths, rows x languages, in 1/UNIT bit."""
        return np.concatenate([g.code_lengths(offsets, data) for g in self.groups], axis=1)


def _ppm_probabilities(counts: list[np.ndarray]) -> np.ndarray:
    """Probabilities of the symbols for n contexts; counts: per order, from the longest, n x symbols."""
    n, size = counts[0].shape
    p, seen, escape = np.zeros((n, size)), np.zeros((n, size), bool), np.ones(n)
    for c in counts:
        c = np.where(seen, 0, c)
        total, kinds = c.sum(axis=1), (c > 0).sum(axis=1)
        has = total > 0
        whole = np.where(has, total + kinds, 1)
        p += (escape / whole)[:, None] * c
        escape = np.where(has, escape * kinds / whole, escape)
        seen |= c > 0
    rest = 256 - seen.sum(axis=1)  # byte values that no context has seen share what is left
    return np.where(seen, p, (escape / np.maximum(rest, 1))[:, None])


def train(texts: dict[str, list[bytes]], min_count: int = 2) -> PpmModel:
    """Fit on labelled byte strings. Texts may be empty; at least one language is needed."""
    langs = sorted(texts)
    return PpmModel([_compiled({lang: texts[lang] for lang in langs[k: k + GROUP]}, min_count) for k in range(0, len(langs), GROUP)])


def _compiled(texts: dict[str, list[bytes]], min_count: int) -> PpmTrees:
    langs = list(texts)
    present = np.zeros(256, bool)
    for lang in langs:
        for t in texts[lang]:
            present[np.unique(np.frombuffer(t, np.uint8))] = True
    alphabet = np.full(256, 1 + int(present.sum()), np.int32)
    alphabet[present] = 1 + np.arange(int(present.sum()))
    size = 2 + int(present.sum())  # boundary, bytes of the sample, any other byte

    grams: list[np.ndarray] = []
    for lang in langs:
        parts = [x for t in texts[lang] for x in (np.zeros(ORDER, np.int16), alphabet[np.frombuffer(t, np.uint8)].astype(np.int16))]
        s = np.concatenate(parts) if parts else np.zeros(0, np.int16)
        if len(s) <= ORDER:
            grams.append(np.zeros((0, ORDER + 1), np.int16))
            continue
        g = np.lib.stride_tricks.sliding_window_view(s, ORDER + 1)
        grams.append(g[g[:, ORDER] > 0])

    def key(g: np.ndarray, order: int) -> np.ndarray:
        k = np.zeros(len(g), np.int64)
        for d in range(ORDER - order, ORDER):
            k = k * size + g[:, d]
        return k

    most = max(64, TABLE_BYTES // (2 * size) - size - 1)
    contexts: dict[int, np.ndarray] = {0: np.zeros(1, np.int64), 1: np.arange(size)}
    for order, share in ((2, most // 2), (3, most - most // 2)):
        found = [np.unique(key(g, order), return_counts=True) for g in grams]
        keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        n = np.bincount(at, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
        keep = np.flatnonzero(n >= min_count)
        keep = keep[np.lexsort((keys[keep], -n[keep]))][:share]
        contexts[order] = np.sort(keys[keep])

    trees = []  # per language and order: contexts x symbols
    for g in grams:
        tree = {}
        for order, keys in contexts.items():
            k = key(g, order)
            at = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
            hit = keys[at] == k if len(keys) else np.zeros(len(k), bool)
            tree[order] = np.bincount(at[hit] * size + g[hit, ORDER], minlength=max(len(keys), 1) * size).reshape(-1, size)[: len(keys)].astype(np.float64)
        trees.append(tree)

    def rows_of(keys: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        known = contexts[order]
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        return at, known[at] == keys if len(known) else np.zeros(len(keys), bool)

    first, row = {}, 0
    blocks = []
    for order in range(ORDER + 1):
        keys = contexts[order]
        first[order] = row
        row += len(keys)
        block = np.zeros((len(keys), size, len(langs)), np.uint16)
        for a in range(0, len(keys), 4096):
            part = keys[a: a + 4096]
            for li, tree in enumerate(trees):
                counts = []
                for d in range(order, -1, -1):
                    at, hit = rows_of(part % size**d, d)
                    got = tree[d][at] if len(contexts[d]) else np.zeros((len(part), size))
                    counts.append(np.where(hit[:, None], got, 0))
                bits = -np.log2(np.maximum(_ppm_probabilities(counts), 2.0**-60))
                block[a: a + 4096, :, li] = np.rint(bits * UNIT).astype(np.uint16)
        block[:, 0, :] = 0
        blocks.append(block)
    pairs = np.tile(np.arange(size, dtype=np.int32) + first[1], size)
    pairs[contexts[2]] = first[2] + np.arange(len(contexts[2]), dtype=np.int32)
    heads, at = np.unique(contexts[3] // size, return_inverse=True)
    places = np.zeros(size * size, np.int32)
    places[heads] = 1 + np.arange(len(heads), dtype=np.int32)
    triples = np.full((len(heads) + 1) * size, -1, np.int32)
    triples[(1 + at) * size + contexts[3] % size] = first[3] + np.arange(len(contexts[3]), dtype=np.int32)
    return PpmTrees(langs, alphabet, size, pairs, places, triples, np.concatenate(blocks).reshape(-1, len(langs)))


def fit(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", key: str = "doc_id",
        sample_rows: int = 600, sample_bytes: int = 4 << 20) -> PpmModel | None:
    """Train on the bounded sample described above of the rows where usable holds; None if no row is labelled.

    Rows with a null language, text or key, or for which usable is null, are not learned from.
    """
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text"), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)).alias("place"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))  # a row for each language: broadcast, so that only the sample is shuffled
    chosen = rows.join(F.broadcast(counts), "lang").where(F.col("place") < F.least(F.lit(1.0), sample_rows / F.col("n")) * (1 << 30))
    size = F.octet_length("text")
    order = Window.partitionBy("lang").orderBy(size > sample_bytes // 8, "place", size, F.xxhash64("text"))
    held = (chosen.withColumn("held", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(order))
            .where((F.col("rank") == 1) | ((F.col("rank") <= 2 * sample_rows) & (F.col("held") <= sample_bytes))))
    texts: dict[str, list[bytes]] = {}
    for r in held.select("lang", "rank", "text").orderBy("lang", "rank").collect():
        texts.setdefault(r["lang"], []).append(bytes(r["text"]))
    texts = {k: v for k, v in texts.items() if any(v)}
    return train(texts) if texts else None


def predict(docs: DataFrame, model: PpmModel | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (posterior under equal priors, 0 to 1) and bits_per_byte (of the best language).

    A null text, a text with no letter, and any text where model is None get ``und`` with score 0 and null
    bits_per_byte.  Ties go to the language that sorts first.  Columns of docs by these names are replaced.
    """
    docs = with_columns_replaced(docs, ["lang_pred", "score", "bits_per_byte"])
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0), "bits_per_byte": F.lit(None).cast("double")})
    letters = "__has_letter"
    while letters.lower() in {c.lower() for c in docs.columns}:
        letters = "_" + letters
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m: PpmModel = shared.value
        for batch in batches:
            offsets, data = utf8_view(batch.column(at))
            bits = m.code_lengths(offsets, data)
            has = batch.column(batch.num_columns - 1).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            best = bits.argmin(axis=1)
            low = bits.min(axis=1)
            with np.errstate(under="ignore"):
                post = 1.0 / np.exp2(-(bits - low[:, None]) / UNIT).sum(axis=1)
            names = np.array([*m.langs, UNDETERMINED], dtype=object)[np.where(has, best, len(m.langs))]
            per_byte = low / UNIT / np.maximum(np.diff(offsets), 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(np.where(has, post, 0.0)), pa.array(per_byte, mask=~has)],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "bits_per_byte"])

    out = schema_with(docs, "lang_pred string, score double, bits_per_byte double")
    return docs.withColumn(letters, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).mapInArrow(score, out)


def held_out(key: str = "doc_id") -> Column:
    """True for the rows kept from training: crc32 of the id's text mod 4 is 2. A null id is not held out (nor learned from)."""
    return F.coalesce(crc_text(F.col(key)) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: language of every document of ``documents``, learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, ~held_out() & F.col("doc_id").isNotNull())
    found = predict(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def stage(spark, docs: DataFrame, sf_dir: str, least_score: float = 0.5) -> DataFrame:
    """Pipeline stage: documents without a language, or less likely than least_score to be in the one found, go.

    So null and letterless texts go; rows with null or repeated ids, null languages or sources are judged by their text
    like others, and equal rows stay or go together. If no row is labelled, there is no language to find and all go.
    """
    names = docs.columns
    model = fit(docs, ~held_out())
    return predict(docs, model).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score)).select(*names)
