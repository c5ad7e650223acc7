"""The pipeline's stages against brute force on small tables."""

import hashlib

import corpus_pipeline
from shelfwatch.llm import piece_bpe

from ..conftest import SMALL
from .test_llm import brute_components


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "mixing", "sentencepiece"]
    kept = corpus_pipeline.keep_languages(spark, docs, SMALL)
    assert kept.columns == docs.columns and kept.count() == docs.count()  # every clean document stays
    single = corpus_pipeline.drop_near_duplicates(spark, kept, SMALL)
    want = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in docs.collect()], 5)}
    assert {r.doc_id for r in single.collect()} == want and single.columns == docs.columns
    mixed = corpus_pipeline.mix_sources(spark, single, SMALL)
    words = sum(len(r.text.split()) for r in single.collect())
    assert mixed.columns == docs.columns and abs(sum(len(r.text.split()) for r in mixed.collect()) - 1.5 * words) < 20
    library = piece_bpe.PieceVocabulary(piece_bpe.default_model()).library
    got = corpus_pipeline.tokenise(spark, mixed.limit(20), SMALL).collect()
    assert all(r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() and r.n_tokens == len(r.ids) for r in got)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.ids == library.encode(texts[r.doc_id]) for r in got if len(library.encode(texts[r.doc_id])) == r.n_tokens)


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    from .test_llm import odd_docs

    words = " ".join(f"the word{k} is here" for k in range(30))
    more = spark.createDataFrame([(20, words, "en", "a", 1), (21, words, "en", "b", 1), (None, words + " and", "en", None, 1)], odd_docs(spark).schema)
    docs = odd_docs(spark).unionByName(more)
    docs.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    library = piece_bpe.PieceVocabulary(piece_bpe.default_model()).library
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {r.doc_id for r in got} <= {None, 5, 6, 7, 20} and 20 in {r.doc_id for r in got} and 21 not in {r.doc_id for r in got}
    assert all(r.n_tokens == len(r.ids) and library.decode(r.ids) is not None for r in got)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
