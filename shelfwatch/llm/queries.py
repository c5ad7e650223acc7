"""The numbered queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from . import audio, chat, html_text, language_id, lexical_search, mixing, near_dedup, piece_bpe, substring_dedup, token_alignment, url_filter, vector_search, warc

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_arc_to_warc": warc.query,
    "op3_multi_index_search": vector_search.query,
    "op4_html_text": html_text.query,
    "op5_chat_format": chat.query,
    "op6_audio_features": audio.query,
    "op7_sentencepiece": piece_bpe.query,
    "op8_near_dedup": near_dedup.query,
    "op9_url_filter": url_filter.query,
    "op10_mix_sources": mixing.query,
    "op11_bit_sliced_search": lexical_search.query,
    "op12_token_alignment": token_alignment.query,
    "op13_substring_dedup": substring_dedup.query,
}

ORACLE_SQL = {
    "op2_arc_to_warc": warc.ORACLE_SQL,
    "op5_chat_format": chat.ORACLE_SQL,
    "op10_mix_sources": mixing.ORACLE_SQL,
    "op11_bit_sliced_search": lexical_search.ORACLE_SQL,
    "op13_substring_dedup": substring_dedup.ORACLE_SQL,
}
