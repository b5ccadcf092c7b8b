"""Queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from helixplan.llm import align, chat, exact_dedup, html_text, language, mixing, pieces, quality, resample, simhash, token_files, toxicity, url_filter

QUERIES = {
    "op1_html_text": html_text.op1_html_text,
    "op2_chat_format": chat.op2_chat_format,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_language": language.op7_language,
    "op8_pieces": pieces.op8_pieces,
    "op9_quality": quality.op9_quality,
    "op10_simhash": simhash.op10_simhash,
    "op11_token_files": token_files.op11_token_files,
    "op12_resample": resample.op12_resample,
    "op13_align": align.op13_align,
}

ORACLES = {
    "op2_chat_format": chat.OP2_SQL,
    "op4_url_filter": url_filter.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op12_resample": resample.OP12_SQL,
}
