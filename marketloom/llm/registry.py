"""Queries of this package and their SQL counterparts."""

from __future__ import annotations

from marketloom.llm import (chat_format, exact_dedup, html_text, mixing, neighbours, packing, phrases, quality, secret_scan, shingle_join, url_filter,
                            vector_codes, warc)

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_packing": packing.op3_packing,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_source_mix": mixing.op6_source_mix,
    "op7_neighbours": neighbours.op7_neighbours,
    "op8_warc": warc.op8_warc,
    "op9_html_text": html_text.op9_html_text,
    "op10_shingle_join": shingle_join.op10_shingle_join,
    "op11_chat_format": chat_format.op11_chat_format,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_phrases": phrases.op13_phrases,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op8_warc": warc.OP8_SQL,
    "op10_shingle_join": shingle_join.OP10_SQL,
    "op11_chat_format": chat_format.OP11_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    "op13_phrases": phrases.OP13_SQL,
}
