"""Queries of the corpus operators and their SQL."""

from . import (bitslice_topk, bpe, chat_format, exact_dedup, lang_crf, lexical, line_dedup, merkle, near_dedup, packing, pfair_mix, pii_crf,
               secret_scan)

MODULES = (pii_crf, bitslice_topk, bpe, exact_dedup, pfair_mix, chat_format, lang_crf, line_dedup, secret_scan, near_dedup, lexical, merkle, packing)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
