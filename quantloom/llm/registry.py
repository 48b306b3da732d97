"""Queries of this subpackage, by name."""

from __future__ import annotations

from quantloom.llm import chat_format, embedding_dedup, language_id, packing, sentencepiece_codec, simhash, substring_dedup, token_counts, topk_search, toxicity

_MODULES = (chat_format, embedding_dedup, language_id, packing, sentencepiece_codec, simhash, substring_dedup, token_counts, topk_search, toxicity)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in _MODULES:
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
