"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from terravane.llm import byte_bpe, embedding_dedup, line_dedup, masked_lm, minhash, packing, pii, quality_ranker, quality_rules, toxicity

_MODULES = [pii, minhash, byte_bpe, embedding_dedup, packing, quality_rules, toxicity, line_dedup, masked_lm, quality_ranker]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
