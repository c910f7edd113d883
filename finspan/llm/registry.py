"""Queries of the corpus operators, and their SQL where SQL can express them."""

from finspan.llm import byte_bpe, collocations, context_mixing, conversation_trie, decontaminate, language_id, line_dedup, minhash_near, packing, pii_surrogates, quality_divergence, suffix_dedup, token_store

MODULES = (byte_bpe, collocations, context_mixing, conversation_trie, decontaminate, language_id, line_dedup, minhash_near, packing, pii_surrogates, quality_divergence, suffix_dedup, token_store)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
