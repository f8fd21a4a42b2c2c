"""Queries and oracle SQL of this subpackage."""

from wardline.llm import bpe, decontamination, embedding_dedup, jaccard_join, language_id, periodic_runs, personal_data, quality, sharding, substring_dedup, token_alignment, toxicity, url_filters

MODULES = (decontamination, language_id, bpe, toxicity, jaccard_join, substring_dedup, quality, embedding_dedup, url_filters, sharding, personal_data, token_alignment, periodic_runs)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in getattr(m, "ORACLE", {}).items()}
