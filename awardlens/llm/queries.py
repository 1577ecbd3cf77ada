"""All queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import queries_alignment, queries_conversations, queries_decontamination, queries_hmm, queries_media, queries_mixing, queries_pii, queries_quality, queries_secrets, queries_simhash, queries_substring, queries_toxicity, queries_warc

MODULES = (queries_media, queries_simhash, queries_mixing, queries_warc, queries_hmm, queries_pii, queries_decontamination, queries_substring, queries_secrets, queries_quality, queries_alignment, queries_toxicity, queries_conversations)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
