"""The training-data queries, their SQL, and the corpus pipeline."""

from __future__ import annotations

import corpus_pipeline

from . import attention, bpe, codes, descent, jaccard, language, licenses, mixing, quotes, substrings, suffixes, topk, whitening

MODULES = (jaccard, descent, bpe, quotes, mixing, licenses, attention, language, substrings, topk, suffixes, whitening, codes)


def queries() -> dict:
    found: dict = {}
    for module in MODULES:
        found |= module.QUERIES
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found |= module.ORACLE
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
