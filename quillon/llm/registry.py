"""Queries and SQL of this subpackage, the pipeline among them."""

import corpus_pipeline
from quillon.llm import (
    q_chat,
    q_codes,
    q_graph_search,
    q_jaccard,
    q_lm,
    q_mixing,
    q_phrases,
    q_pieces,
    q_pii,
    q_quality,
    q_revisits,
    q_sharding,
    q_toxicity,
)

_PARTS = [q_lm, q_pieces, q_graph_search, q_mixing, q_pii, q_sharding, q_toxicity, q_quality, q_jaccard, q_revisits, q_codes, q_phrases, q_chat]


def queries():
    out = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    out = {k: s for part in _PARTS for k, s in part.SQL.items()}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
