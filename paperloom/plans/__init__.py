"""The registered queries, one module per family."""

from __future__ import annotations

import importlib

FAMILIES = [
    "source_queries", "text_queries", "passage_queries", "vector_queries", "graph_build_queries", "graph_queries",
    "question_queries", "fusion_queries", "loop_queries", "score_queries", "comparison_queries", "qaset_queries",
    "stream_queries",
]


def load_all():
    from paperloom.plans.registry import QUERIES

    for name in FAMILIES:
        try:
            importlib.import_module(f"paperloom.plans.{name}")
        except ModuleNotFoundError as e:
            if name not in str(e):
                raise
    return QUERIES
