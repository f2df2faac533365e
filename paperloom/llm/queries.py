"""All queries of this folder; importing it registers them."""

from paperloom.llm import corpus_queries, mining_queries, native_queries  # noqa: F401
from paperloom.llm.registry import LLM_QUERIES  # noqa: F401
