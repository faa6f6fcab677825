"""All bindings; importing this module registers them."""

from minutebook.plans import (  # noqa: F401
    correction_queries, page_queries, rollup_queries, search_queries, source_queries, stream_queries, text_queries)
from minutebook.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
