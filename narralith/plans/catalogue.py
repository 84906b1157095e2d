"""All registered queries of the library."""

from __future__ import annotations

from narralith.plans import evaluation_queries, graph_queries, name_queries, sequence_queries, text_queries  # noqa: F401
from narralith.plans.registry import QUERIES, SQL  # noqa: F401
