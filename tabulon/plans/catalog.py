"""All queries of the library."""

from tabulon.plans import batch_queries, element_queries, ingest_queries, ledger_queries, similarity_queries, text_queries, tool_queries  # noqa: F401  they register their queries
from tabulon.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
