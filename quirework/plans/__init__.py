"""The catalogue's queries and their SQL."""

from quirework.plans import book_flow_queries, encoding_queries, flow_queries, lookup_queries, move_queries, proposal_queries, record_queries, similar_queries, source_queries, text_queries  # noqa: F401  (they register their queries)
from quirework.plans.registry import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
