"""All queries of the award operators."""

from . import queries, record_queries, search_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
