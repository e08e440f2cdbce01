"""All queries of the engine outside the training-data subpackage."""

from basalt.plans import table_queries as _table_queries  # noqa: F401  (registers its queries)
from basalt.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
