"""Jobs, input views and registered queries."""

from . import pixel_queries, record_queries, vector_queries  # noqa: F401  (they register their queries)
from . import file_queries  # noqa: F401  (uses theirs)
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
