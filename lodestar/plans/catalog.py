"""Registry of the queries this engine answers and their SQL oracles."""

from . import graph_queries, store_queries, text_queries  # noqa: F401
from .tables import ORACLES, QUERIES  # noqa: F401
