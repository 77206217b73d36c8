"""All registered queries in one place."""

from __future__ import annotations

from . import retrieval_queries, table_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
from .retrieval_queries import flagship  # noqa: F401
