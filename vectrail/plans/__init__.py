"""One runnable query per operator over the given tables, each with its SQL counterpart.

Importing this package fills ``registry.QUERIES`` and ``registry.SQL``.
"""

from . import corpora, files, messages, runs, search, streams, tables, text, vectors  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
