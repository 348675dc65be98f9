"""Named queries over the supplied tables, each with its SQL counterpart."""

from themescope.catalog import clustering, comparing, profiling, reports, storage, texts, vectors  # noqa: F401
from themescope.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
