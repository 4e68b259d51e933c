"""All queries of the library, by name."""

from tessera.plans import documents, metadata, scans, stream, subtitles, transcript  # noqa: F401
from tessera.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
