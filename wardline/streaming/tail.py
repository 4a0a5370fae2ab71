"""Live report: each newly stored finding as a line."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wardline.sinks.reports import stored_line
from wardline.sinks.store import FindingsStore


def live_lines(store: FindingsStore, **options: str) -> DataFrame:
    """A stream of report lines. Its checkpoint remembers files, not times, so
    findings of equal times are never lost."""
    return store.stream(**options).select(stored_line().alias("line"))
