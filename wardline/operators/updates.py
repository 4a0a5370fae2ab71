"""Which signatures are due for an update."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import at_utc

UPDATE_HOURS = 24


def updates_due(
    last_updates: DataFrame,
    as_of: datetime,
    *,
    interval_hours: int = UPDATE_HOURS,
    enabled: bool = True,
) -> DataFrame:
    """``id, last_updated`` rows whose age reached the interval; none when disabled."""
    age = F.greatest(
        F.unix_seconds(at_utc(as_of)) - F.unix_seconds(F.col("last_updated")), F.lit(0)
    )
    return (
        last_updates.withColumn("age_seconds", age)
        .filter(F.lit(enabled) & (F.col("age_seconds") >= interval_hours * 3600))
    )
