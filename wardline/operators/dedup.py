"""Top-n per group, first per window, latest per id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int, *, salts: int = 32
) -> DataFrame:
    """The first ``n`` rows of each group under a total ``order``.

    A group may hold a large share of all rows. Every task first keeps only its
    own best ``n`` per group; these go to ``salts`` reducers per group, which
    again keep ``n`` each, before one reducer per group takes the final ``n``.
    """
    salted = df.withColumn("_salt", F.spark_partition_id() % salts)
    rank = F.row_number()
    within_salt = Window.partitionBy(*keys, "_salt").orderBy(*order)
    within_group = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rank", rank.over(within_salt))
        .filter(F.col("_rank") <= n)
        .drop("_rank", "_salt")
        .withColumn("_rank", rank.over(within_group))
        .filter(F.col("_rank") <= n)
        .drop("_rank")
    )


def first_per_window(
    events: DataFrame, keys: list[str], *, seconds: int = 10, ts: str = "ts"
) -> DataFrame:
    """First event of each ``keys`` value within fixed windows of ``seconds``.

    Aggregation starts before the shuffle, so a hot key sends one row per task.
    """
    rest = [c for c in events.columns if c != ts]
    slot = F.floor(F.unix_seconds(ts) / seconds)
    first = F.min_by(F.struct(*rest), F.struct(ts, *_sortable(events, rest)))
    return (
        events.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], slot.alias("_slot"))
        .agg(first.alias("_first"), F.min(ts).alias(ts))
        .select(*[F.col(f"_first.{c}") if c != ts else F.col(ts) for c in events.columns])
    )


def _sortable(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns usable as a tie break (maps have no order)."""
    kinds = dict(df.dtypes)
    return [c for c in columns if "map<" not in kinds[c]]


def latest_per_id(df: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """One row per id: the newest write. Each task sends one row per id at most."""
    newest = Window.partitionBy(*keys).orderBy(*newest_first)
    return (
        df.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")
    )
