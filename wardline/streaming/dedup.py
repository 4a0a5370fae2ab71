"""First connection per key and capture window, on a stream, without losing late rows.

The state of a key is the windows it was seen in, back to ``horizon`` seconds before the
newest one it knew. A row of a window further back may be a repetition or a first
one; the state cannot tell any more, so the row is passed on marked ``late``, and so is
a row without a time. Late rows stand beside the first ones in one table (``DedupFeed``),
and ``DedupFeed.settled`` decides on them over all that was kept. A key that was quiet for ``quiet``
seconds is forgotten by a timer; if it comes back its rows count as first ones.

A key may hold a large share of the stream, so rows are reduced to one per key and window
within each Arrow batch before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from wardline.operators import dedup
from wardline.session import configure, shared_dir
from wardline.streaming.watch import start_stateful

# Fixed value: seconds of one capture window.
WINDOW_SECONDS = 10
HORIZON_SECONDS = 3600
QUIET_SECONDS = 86_400


def _window(ts: str, seconds: int) -> Column:
    return F.expr(f"unix_seconds({ts}) div {seconds} * {seconds}")


class _FirstSeen(StatefulProcessor):
    """Passes on the first row of each window of a key, and rows it cannot judge."""

    def __init__(self, fields: list[str], horizon: int, quiet: int):
        self.fields, self.horizon, self.quiet_ms = fields, horizon, 1000 * quiet

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "start bigint", "at bigint")
        self.last = handle.getValueState("last", "newest bigint, touched bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        known = self.last.exists()
        # judged by what was known before this batch, so the order within it does not matter
        before = self.last.get()[0] if known else None
        newest, added = before, {}
        for row in rows:
            start = row["_start"]
            if start is None or (before is not None and start < before - self.horizon):
                yield self.passed(row, True)
                continue
            if start in added or (known and self.seen.containsKey((start,))):
                continue
            added[start] = now
            newest = start if newest is None else max(newest, start)
            yield self.passed(row, False)
        for start, at in added.items():
            self.seen.updateValue((start,), (at,))
        if newest is None:
            return
        if newest != before and known:
            for (start,) in list(self.seen.keys()):
                if start < newest - self.horizon:
                    self.seen.removeKey((start,))
        self.last.update((newest, now))
        if not known:
            self.handle.registerTimer(now + self.quiet_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.last.exists():
            return iter([])
        due = self.last.get()[1] + self.quiet_ms
        if due <= timerValues.getCurrentProcessingTimeInMs():
            self.seen.clear()
            self.last.clear()
        else:
            self.handle.registerTimer(due)
        return iter([])

    def passed(self, row: Row, late: bool) -> Row:
        return Row(**{name: row[name] for name in self.fields}, late=late)

    def close(self) -> None:
        pass


def _one_per_batch(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The earliest row of each key and window of a batch; rows without a time all stay."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        places = table.select([*keys, "_start", "ts"]).append_column("_at", pa.array(range(table.num_rows)))
        places = places.sort_by([("ts", "ascending"), ("_at", "ascending")])
        timed = places.filter(places["_start"].is_valid())
        first = timed.group_by([*keys, "_start"], use_threads=False).aggregate([("_at", "first")])
        kept = first["_at_first"].to_pylist() + places.filter(places["_start"].is_null())["_at"].to_pylist()
        yield batch.take(pa.array(sorted(kept), pa.int64()))


def first_per_window(
    events: DataFrame,
    keys: list[str],
    *,
    seconds: int = WINDOW_SECONDS,
    horizon: int = HORIZON_SECONDS,
    quiet: int = QUIET_SECONDS,
) -> DataFrame:
    """The columns of ``events`` and ``late``: one row per key and fixed window of ``ts``, and all late rows."""
    configure(events.sparkSession)
    fields = events.columns
    marked = events.withColumn("_start", _window("ts", seconds))
    reduced = marked.mapInArrow(lambda batches: _one_per_batch(batches, keys), marked.schema)
    shape = T.StructType([*events.schema.fields, T.StructField("late", T.BooleanType())])
    return reduced.groupBy(*keys).transformWithState(
        _FirstSeen(fields, horizon, quiet), shape, "Append", "ProcessingTime"
    )


class DedupFeed:
    """First rows and late rows of a stream in one table, partitioned by ``late``."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        keys: list[str],
        *,
        seconds: int = WINDOW_SECONDS,
        checkpoints: str | None = None,
        **options,
    ):
        self.spark, self.path, self.keys, self.seconds = spark, path.rstrip("/"), keys, seconds
        self.checkpoints = checkpoints or f"{shared_dir(spark)}/dedup"
        self.options = options

    def start(self, events: DataFrame, *, once: bool = False, interval: int = 10) -> StreamingQuery:
        found = first_per_window(events, self.keys, seconds=self.seconds, **self.options)
        writer = (
            found.writeStream.queryName("dedup")
            .format("parquet")
            .partitionBy("late")
            .option("path", self.path)
            .option("checkpointLocation", self.checkpoints)
        )
        return start_stateful(writer, once, interval)

    def rows(self) -> DataFrame:
        # names of folders come back as text
        rows = self.spark.read.parquet(self.path)
        return rows.withColumn("late", F.col("late").cast("boolean"))

    def late(self) -> DataFrame:
        return self.rows().filter("late").drop("late")

    def settled(self) -> DataFrame:
        """One row per key and window over first and late rows; rows without a time all stay."""
        rows = self.rows().drop("late")
        timed = dedup.first_per_window(rows.filter("ts IS NOT NULL"), self.keys, seconds=self.seconds)
        return timed.unionByName(rows.filter("ts IS NULL"))


def first_within_delay(events: DataFrame, keys: list[str], *, delay: str) -> DataFrame:
    """One row per key until ``delay`` of event time has passed since it.

    Rows more than ``delay`` behind the newest row are left out.
    """
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
