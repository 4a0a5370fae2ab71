"""Debounced alerts: new actionable findings -> outbox of payloads.

Two streaming queries. The first spools the alerts among the store's new rows, with the
time at which its micro-batch noticed them. The second reads of the spool only
which services were noticed when, reduced to one row per service and time within each task, and
keeps in Spark's state store when each service was last sent; a state expires when its service was quiet for
``KEPT_SECONDS``. Services that are due are joined with the spool, and their alerts written as
payloads: one document a batch, written by as many tasks as it needs. Alerts themselves are
never shuffled by service.

Both queries write through Spark's checkpoints: a micro-batch that is repeated after a failure
finds the same rows, the same times and the same state, and replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from wardline.operators.debounce import DEBOUNCE_SECONDS, service_key
from wardline.session import configure, shared_dir
from wardline.sinks.documents import alert_lines, write_documents
from wardline.sinks.reports import actionable
from wardline.sinks.store import FindingsStore
from wardline.streaming.watch import start_stateful, triggered

#: a service quiet for so long, and for the debounce, leaves the state
KEPT_SECONDS = 86_400

SPOOLED = (
    "service string, noticed_at timestamp, finding_id string, ts timestamp, risk_level string,"
    " risk_score int, service_name string, detail string, day date"
)


class _Due(StatefulProcessor):
    """Of the times (microseconds) at which a service was noticed, those at which it is sent."""

    def __init__(self, debounce: int):
        self.debounce = debounce

    def init(self, handle) -> None:
        kept = 1000 * (self.debounce + KEPT_SECONDS)
        self.fired = handle.getValueState("fired", "at bigint", ttlDurationMs=kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.fired.get()[0] if self.fired.exists() else None
        sent = False
        for at in sorted({row["noticed"] for row in rows}):
            if last is None or at - last >= 1_000_000 * self.debounce:
                last, sent = at, True
                yield Row(service=key[0], sent=at)
        if sent:
            self.fired.update((last,))

    def close(self) -> None:
        pass


def _distinct_in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from pa.Table.from_batches([batch]).group_by(batch.schema.names).aggregate([]).to_batches()


class AlertFeed:
    def __init__(
        self,
        store: FindingsStore,
        outbox: str,
        *,
        debounce: int = DEBOUNCE_SECONDS,
        checkpoints: str | None = None,
    ):
        self.store = store
        self.outbox = outbox.rstrip("/")
        self.debounce = debounce
        self.checkpoints = checkpoints or f"{shared_dir(store.spark)}/alerts"

    @property
    def spool(self) -> str:
        return f"{self.outbox}/spool"

    def start_spool(
        self, *, once: bool = False, interval: int = 5, noticed_at: Column | None = None, **options: str
    ) -> StreamingQuery:
        """Keep the alerts among new findings; ``noticed_at`` is the micro-batch's time unless given."""
        alerts = actionable(self.store.stream(**options)).select(
            service_key(F.col("service_id")).alias("service"),
            (F.current_timestamp() if noticed_at is None else noticed_at).alias("noticed_at"),
            F.col("id").alias("finding_id"),
            F.col("timestamp").alias("ts"),
            "risk_level",
            "risk_score",
            "service_name",
            "detail",
        )
        writer = (
            alerts.withColumn("day", F.to_date("noticed_at"))
            .writeStream.queryName("alert_spool")
            .format("parquet")
            .partitionBy("day")
            .option("path", self.spool)
            .option("checkpointLocation", f"{self.checkpoints}/spool")
        )
        return triggered(writer, once, interval).start()

    def start_sends(self, *, once: bool = False, interval: int = 5) -> StreamingQuery:
        """Decide which spooled services are due, and write their payloads."""
        spark = configure(self.store.spark)
        noticed = spark.readStream.schema(SPOOLED).parquet(self.spool)
        noticed = noticed.select("service", F.unix_micros("noticed_at").alias("noticed"))
        noticed = noticed.mapInArrow(_distinct_in_batches, noticed.schema)
        due = noticed.groupBy("service").transformWithState(
            _Due(self.debounce), "service string, sent bigint", "Append", "ProcessingTime"
        )
        writer = (
            due.writeStream.queryName("alert_sends")
            .option("checkpointLocation", f"{self.checkpoints}/sends")
            .foreachBatch(self.send_batch)
        )
        return start_stateful(writer, once, interval)

    def start(self, *, once: bool = False, interval: int = 5, **options) -> StreamingQuery:
        """Both queries; the second one is returned. ``once`` stops after what has arrived so far."""
        spool = self.start_spool(once=once, interval=interval, **options)
        if once:
            spool.awaitTermination()
        return self.start_sends(once=once, interval=interval)

    def send_batch(self, due: DataFrame, batch_id: int) -> None:
        """Write the alerts of the services that are due as payloads of this batch."""
        spark = due.sparkSession
        configure(spark)
        sends = f"{self.outbox}/sends/batch_id={batch_id}"
        due.write.mode("overwrite").parquet(sends)
        due = spark.read.schema("service string, sent bigint").parquet(sends)
        first, last = due.agg(F.min("sent"), F.max("sent")).first()
        if first is None:
            return
        # only the spool's folders and files of these times are read
        ends = [F.timestamp_micros(F.lit(end)) for end in (first, last)]
        alerts = spark.read.schema(SPOOLED).parquet(self.spool)
        alerts = alerts.filter(F.col("day").between(*map(F.to_date, ends)) & F.col("noticed_at").between(*ends))
        on = (alerts["service"] == due["service"]) & (F.unix_micros(alerts["noticed_at"]) == due["sent"])
        sent = alerts.join(due, on, "left_semi").withColumn("payload", F.lit("alerts"))
        # each batch replaces its own folder only
        write_documents(alert_lines(sent, "payload"), "payload", f"{self.outbox}/payloads/batch_id={batch_id}")
