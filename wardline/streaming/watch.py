"""The watch: one streaming query per telemetry table, all into one findings store.

A table that fails stops its own query only. Signatures and policy are loaded
anew for every micro-batch. A micro-batch replayed after a failure writes the
same finding ids again, which readers of the store see once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from wardline.plans.scan import analyze
from wardline.policy import Policy
from wardline.registry import Registry
from wardline.session import configure, shared_dir
from wardline.sinks.store import FindingsStore
from wardline.sources.select import EVENT_BUILDERS

# Fixed value: seconds between passes of a background watch.
INTERVAL_SECONDS = 300


class Watch:
    def __init__(
        self,
        store: FindingsStore,
        load_registry: Callable[[], Registry],
        load_policy: Callable[[], Policy],
        *,
        checkpoints: str | None = None,
    ):
        self.store = store
        self.load_registry = load_registry
        self.load_policy = load_policy
        self.checkpoints = checkpoints or f"{shared_dir(store.spark)}/watch"

    def write_batch(self, name: str, batch: DataFrame) -> None:
        """Scan one micro-batch of table ``name``."""
        configure(batch.sparkSession)
        registry = self.load_registry()
        # what is kept must not depend on how the stream was cut
        options = {"per_profile": None} if name == "visits" else {}
        events = EVENT_BUILDERS[name](batch, registry, **options)
        self.store.append(analyze(events, registry, self.load_policy()), feed=name)

    def start(
        self, name: str, table: DataFrame, *, once: bool = False, interval: int = INTERVAL_SECONDS
    ) -> StreamingQuery:
        """Watch the stream ``table``; ``once`` stops after what has arrived so far."""
        writer = (
            table.writeStream.queryName(f"watch_{name}")
            .option("checkpointLocation", f"{self.checkpoints}/{name}")
            .foreachBatch(lambda batch, _: self.write_batch(name, batch))
        )
        return triggered(writer, once, interval).start()


def start_stateful(writer: DataStreamWriter, once: bool, interval: int) -> StreamingQuery:
    """Start a query whose state goes by processing time.

    Its operator always asks for another batch, so with ``once`` such batches without
    data are left out; the query takes the setting over when it starts.
    """
    conf, name = SparkSession.active().conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    try:
        if once:
            conf.set(name, "false")
        return triggered(writer, once, interval).start()
    finally:
        conf.set(name, before)


def triggered(writer: DataStreamWriter, once: bool, interval: int) -> DataStreamWriter:
    if once:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{interval} seconds")
