"""Delivery of routed alerts: an outbox of batches and a ledger of attempts.

A round first notes the attempts it is about to make, then makes them in tasks, then
notes how they ended. Each note is a folder of its own, named by the round, so a round that is
repeated replaces its notes, and what a lost round had begun is due again after its pause.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.text import at_utc
from wardline.operators.routes import FAILED, LEDGER, SENDING, SENT, due_deliveries, routed_batches
from wardline.sinks.versions import _read

BATCHES = "batch_id string, channel string, n_alerts bigint"


class Deliveries:
    def __init__(self, spark: SparkSession, path: str, **limits: int):
        self.spark, self.path, self.limits = spark, path.rstrip("/"), limits

    def enqueue(self, routes: DataFrame, batch: int | str) -> None:
        """Put a batch's routed alerts (with ``channel``) up for delivery; again, it replaces itself."""
        rows = routed_batches(routes.withColumn("batch_id", F.lit(str(batch))))
        rows.select("batch_id", "channel", "n_alerts").write.mode("overwrite").parquet(f"{self.path}/batches/part={batch}")

    def batches(self) -> DataFrame:
        return _read(self.spark, f"{self.path}/batches", f"{BATCHES}, part string").drop("part")

    def ledger(self) -> DataFrame:
        return _read(self.spark, f"{self.path}/ledger", f"{LEDGER}, round string, step string").drop("round", "step")

    def _note(self, rows: DataFrame, number: int, step: str) -> DataFrame:
        path = f"{self.path}/ledger/round={number}/step={step}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def deliver(self, number: int, now: datetime, send: Callable[[str, str, int], bool]) -> DataFrame:
        """One round: ``send(batch_id, channel, attempt)`` for what is due; the attempts and how they ended."""
        due = due_deliveries(self.batches(), self.earlier(number), now, **self.limits)
        at = at_utc(now).alias("at")
        begun = self._note(due.select("batch_id", "channel", "attempt", F.lit(SENDING).alias("state"), at), number, "begun")

        def attempts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ended = [
                    SENT if send(r.batch_id, r.channel, r.attempt) else FAILED for r in batch.itertuples()
                ]
                yield batch.assign(state=ended)

        return self._note(begun.mapInPandas(attempts, begun.schema), number, "ended")

    def earlier(self, number: int) -> DataFrame:
        """The ledger of the rounds before."""
        rows = _read(self.spark, f"{self.path}/ledger", f"{LEDGER}, round string, step string")
        return rows.filter(F.col("round").cast("int") < number).drop("round", "step")
