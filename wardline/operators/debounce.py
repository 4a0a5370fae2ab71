"""Replay of the per-service alert debounce over stored alerts.

An alert pass sends all its rows of a service unless that service was sent less
than ``debounce`` seconds ago; only a send moves that clock. This greedy rule
looks back without end, so it is split by time: each bucket of a service's
timeline is reduced to a table "ready-again time at its start -> at its end",
the tables of a service are chained, and with its true start known each bucket
is replayed on its own. Rows are counted per service and pass before anything
else; what follows is bounded by elapsed time, not by the number of alerts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEBOUNCE_SECONDS = 30
BUCKET_SECONDS = 6 * 3600


def service_key(signature_id: Column) -> Column:
    return F.coalesce(signature_id, F.lit("unknown"))


def debounced_sends(
    alerts: DataFrame,
    *,
    key: str = "service",
    ts: str = "ts",
    debounce: int = DEBOUNCE_SECONDS,
    bucket: int = BUCKET_SECONDS,
) -> DataFrame:
    """``key, sent_at, n_alerts``: the passes (whole seconds) that are sent."""
    bucket = max(bucket, debounce)
    passes = alerts.groupBy(F.col(key), F.unix_seconds(ts).alias("_sec")).agg(
        F.count("*").alias("_n")
    )
    buckets = (
        passes.groupBy(key, F.floor(F.col("_sec") / bucket).alias("_bucket"))
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(F.pmod("_sec", F.lit(bucket)).cast("int").alias("at"), "_n")
                )
            ).alias("_passes")
        )
    )
    offsets = F.transform("_passes", lambda p: p["at"])

    def ready_after(start: Column) -> Column:
        return F.aggregate(
            offsets,
            start.cast("int"),
            lambda ready, at: F.when(at >= ready, at + debounce).otherwise(ready),
        )

    # between two passes all start times act alike, so one of each kind is enough
    kinds = F.concat(F.filter(offsets, lambda at: at < debounce), F.array(F.lit(debounce)))
    ends = buckets.select(
        key,
        "_bucket",
        F.transform(
            kinds,
            lambda start: F.struct(
                start.alias("up_to"),
                F.greatest(ready_after(start) - bucket, F.lit(0)).alias("ready"),
            ),
        ).alias("_end"),
    )
    start_at = F.struct(
        F.lit(None).cast("bigint").alias("bucket"),
        F.lit(0).alias("ready"),
        F.array().cast("array<struct<bucket:bigint,ready:int>>").alias("starts"),
    )

    def chain(state: Column, step: Column) -> Column:
        follows = F.coalesce(step["_bucket"] == state["bucket"] + 1, F.lit(False))
        ready = F.when(follows, state["ready"]).otherwise(0)
        return F.struct(
            step["_bucket"].alias("bucket"),
            F.element_at(F.filter(step["_end"], lambda end: end["up_to"] >= ready), 1)["ready"].alias(
                "ready"
            ),
            F.concat(
                state["starts"],
                F.array(F.struct(step["_bucket"].alias("bucket"), ready.alias("ready"))),
            ).alias("starts"),
        )

    starts = (
        ends.groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("_bucket", "_end"))).alias("_steps"))
        .select(
            key, F.explode(F.aggregate("_steps", start_at, chain)["starts"]).alias("_start")
        )
        .select(
            F.col(key).alias("_key"),
            F.col("_start.bucket").alias("_start_bucket"),
            F.col("_start.ready").alias("_ready"),
        )
    )
    replay_from = F.struct(
        F.col("_ready").alias("ready"),
        F.array().cast("array<struct<at:int,_n:bigint>>").alias("sent"),
    )

    def replay(state: Column, step: Column) -> Column:
        sends = step["at"] >= state["ready"]
        return F.struct(
            F.when(sends, step["at"] + debounce).otherwise(state["ready"]).alias("ready"),
            F.when(sends, F.concat(state["sent"], F.array(step)))
            .otherwise(state["sent"])
            .alias("sent"),
        )

    return (
        buckets.join(
            starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_start_bucket"))
        )
        .select(
            key,
            "_bucket",
            F.explode(F.aggregate("_passes", replay_from, replay)["sent"]).alias("_sent"),
        )
        .select(
            key,
            F.timestamp_seconds(F.col("_bucket") * bucket + F.col("_sent.at")).alias("sent_at"),
            F.col("_sent._n").alias("n_alerts"),
        )
    )


def debounced_alerts(alerts: DataFrame, *, key: str = "service", ts: str = "ts", **options) -> DataFrame:
    """The rows of the passes that are sent."""
    sends = debounced_sends(alerts, key=key, ts=ts, **options).select(
        F.col(key).alias("_key"), F.col("sent_at")
    )
    same_pass = F.col(key).eqNullSafe(F.col("_key")) & (F.date_trunc("second", ts) == F.col("sent_at"))
    return alerts.join(sends, same_pass, "left_semi")
