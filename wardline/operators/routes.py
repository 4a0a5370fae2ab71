"""Which channels an alert goes to, and which deliveries are due.

A rule names the channels to notify. Alerts are counted per batch and channel, so what
is to be delivered is one row per batch and channel, however many alerts there are. The ledger holds one
row per attempt (batch, channel, attempt, state, time); a delivery is due again after
a failure, or after an attempt whose end was never noted, when its pause is over.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import at_utc
from wardline.operators.matching import sql_text, sql_texts
from wardline.policy import Policy

MOST_ATTEMPTS = 5
PAUSE_SECONDS = 60
#: states of an attempt
SENDING, SENT, FAILED = "sending", "sent", "failed"

LEDGER = "batch_id string, channel string, attempt int, state string, at timestamp"


def alert_routes(alerts: DataFrame, policy: Policy, *, default: tuple[str, ...] = ()) -> DataFrame:
    """``alerts`` with ``channel``: a row for each channel of the alert's ``matched_rule``.

    A rule's own channels count once each; alerts of rules without any, or of none,
    go to ``default``.
    """
    cases = [
        f"WHEN {sql_text(rule.id)} THEN array({sql_texts(dict.fromkeys(rule.notify))})"
        for rule in policy.rules
        if rule.notify
    ]
    others = f"CAST(array({sql_texts(dict.fromkeys(default))}) AS array<string>)"
    found = f"CASE matched_rule {' '.join(cases)} ELSE {others} END" if cases else others
    return alerts.select("*", F.explode(F.expr(found)).alias("channel"))


def routed_batches(routes: DataFrame, batch_id: str = "batch_id") -> DataFrame:
    """``batch_id, channel, n_alerts``: what is to be delivered."""
    return routes.groupBy(F.col(batch_id).cast("string").alias("batch_id"), "channel").agg(
        F.count("*").alias("n_alerts")
    )


def due_deliveries(
    batches: DataFrame,
    ledger: DataFrame,
    now: datetime,
    *,
    most: int = MOST_ATTEMPTS,
    pause: int = PAUSE_SECONDS,
) -> DataFrame:
    """``batches`` that are due, with the number ``attempt`` of their next one.

    Repeated ledger rows count once: attempts are known by their numbers. The pause doubles
    with each attempt.
    """
    tried = ledger.groupBy("batch_id", "channel").agg(
        F.max("attempt").alias("_tried"),
        F.bool_or(F.col("state") == SENT).alias("_sent"),
        F.max("at").alias("_last"),
    )
    waited = F.unix_seconds(at_utc(now)) - F.unix_seconds("_last")
    ready = F.col("_tried").isNull() | (
        ~F.col("_sent") & (F.col("_tried") < most) & (waited >= F.expr(f"{pause} * power(2, _tried - 1)"))
    )
    found = batches.join(tried, ["batch_id", "channel"], "left").filter(ready)
    return found.select(*batches.columns, (F.coalesce("_tried", F.lit(0)) + 1).alias("attempt"))
