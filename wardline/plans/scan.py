"""The scan: events -> matched, scored, governed findings."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.risk import has_severity, risk_level, risk_score
from wardline.functions.text import binary_name_sql, extract_host_sql, spark_regex
from wardline.operators.contains import join_pattern_owner
from wardline.operators.matching import (
    sql_texts,
    usable_patterns,
    with_computed,
    with_dlp_matches,
    with_signature_id,
    with_signature_info,
)
from wardline.operators.ranges import join_range_owner
from wardline.operators.rules import apply_policy
from wardline.policy import Policy
from wardline.registry import Registry
from wardline.schemas import EVENT_FIELDS

REDACTED = "[REDACTED]"


_HOST = f"""CASE type
    WHEN 'network_connection' THEN remote_host
    WHEN 'browser_history' THEN {extract_host_sql("url")}
END"""
_PROGRAM = f"""CASE type
    WHEN 'process' THEN name
    WHEN 'shell_history' THEN {binary_name_sql("command")}
END"""
_TEXT = "CASE type WHEN 'process' THEN cmdline WHEN 'shell_history' THEN command END"

# A code finding is its own match; all others have those found in their text.
_DLP_MATCHES = f"""CASE WHEN type = 'codebase_file' THEN array(named_struct(
        'pattern_id', matched_text,
        'description', concat("Pattern '", matched_text, "' found in source file"),
        'severity', 'critical'))
    ELSE dlp_matches
END"""

_SERVICE = "coalesce(signature.name, 'unknown service')"
_DETAIL = f"""CASE type
    WHEN 'network_connection' THEN concat({_SERVICE}, ' — connection to ', remote_host, ':', port)
    WHEN 'process' THEN concat({_SERVICE}, " — process '", name, "' running (pid ", pid, ')')
    WHEN 'shell_history' THEN
        concat({_SERVICE}, ' — found in ', shell, ' history: `', command, '`')
    WHEN 'browser_history' THEN concat({_SERVICE}, ' — visited via ', browser, ': ', url)
    WHEN 'codebase_file' THEN concat("DLP match '", matched_text, "' in ", file_path,
        coalesce(concat(':', line_number), ''))
END"""


_AGENT = "CASE WHEN type = 'network_connection' AND signature_id IS NULL THEN http_headers['user-agent'] END"
_ADDRESS = "CASE WHEN type = 'network_connection' AND signature_id IS NULL THEN remote_ip END"


def match_events(
    events: DataFrame,
    registry: Registry,
    *,
    ranges: DataFrame | None = None,
    agents: DataFrame | None = None,
) -> DataFrame:
    """Add ``signature_id``, ``signature`` and ``dlp_matches``; drop what matches nothing.

    With ``ranges`` (cidr, owner: a signature's id), a connection whose host names
    no service belongs to the owner of the longest range around its address; with
    ``agents`` (pattern, owner), one still without a service to the smallest owner of a pattern in its user agent.
    """
    texts = with_computed(events, _host=_HOST, _program=_PROGRAM, _text=_TEXT)
    matched = with_signature_id(texts, "_host", "_program", registry)
    if ranges is not None:
        matched = join_range_owner(with_computed(matched, _address=_ADDRESS), "_address", ranges, "_owner")
        matched = matched.withColumn("signature_id", F.coalesce("signature_id", "_owner")).drop("_address", "_owner")
    if agents is not None:
        matched = join_pattern_owner(with_computed(matched, _agent=_AGENT), "_agent", agents, "_client")
        matched = matched.withColumn("signature_id", F.coalesce("signature_id", "_client")).drop("_agent", "_client")
    # only code findings have matches without a signature
    matched = matched.filter("signature_id IS NOT NULL OR type = 'codebase_file'")
    matched = (
        with_dlp_matches(matched, "_text", registry)
        .withColumn("dlp_matches", F.expr(_DLP_MATCHES))
        .drop("_host", "_program", "_text")
    )
    return with_signature_info(matched, registry)


def score_events(
    events: DataFrame,
    registry: Registry,
    *,
    approved_ids: Collection[str] | None = None,
    ranges: DataFrame | None = None,
    agents: DataFrame | None = None,
) -> DataFrame:
    """Matched events with ``tags``, ``detail``, ``risk_score`` and ``risk_level``.

    Without ``approved_ids`` no service counts as unapproved.
    """
    unapproved = "false"
    if approved_ids is not None:
        approved = f"signature_id IN ({sql_texts(approved_ids)})" if approved_ids else "false"
        unapproved = f"NOT coalesce({approved}, false)"
    score = risk_score(
        "signature.risk_base",
        has_severity("dlp_matches", "critical"),
        has_severity("dlp_matches", "high"),
        unapproved,
    )
    return (
        match_events(events, registry, ranges=ranges, agents=agents)
        .selectExpr(
            "*",
            "signature.name AS service_name",
            "signature.tags AS tags",
            f"{_DETAIL} AS detail",
            f"{score} AS risk_score",
        )
        .withColumn("risk_level", F.expr(risk_level("risk_score")))
        .drop("signature")
    )


def analyze(
    events: DataFrame,
    registry: Registry,
    policy: Policy,
    *,
    approved_ids: Collection[str] | None = None,
    ranges: DataFrame | None = None,
    agents: DataFrame | None = None,
) -> DataFrame:
    """EVENT rows -> FINDING rows. One event gives at most one finding, of the same id."""
    scored = score_events(events, registry, approved_ids=approved_ids, ranges=ranges, agents=agents)
    governed = apply_policy(scored, policy)
    return governed.selectExpr(
        "event_id AS finding_id",
        "ts",
        "source",
        "signature_id",
        "service_name",
        "risk_score",
        "risk_level",
        "dlp_matches",
        "detail",
        "policy_action",
        "matched_rule",
        f"struct({', '.join(EVENT_FIELDS)}) AS event",
    )


def redact(findings: DataFrame, registry: Registry) -> DataFrame:
    """Blank every text its matched signature's patterns find, in detail and event."""
    registry = usable_patterns(findings.sparkSession, registry)

    def blank(text: Column) -> Column:
        cleaned = F.when(F.lit(False), text)
        for sig in registry.all():
            if sig.dlp_patterns:
                without = text
                for p in sig.dlp_patterns:
                    without = F.regexp_replace(without, spark_regex(p.pattern), REDACTED)
                cleaned = cleaned.when(F.col("signature_id") == sig.id, without)
        return cleaned.otherwise(text)

    event = F.col("event")
    for name in ("cmdline", "command", "url"):
        event = event.withField(name, blank(F.col(f"event.{name}")))
    return findings.withColumn("detail", blank(F.col("detail"))).withColumn("event", event)
