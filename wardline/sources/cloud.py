"""Audit records of cloud providers, one JSON text a line, read by shape when they are needed.

Each line is parsed to a VARIANT once; fields are looked up under the names that
providers give them, the first that is there. A line may hold one record or a list of
records under ``Records`` or ``value``. What cannot be used stays a row, with the reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.matching import keep_host_matches, with_computed
from wardline.registry import Registry
from wardline.schemas import as_events

# Where providers' audit records have the time, the called service, the
# operation, the caller, the caller's address and the record's own id.
FIELDS = {
    "time": ["$.eventTime", "$.timestamp", "$.time"],
    "service": ["$.eventSource", "$.protoPayload.serviceName", "$.properties.host", "$.host"],
    "operation": ["$.eventName", "$.protoPayload.methodName", "$.operationName", "$.operation"],
    "actor": [
        "$.userIdentity.arn",
        "$.protoPayload.authenticationInfo.principalEmail",
        "$.identity.claims.upn",
        "$.user",
    ],
    "address": ["$.sourceIPAddress", "$.protoPayload.requestMetadata.callerIp", "$.callerIpAddress"],
    "record_id": ["$.eventID", "$.insertId", "$.correlationId", "$.id"],
}
# Names of lists of records.
LISTS = ["$.Records", "$.value"]


def _field(name: str) -> str:
    paths = ", ".join(f"try_variant_get(_record, '{path}', 'string')" for path in FIELDS[name])
    return f"nullif(trim(coalesce({paths})), '')"


def parse_records(lines: DataFrame) -> DataFrame:
    """``host, ts, line`` -> one row per record: its fields, ``ts`` (its own time) and ``reason``.

    ``reason`` is null for usable records, else ``not JSON``, ``no record``, ``no service`` or
    ``no time``. ``part`` numbers the records of a line from 0.
    """
    parsed = with_computed(
        lines.select("host", F.col("ts").alias("logged_at"), "line"), _line="try_parse_json(line)"
    )
    lists = ", ".join(f"try_variant_get(_line, '{path}', 'array<variant>')" for path in LISTS)
    records = parsed.selectExpr("*", f"posexplode_outer(coalesce({lists}, array(_line))) AS (part, _record)")
    records = with_computed(records, **{f"_{name}": _field(name) for name in FIELDS})
    # a time is text with a zone, or milliseconds since 1970
    time = (
        "coalesce(try_to_timestamp(_time), timestamp_millis(CASE WHEN _time RLIKE '^[0-9]{11,14}$'"
        " THEN CAST(_time AS BIGINT) END))"
    )
    return with_computed(records, _ts=time).selectExpr(
        "host",
        "logged_at",
        "line",
        "coalesce(part, 0) AS part",
        "_ts AS ts",
        "lower(_service) AS service",
        "_operation AS operation",
        "_actor AS actor",
        "_address AS address",
        "_record_id AS record_id",
        "CASE WHEN _line IS NULL THEN 'not JSON'"
        " WHEN _record IS NULL OR schema_of_variant(_record) NOT LIKE 'OBJECT%' THEN 'no record'"
        " WHEN _service IS NULL THEN 'no service' WHEN _ts IS NULL THEN 'no time' END AS reason",
    )


def cloud_log_events(lines: DataFrame, registry: Registry) -> DataFrame:
    """``host, ts, line``: calls of known services, at the record's own time.

    A record without an id of its own is known by its place and its line's text.
    """
    usable = parse_records(lines).filter("reason IS NULL").withColumn("remote_host", F.col("service"))
    found = keep_host_matches(usable, "remote_host", registry).selectExpr(
        "*",
        "address AS remote_ip",
        "443 AS port",
        "'cloud' AS protocol",
        "concat_ws(' ', operation, actor) AS body_snippet",
    )
    return as_events(
        found,
        source="cloud_log",
        type_="network_connection",
        key=["remote_host", "operation", "actor", "coalesce(record_id, concat(part, ':', md5(line)))"],
    )


def cloud_log_rejects(lines: DataFrame) -> DataFrame:
    """``host, logged_at, part, reason, line``: records that give no event, and why."""
    return parse_records(lines).filter("reason IS NOT NULL").select("host", "logged_at", "part", "reason", "line")
