"""Row shapes shared by all operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

EVENT_FIELDS = {
    "event_id": "string",
    "source": "string",
    "ts": "timestamp",
    "type": "string",
    "remote_host": "string",
    "remote_ip": "string",
    "port": "int",
    "protocol": "string",
    "http_headers": "map<string,string>",
    "body_snippet": "string",
    "pid": "bigint",
    "name": "string",
    "cmdline": "string",
    "exe_path": "string",
    "url": "string",
    "title": "string",
    "browser": "string",
    "command": "string",
    "shell": "string",
    "history_file": "string",
    "file_path": "string",
    "line_number": "int",
    "matched_text": "string",
}
EVENT = ", ".join(f"{name} {kind}" for name, kind in EVENT_FIELDS.items())

DLP_MATCH = "struct<pattern_id:string,description:string,severity:string>"

SIGNATURE = (
    "id string, name string, version string, risk_base int, domains array<string>, "
    "ip_ranges array<string>, process_names array<string>, "
    "dlp_patterns array<struct<id:string,pattern:string,severity:string>>, "
    "user_agents array<string>, tags array<string>, privacy_policy_url string"
)

RULE = (
    "policy_id string, rule_idx int, id string, description string, trigger string, "
    "exclude_ids array<string>, tags array<string>, action string, notify array<string>, "
    "min_score int, score_override int"
)

FINDING = (
    "finding_id string, ts timestamp, source string, signature_id string, "
    f"service_name string, risk_score int, risk_level string, dlp_matches array<{DLP_MATCH}>, "
    "detail string, policy_action string, matched_rule string, event struct<"
    + ",".join(f"{name}:{kind}" for name, kind in EVENT_FIELDS.items())
    + ">"
)


def as_events(
    df: DataFrame, *, source: str, type_: str, key: list[str], timed: str = "true"
) -> DataFrame:
    """Shape ``df`` into EVENT rows; fields it does not carry become null.

    The id is a hash of the source, the natural key (SQL expressions) and the
    event time, so a retried task or a replayed micro-batch gives the same id.
    A null part has a mark of its own, so that parts never change places. With
    ``timed`` an SQL condition, only rows that meet it have the time in their id.
    """
    present = set(df.columns)
    fields = {
        name: f"CAST({name if name in present else 'NULL'} AS {kind}) AS {name}"
        for name, kind in EVENT_FIELDS.items()
    }
    time = f"CASE WHEN {timed} THEN CAST(unix_micros(ts) AS string) END"
    parts = ", ".join(f"coalesce({part}, '\\u0002')" for part in [f"'{source}'", *key, time])
    fields["event_id"] = f"sha2(concat_ws('\\u0001', {parts}), 256) AS event_id"
    fields["source"] = f"'{source}' AS source"
    fields["type"] = f"'{type_}' AS type"
    return df.selectExpr(*fields.values())
