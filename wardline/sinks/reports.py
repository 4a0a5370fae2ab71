"""Report lines and JSON rows as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import html_escape, pad_right, rfc3339
from wardline.sinks.store import event_json

# Shown names of actions, cell colors of levels.
SHOWN_ACTION = {"allow": "ALLOWED", "warn": "WARN", "block": "BLOCKED"}
LEVEL_COLOR = {"CRITICAL": "#f44336", "HIGH": "#ff9800", "MEDIUM": "#ffc107", "LOW": "#4caf50"}
ACTIONABLE_LEVELS = ["HIGH", "CRITICAL"]
NOTHING_FOUND = "No findings."
MARKDOWN_HEAD = ["| Risk | Service | Detail |", "|------|---------|--------|"]


def _service() -> Column:
    return F.coalesce("service_name", F.lit("unknown"))


def shown_action(action: Column) -> Column:
    shown = F.when(F.lit(False), action)
    for name, text in SHOWN_ACTION.items():
        shown = shown.when(action == name, text)
    return shown


def actionable(findings: DataFrame) -> DataFrame:
    """Only what alerts are sent for."""
    return findings.filter(F.col("risk_level").isin(ACTIONABLE_LEVELS))


def scan_line() -> Column:
    """``[level] [action] (rule: r)  service  detail [DLP: a, b]`` of a FINDING row."""
    rule = F.coalesce(F.concat(F.lit(" (rule: "), "matched_rule", F.lit(")")), F.lit(""))
    ids = F.array_join(F.transform("dlp_matches", lambda match: match["pattern_id"]), ", ")
    dlp = F.when(F.size("dlp_matches") > 0, F.concat(F.lit(" [DLP: "), ids, F.lit("]")))
    return F.concat(
        F.lit("["), pad_right(F.col("risk_level"), 8), F.lit("] ["),
        pad_right(shown_action(F.col("policy_action")), 7), F.lit("]"), rule, F.lit("  "),
        pad_right(_service(), 20), F.lit("  "), "detail", F.coalesce(dlp, F.lit("")),
    )


def stored_line() -> Column:
    """``[level]  service detail  (time)`` of a stored row."""
    return F.concat(
        F.lit("["), pad_right(F.col("risk_level"), 8), F.lit("]  "), pad_right(_service(), 20),
        F.lit(" "), "detail", F.lit("  ("), rfc3339(F.col("timestamp")), F.lit(")"),
    )


def markdown_row() -> Column:
    return F.concat(F.lit("| "), "risk_level", F.lit(" | "), _service(), F.lit(" | "), "detail", F.lit(" |"))


def html_row(*, time: Column | None = None, escape_service: bool = False) -> Column:
    """One table row. ``time`` defaults to a finding's ``ts`` to the second.

    Scan reports leave the service name as it is, stored reports escape it.
    """
    color = F
    for level, code in LEVEL_COLOR.items():
        color = color.when(F.col("risk_level") == level, code)
    if time is None:
        time = F.date_format("ts", "yyyy-MM-dd HH:mm:ss 'UTC'")
    service = html_escape(_service()) if escape_service else _service()
    head = '<tr><td style="background:'
    return F.concat(
        F.lit(head), color.otherwise(LEVEL_COLOR["LOW"]),
        F.lit(';color:#fff;font-weight:bold;padding:4px 8px">'), "risk_level",
        F.lit("</td><td>"), service, F.lit("</td><td>"), html_escape(F.col("detail")),
        F.lit('</td><td style="color:#888;font-size:0.9em">'), time, F.lit("</td></tr>"),
    )


def stored_html_row() -> Column:
    return html_row(time=html_escape(rfc3339(F.col("timestamp"))), escape_service=True)


def stored_json() -> Column:
    """The seven report columns as one JSON object, null service kept."""
    row = F.struct(
        "id", rfc3339(F.col("timestamp")).alias("timestamp"), "source", "service_name",
        "risk_score", "risk_level", "detail",
    )
    return F.to_json(row, {"ignoreNullFields": "false"})


def finding_json() -> Column:
    """A whole FINDING row as one JSON object, its event with the fields of its type."""
    flat = F.to_json(
        F.struct(
            F.col("finding_id").alias("id"),
            rfc3339(F.col("ts"), "Z").alias("timestamp"),
            "signature_id", "service_name", "risk_score",
            F.lower("risk_level").alias("risk_level"),
            "dlp_matches", "detail", "policy_action", "matched_rule",
        ),
        {"ignoreNullFields": "false"},
    )
    without_end = F.substring(flat, F.lit(1), F.length(flat) - 1)
    return F.concat(without_end, F.lit(',"event":'), event_json(F.col("event")), F.lit("}"))


def or_nothing_found(lines: DataFrame) -> DataFrame:
    """``lines`` (one column), or the "nothing found" line where there are none."""
    name = lines.columns[0]
    nothing = (
        lines.limit(1)
        .agg(F.count("*").alias("_n"))
        .filter("_n = 0")
        .select(F.lit(NOTHING_FOUND).alias(name))
    )
    return lines.unionByName(nothing)


SCAN_FORMATS = ("pretty", "json", "sarif", "markdown", "html")


def scan_report(findings: DataFrame, fmt: str = "pretty") -> DataFrame:
    """``place, finding_id, line`` of a fresh scan; in this order the lines are the report.

    SARIF is one run; markdown has its head first.
    """
    from wardline.sinks.documents import sarif_lines

    if fmt not in SCAN_FORMATS:
        raise ValueError(f"unknown format {fmt!r}, choose of {', '.join(SCAN_FORMATS)}")
    if fmt == "sarif":
        return sarif_lines(findings.withColumn("_one", F.lit(0)), "_one").drop("_one")
    line = {"pretty": scan_line, "json": finding_json, "markdown": markdown_row, "html": html_row}[fmt]()
    rows = findings.select(F.lit(len(MARKDOWN_HEAD)).alias("place"), "finding_id", line.alias("line"))
    if fmt != "markdown":
        return rows
    head = findings.sparkSession.createDataFrame(
        [(k, None, text) for k, text in enumerate(MARKDOWN_HEAD)], "place int, finding_id string, line string"
    )
    return head.unionByName(rows)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def level_select(findings: DataFrame, level: str) -> DataFrame:
    return findings.filter(F.col("risk_level") == level)


def summary_columns(findings: DataFrame) -> DataFrame:
    return findings.select(F.col("service_name").alias("service"), "risk_level", "detail")


def counts_by_source(findings: DataFrame) -> DataFrame:
    """What a scan tells its user: findings per source and level."""
    return findings.groupBy("source", "risk_level").agg(F.count("*").alias("n_findings"))
