"""JSON documents that wrap many rows: SARIF logs and alert payloads.

A run or a batch is one document, whatever its size. ``sarif_logs`` and
``alert_payloads`` make each one row, for documents that fit a row; ``parts``
splits them by a hash of the id, the same way however the data lie. For runs of
any size ``sarif_lines`` and ``alert_lines`` give the text of the document as ordered
lines, of which no task holds more than its share, and ``write_documents`` writes them
so that the files of a run, one after another in the order of their names, are its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import __version__
from wardline.functions.text import rfc3339

TOOL = "wardline"

# SARIF schema, version and level names.
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
SARIF_VERSION = "2.1.0"
SARIF_LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}


def in_documents(
    rows: DataFrame, key: str, item: Column, order: str, *, parts: int = 1
) -> DataFrame:
    """``key, doc_id, n_rows, items``: the items of each key and part, in order."""
    digits = F.substring(F.md5(F.col(order).cast("string")), 1, 8)
    part = F.conv(digits, 16, 10).cast("bigint") % parts
    return (
        rows.select(F.col(key), item.alias("_item"), F.col(order).alias("_order"), part.alias("doc_id"))
        .groupBy(key, "doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("_order", "_item"))).alias("_rows"))
        .select(
            key,
            "doc_id",
            F.size("_rows").alias("n_rows"),
            F.transform("_rows", lambda row: row["_item"]).alias("items"),
        )
    )


def sarif_result(prefix: str = TOOL) -> Column:
    """SARIF result of a FINDING row; a location only for code findings."""
    level = F
    for name, sarif_level in SARIF_LEVELS.items():
        level = level.when(F.col("risk_level") == name, sarif_level)
    line = F.col("event.line_number")
    location = F.struct(
        F.struct(
            F.struct(F.col("event.file_path").alias("uri")).alias("artifactLocation"),
            F.when(line.isNotNull(), F.struct(line.alias("startLine"))).alias("region"),
        ).alias("physicalLocation")
    )
    return F.struct(
        F.coalesce("signature_id", F.lit(f"{prefix}/unknown")).alias("ruleId"),
        level.otherwise("note").alias("level"),
        F.struct(F.col("detail").alias("text")).alias("message"),
        F.when(F.col("event.type") == "codebase_file", F.array(location)).alias("locations"),
    )


def sarif_head(tool: str, information_uri: str) -> Column:
    """The document's text before the first result."""
    driver = F.to_json(
        F.struct(
            F.lit(tool).alias("name"),
            F.lit(__version__).alias("version"),
            F.lit(information_uri).alias("informationUri"),
        )
    )
    start = '{"$schema":"' + SARIF_SCHEMA + '","version":"' + SARIF_VERSION + '","runs":[{"tool":{"driver":'
    return F.concat(F.lit(start), driver, F.lit('},"results":['))


SARIF_TAIL = "]}]}"


def sarif_logs(
    findings: DataFrame,
    run_id: str,
    *,
    information_uri: str = "",
    tool: str = TOOL,
    parts: int = 1,
) -> DataFrame:
    """``run_id, doc_id, n_results, sarif``: the SARIF document of each run, as a row."""
    docs = in_documents(findings, run_id, F.to_json(sarif_result(tool)), "finding_id", parts=parts)
    document = F.concat(
        sarif_head(tool, information_uri), F.array_join("items", ","), F.lit(SARIF_TAIL)
    )
    return docs.select(run_id, "doc_id", F.col("n_rows").alias("n_results"), document.alias("sarif"))


def _lines(rows: DataFrame, key: str, head: Column, item: Column, tail: str) -> DataFrame:
    """``key, place, finding_id, line``: a head, a line for each row, a tail.

    The first item of a document has no comma before it, wherever the others lie.
    """
    runs = rows.groupBy(key).agg(F.min("finding_id").alias("_first"))
    first = runs.select(F.col(key).alias("_run"), "_first")
    comma = F.when(F.col("finding_id") == F.col("_first"), "").otherwise(",")
    items = rows.join(first, F.col(key).eqNullSafe(F.col("_run"))).select(
        key, F.lit(1).alias("place"), "finding_id", F.concat(comma, item).alias("line")
    )
    none = F.lit(None).cast("string").alias("finding_id")
    heads = runs.select(key, F.lit(0).alias("place"), none, head.alias("line"))
    tails = runs.select(key, F.lit(2).alias("place"), none, F.lit(tail).alias("line"))
    return heads.unionByName(items).unionByName(tails)


def sarif_lines(
    findings: DataFrame, run_id: str, *, information_uri: str = "", tool: str = TOOL
) -> DataFrame:
    """``run_id, place, finding_id, line``: the same documents, a line for each result.

    In the order of ``run_id, place, finding_id`` the lines make up each run's document.
    """
    return _lines(findings, run_id, sarif_head(tool, information_uri), F.to_json(sarif_result(tool)), SARIF_TAIL)


def write_documents(lines: DataFrame, key: str, path: str) -> None:
    """Write ``key, place, finding_id, line`` as text, a folder per key.

    Lines are range-partitioned in the order of the documents, so a large one is written by
    many tasks, and the files of a folder in the order of their names are the document.
    """
    order = [key, "place", "finding_id"]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select(key, "line").write.mode("overwrite").partitionBy(key).text(path)


def alert_item() -> Column:
    return F.struct(
        F.col("finding_id").alias("id"),
        rfc3339(F.col("ts"), "Z").alias("timestamp"),
        "risk_level",
        "risk_score",
        F.col("service_name").alias("service"),
        "detail",
    )


def alert_payloads(
    alerts: DataFrame, batch_id: str, *, tool: str = TOOL, parts: int = 1
) -> DataFrame:
    """``batch_id, doc_id, n_alerts, payload``: what the alert channel is to send."""
    item = F.to_json(alert_item(), {"ignoreNullFields": "false"})
    docs = in_documents(alerts, batch_id, item, "finding_id", parts=parts)
    head = f'{{"tool":"{tool}","version":"{__version__}","findings":['
    payload = F.concat(F.lit(head), F.array_join("items", ","), F.lit("]}"))
    return docs.select(batch_id, "doc_id", F.col("n_rows").alias("n_alerts"), payload.alias("payload"))


ALERT_HEAD = f'{{"tool":"{TOOL}","version":"{__version__}","findings":['
ALERT_TAIL = "]}"


def alert_lines(alerts: DataFrame, batch_id: str) -> DataFrame:
    """``batch_id, place, finding_id, line``: alert payloads of any size, a line for each alert."""
    item = F.to_json(alert_item(), {"ignoreNullFields": "false"})
    return _lines(alerts, batch_id, F.lit(ALERT_HEAD), item, ALERT_TAIL)
