"""Choosing sources and uniting their events."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from wardline import schemas
from wardline.registry import Registry
from wardline.sources import cloud, telemetry

log = logging.getLogger(__name__)

# Raw table -> how its events are made.
EVENT_BUILDERS: dict[str, Callable[..., DataFrame]] = {
    "connections": telemetry.connection_events,
    "netstat_lines": telemetry.netstat_events,
    "dns_answers": telemetry.dns_events,
    "processes": telemetry.process_events,
    "shell_lines": telemetry.shell_events,
    "visits": telemetry.visit_events,
    "code_files": telemetry.code_events,
    "http_payloads": telemetry.http_events,
    "tls_names": telemetry.tls_events,
    "cloud_logs": cloud.cloud_log_events,
}

# Sources whose addresses can be held against ranges.
RANGED = ["connections", "netstat_lines", "http_payloads", "tls_names"]

# How Spark says that a table is not there.
ABSENT = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND")

# Named selections; payload capture and cloud logs take part only where asked for.
SELECTIONS = {
    "net": ["connections", "netstat_lines", "dns_answers"],
    "os": ["processes", "shell_lines"],
    "browser": ["visits"],
    "shell": ["shell_lines"],
    "codebase": ["code_files"],
    "cloud": ["cloud_logs"],
    "pcap": ["http_payloads", "tls_names"],
    "all": [
        "connections", "netstat_lines", "dns_answers", "processes", "shell_lines", "visits", "code_files",
    ],
}


def selected_tables(names: list[str]) -> list[str]:
    """Raw tables of one or more selections, each once, in order."""
    return list(dict.fromkeys(table for name in names for table in SELECTIONS[name]))


def union_events(
    spark: SparkSession,
    tables: dict[str, DataFrame | Callable[[], DataFrame]],
    registry: Registry,
    selection: list[str] | None = None,
    *,
    absent: list[str] | None = None,
    ranges: DataFrame | None = None,
) -> DataFrame:
    """All events of the selected tables.

    With ``ranges`` (cidr, owner), connections to their addresses count as well.

    A table that does not exist counts as empty and is named in ``absent``.
    Anything else, as a table without a needed column, is an error.
    """
    parts = []
    for name in selected_tables(selection or ["all"]):
        if name not in tables:
            continue
        try:
            table = tables[name]() if callable(tables[name]) else tables[name]
            more = {"ranges": ranges} if ranges is not None and name in RANGED else {}
            parts.append(EVENT_BUILDERS[name](table, registry, **more))
        except AnalysisException as error:
            if error.getCondition() not in ABSENT:
                raise
            log.warning("source %s is absent, going on without it: %s", name, error)
            if absent is not None:
                absent.append(name)
    if not parts:
        return spark.createDataFrame([], schemas.EVENT)
    return reduce(DataFrame.unionByName, parts)
