"""One pass over a fleet's tables: scan, store, raise alerts, remember files."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.incremental import ScanState, changed_by_mtime, changed_combined
from wardline.plans.scan import analyze
from wardline.policy import Policy
from wardline.registry import Registry
from wardline.sinks import reports, store
from wardline.sources.files import SourceTree
from wardline.streaming.alerts import AlertFeed
from wardline.sources.select import ABSENT, selected_tables, union_events

Tables = dict[str, DataFrame | SourceTree | Callable[[], DataFrame]]


def scan_pass(
    spark: SparkSession,
    tables: Tables,
    registry: Registry,
    policy: Policy,
    target: store.FindingsStore,
    *,
    selection: list[str] | None = None,
    state: ScanState | None = None,
    commits: DataFrame | None = None,
    alerts: AlertFeed | None = None,
) -> list[str]:
    """Scan the selected tables, append what is found, and name the tables that were absent.

    With ``alerts``, payloads that are due go to its outbox at the end: for all
    findings stored since the feed last looked, each row once.

    With ``state``, of ``code_files`` only those changed since the last pass
    count: by the commit log ``commits`` for repos that have one, else by mtime.
    Of a ``SourceTree`` only those files are opened; of a table, hits are found
    where the contents lie, and hits, not contents, meet the list of changes. The
    listing is written before contents are read, the scan goes by what was written,
    and it is remembered only if this pass scanned ``code_files``, after the findings
    are written: a file changed meanwhile is newer than what is remembered.
    """
    staged, changed, absent = None, None, []
    files = tables.get("code_files") if "code_files" in selected_tables(selection or ["all"]) else None
    if state is not None and files is not None:
        try:
            files = files() if callable(files) else files
        except AnalysisException as error:
            if error.getCondition() not in ABSENT:
                raise
            files = None
    if state is not None and files is not None:
        # a state written by this pass must not reach the plan it is compared in
        version = state.version()
        listing = files.listing() if isinstance(files, SourceTree) else files
        listing = listing.select("repo", "path", "mtime", *(["uri", "size"] if isinstance(files, SourceTree) else []))
        staged, listing = state.stage_listing(listing, commits)
        if commits is None:
            changed = changed_by_mtime(listing, state.read(version)).select("repo", "path")
        else:
            changed = changed_combined(listing, state.read(version), commits, state.last_commits(version))
        if isinstance(files, SourceTree):
            files = files.contents(listing.join(changed, ["repo", "path"], "left_semi"))
            changed = None
    elif isinstance(files, SourceTree):
        files = files.contents(files.listing())
    if files is not None:
        tables = {**tables, "code_files": files}
    events = union_events(spark, tables, registry, selection, absent=absent)
    if changed is not None:
        paths = changed.select(F.concat_ws("/", "repo", "path").alias("_changed"))
        is_code = F.col("type") == "codebase_file"
        code = events.filter(is_code).join(paths, F.col("file_path") == F.col("_changed"), "left_semi")
        events = events.filter(~is_code).unionByName(code)
    target.append(analyze(events, registry, policy))
    if staged is not None:
        state.commit(staged)
    if alerts is not None:
        alerts.start(once=True).awaitTermination()
    return absent


REPORT_FORMATS = {
    "pretty": reports.stored_line,
    "json": reports.stored_json,
    "markdown": reports.markdown_row,
    "html": reports.stored_html_row,
}


def stored_report(
    stored: DataFrame,
    fmt: str = "pretty",
    *,
    hours: int | None = None,
    as_of: datetime | None = None,
    limit: int = store.RECENT_ROWS,
) -> DataFrame:
    """Report lines of stored findings, newest first: all of the last hours, or the latest ``limit``."""
    if hours is None:
        rows = store.recent(stored, limit)
    else:
        if as_of is None:
            raise ValueError("a report by hours needs as_of")
        rows = store.last_hours(stored, hours, as_of)
    order = [F.col("timestamp").desc(), "id"]
    return rows.orderBy(*order).select(REPORT_FORMATS[fmt]().alias("line"))
