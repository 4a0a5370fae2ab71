"""The registered queries: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.risk import risk_level, risk_score
from wardline.operators import (
    contains,
    debounce,
    dedup,
    incremental,
    matching,
    payloads,
    ranges,
    routes,
    rules,
)
from wardline.operators.updates import updates_due
from wardline.operators.secrets import secret_lines as find_secret_lines
from wardline.plans.scan import analyze
from wardline.policy import Policy, Rule
from wardline.registry import Registry, signature_list as list_signatures
from wardline.session import configure, new_folder
from wardline.sinks import documents, reports, store
from wardline.sources import cloud
from wardline.sources import telemetry as sources
from wardline.sources.select import union_events
from wardline.workload import telemetry as raw

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = datetime(2024, 1, 30)
SINCE = datetime(2024, 1, 28, 12, 30)

# A second policy, to compare with the bundled one: exclusions, both thresholds.
STRICT = Policy(
    mode="allow",
    rules=(
        Rule("approved", "any", "allow", tags=("open-source",)),
        Rule("no-secrets", "dlp_match", "block", exclude_ids=("openai",), score_override=99),
        Rule("high-cloud", "ai_detected", "block", tags=("paid", "cloud"), min_score=90),
    ),
    block_at=80,
    warn_at=50,
)
THRESHOLDS_ONLY = Policy(mode="allow", block_at=80, warn_at=50)


def flat_findings(findings: DataFrame) -> DataFrame:
    """FINDING rows as plain columns."""
    return findings.selectExpr(
        "finding_id",
        "CAST(ts AS string) AS ts",
        "source",
        "signature_id",
        "service_name",
        "risk_score",
        "risk_level",
        "array_join(dlp_matches.pattern_id, ',') AS dlp",
        "detail",
        "policy_action",
        "matched_rule",
    )


def _scan(events: DataFrame) -> DataFrame:
    return analyze(events, Registry.bundled(), Policy.bundled())


def visit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_findings(
        _scan(sources.visit_events(raw.visits(spark, sf_dir), Registry.bundled()))
    )


def latest_visits_per_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.latest_visits(raw.visits(spark, sf_dir), per_profile=200).select(
        "host", "browser", "profile", F.col("visit_ts").cast("string").alias("visit_ts"), "url"
    )


def network_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = sources.parse_netstat(raw.netstat_lines(spark, sf_dir))
    connections = raw.connections(spark, sf_dir).unionByName(parsed)
    return flat_findings(_scan(sources.connection_events(connections, Registry.bundled())))


def netstat_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.parse_netstat(raw.netstat_lines(spark, sf_dir)).withColumn(
        "ts", F.col("ts").cast("string")
    )


def capture_first_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = dedup.first_per_window(raw.tls_names(spark, sf_dir), ["sni", "port"], seconds=86_400)
    return first.withColumn("ts", F.col("ts").cast("string"))


def dns_reachable_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sources.reachable_domains(raw.dns_answers(spark, sf_dir), Registry.bundled())
    return found.withColumn("ts", F.col("ts").cast("string"))


def dns_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_findings(
        _scan(sources.dns_events(raw.dns_answers(spark, sf_dir), Registry.bundled()))
    )


def tls_name_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_findings(
        _scan(sources.tls_events(raw.tls_names(spark, sf_dir), Registry.bundled()))
    )


def http_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = sources.http_events(raw.http_payloads(spark, sf_dir), Registry.bundled())
    return events.select(
        "event_id",
        F.col("ts").cast("string").alias("ts"),
        "remote_host",
        "remote_ip",
        "port",
        "protocol",
        F.size("http_headers").alias("n_headers"),
        F.col("http_headers")["authorization"].alias("authorization"),
        F.col("http_headers")["x-ratio"].alias("x_ratio"),
    )


def http_log_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_findings(
        _scan(sources.http_events(raw.http_payloads(spark, sf_dir), Registry.bundled()))
    )


def process_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_findings(
        _scan(sources.process_events(raw.processes(spark, sf_dir), Registry.bundled()))
    )


def shell_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_findings(
        _scan(sources.shell_events(raw.shell_lines(spark, sf_dir), Registry.bundled()))
    )


def secret_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_findings(_scan(sources.code_events(raw.code_files(spark, sf_dir))))


def document_dlp_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = raw.table(spark, sf_dir, "documents").select("doc_id", "text")
    return matching.all_pattern_hits(texts, "text", Registry.bundled()).drop("text")


def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = risk_score("base", "critical", "high", "unapproved")
    return (
        raw.scored_inputs(spark, sf_dir)
        .selectExpr("event_id", f"{score} AS risk_score")
        .withColumn("risk_level", F.expr(risk_level("risk_score")))
    )


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = risk_score("base", "critical", "high")
    inputs = raw.scored_inputs(spark, sf_dir).withColumn("risk_score", F.expr(score))
    return matching.with_signature_info(inputs, Registry.bundled()).withColumn(
        "tags", F.col("signature.tags")
    )


def _actions(spark: SparkSession, sf_dir: str, policies: dict[str, Policy]) -> DataFrame:
    return rules.apply_policies(_scored(spark, sf_dir), policies).select(
        "policy_id", "event_id", "risk_score", "risk_level", "policy_action", "matched_rule"
    )


def policy_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _actions(spark, sf_dir, {"bundled": Policy.bundled(), "strict": STRICT})


def policy_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _actions(spark, sf_dir, {"none": Policy(), "thresholds": THRESHOLDS_ONLY})


def policy_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.policy_check(
        _scored(spark, sf_dir), {"bundled": Policy.bundled(), "strict": STRICT}
    )


def _all_events(spark: SparkSession, sf_dir: str, selection: list[str]) -> DataFrame:
    makers = ["connections", "netstat_lines", "dns_answers", "processes", "shell_lines", "visits",
              "code_files", "http_payloads", "tls_names"]
    tables = {name: getattr(raw, name)(spark, sf_dir) for name in makers}
    return union_events(spark, tables, Registry.bundled(), selection)


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_findings(_scan(_all_events(spark, sf_dir, ["all", "pcap"])))


def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts_by_source(_scan(_all_events(spark, sf_dir, ["all"])))


def _report(stored: DataFrame) -> DataFrame:
    return stored.withColumn("timestamp", F.col("timestamp").cast("string"))


def findings_last_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(store.last_hours(raw.stored_history(spark, sf_dir), 24, AS_OF))


def findings_recent_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(store.recent(raw.stored_history(spark, sf_dir)))


def findings_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(store.since(raw.stored_history(spark, sf_dir), SINCE))


def findings_today_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.count_on(raw.stored_history(spark, sf_dir), AS_OF)


def ci_gate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.gate_count(raw.stored_history(spark, sf_dir))


def findings_of_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summary_columns(
        reports.level_select(raw.stored_history(spark, sf_dir), "CRITICAL")
    )


def actionable_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.actionable(raw.stored_history(spark, sf_dir)).select("id", "risk_level")


def _latest_columns(latest: DataFrame) -> DataFrame:
    return latest.select(
        "id",
        F.col("event_date").cast("string").alias("event_date"),
        F.col("written_at").cast("string").alias("written_at"),
        F.col("timestamp").cast("string").alias("timestamp"),
        "risk_score",
        "policy_action",
        "detail",
    )


def findings_latest_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest_columns(store.stored_latest(raw.rewritten_history(spark, sf_dir).drop("event_id")))


def _written_store(spark: SparkSession, sf_dir: str) -> store.FindingsStore:
    """A store that was written to, compacted, and written to twice more."""
    written = store.FindingsStore(spark, new_folder(spark, "store"), buckets=8)
    rows = raw.rewritten_history(spark, sf_dir)
    for part in range(3):
        chosen = rows.filter(f"event_id % 7 % 3 = {part}").drop("event_id")
        missing = [f"CAST(NULL AS {kind}) AS {name}" for name, kind in (c.split() for c in store.STORED.split(", "))
                   if name not in (*chosen.columns, "feed")]
        written.append_rows(chosen.selectExpr("*", *missing), feed=f"part{part}")
        if part == 0:
            written.compact(trim=True)
    return written


def store_latest_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest write of each id, from files: a compacted table and the log since."""
    return _latest_columns(_written_store(spark, sf_dir).read())


def store_last_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _written_store(spark, sf_dir).last_hours(24, AS_OF)
    return found.select("id", F.col("timestamp").cast("string").alias("timestamp"), "source", "risk_score", "detail")


def signature_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing, with how many stored findings each signature has."""
    counts = (
        raw.stored_history(spark, sf_dir)
        .groupBy(F.col("service_id").alias("id"))
        .agg(F.count("*").alias("n_findings"))
    )
    return (
        list_signatures(Registry.bundled().frame(spark))
        .join(counts, "id", "left")
        .select("id", "version", "risk_base", "name", F.coalesce("n_findings", F.lit(0)).alias("n_findings"))
        .orderBy("id")
    )


def stale_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures whose last recorded update is at least a day old."""
    updates = raw.stored_history(spark, sf_dir).filter("service_id IS NOT NULL")
    last = updates.groupBy(F.col("service_id").alias("id")).agg(
        F.max("timestamp").alias("last_updated")
    )
    due = updates_due(last, datetime(2024, 2, 1), interval_hours=24)
    return due.withColumn("last_updated", F.col("last_updated").cast("string"))


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = raw.code_files(spark, sf_dir).select("repo", "path", "mtime")
    return incremental.changed_by_mtime(files, raw.scan_state(spark, sf_dir))


def changed_files_by_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.changed_by_commit(
        raw.commits(spark, sf_dir), raw.last_commits(spark, sf_dir)
    )


def changed_files_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repos whose name ends in 5 have no commit log; of the others some were never scanned."""
    return incremental.changed_combined(
        raw.code_files(spark, sf_dir),
        raw.scan_state(spark, sf_dir),
        raw.commits(spark, sf_dir).filter("repo NOT LIKE '%5'"),
        raw.last_commits(spark, sf_dir),
    )


def incremental_secret_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # contents are searched where they lie; only hits and the narrow listing are joined
    hits = find_secret_lines(raw.code_files(spark, sf_dir))
    return incremental.only_changed(hits, changed_files(spark, sf_dir))


def _some_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(_all_events(spark, sf_dir, ["all", "pcap"]))


def stored_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat rows; those without a date have the time of the write, which is left out."""
    return (
        store.stored_rows(_some_findings(spark, sf_dir))
        .drop("written_at")
        .withColumn("timestamp", F.when(F.col("event_date").isNotNull(), F.col("timestamp")).cast("string"))
        .withColumn("event_date", F.col("event_date").cast("string"))
    )


def findings_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _some_findings(spark, sf_dir).select("finding_id", reports.finding_json().alias("json"))


def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _some_findings(spark, sf_dir).select(
        "finding_id", F.to_json(documents.sarif_result()).alias("result")
    )


def sarif_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _scan(_all_events(spark, sf_dir, ["codebase"])).withColumn("run_id", F.date_format("ts", "yyyy-MM-dd HH:mm"))
    return documents.sarif_logs(runs, "run_id")


def sarif_logs_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _scan(_all_events(spark, sf_dir, ["codebase"])).withColumn("run_id", F.date_format("ts", "yyyy-MM-dd HH"))
    return documents.sarif_logs(runs, "run_id", parts=3)


def scan_report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scan_report(_some_findings(spark, sf_dir), "markdown")


def scan_report_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scan_report(_some_findings(spark, sf_dir), "sarif")


def alert_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = reports.actionable(raw.stored_history(spark, sf_dir)).select(
        F.col("id").alias("finding_id"),
        F.col("timestamp").alias("ts"),
        "risk_level",
        "risk_score",
        "service_name",
        "detail",
        F.date_format("timestamp", "yyyy-MM-dd HH").alias("batch_id"),
    )
    return documents.alert_payloads(alerts, "batch_id")


def alert_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert payloads as ordered lines, the whole history one batch per day."""
    alerts = reports.actionable(raw.stored_history(spark, sf_dir)).select(
        F.col("id").alias("finding_id"),
        F.col("timestamp").alias("ts"),
        "risk_level",
        "risk_score",
        "service_name",
        "detail",
        F.date_format("timestamp", "yyyy-MM-dd").alias("batch_id"),
    )
    return documents.alert_lines(alerts, "batch_id")


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _some_findings(spark, sf_dir).select("finding_id", reports.scan_line().alias("line"))


def stored_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.stored_history(spark, sf_dir).select(
        "id", reports.stored_line().alias("line"), reports.stored_json().alias("json")
    )


def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.stored_history(spark, sf_dir).select("id", reports.markdown_row().alias("row"))


def html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = raw.stored_history(spark, sf_dir).withColumn("ts", F.col("timestamp"))
    return history.select(
        "id", reports.html_row().alias("scan_row"), reports.stored_html_row().alias("stored_row")
    )


def alert_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = reports.actionable(raw.stored_history(spark, sf_dir)).select(
        debounce.service_key(F.col("service_id")).alias("service"), F.col("timestamp").alias("ts")
    )
    # the events of a service are hours apart, so is the debounce here
    return debounce.debounced_sends(alerts, debounce=21_600).withColumn(
        "sent_at", F.col("sent_at").cast("string")
    )


def _ranged_registry() -> Registry:
    """The bundled registry with the test ranges."""
    return Registry.of(
        replace(sig, ip_ranges=tuple(raw.IP_RANGES.get(sig.id, ()))) for sig in Registry.bundled().all()
    )


def ip_range_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = _ranged_registry()
    table = ranges.registry_ranges(spark, registry)
    events = sources.connection_events(raw.ranged_connections(spark, sf_dir), registry, ranges=table)
    return flat_findings(analyze(events, registry, Policy.bundled(), ranges=table))


def ip_range_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten ranges for each address; the longest around it."""
    addresses = raw.many_addresses(spark, sf_dir)
    return ranges.join_range_owner(addresses, "address", raw.many_ranges(spark, sf_dir), "owner")


def cloud_log_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_findings(_scan(cloud.cloud_log_events(raw.cloud_logs(spark, sf_dir), Registry.bundled())))


def cloud_log_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejects = cloud.cloud_log_rejects(raw.cloud_logs(spark, sf_dir))
    return rejects.withColumn("logged_at", F.col("logged_at").cast("string"))


def http_dlp_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.payload_hits(raw.leaky_payloads(spark, sf_dir), Registry.bundled())


def user_agent_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    agents = matching.registry_agents(spark, Registry.bundled())
    events = sources.http_events(raw.agent_payloads(spark, sf_dir), Registry.bundled(), agents=agents)
    return flat_findings(analyze(events, Registry.bundled(), Policy.bundled(), agents=agents))


def user_agent_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern for each event, met by user agents through their rare grams."""
    texts = raw.agent_texts(spark, sf_dir)
    return contains.join_pattern_owner(texts, "agent", raw.many_agents(spark, sf_dir), "owner")


ROUTES = Policy(
    rules=(
        Rule("critical", "any", "block", notify=("slack", "pager", "slack")),
        Rule("high", "any", "warn"),
        Rule("other", "any", "warn", notify=("never",)),
    )
)


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = reports.actionable(raw.stored_history(spark, sf_dir)).withColumn("matched_rule", F.lower("risk_level"))
    alerts = alerts.withColumn("batch_id", F.date_format("timestamp", "yyyy-MM-dd"))
    return routes.routed_batches(routes.alert_routes(alerts, ROUTES, default=("mail",)))


def alert_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir)


def due_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.due_deliveries(_routed(spark, sf_dir), raw.deliveries(spark, sf_dir), AS_OF, most=5, pause=21_600)


_QUERIES: list[Query] = [
    visit_findings, latest_visits_per_profile, network_findings, netstat_connections,
    capture_first_connections, dns_reachable_domains, dns_findings, tls_name_findings,
    http_log_events, http_log_findings, process_findings, shell_findings, secret_lines,
    document_dlp_hits, risk_scores, policy_actions, policy_thresholds, policy_check,
    all_findings, scan_counts, findings_last_24h, findings_recent_1000, findings_since,
    findings_today_count, ci_gate_count, findings_of_level, actionable_findings,
    findings_latest_by_id, store_latest_by_id, store_last_24h, signature_list, stale_signatures, changed_files,
    changed_files_by_commit, changed_files_combined, incremental_secret_lines, stored_findings, findings_json,
    sarif_results, sarif_logs, sarif_logs_in_parts, scan_report_markdown, scan_report_sarif, alert_payload, alert_lines, report_lines, stored_report_lines,
    markdown_rows, html_rows, alert_debounce, ip_range_findings, ip_range_owners,
    cloud_log_findings, cloud_log_rejects, http_dlp_hits, user_agent_findings, user_agent_owners,
    alert_routes, due_deliveries,
]


def _configured(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {query.__name__: _configured(query) for query in _QUERIES}
