import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardline.operators import debounce, dedup, incremental
from wardline.operators.updates import updates_due
from wardline.plans.passes import REPORT_FORMATS, scan_pass, stored_report
from wardline.plans.scan import analyze
from wardline.policy import Policy
from wardline.registry import Registry
from wardline.sinks import documents, reports, store
from wardline.sinks.versions import VersionedTable
from wardline.sources import telemetry

BUNDLED = Registry.bundled()
T0 = datetime(2024, 1, 1)


def plain_sends(seconds, wait):
    sent = []
    for s in sorted(set(seconds)):
        if not sent or s - sent[-1] >= wait:
            sent.append(s)
    return sent


def sends(spark, alerts, **options):
    table = spark.createDataFrame(
        [(k, T0 + timedelta(seconds=s)) for k, s in alerts], "service string, ts timestamp"
    )
    got = {}
    for r in debounce.debounced_sends(table, **options).collect():
        got.setdefault(r.service, {})[(r.sent_at - T0).total_seconds()] = r.n_alerts
    return got


def test_debounce_example(spark):
    got = sends(spark, [("s", t) for t in (0, 10, 29, 30, 45, 59, 60, 61, 90)])
    assert sorted(got["s"]) == [0, 30, 60, 90]


@pytest.mark.parametrize("wait,bucket,span", [(30, 60, 600), (30, 30, 400), (7, 20, 300), (60, 10, 900), (30, 21600, 500)])
def test_debounce_equals_plain_replay(spark, wait, bucket, span):
    rng = random.Random(wait * bucket)
    alerts = [(rng.choice(["a", "b", "c"]), rng.randrange(span)) for _ in range(400)]
    alerts += [("sparse", t) for t in (5, 5 + 10 * bucket, 6 + 10 * bucket)]
    alerts += [("dense", t) for t in range(span)]
    got = sends(spark, alerts, debounce=wait, bucket=bucket)
    for key in {k for k, _ in alerts}:
        times = [t for k, t in alerts if k == key]
        assert sorted(got[key]) == plain_sends(times, wait)
        assert all(n == times.count(t) for t, n in got[key].items())


def test_debounced_rows(spark):
    table = spark.createDataFrame(
        [("s", T0 + timedelta(seconds=t), i) for i, t in enumerate((0, 0.25, 10, 30.5))],
        "service string, ts timestamp, i int",
    )
    assert sorted(r.i for r in debounce.debounced_alerts(table).collect()) == [0, 1, 3]


def test_top_n_with_a_hot_group(spark):
    rows = [("hot", i % 700, f"u{i}") for i in range(2000)] + [(f"g{i % 50}", i, "u") for i in range(300)]
    table = spark.createDataFrame(rows, "g string, t int, u string").repartition(7)
    got = dedup.top_n_per_group(table, ["g"], [F.col("t").desc(), F.col("u")], 20, salts=3).collect()
    want = []
    for g in {r[0] for r in rows}:
        want += sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:20]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_n_prunes_before_its_shuffles(spark):
    spark.range(1).count()
    table = spark.range(100).withColumn("g", F.col("id") % 3)
    plan = dedup.top_n_per_group(table, ["g"], [F.col("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Partial") == 2 and plan.count("WindowGroupLimit") == 4


def test_first_per_window(spark):
    rows = [("h", 443, 0, "b"), ("h", 443, 0, "a"), ("h", 443, 9, "x"), ("h", 443, 10, "y"), ("h", 80, 3, "z"), ("k", 443, 5, "w")]
    table = spark.createDataFrame(
        [(h, p, T0 + timedelta(seconds=s), v) for h, p, s, v in rows], "host string, port int, ts timestamp, v string"
    ).repartition(3)
    got = {r.v for r in dedup.first_per_window(table, ["host", "port"]).collect()}
    assert got == {"a", "y", "z", "w"}


def test_changed_files(spark):
    files = spark.createDataFrame(
        [("r", "same", 5), ("r", "newer", 6), ("r", "older", 4), ("r", "unknown", 1), ("r", "zero", 0), ("q", "same", 9)],
        "repo string, path string, mtime bigint",
    )
    state = spark.createDataFrame(
        [("r", p, 5) for p in ("same", "newer", "older", "gone")], "repo string, path string, mtime bigint"
    )
    changed = incremental.changed_by_mtime(files, state)
    assert {(r.repo, r.path) for r in changed.collect()} == {("r", "newer"), ("r", "unknown"), ("q", "same")}
    assert incremental.only_changed(files, changed).count() == 3


def test_changed_by_commit(spark):
    commits = spark.createDataFrame(
        [("r", 1, "a"), ("r", 2, "b"), ("r", 3, "a"), ("new", 1, "z")], "repo string, commit_seq int, path string"
    )
    last = spark.createDataFrame([("r", 2)], "repo string, commit_seq int")
    got = {(r.repo, r.path) for r in incremental.changed_by_commit(commits, last).collect()}
    assert got == {("r", "a"), ("new", "z")}


def test_versioned_table(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "a int")
    assert (table.version(), table.read().count()) == (0, 0)
    table.replace(spark.createDataFrame([(1,), (2,)], "a int"))
    table.replace(spark.createDataFrame([(3,)], "a int"))
    assert table.version() == 2 and [r.a for r in table.read().collect()] == [3]
    # a version without commit row stays unseen
    spark.createDataFrame([(9,)], "a int").write.parquet(str(tmp_path / "t" / "v3"))
    assert [r.a for r in table.read().collect()] == [3]
    assert table.replace(spark.createDataFrame([(4,)], "a int")) == 3
    assert [r.a for r in table.read().collect()] == [4]
    assert table.version(at_most=2) == 2


def test_updates_due(spark):
    now = datetime(2024, 1, 2)
    rows = [("due", now - timedelta(hours=24)), ("fresh", now - timedelta(hours=24, seconds=-1)), ("future", now + timedelta(1))]
    table = spark.createDataFrame(rows, "id string, last_updated timestamp")
    assert [r.id for r in updates_due(table, now).collect()] == ["due"]
    assert updates_due(table, now, enabled=False).count() == 0
    assert {r.id: r.age_seconds for r in updates_due(table, now, interval_hours=0).collect()}["future"] == 0


# --- store and reports -----------------------------------------------------------


def connections(spark, *rows):
    return spark.createDataFrame(
        [("m", ts, host, 443) for ts, host in rows], "host string, ts timestamp, remote_ip string, port int"
    )


def findings(spark, *rows, policy=None):
    return analyze(
        telemetry.connection_events(connections(spark, *rows), BUNDLED), BUNDLED, policy or Policy.bundled()
    )


def test_store(spark, tmp_path):
    target = store.FindingsStore(spark, str(tmp_path / "f"))
    assert target.read().count() == 0
    rows = [(T0 + timedelta(hours=i), "api.openai.com") for i in range(5)]
    target.append(findings(spark, *rows))
    stored = target.read()
    assert stored.count() == 5
    assert {r.source for r in stored.collect()} == {"net"}
    # the same events again, under another policy: replaced, not added
    target.append(findings(spark, *rows, policy=Policy(mode="block")))
    assert target.log().count() == 10
    assert {(r.policy_action) for r in target.read().collect()} == {"block"}
    now = T0 + timedelta(hours=4, minutes=30)
    assert [r.timestamp.hour for r in store.last_hours(target.read(), 1, now).collect()] == [4]
    assert [r.timestamp.hour for r in store.since(target.read(), T0 + timedelta(hours=2)).collect()] == [3, 4]
    assert [r.timestamp.hour for r in store.recent(target.read(), 2).collect()] == [4, 3]
    assert store.count_on(target.read(), now).first().n_findings == 5
    assert store.count_on(target.read(), now + timedelta(1)).first().n_findings == 0
    assert store.gate_count(target.read()).first().n_findings == 5
    target.compact()
    assert target.read_compacted().count() == 5


def test_findings_without_time_are_stored_at_write_time(spark, tmp_path):
    visits = spark.createDataFrame(
        [("m", "Chrome", "p", None, "https://claude.ai/", None)],
        "host string, browser string, profile string, visit_ts timestamp, url string, title string",
    )
    target = store.FindingsStore(spark, str(tmp_path / "f"))
    target.append(analyze(telemetry.visit_events(visits, BUNDLED), BUNDLED, Policy.bundled()))
    row = target.read().first()
    assert row.timestamp == row.written_at and row.event_date is None
    assert json.loads(row.raw_event)["timestamp"] is None
    # a rescan replaces it, whatever the day, and it keeps its first time
    target.append(analyze(telemetry.visit_events(visits, BUNDLED), BUNDLED, Policy.bundled()))
    again = target.read().collect()
    assert len(again) == 1 and again[0].timestamp == row.timestamp < again[0].written_at
    assert store.last_hours(target.read(), 1, row.timestamp).count() == 1
    assert store.count_on(target.read(), row.timestamp).first().n_findings == 1


def test_compacted_store_with_trimmed_log(spark, tmp_path):
    target = store.FindingsStore(spark, str(tmp_path / "f"))
    days = [(T0 + timedelta(days=i), "claude.ai") for i in range(6)]
    target.append(findings(spark, *days[:4]))
    target.compact(trim=True)
    assert target.log().count() == 0 and target.read().count() == 4
    target.append(findings(spark, *days[2:]))
    assert target.read().count() == 6 and target.writes().count() == 8
    newest = target.recent(2)
    assert [r.timestamp for r in newest.collect()] == [d for d, _ in days[:3:-1]]
    assert "PartitionFilters: [(isnull(event_date" in newest._jdf.queryExecution().executedPlan().toString()
    target.compact(trim=True)
    assert target.read().count() == 6 and target.log().count() == 0


def lines_below(plan, name):
    """The plan's lines below the first line that names ``name``."""
    lines = plan.splitlines()
    at = next(k for k, line in enumerate(lines) if name in line)
    return lines[at + 1 :]


def test_a_compacted_store_is_read_without_shuffling_its_rows(spark, tmp_path):
    target = store.FindingsStore(spark, str(tmp_path / "f"), buckets=4)
    days = [(T0 + timedelta(days=i), "claude.ai") for i in range(6)]
    target.append(findings(spark, *days[:4]))
    target.compact(trim=True)
    target.append(findings(spark, *days[2:], policy=Policy(mode="block")))
    plan = target.read()._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    scan = next(k for k, line in enumerate(lines) if "wardline_findings_" in line)
    depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-"))
    above = []
    for line in reversed(lines[:scan]):
        at = len(line) - len(line.lstrip(" :+-"))
        if at < depth:
            above.append(line)
            depth = at
    assert "Bucketed: true" in lines[scan] and any("Aggregate" in line for line in above)
    assert not any("Exchange" in line for line in above)
    # the log's writes are reduced within tasks before they are shuffled
    log = next(k for k, line in enumerate(lines) if "/f/log" in line)
    assert any("partial_max_by" in line for line in lines[scan:log])
    assert {(r.timestamp.day, r.policy_action) for r in target.read().collect()} == {
        (1, "warn"), (2, "warn"), (3, "block"), (4, "block"), (5, "block"), (6, "block"),
    }
    # a second compaction keeps the rows where they are
    target.compact(trim=True)
    assert target.read().count() == 6 == target.read_compacted().count()
    files = {f.rsplit("_", 1)[1] for f in target.read_compacted().inputFiles()}
    assert len(files) <= 4


def test_one_aggregate_finds_the_newest_write(spark):
    rows = [("a", None, k, 1 + k % 2, 5, act) for k, act in enumerate(["warn", None, "allow", "block"])]
    rows += [("b", T0.date(), 3, 1, 5, "allow"), ("b", T0.date(), 4, 1, 5, "warn"), ("c", T0.date(), 9, 2, 7, None)]
    df = spark.createDataFrame(rows, "id string, event_date date, t int, w int, risk_score int, policy_action string")
    df = df.selectExpr("*", "timestamp_seconds(t) AS timestamp", "timestamp_seconds(w) AS written_at").drop("t", "w")
    got = {r.id: (r.timestamp.second, r.policy_action) for r in store.stored_latest(df).collect()}
    # an undated finding shows its first time; of equal writes one without an action comes first, then by name
    assert got == {"a": (0, None), "b": (3, "allow"), "c": (9, None)}
    plan = store.stored_latest(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_max_by") > plan.index("Exchange") and "Window" not in plan


def test_a_compaction_that_died_is_not_seen(spark, tmp_path):
    target = store.FindingsStore(spark, str(tmp_path / "f"), buckets=2)
    target.append(findings(spark, (T0, "claude.ai")))
    target.compact()
    dead = tmp_path / "f" / "compacted" / "g2-b2-00000000"
    dead.mkdir()
    (dead / "part-0.parquet").write_text("half")
    assert target.read().count() == 1
    assert target.compact() == 2
    assert target.compact() == 3
    # another session's view of the same folder, and other buckets
    again = store.FindingsStore(spark, str(tmp_path / "f"), buckets=3)
    assert again.read().count() == 1 and again.compact() == 4 and again.read().count() == 1
    names = sorted(p.name for p in (tmp_path / "f" / "compacted").iterdir() if (p / "_SUCCESS").exists())
    assert [n.split("-")[0] for n in names] == ["g3", "g4"]


def test_last_hours_is_inclusive_to_the_second(spark):
    rows = [(i, T0 + timedelta(seconds=s)) for i, s in enumerate((-0.001, 0, 0.5, 3600))]
    stored = spark.createDataFrame(rows, "id int, timestamp timestamp").withColumns(
        {"event_date": F.to_date("timestamp"), **{c: F.lit("x") for c in ("source", "service_name", "risk_score", "risk_level", "detail")}}
    )
    got = store.last_hours(stored, 1, T0 + timedelta(hours=1, microseconds=900_000)).collect()
    assert [r.id for r in got] == [3, 2, 1]
    assert [r.id for r in store.since(stored, T0).collect()] == [2, 3]


def test_time_queries_prune_partitions(spark, tmp_path):
    target = store.FindingsStore(spark, str(tmp_path / "f"))
    target.append(findings(spark, *[(T0 + timedelta(days=i), "claude.ai") for i in range(4)]))
    recent = target.last_hours(24, T0 + timedelta(days=3))
    plan = recent._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [(isnull(event_date" in scan
    assert "raw_event" not in scan.split("ReadSchema")[1]
    assert [r.timestamp.day for r in recent.collect()] == [4, 3]


def test_stored_json(spark):
    row = store.stored_rows(findings(spark, (T0, "claude.ai"))).first()
    assert json.loads(row.dlp_matches) == []
    event = json.loads(row.raw_event)
    assert event["payload"] == {
        "type": "network_connection", "remote_host": "claude.ai", "remote_ip": "claude.ai", "port": 443,
        "protocol": "tcp", "http_headers": None, "body_snippet": None,
    }
    assert (event["source"], event["timestamp"], event["id"]) == ("network", "2024-01-01T00:00:00Z", row.id)
    whole = json.loads(findings(spark, (T0, "claude.ai")).select(reports.finding_json()).first()[0])
    assert whole["event"] == event and whole["matched_rule"] == "warn-unapproved-cloud-ai"


def test_report_lines(spark):
    one = findings(spark, (T0, "claude.ai"))
    assert one.select(reports.scan_line()).first()[0] == (
        "[HIGH    ] [WARN   ] (rule: warn-unapproved-cloud-ai)  Anthropic / Claude    Anthropic / Claude — connection to claude.ai:443"
    )
    assert one.select(reports.html_row()).first()[0].endswith("2024-01-01 00:00:00 UTC</td></tr>")
    stored = store.stored_rows(one)
    assert stored.select(reports.stored_line()).first()[0] == (
        "[HIGH    ]  Anthropic / Claude   Anthropic / Claude — connection to claude.ai:443  (2024-01-01T00:00:00+00:00)"
    )
    for name in REPORT_FORMATS:
        assert stored_report(stored, name).count() == 1
    assert stored_report(stored, hours=1, as_of=T0 + timedelta(hours=2)).count() == 0
    lines = stored_report(stored, hours=1, as_of=T0 + timedelta(hours=2))
    assert [r.line for r in reports.or_nothing_found(lines).collect()] == ["No findings."]
    assert reports.or_nothing_found(stored_report(stored)).count() == 1


def test_long_service_names_stay_whole(spark):
    row = spark.createDataFrame([("abcdef", "ab")], "a string, b string")
    from wardline.functions.text import pad_right

    assert tuple(row.select(pad_right(F.col("a"), 4), pad_right(F.col("b"), 4)).first()) == ("abcdef", "ab  ")


def test_sarif(spark):
    run = findings(spark, *[(T0 + timedelta(seconds=i), "claude.ai") for i in range(7)]).withColumn("run", F.lit("r1"))
    code = telemetry.code_events(
        spark.createDataFrame([("r", "a.py", 0, bytearray(b"\nhf_ABCDEFGHIJKLMNOPQRSTUv"))], "repo string, path string, mtime bigint, content binary")
    )
    run = run.unionByName(analyze(code, BUNDLED, Policy.bundled()).withColumn("run", F.lit("r1")))
    docs = documents.sarif_logs(run, "run", tool="t").collect()
    assert len(docs) == 1 and docs[0].n_results == 8
    log = json.loads(docs[0].sarif)
    assert log["version"] == "2.1.0" and log["runs"][0]["tool"]["driver"]["name"] == "t"
    results = log["runs"][0]["results"]
    secret = next(r for r in results if r["ruleId"] == "t/unknown")
    assert secret["level"] == "error"
    assert secret["locations"] == [
        {"physicalLocation": {"artifactLocation": {"uri": "r/a.py"}, "region": {"startLine": 2}}}
    ]
    assert all("locations" not in r for r in results if r is not secret)


def test_documents_split_only_when_asked(spark):
    rows = [("hot", i) for i in range(250)] + [("k", i) for i in range(3)] + [(None, 1)]
    table = spark.createDataFrame(rows, "k string, i int")
    for parts in (1, 4):
        layouts = []
        for n in (1, 5):
            docs = documents.in_documents(table.repartition(n), "k", F.col("i").cast("string"), "i", parts=parts).collect()
            layouts.append(sorted((d.k or "", d.doc_id, d["items"]) for d in docs))
            assert sorted((d.k or "", int(i)) for d in docs for i in d["items"]) == sorted((k or "", i) for k, i in rows)
            assert len([d for d in docs if d.k == "hot"]) == parts
        assert layouts[0] == layouts[1]


def test_sarif_lines_make_up_the_document(spark):
    run = findings(spark, *[(T0 + timedelta(seconds=i), "claude.ai") for i in range(30)])
    run = run.withColumn("run", F.when(F.second("ts") < 10, "a").otherwise("b"))
    whole = {r.run: r.sarif for r in documents.sarif_logs(run, "run").collect()}
    lines = documents.sarif_lines(run.repartition(4), "run").orderBy("run", "place", "finding_id").collect()
    assert {k: "".join(r.line for r in lines if r.run == k) for k in whole} == whole
    shown = reports.scan_report(run, "markdown").orderBy("place", "finding_id").collect()
    assert [r.line for r in shown[:2]] == reports.MARKDOWN_HEAD and len(shown) == 32
    for fmt in reports.SCAN_FORMATS:
        assert reports.scan_report(run, fmt).count() >= 30


def test_scan_pass_raises_alerts(spark, tmp_path):
    from wardline.streaming.alerts import AlertFeed

    target = store.FindingsStore(spark, str(tmp_path / "f"))
    feed = AlertFeed(target, str(tmp_path / "out"), checkpoints=str(tmp_path / "c"), debounce=3600)
    files = spark.createDataFrame([("r", "a.py", 0, bytearray(b"hf_ABCDEFGHIJKLMNOPQRSTUv"))], "repo string, path string, mtime bigint, content binary")
    for _ in range(2):
        scan_pass(spark, {"code_files": files}, BUNDLED, Policy.bundled(), target, selection=["codebase"], alerts=feed)
    # the second pass finds the same, within the debounce
    (folder,) = (tmp_path / "out" / "payloads").glob("batch_id=*/payload=alerts")
    sent = json.loads("".join(f.read_text() for f in sorted(folder.glob("part-*"))))
    assert len(sent["findings"]) == 1


def test_large_documents_are_written_in_order_by_many_tasks(spark, tmp_path):
    """One run holds a third of all findings."""
    rows = findings(spark, *[(T0 + timedelta(seconds=i), "claude.ai") for i in range(600)])
    rows = rows.withColumn("run", F.expr("IF(second(ts) < 20, 'big', concat('r', minute(ts)))")).persist()
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        for lines, whole, name in (
            (documents.sarif_lines(rows, "run"), documents.sarif_logs(rows, "run").select("run", "sarif"), "sarif"),
            (documents.alert_lines(rows, "run"), documents.alert_payloads(rows, "run").select("run", "payload"), "alerts"),
        ):
            documents.write_documents(lines, "run", str(tmp_path / name))
            for run, text in whole.collect():
                parts = sorted((tmp_path / name / f"run={run}").glob("part-*"))
                got = "".join(p.read_text() for p in parts)
                assert json.loads(got) == json.loads(text)
                assert run != "big" or len(parts) > 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_alert_payload(spark):
    alerts = findings(spark, (T0, "claude.ai"), (T0 + timedelta(milliseconds=5), "api.openai.com")).withColumn("b", F.lit(7))
    payload = json.loads(documents.alert_payloads(alerts, "b").first().payload)
    assert {f["timestamp"] for f in payload["findings"]} == {"2024-01-01T00:00:00Z", "2024-01-01T00:00:00.005Z"}
    assert set(payload["findings"][0]) == {"id", "timestamp", "risk_level", "risk_score", "service", "detail"}


def test_scan_pass_reads_changed_files_only(spark, tmp_path):
    target = store.FindingsStore(spark, str(tmp_path / "f"))
    state = incremental.ScanState(spark, str(tmp_path / "state"))
    key = b"hf_ABCDEFGHIJKLMNOPQRSTUv"
    schema = "repo string, path string, mtime bigint, content binary"

    def run(*files):
        table = spark.createDataFrame([("r", p, m, bytearray(key)) for p, m in files], schema)
        scan_pass(spark, {"code_files": table}, BUNDLED, Policy.bundled(), target, state=state)
        return target.log().count()

    assert run(("a.py", 10), ("b.py", 10)) == 2
    assert run(("a.py", 10), ("b.py", 10)) == 2
    assert run(("a.py", 20), ("b.py", 10), ("c.py", 5)) == 4
    assert state.version() == 3


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contents_are_not_shuffled(spark):
    """Neither form of an incremental scan has file contents below an exchange."""
    from wardline.operators.secrets import secret_lines

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = spark.createDataFrame([("r", "a.py", 1, bytearray(b"x"))], "repo string, path string, mtime bigint, content binary")
        known = spark.createDataFrame([], "repo string, path string, mtime bigint")
        changed = incremental.changed_by_mtime(files.select("repo", "path", "mtime"), known)
        plan = plan_of(incremental.only_changed(secret_lines(files), changed))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in plan
    below, depth = [], None
    for line in plan.splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at <= depth:
            depth = None
        if depth is None and "Exchange" in line:
            depth = at
        elif depth is not None and "Project" in line:
            below.append(line)
            depth = None  # what the exchange is given
    assert below and not any("content#" in line for line in below)


def test_scan_pass_remembers_only_what_it_scanned(spark, tmp_path):
    from wardline.sources.files import SourceTree

    target = store.FindingsStore(spark, str(tmp_path / "f"))
    state = incremental.ScanState(spark, str(tmp_path / "state"))
    tree = tmp_path / "tree"
    (tree / "p").mkdir(parents=True)
    (tree / "p" / "_k.py").write_text("hf_ABCDEFGHIJKLMNOPQRSTUv")
    tables = {"code_files": SourceTree(spark, str(tree), "r")}
    for selection, version, found in ((["net"], 0, 0), (["codebase"], 1, 1), (["codebase"], 2, 1)):
        scan_pass(spark, tables, BUNDLED, Policy.bundled(), target, selection=selection, state=state)
        assert (state.version(), target.log().count()) == (version, found)


def test_a_file_changed_during_a_pass_is_found_by_the_next(spark, tmp_path):
    from wardline.sources.files import SourceTree

    target = store.FindingsStore(spark, str(tmp_path / "f"))
    state = incremental.ScanState(spark, str(tmp_path / "state"))
    tree = tmp_path / "tree"
    (tree / "p").mkdir(parents=True)
    (tree / "p" / "a.py").write_text("nothing")
    tables = {"code_files": SourceTree(spark, str(tree), "r")}
    append = target.append

    def edited_after(findings, **options):
        append(findings, **options)
        (tree / "p" / "a.py").write_text("hf_ABCDEFGHIJKLMNOPQRSTUv")
        (tree / "p" / "b.py").write_text("hf_ABCDEFGHIJKLMNOPQRSTUw")

    target.append = edited_after
    scan_pass(spark, tables, BUNDLED, Policy.bundled(), target, selection=["codebase"], state=state)
    assert target.log().count() == 0
    target.append = append
    scan_pass(spark, tables, BUNDLED, Policy.bundled(), target, selection=["codebase"], state=state)
    assert target.read().count() == 2


def test_a_pass_that_dies_remembers_nothing(spark, tmp_path):
    target = store.FindingsStore(spark, str(tmp_path / "f"))
    state = incremental.ScanState(spark, str(tmp_path / "state"))
    schema = "repo string, path string, mtime bigint, content binary"
    files = spark.createDataFrame([("r", "a.py", 1, bytearray(b"hf_ABCDEFGHIJKLMNOPQRSTUv"))], schema)
    append = target.append

    def broken(findings, **options):
        raise RuntimeError("lost")

    target.append = broken
    with pytest.raises(RuntimeError):
        scan_pass(spark, {"code_files": files}, BUNDLED, Policy.bundled(), target, selection=["codebase"], state=state)
    assert state.version() == 0
    target.append = append
    scan_pass(spark, {"code_files": files}, BUNDLED, Policy.bundled(), target, selection=["codebase"], state=state)
    assert (state.version(), target.log().count()) == (1, 1)


def test_scan_pass_by_commit(spark, tmp_path):
    target = store.FindingsStore(spark, str(tmp_path / "f"))
    state = incremental.ScanState(spark, str(tmp_path / "state"))
    schema = "repo string, path string, mtime bigint, content binary"
    key = bytearray(b"hf_ABCDEFGHIJKLMNOPQRSTUv")

    def run(commits, *files):
        table = spark.createDataFrame([(*f, key) for f in files], schema)
        log = spark.createDataFrame(commits, "repo string, commit_seq bigint, path string")
        before = target.log().count()
        scan_pass(spark, {"code_files": table}, BUNDLED, Policy.bundled(), target, selection=["codebase"], state=state, commits=log)
        return target.log().count() - before

    files = [("git", "a.py", 5), ("git", "b.py", 5), ("git", "untracked.py", 5), ("plain", "c.py", 5)]
    log = [("git", 1, "a.py"), ("git", 1, "b.py")]
    assert run(log, *files) == 3  # all tracked files, and those newer than never
    assert run(log, *files) == 0
    log.append(("git", 2, "b.py"))
    assert run(log, ("git", "a.py", 9), ("git", "b.py", 5), ("plain", "c.py", 9)) == 2


def test_old_versions_are_removed(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "a int")
    for k in range(12):
        table.replace(spark.createDataFrame([(k,)], "a int").coalesce(1))
    assert table.versions() == [11, 12] and table.read().first().a == 11
    assert len([p for p in (tmp_path / "t").iterdir() if p.name != "commits"]) == 2


def test_utc_literals(spark):
    from wardline.functions.text import at_utc

    aware = datetime(2024, 1, 1, 2, tzinfo=UTC) + timedelta(microseconds=1)
    row = spark.range(1).select(at_utc(aware).cast("string"), at_utc(T0).cast("string")).first()
    assert tuple(row) == ("2024-01-01 02:00:00.000001", "2024-01-01 00:00:00")
