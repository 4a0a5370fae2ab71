"""Audit records of cloud providers, good and bad."""

import json

from pyspark.sql import functions as F

from wardline.plans.scan import analyze
from wardline.policy import Policy
from wardline.registry import Registry
from wardline.sources import cloud
from wardline.sources.select import SELECTIONS, union_events

BUNDLED = Registry.bundled()
TRAIL = {"eventTime": "2024-01-01T01:00:00Z", "eventSource": "API.openai.com", "eventName": "Invoke", "eventID": "e1",
         "userIdentity": {"arn": "arn:u"}, "sourceIPAddress": "10.0.0.1"}
AUDIT = {"timestamp": 1704070800123, "insertId": "i1", "protoPayload": {"serviceName": "claude.ai", "methodName": "Predict"}}
PLAIN = {"time": "2024-01-01T02:00:00+01:00", "host": "claude.ai", "operation": "chat"}


def logs(spark, *lines):
    rows = [("h", line if isinstance(line, str) or line is None else json.dumps(line)) for line in lines]
    df = spark.createDataFrame(rows, "host string, line string")
    return df.withColumn("ts", F.timestamp_seconds(F.lit(1704153600))).select("host", "ts", "line")


def test_shapes_of_three_providers(spark):
    rows = cloud.parse_records(logs(spark, TRAIL, AUDIT, PLAIN)).orderBy("service", "ts").collect()
    got = [(r.service, r.operation, r.actor, r.address, r.record_id, r.ts.isoformat(), r.reason) for r in rows]
    assert got == [
        ("api.openai.com", "Invoke", "arn:u", "10.0.0.1", "e1", "2024-01-01T01:00:00", None),
        ("claude.ai", "chat", None, None, None, "2024-01-01T01:00:00", None),
        ("claude.ai", "Predict", None, None, "i1", "2024-01-01T01:00:00.123000", None),
    ]


def test_lists_of_records(spark):
    rows = cloud.parse_records(logs(spark, {"Records": [TRAIL, AUDIT]}, {"value": [PLAIN, None]})).collect()
    assert sorted((r.part, r.service or "", r.reason or "") for r in rows) == [
        (0, "api.openai.com", ""), (0, "claude.ai", ""), (1, "", "no record"), (1, "claude.ai", ""),
    ]


def test_what_cannot_be_used_stays_a_row(spark):
    bad = ["", "{", "nonsense", None, "3", '"text"', [1], {"Records": []}, {"Records": 7}, {}, {**TRAIL, "eventSource": " "},
           {**TRAIL, "eventTime": "soon"}, {**TRAIL, "eventTime": None}, '{"a":1,"a":2}']
    lines = logs(spark, TRAIL, *bad)
    rejects = cloud.cloud_log_rejects(lines).collect()
    assert len(rejects) == len(bad)
    reasons = {r.line: r.reason for r in rejects}
    assert reasons["{"] == reasons[""] == reasons[None] == "not JSON"
    assert reasons["3"] == reasons["[1]"] == "no record" and reasons["{}"] == "no service"
    assert reasons[json.dumps({**TRAIL, "eventTime": "soon"})] == "no time"
    assert cloud.cloud_log_events(lines, BUNDLED).count() == 1


def test_events_repeat_their_ids_and_are_opt_in(spark):
    lines = logs(spark, TRAIL, TRAIL, PLAIN, {"Records": [PLAIN, PLAIN]})
    found = analyze(cloud.cloud_log_events(lines, BUNDLED), BUNDLED, Policy.bundled()).collect()
    # a record with an id is one event however often it is logged; others go by line and place
    assert len(found) == 5 and len({r.finding_id for r in found}) == 4
    assert {r.source for r in found} == {"cloud_log"} and {r.event.protocol for r in found} == {"cloud"}
    assert "cloud_logs" not in SELECTIONS["all"]
    tables = {"cloud_logs": lines}
    assert union_events(spark, tables, BUNDLED, ["all"]).count() == 0
    assert union_events(spark, tables, BUNDLED, ["cloud"]).count() == 5
