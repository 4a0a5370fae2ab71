import json
import time
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from wardline.operators import dedup as batch_dedup
from wardline.plans.scan import analyze
from wardline.policy import Policy
from wardline.registry import Registry
from wardline.sinks.store import FindingsStore
from wardline.sources import files, telemetry
from wardline.streaming import dedup
from wardline.streaming.alerts import AlertFeed
from wardline.streaming.tail import live_lines
from wardline.streaming.watch import Watch

BUNDLED = Registry.bundled()
T0 = datetime(2024, 1, 1)
SCHEMA = files.TABLES["connections"]


def land(spark, path, *rows):
    """One more file of connections in the folder ``path``."""
    table = spark.createDataFrame([("m", T0 + timedelta(seconds=s), h, 443) for s, h in rows], SCHEMA)
    table.coalesce(1).write.mode("append").parquet(str(path))


def run(query):
    assert query.awaitTermination(60) or query.stop()
    assert query.exception() is None
    return query


@pytest.fixture
def place(spark, tmp_path):
    watch = Watch(
        FindingsStore(spark, str(tmp_path / "store")),
        Registry.bundled,
        Policy.bundled,
        checkpoints=str(tmp_path / "checkpoints"),
    )
    return watch, tmp_path / "in"


def test_watch_equals_batch(spark, place):
    watch, folder = place
    for i in range(3):
        land(spark, folder, (i, "claude.ai"), (i, "example.org"), (i + 100, "x.openai.com"))
        stream = files.stream_table(spark, "connections", str(folder), maxFilesPerTrigger="1")
        run(watch.start("connections", stream, once=True))
    batch = analyze(
        telemetry.connection_events(files.read_table(spark, "connections", str(folder)), BUNDLED), BUNDLED, Policy.bundled()
    )
    want = sorted((r.finding_id, r.risk_score, r.policy_action, r.detail) for r in batch.collect())
    got = sorted((r.id, r.risk_score, r.policy_action, r.detail) for r in watch.store.read().collect())
    assert got == want and len(got) == 6


def test_replayed_batch_adds_nothing(spark, place):
    watch, folder = place
    land(spark, folder, (0, "claude.ai"))
    table = files.read_table(spark, "connections", str(folder))
    watch.write_batch("connections", table)
    watch.write_batch("connections", table)
    assert watch.store.read().count() == 1


def test_policy_is_loaded_for_every_batch(spark, place):
    watch, folder = place
    policies = iter([Policy(mode="allow"), Policy(mode="block")])
    watch.load_policy = lambda: next(policies)
    for i in range(2):
        land(spark, folder, (i, "claude.ai"))
        run(watch.start("connections", files.stream_table(spark, "connections", str(folder)), once=True))
    got = {r.timestamp.second: r.policy_action for r in watch.store.read().collect()}
    assert got == {0: "allow", 1: "block"}


def test_tables_watched_side_by_side(spark, place, tmp_path):
    watch, folder = place
    land(spark, folder, (0, "claude.ai"))
    shell = spark.createDataFrame([("m", T0, "bash", "f", None, "ollama run x")], files.TABLES["shell_lines"])
    shell.write.parquet(str(tmp_path / "shell"))
    started = [
        watch.start("connections", files.stream_table(spark, "connections", str(folder)), once=True),
        watch.start("shell_lines", files.stream_table(spark, "shell_lines", str(tmp_path / "shell")), once=True),
    ]
    for query in started:
        run(query)
    assert {r.source for r in watch.store.read().collect()} == {"net", "shell"}


def test_live_lines_lose_no_ties(spark, place):
    watch, folder = place
    lines = []

    def note(batch, _):
        lines.extend(r.line for r in batch.collect())

    for host in ("claude.ai", "api.openai.com"):
        land(spark, folder, (5, host))
        run(watch.start("connections", files.stream_table(spark, "connections", str(folder)), once=True))
        query = (
            live_lines(watch.store)
            .writeStream.foreachBatch(note)
            .option("checkpointLocation", f"{watch.checkpoints}/tail")
            .trigger(availableNow=True)
            .start()
        )
        run(query)
    assert [line[:8] for line in lines] == ["[HIGH   "] * 2
    assert all(line.endswith("(2024-01-01T00:00:05+00:00)") for line in lines)


def payload_details(spark, feed):
    """(batch, detail) of all alerts; each batch's files in name order are one document."""
    found = []
    for batch in sorted(Path(feed.outbox, "payloads").glob("batch_id=*")):
        text = "".join(f.read_text() for f in sorted((batch / "payload=alerts").glob("part-*")))
        found += [(int(batch.name.split("=")[1]), f["detail"]) for f in json.loads(text)["findings"]]
    return sorted(found)


def test_alerts_are_debounced_across_batches(spark, place, tmp_path):
    watch, folder = place
    feed = AlertFeed(watch.store, str(tmp_path / "outbox"), checkpoints=f"{watch.checkpoints}/alerts")
    sent, seen = {}, []
    for at in (0, 10, 29, 30, 45, 60, 95):
        land(spark, folder, (at, "claude.ai"), (at, "api.openai.com" if at >= 29 else "localhost"))
        run(watch.start("connections", files.stream_table(spark, "connections", str(folder)), once=True))
        run(feed.start(once=True, noticed_at=F.lit(T0 + timedelta(seconds=at))))
        now = payload_details(spark, feed)
        sent[at] = {d.split(" ")[0] for _, d in now[len(seen) :]}
        assert now[: len(seen)] == seen
        seen = now
    assert sent == {
        0: {"Anthropic"}, 10: set(), 29: {"OpenAI"}, 30: {"Anthropic"}, 45: set(),
        60: {"Anthropic", "OpenAI"}, 95: {"Anthropic", "OpenAI"},
    }


def test_alerts_of_a_killed_batch_are_sent_once(spark, place, tmp_path):
    watch, folder = place
    feed = AlertFeed(watch.store, str(tmp_path / "outbox"), checkpoints=str(tmp_path / "c"))
    land(spark, folder, (0, "claude.ai"), (1, "claude.ai"), (0, "api.openai.com"))
    run(watch.start("connections", files.stream_table(spark, "connections", str(folder)), once=True))
    send = feed.send_batch

    def dies_after_writing(due, batch_id):
        send(due, batch_id)
        raise RuntimeError("killed")

    feed.send_batch = dies_after_writing
    with pytest.raises(StreamingQueryException):
        feed.start(once=True).awaitTermination(60)
    feed.send_batch = send
    for _ in range(2):
        run(feed.start(once=True))
    details = [d.split(" ")[0] for _, d in payload_details(spark, feed)]
    assert sorted(details) == ["Anthropic", "Anthropic", "OpenAI"]


def test_state_of_the_debounce_is_one_row_a_service(spark, place, tmp_path):
    watch, folder = place
    feed = AlertFeed(watch.store, str(tmp_path / "outbox"), checkpoints=str(tmp_path / "c"))
    for at in range(3):
        land(spark, folder, *[(at + 60 * k, "claude.ai") for k in range(20)], (at, "api.openai.com"))
        run(watch.start("connections", files.stream_table(spark, "connections", str(folder)), once=True))
        query = run(feed.start(once=True, noticed_at=F.lit(T0 + timedelta(minutes=at))))
    assert query.recentProgress[0]["stateOperators"][0]["numRowsTotal"] == 2


ROWS = [(0, "a"), (3, "a"), (9, "a"), (10, "a"), (4, "b"), (5, "b"), (25, "c")]
DAY = 86_400


def dedup_feed(spark, tmp_path, **options):
    return dedup.DedupFeed(spark, str(tmp_path / "out"), ["remote_ip", "port"], checkpoints=str(tmp_path / "c"), **options)


def windows(df):
    return sorted((r.remote_ip, int((r.ts - T0).total_seconds()) // 10) for r in df.collect())


def test_first_per_window_stream(spark, tmp_path):
    feed = dedup_feed(spark, tmp_path)
    land(spark, tmp_path / "in", *ROWS)
    for more in ([], [(7, "a"), (12, "a"), (33, "c")]):
        if more:
            land(spark, tmp_path / "in", *more)
        run(feed.start(files.stream_table(spark, "connections", str(tmp_path / "in")), once=True))
    want = [("a", 0), ("a", 1), ("b", 0), ("c", 2), ("c", 3)]
    assert windows(feed.rows().filter("NOT late")) == want == windows(feed.settled())
    assert feed.late().count() == 0


def test_rows_a_day_late_are_kept(spark, tmp_path):
    """Late rows of known and of unknown keys: none vanishes, and settling equals the batch result."""
    feed = dedup_feed(spark, tmp_path)
    parts = [
        [(DAY + 5, "a"), (DAY + 6, "a"), (DAY + 5, "b")],
        # a day late: a key seen since, twice in a window, and a key never seen
        [(5, "a"), (7, "a"), (5, "new"), (DAY + 7, "a"), (DAY + 15, "b")],
        [(6, "a"), (DAY + 16, "b"), (2 * DAY, "b"), (DAY + 17, "b")],
    ]
    for part in parts:
        land(spark, tmp_path / "in", *part)
        run(feed.start(files.stream_table(spark, "connections", str(tmp_path / "in")), once=True))
    every = files.read_table(spark, "connections", str(tmp_path / "in"))
    assert windows(feed.settled()) == windows(batch_dedup.first_per_window(every, ["remote_ip", "port"]))
    kept = windows(feed.rows().filter("NOT late"))
    assert ("new", 0) in kept and len(kept) == len(set(kept))
    # one of the two rows of one batch and window may already be left out before the state
    assert {w for w in windows(feed.late())} == {("a", 0)}


def test_rows_without_a_time_are_kept(spark, tmp_path):
    feed = dedup_feed(spark, tmp_path)
    rows = [("m", None, "a", 443), ("m", None, "a", 443), ("m", T0, "a", 443), ("m", T0, None, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    run(feed.start(files.stream_table(spark, "connections", str(tmp_path / "in")), once=True))
    assert feed.late().count() == 2 and feed.settled().count() == 4


def test_quiet_keys_leave_the_state(spark, tmp_path):
    feed = dedup_feed(spark, tmp_path, quiet=1)
    for k in range(3):
        land(spark, tmp_path / "in", (k * 100, f"h{k}"))
        query = run(feed.start(files.stream_table(spark, "connections", str(tmp_path / "in")), once=True))
        time.sleep(1.2)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 3 * 3
    assert feed.rows().count() == 3


def test_a_hot_key_is_reduced_before_the_shuffle(spark, tmp_path):
    rows = {"k": ["a", "a", "b", "a"], "ts": [T0, T0 + timedelta(seconds=3), None, T0], "_start": [10, 10, None, 0]}
    (kept,) = dedup._one_per_batch([pa.RecordBatch.from_pydict(rows)], ["k"])
    assert kept.to_pydict()["_start"] == [10, None, 0] and kept.to_pydict()["ts"][0] == T0
    feed = dedup_feed(spark, tmp_path)
    land(spark, tmp_path / "in", *[(k % 10, "a") for k in range(3000)])
    query = run(feed.start(files.stream_table(spark, "connections", str(tmp_path / "in")), once=True))
    assert query.recentProgress[0]["numInputRows"] == 3000
    assert query.recentProgress[0]["stateOperators"][0]["numRowsUpdated"] <= 2
    assert windows(feed.settled()) == [("a", 0)]


def test_first_within_delay_stream(spark, tmp_path):
    land(spark, tmp_path / "in", *ROWS[:3])
    land(spark, tmp_path / "in", (4, "b"))
    stream = files.stream_table(spark, "connections", str(tmp_path / "in"), maxFilesPerTrigger="1")
    query = (
        dedup.first_within_delay(stream, ["remote_ip", "port"], delay="10 seconds")
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True)
        .start()
    )
    run(query)
    got = [r.remote_ip for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == ["a", "b"]
