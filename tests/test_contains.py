"""Many patterns against Python's own test; routes and deliveries."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardline.operators import contains, routes
from wardline.policy import Policy, Rule
from wardline.streaming.deliveries import Deliveries

T0 = datetime(2024, 1, 1)


def words_and_texts():
    rng = random.Random(3)
    letters = "abcé "
    patterns = [("".join(rng.choices(letters, k=rng.choice((1, 2, 3, 4, 6, 9)))), f"o{rng.randrange(30)}") for _ in range(300)]
    patterns += [("python-client/" + str(k), f"p{k}") for k in range(300)] + [("", "never"), ("abc", None), (None, "x")]
    texts = ["".join(rng.choices(letters, k=rng.randrange(0, 25))) for _ in range(150)]
    texts += [f"my python-client/{rng.randrange(400)} x" for _ in range(60)] + [None, None, "", "zz", "python-client/", "zz python-client/7"] * 2
    return patterns, texts


def plain(text, patterns, prefix):
    if text is None:
        return None
    test = str.startswith if prefix else str.__contains__
    return min((o for p, o in patterns if p and o and test(text, p)), default=None)


@pytest.mark.parametrize("prefix", [False, True])
@pytest.mark.parametrize("broadcast_bytes", [8_000_000, 0])
def test_owners_in_both_ways(spark, prefix, broadcast_bytes):
    patterns, texts = words_and_texts()
    table = spark.createDataFrame(patterns, "pattern string, owner string")
    df = spark.createDataFrame(list(enumerate(texts)), "k int, agent string").repartition(3)
    got = contains.join_pattern_owner(df, "agent", table, "o", prefix=prefix, broadcast_bytes=broadcast_bytes)
    assert got.columns == ["k", "agent", "o"]
    assert {r.k: r.o for r in got.collect()} == {k: plain(t, patterns, prefix) for k, t in enumerate(texts)}


def test_patterns_stand_under_rare_grams(spark):
    table = spark.range(2000).selectExpr("concat('python-client/', id) AS pattern", "'o' AS owner")
    index = contains.gram_index(table)
    assert index.count() == 2000
    crowded = index.groupBy("gram").count().agg(F.max("count")).first()[0]
    assert crowded < 100  # 'pyt', which all have, would hold 2,000


def test_no_patterns_and_no_texts(spark):
    none = spark.createDataFrame([], "pattern string, owner string")
    df = spark.createDataFrame([("a",), (None,)], "agent string")
    assert {r.o for r in contains.join_pattern_owner(df, "agent", none, "o").collect()} == {None}
    some = spark.createDataFrame([("a", "x")], "pattern string, owner string")
    assert contains.join_pattern_owner(df.limit(0), "agent", some, "o").collect() == []


POLICY = Policy(rules=(Rule("r", "any", "block", notify=("slack", "mail", "slack")), Rule("q", "any", "warn")))


def alerts(spark, *rules):
    return spark.createDataFrame([(f"f{k}", r) for k, r in enumerate(rules)], "finding_id string, matched_rule string")


def test_routes(spark):
    rows = routes.alert_routes(alerts(spark, "r", "q", None, "r"), POLICY, default=("pager",)).collect()
    assert sorted((r.finding_id, r.channel) for r in rows) == [
        ("f0", "mail"), ("f0", "slack"), ("f1", "pager"), ("f2", "pager"), ("f3", "mail"), ("f3", "slack"),
    ]
    assert routes.alert_routes(alerts(spark, "q", None), POLICY).collect() == []
    assert routes.alert_routes(alerts(spark, "r"), Policy()).collect() == []


def test_a_batch_is_delivered_once_per_retry(spark, tmp_path):
    """Slack fails twice, mail works; a repeated batch and a repeated round change nothing."""
    box = Deliveries(spark, str(tmp_path / "d"), pause=10)
    noted = tmp_path / "sent"
    noted.mkdir()

    def send(batch_id, channel, attempt):
        with open(noted / f"{batch_id}-{channel}-{attempt}", "a") as file:
            file.write("x")
        return channel == "mail" or attempt == 3

    rows = routes.alert_routes(alerts(spark, "r", "r", "q"), POLICY)
    for _ in range(2):
        box.enqueue(rows, 7)
    assert [(r.channel, r.n_alerts) for r in box.batches().orderBy("channel").collect()] == [("mail", 2), ("slack", 2)]

    def attempted(number, seconds):
        done = box.deliver(number, T0 + timedelta(seconds=seconds), send)
        return sorted((r.channel, r.attempt, r.state) for r in done.collect())

    assert attempted(1, 0) == [("mail", 1, "sent"), ("slack", 1, "failed")]
    assert attempted(2, 5) == []  # the pause is not over
    box.enqueue(rows, 7)
    assert attempted(3, 10) == [("slack", 2, "failed")]
    # the pause has doubled
    assert attempted(4, 29) == []
    assert attempted(5, 30) == [("slack", 3, "sent")]
    assert attempted(6, 1000) == []
    assert sorted(p.name for p in noted.iterdir()) == ["7-mail-1", "7-slack-1", "7-slack-2", "7-slack-3"]
    assert all(p.read_text() == "x" for p in noted.iterdir())


def test_a_round_that_dies_is_due_again_after_its_pause(spark, tmp_path):
    box = Deliveries(spark, str(tmp_path / "d"), pause=10, most=2)
    box.enqueue(routes.alert_routes(alerts(spark, "r"), Policy(rules=(Rule("r", "any", "block", notify=("mail",)),))), 1)

    def dies(batch_id, channel, attempt):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        box.deliver(1, T0, dies)
    assert [(r.attempt, r.state) for r in box.ledger().collect()] == [(1, "sending")]
    fails = lambda *_: False
    assert box.deliver(2, T0 + timedelta(seconds=9), fails).count() == 0
    assert [r.attempt for r in box.deliver(3, T0 + timedelta(seconds=10), fails).collect()] == [2]
    assert box.deliver(4, T0 + timedelta(days=1), fails).count() == 0  # no more than two
