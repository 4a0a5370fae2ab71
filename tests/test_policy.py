import random

import pytest
from pyspark.sql import functions as F

from wardline.operators.rules import apply_policy, policy_check, verdict
from wardline.policy import InvalidPolicy, Policy, Rule, lint_policies, parse_policy, rule_list

SCORED = "signature_id string, tags array<string>, dlp_matches array<struct<pattern_id:string,description:string,severity:string>>, risk_score int"
MATCH = ("p", "d", "critical")


def answer(spark, policy, signature_id, tags, has_dlp, score):
    row = spark.createDataFrame([(signature_id, tags, [MATCH] if has_dlp else [], score)], SCORED)
    return tuple(row.select(verdict(policy).alias("v")).first().v)


def rule(id_, trigger, action, **more):
    return Rule(id=id_, trigger=trigger, action=action, **more)


CASES = [
    (Policy(), ("openai", [], False, 50), ("warn", None, None)),
    (
        Policy(rules=(rule("block", "ai_detected", "block"), rule("w", "ai_detected", "warn"))),
        ("openai", [], False, 50),
        ("block", "block", None),
    ),
    (
        Policy(rules=(rule("b", "ai_detected", "block", exclude_ids=("openai",)),)),
        ("openai", [], False, 50),
        ("warn", None, None),
    ),
    (
        Policy(rules=(rule("b", "ai_detected", "block", exclude_ids=("openai",)),)),
        ("anthropic", [], False, 50),
        ("block", "b", None),
    ),
    (
        Policy(rules=(rule("a", "ai_detected", "allow", tags=("local",)),)),
        ("ollama", ["local"], False, 50),
        ("allow", "a", None),
    ),
    (
        Policy(rules=(rule("a", "ai_detected", "allow", tags=("local",)),)),
        ("openai", ["cloud"], False, 50),
        ("warn", None, None),
    ),
    (
        Policy(rules=(rule("a", "ai_detected", "allow", tags=("local",)),)),
        (None, None, True, 50),
        ("warn", None, None),
    ),
    (
        Policy(rules=(rule("u", "any", "block", exclude_ids=("unknown",)),)),
        (None, None, True, 50),
        ("warn", None, None),
    ),
    (Policy(rules=(rule("d", "dlp_match", "block"),)), ("openai", [], False, 50), ("warn", None, None)),
    (Policy(rules=(rule("d", "dlp_match", "block"),)), ("openai", [], True, 50), ("block", "d", None)),
    (Policy(rules=(rule("any", "any", "allow"),)), ("x", [], False, 1), ("allow", "any", None)),
    (Policy(rules=(rule("m", "any", "block", min_score=76),)), ("x", [], False, 50), ("warn", None, None)),
    (Policy(rules=(rule("m", "any", "block", min_score=76),)), ("x", [], False, 76), ("block", "m", None)),
    (Policy(rules=(rule("m", "any", "block", min_score=76),)), ("x", [], False, 95), ("block", "m", None)),
    (
        Policy(rules=(rule("o", "ai_detected", "warn", score_override=90),)),
        ("x", [], False, 40),
        ("warn", "o", 90),
    ),
    (
        Policy(rules=(rule("o", "dlp_match", "block", score_override=99),)),
        ("x", [], False, 40),
        ("warn", None, None),
    ),
    (Policy(mode="allow", block_at=80), ("x", [], False, 85), ("block", None, None)),
    (Policy(mode="allow", block_at=80), ("x", [], False, 79), ("allow", None, None)),
    (Policy(mode="allow", warn_at=50), ("x", [], False, 60), ("warn", None, None)),
    (Policy(mode="allow", block_at=80, warn_at=50), ("x", [], False, 85), ("block", None, None)),
    (
        Policy(mode="warn", rules=(rule("allow-it", "ai_detected", "allow"),), block_at=50),
        ("x", [], False, 60),
        ("allow", "allow-it", None),
    ),
]


@pytest.mark.parametrize("policy,finding,expected", CASES)
def test_verdict(spark, policy, finding, expected):
    assert answer(spark, policy, *finding) == expected


@pytest.mark.parametrize(
    "override,score,expected", [(None, 40, (40, "MEDIUM")), (95, 40, (95, "CRITICAL")), (200, 1, (100, "CRITICAL")), (10, 90, (10, "LOW"))]
)
def test_override_sets_score_and_level(spark, override, score, expected):
    policy = Policy(rules=(rule("r", "any", "block", score_override=override),))
    row = spark.createDataFrame([("x", [], [], score)], SCORED)
    done = apply_policy(row, policy).first()
    assert (done.risk_score, done.risk_level) == expected
    assert (done.policy_action, done.matched_rule) == ("block", "r")


def plain_verdict(policy, signature_id, tags, has_dlp, score):
    for r in policy.rules:
        if r.trigger == "dlp_match" and not has_dlp:
            continue
        if r.min_score is not None and score < r.min_score:
            continue
        if (signature_id or "unknown") in r.exclude_ids:
            continue
        if r.tags and not set(r.tags) & set(tags or []):
            continue
        return r.action, r.id, r.score_override
    if policy.block_at is not None and score >= policy.block_at:
        return "block", None, None
    if policy.warn_at is not None and score >= policy.warn_at:
        return "warn", None, None
    return policy.mode, None, None


def random_policy(rng):
    def some(values):
        return tuple(v for v in values if rng.random() < 0.3)

    def maybe(value):
        return value if rng.random() < 0.5 else None

    rules = tuple(
        Rule(
            id=f"r{i}",
            trigger=rng.choice(["ai_detected", "dlp_match", "any"]),
            action=rng.choice(["allow", "warn", "block"]),
            exclude_ids=some(["a", "b", "unknown"]),
            tags=some(["local", "cloud", "it's"]),
            min_score=maybe(rng.randrange(256)),
            score_override=maybe(rng.randrange(256)),
        )
        for i in range(rng.randrange(5))
    )
    return Policy(
        mode=rng.choice(["allow", "warn", "block"]),
        rules=rules,
        block_at=maybe(rng.randrange(101)),
        warn_at=maybe(rng.randrange(101)),
    )


def test_random_policies_agree_with_plain_evaluation(spark):
    rng = random.Random(7)
    findings = [
        (sig, tags, [MATCH] if dlp else [], score)
        for sig in ("a", "b", None)
        for tags in (None, [], ["local"], ["cloud", "it's"])
        for dlp in (False, True)
        for score in (0, 50, 76, 100)
    ]
    table = spark.createDataFrame(findings, SCORED)
    for _ in range(12):
        policy = random_policy(rng)
        got = [tuple(row.v) for row in table.select(verdict(policy).alias("v")).collect()]
        assert got == [plain_verdict(policy, s, t, bool(d), n) for s, t, d, n in findings]


def test_policy_check_counts_every_finding(spark):
    rng = random.Random(3)
    findings = [
        (rng.choice(["a", "b", None]), rng.choice([None, ["local"]]), [MATCH] * rng.randrange(3), rng.randrange(101))
        for _ in range(300)
    ]
    policies = {"one": random_policy(rng), "two": random_policy(rng)}
    got = policy_check(spark.createDataFrame(findings, SCORED), policies).collect()
    want = {}
    for name, policy in policies.items():
        for s, t, d, n in findings:
            action, rule_id, _ = plain_verdict(policy, s, t, bool(d), n)
            want[name, rule_id, action] = want.get((name, rule_id, action), 0) + 1
    assert {(r.policy_id, r.matched_rule, r.policy_action): r.n_findings for r in got} == want


def test_bundled_policy():
    policy = Policy.bundled()
    assert [r.id for r in policy.rules] == [
        "allow-local-models", "block-dlp-critical", "block-critical-score", "warn-unapproved-cloud-ai",
    ]
    assert (policy.mode, policy.block_at, policy.warn_at) == ("warn", 90, 60)
    assert policy.rules[1].score_override == 95
    assert policy.rules[2].min_score == 76


@pytest.mark.parametrize(
    "text",
    [
        "this is not valid toml !!!",
        'mode = "warn"',
        'version = "1"\nmode = "maybe"',
        'version = "1"\nmode = "warn"\n[[rules]]\nid = "x"\ntrigger = "any"',
        'version = "1"\nmode = "warn"\n[thresholds]\nblock = 300',
    ],
)
def test_invalid_policies(text):
    with pytest.raises(InvalidPolicy):
        parse_policy(text)


def test_unusable_policy_falls_back(tmp_path):
    (tmp_path / "bad.toml").write_text("nope !!")
    assert Policy.load_or_default(str(tmp_path / "bad.toml")) == Policy()
    assert Policy.load_or_default(str(tmp_path / "missing.toml")) == Policy()


def test_lint_and_listing(spark, tmp_path):
    (tmp_path / "bad.toml").write_text("nope !!")
    (tmp_path / "good.toml").write_text('version = "1"\nmode = "block"\n')
    rows = {r.path.rsplit("/", 1)[-1]: r for r in lint_policies(spark, str(tmp_path)).collect()}
    assert not rows["bad.toml"].valid and rows["bad.toml"].error
    assert rows["good.toml"].valid and rows["good.toml"].mode == "block"
    listed = rule_list(Policy.bundled().frame(spark, "bundled")).collect()
    assert [r.rule_idx for r in listed] == [0, 1, 2, 3]
    assert listed[1].trigger == "dlp_match"


def test_policy_columns_are_null_safe(spark):
    row = spark.createDataFrame([(None, None, [], 10)], SCORED)
    done = apply_policy(row.withColumn("tags", F.col("tags")), Policy.bundled()).first()
    assert done.matched_rule == "warn-unapproved-cloud-ai"
