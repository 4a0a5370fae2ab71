"""Policy rules, compiled into one CASE expression per policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.risk import MAX_SCORE, risk_level
from wardline.operators.matching import sql_text, sql_texts
from wardline.policy import Policy, Rule

# Without a signature, rules see this id and no tags.
UNKNOWN_SIGNATURE = "unknown"


def _verdict_sql(action: str, rule: str | None = None, override: int | None = None) -> str:
    return (
        f"named_struct('action', '{action}', "
        f"'rule', CAST({'NULL' if rule is None else sql_text(rule)} AS string), "
        f"'score_override', CAST({'NULL' if override is None else override} AS int))"
    )


def _fires_sql(rule: Rule) -> str:
    # the triggers ai_detected and any hold for every finding
    tests = ["size(dlp_matches) > 0" if rule.trigger == "dlp_match" else "true"]
    if rule.min_score is not None:
        tests.append(f"risk_score >= {rule.min_score}")
    if rule.exclude_ids:
        tests.append(
            f"coalesce(signature_id, '{UNKNOWN_SIGNATURE}') NOT IN ({sql_texts(rule.exclude_ids)})"
        )
    if rule.tags:
        tests.append(f"coalesce(arrays_overlap(tags, array({sql_texts(rule.tags)})), false)")
    return " AND ".join(tests)


def verdict(policy: Policy) -> Column:
    """``struct<action,rule,score_override>``: first rule that fires, then thresholds, then mode.

    Reads the columns ``signature_id``, ``tags``, ``dlp_matches`` and ``risk_score``.
    """
    cases = [
        f"WHEN {_fires_sql(rule)} THEN {_verdict_sql(rule.action, rule.id, rule.score_override)}"
        for rule in policy.rules
    ]
    if policy.block_at is not None:
        cases.append(f"WHEN risk_score >= {policy.block_at} THEN {_verdict_sql('block')}")
    if policy.warn_at is not None:
        cases.append(f"WHEN risk_score >= {policy.warn_at} THEN {_verdict_sql('warn')}")
    default = _verdict_sql(policy.mode)
    return F.expr(f"CASE {' '.join(cases)} ELSE {default} END" if cases else default)


def apply_policy(scored: DataFrame, policy: Policy) -> DataFrame:
    """Add action and rule; a rule's override replaces score and level.

    Takes ``signature_id``, ``tags``, ``dlp_matches`` and ``risk_score``.
    """
    return _governed(scored.withColumn("_verdict", verdict(policy)))


def apply_policies(scored: DataFrame, policies: dict[str, Policy]) -> DataFrame:
    """``apply_policy`` for several policies in one scan: a row for each, named in ``policy_id``."""
    answers = [
        F.struct(F.lit(name).alias("policy_id"), verdict(policy).alias("verdict"))
        for name, policy in policies.items()
    ]
    each = scored.withColumn("_answer", F.explode(F.array(*answers)))
    each = each.withColumns({"policy_id": F.col("_answer.policy_id"), "_verdict": F.col("_answer.verdict")})
    return _governed(each.drop("_answer"))


def _governed(judged: DataFrame) -> DataFrame:
    """Rows with a ``_verdict`` -> action, rule, and the score it leaves."""
    override = f"least(_verdict.score_override, {MAX_SCORE})"
    overridden = f"IF(_verdict.score_override IS NULL, risk_score, {override})"
    return (
        judged.withColumns(
            {
                "risk_score": F.expr(overridden),
                "policy_action": F.col("_verdict.action"),
                "matched_rule": F.col("_verdict.rule"),
            }
        )
        .withColumn("risk_level", F.expr(risk_level("risk_score")))
        .drop("_verdict")
    )


def policy_check(scored: DataFrame, policies: dict[str, Policy]) -> DataFrame:
    """Which rules of candidate policies would fire on scored findings, and how often.

    Findings that look alike to every rule are counted first, so the policies
    run over a table of at most signatures x tags x scores rows.
    """
    # all that rules see of the matches is whether there are any
    flag = F.expr("slice(transform(dlp_matches, m -> true), 1, 1)").alias("dlp_matches")
    alike = scored.groupBy("signature_id", "tags", flag, "risk_score").agg(
        F.count("*").alias("n")
    )
    answers = F.array(
        *[
            F.struct(F.lit(name).alias("policy_id"), verdict(policy).alias("verdict"))
            for name, policy in policies.items()
        ]
    )
    return (
        alike.select("n", F.explode(answers).alias("answer"))
        .groupBy(
            F.col("answer.policy_id").alias("policy_id"),
            F.col("answer.verdict.rule").alias("matched_rule"),
            F.col("answer.verdict.action").alias("policy_action"),
        )
        .agg(F.sum("n").alias("n_findings"))
    )
