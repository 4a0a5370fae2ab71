"""Governance policies: ordered rules, thresholds and a default action."""

from __future__ import annotations

import logging
import tomllib
from dataclasses import dataclass, field
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from wardline import schemas
from wardline.registry import local_frame

log = logging.getLogger(__name__)

BUNDLED_FILE = str(Path(__file__).parent / "data" / "policy.toml")

# Spellings in policy files.
ACTIONS = ("allow", "warn", "block")
TRIGGERS = ("ai_detected", "dlp_match", "any")


class InvalidPolicy(ValueError):
    """A policy file has a missing or wrongly typed field."""


@dataclass(frozen=True)
class Rule:
    id: str
    trigger: str
    action: str
    description: str | None = None
    exclude_ids: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    notify: tuple[str, ...] = ()
    min_score: int | None = None
    score_override: int | None = None


@dataclass(frozen=True)
class Policy:
    """Defaults are those of a scan without any policy file: warn, no rules."""

    version: str = "1.0"
    mode: str = "warn"
    rules: tuple[Rule, ...] = ()
    block_at: int | None = None
    warn_at: int | None = None
    webhooks: dict[str, str | None] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Policy:
        return parse_policy(Path(path).read_text(encoding="utf-8"))

    @classmethod
    def load_or_default(cls, path: str) -> Policy:
        """What each watch cycle does: an unusable file means the default."""
        try:
            return cls.load(path)
        except (OSError, UnicodeDecodeError, InvalidPolicy) as error:
            log.warning("policy %s not usable, going on with the default: %s", path, error)
            return cls()

    @classmethod
    @cache
    def bundled(cls) -> Policy:
        return cls.load(BUNDLED_FILE)

    def frame(self, spark: SparkSession, policy_id: str) -> DataFrame:
        """The rules as a table of RULE rows."""
        rows = [
            {"policy_id": policy_id, "rule_idx": i, **vars(rule)}
            for i, rule in enumerate(self.rules)
        ]
        return local_frame(spark, rows, schemas.RULE)


def parse_policy(text: str) -> Policy:
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise InvalidPolicy(f"not TOML: {error}") from error
    thresholds = _table(doc, "thresholds")
    rules = doc.get("rules", [])
    if not isinstance(rules, list):
        raise InvalidPolicy("rules must be a list of tables")
    return Policy(
        version=_text(doc, "version"),
        mode=_choice(doc, "mode", ACTIONS),
        rules=tuple(_rule(rule) for rule in rules),
        block_at=_byte(thresholds, "block"),
        warn_at=_byte(thresholds, "warn"),
        webhooks={
            channel: _optional_text(_table(_table(doc, "notifications"), channel), "webhook_url")
            for channel in ("slack", "discord")
            if channel in _table(doc, "notifications")
        },
    )


def _rule(doc: object) -> Rule:
    if not isinstance(doc, dict):
        raise InvalidPolicy("a rule must be a table")
    return Rule(
        id=_text(doc, "id"),
        trigger=_choice(doc, "trigger", TRIGGERS),
        action=_choice(doc, "action", ACTIONS),
        description=_optional_text(doc, "description"),
        exclude_ids=_texts(doc, "exclude_ids"),
        tags=_texts(doc, "tags"),
        notify=_texts(doc, "notify"),
        min_score=_byte(doc, "min_score"),
        score_override=_byte(doc, "score_override"),
    )


def _table(doc: dict, key: str) -> dict:
    value = doc.get(key, {})
    if not isinstance(value, dict):
        raise InvalidPolicy(f"{key} must be a table")
    return value


def _text(doc: dict, key: str) -> str:
    value = _optional_text(doc, key)
    if value is None:
        raise InvalidPolicy(f"{key} is missing")
    return value


def _optional_text(doc: dict, key: str) -> str | None:
    value = doc.get(key)
    if value is not None and not isinstance(value, str):
        raise InvalidPolicy(f"{key} must be text")
    return value


def _choice(doc: dict, key: str, allowed: tuple[str, ...]) -> str:
    value = _text(doc, key)
    if value not in allowed:
        raise InvalidPolicy(f"{key} must be one of {', '.join(allowed)}")
    return value


def _texts(doc: dict, key: str) -> tuple[str, ...]:
    values = doc.get(key, [])
    if not isinstance(values, list) or not all(isinstance(v, str) for v in values):
        raise InvalidPolicy(f"{key} must be a list of texts")
    return tuple(values)


def _byte(doc: dict, key: str) -> int | None:
    value = doc.get(key)
    if value is None:
        return None
    if type(value) is not int or not 0 <= value <= 255:
        raise InvalidPolicy(f"{key} must be an integer from 0 to 255")
    return value


def lint_policies(spark: SparkSession, directory: str) -> DataFrame:
    """One ``(path, valid, error, mode, n_rules)`` row per ``*.toml`` file of a folder."""
    texts = spark.read.text(directory, wholetext=True, pathGlobFilter="*.toml").selectExpr(
        "_metadata.file_path AS path", "value AS text"
    )
    return texts.mapInPandas(
        _lint_batches, "path string, valid boolean, error string, mode string, n_rules int"
    )


def _lint_batches(batches):
    for batch in batches:
        reports = [_lint_one(text) for text in batch["text"]]
        yield batch[["path"]].assign(
            valid=[error is None for error, _ in reports],
            error=[error for error, _ in reports],
            mode=[policy.mode if policy else None for _, policy in reports],
            n_rules=[len(policy.rules) if policy else None for _, policy in reports],
        )


def _lint_one(text: str) -> tuple[str | None, Policy | None]:
    try:
        return None, parse_policy(text)
    except InvalidPolicy as error:
        return str(error), None


def rule_list(policy_df: DataFrame) -> DataFrame:
    """The rules in the order they are tried."""
    return policy_df.select("policy_id", "rule_idx", "id", "trigger", "action").orderBy(
        "policy_id", "rule_idx"
    )
