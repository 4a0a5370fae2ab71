"""Joins of telemetry with the signature registry.

A registry of ordinary size becomes literals inside the plan: matching is then
a filter on the scan, without any join or shuffle. A larger one is joined as a
table instead, broadcast only if its texts are few enough bytes. Both ways give
the same rows. Where several signatures match, the smallest id is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.text import last_labels, spark_regex
from wardline.operators.contains import join_pattern_owner
from wardline.registry import Registry, Signature, local_frame
from wardline.schemas import DLP_MATCH
from wardline.session import spread

# Up to here a lookup is written into the plan as literals.
LITERAL_LIMIT = 256
# Up to here a lookup table's texts are broadcast; beyond, Spark picks the join by size.
BROADCAST_BYTES = 8_000_000
# Patterns of one projection; more are spread over several.
PATTERNS_PER_STEP = 256

_NO_TEXT = "CAST(NULL AS string)"


def sql_text(value: str) -> str:
    """``value`` as a SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_texts(values: Iterable[str]) -> str:
    return ", ".join(map(sql_text, values))


def any_of(conditions: list[str]) -> Column:
    return F.expr(" OR ".join(conditions) or "false")


def with_computed(df: DataFrame, **columns: str) -> DataFrame:
    """Add columns (SQL expressions) that are worked out once per row.

    A filter on a plain ``withColumn`` result is pushed below it with the whole
    expression copied in for every mention; a generator of one row is not.
    """
    fields = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return df.selectExpr("*", f"inline(array(struct({fields})))")


def lookup_join(df: DataFrame, table: DataFrame, texts: Iterable[str], on: Column) -> DataFrame:
    """Left join with a lookup table that holds ``texts``."""
    size = sum(len(text.encode()) + 16 for text in texts)
    return df.join(F.broadcast(table) if size <= BROADCAST_BYTES else table, on, "left")


def _pairs(owners: dict[str, str]) -> Iterable[str]:
    return (text for pair in owners.items() for text in pair)


# --- hosts ------------------------------------------------------------------


def _domains_by_labels(registry: Registry) -> dict[int, dict[str, str]]:
    groups: dict[int, dict[str, str]] = {}
    for domain, owner in registry.domains().items():
        groups.setdefault(domain.count(".") + 1, {})[domain] = owner
    return groups


def host_matches(host: str, registry: Registry) -> Column:
    """The host in column ``host`` equals a registry domain or lies under one.

    A domain of n labels covers a host exactly if the last n labels of the
    host are that domain, so the suffix test is a few set look-ups.
    """
    return any_of(
        [
            f"substring_index({host}, '.', -{n}) IN ({sql_texts(domains)})"
            for n, domains in _domains_by_labels(registry).items()
        ]
    )


def url_matches(url: str, registry: Registry) -> Column:
    """``host_matches`` of the URL's host, as one expression over the raw URL."""
    domains = "|".join(re.escape(d) for d in registry.domains() if not re.search("[/?]", d))
    if not domains:
        return F.lit(False)
    return F.col(url).rlike(rf"^(?:https://)*+(?:http://)*+(?:[^/?]*\.)?(?:{domains})(?:[/?]|\z)")


def host_signature(host: str, registry: Registry) -> Column:
    """Id of the signature whose domains cover the host, else null."""
    hits = [
        f"map({sql_texts(part for pair in domains.items() for part in pair)})"
        f"[substring_index({host}, '.', -{n})]"
        for n, domains in _domains_by_labels(registry).items()
    ]
    return F.expr(f"least({', '.join([*hits, _NO_TEXT, _NO_TEXT])})")


def join_host_signature(df: DataFrame, host: str, registry: Registry, out: str) -> DataFrame:
    """``host_signature`` for a registry of any size: one equi join per label count."""
    found = []
    for n, domains in sorted(_domains_by_labels(registry).items()):
        table = local_frame(
            df.sparkSession,
            [{f"_dom{n}": domain, f"_sig{n}": owner} for domain, owner in domains.items()],
            f"_dom{n} string, _sig{n} string",
        )
        on = last_labels(F.col(host), n) == F.col(f"_dom{n}")
        df = lookup_join(df, table, _pairs(domains), on).drop(f"_dom{n}")
        found.append(f"_sig{n}")
    nothing = F.lit(None).cast("string")
    return df.withColumn(out, F.least(*found, nothing, nothing)).drop(*found)


# --- programs ---------------------------------------------------------------


def program_matches(name: str, registry: Registry) -> Column:
    """The name in column ``name`` contains a registry process name."""
    return any_of([f"contains({name}, {sql_text(part)})" for part in registry.process_names()])


def program_starts_with(name: str, registry: Registry) -> Column:
    """The name equals a registry process name or starts with one."""
    return any_of([f"startswith({name}, {sql_text(part)})" for part in registry.process_names()])


def program_signature(name: str, registry: Registry) -> Column:
    """Id of the signature one of whose process names the name contains, else null."""
    parts_of: dict[str, list[str]] = {}
    for part, owner in registry.process_names().items():
        parts_of.setdefault(owner, []).append(f"contains({name}, {sql_text(part)})")
    cases = [
        f"WHEN {' OR '.join(parts_of[owner])} THEN {sql_text(owner)}" for owner in sorted(parts_of)
    ]
    return F.expr(f"CASE {' '.join(cases)} END" if cases else _NO_TEXT)


def join_program_signature(
    df: DataFrame, name: str, registry: Registry, out: str, *, prefix: bool = False
) -> DataFrame:
    """``program_signature`` for a registry of any size.

    Distinct names meet the registry's names by their rarest grams (or, with ``prefix``, first ones).
    """
    owners = registry.process_names()
    always = owners.pop("", None)
    if not owners:
        return df.withColumn(out, F.when(F.col(name).isNotNull(), F.lit(always)).cast("string"))
    table = local_frame(
        df.sparkSession,
        [{"pattern": part, "owner": owner} for part, owner in owners.items()],
        "pattern string, owner string",
    )
    found = join_pattern_owner(df, name, table, "_sig", prefix=prefix)
    any_name = F.when(F.col(name).isNotNull(), F.lit(always)).cast("string")
    return found.withColumn(out, F.least(F.col("_sig"), any_name)).drop("_sig")


def registry_agents(spark: SparkSession, registry: Registry) -> DataFrame:
    """``pattern, owner``: texts that name a service's clients in a user agent."""
    rows = [{"pattern": text, "owner": sig.id} for sig in registry.all() for text in sig.user_agents]
    return local_frame(spark, rows, "pattern string, owner string")


def keep_host_matches(df: DataFrame, host: str, registry: Registry) -> DataFrame:
    """Rows whose ``host`` column is covered by some signature."""
    if is_literal_sized(registry):
        return df.filter(host_matches(host, registry))
    return join_host_signature(df, host, registry, "_hit").filter("_hit IS NOT NULL").drop("_hit")


def keep_program_matches(
    df: DataFrame, name: str, registry: Registry, *, prefix: bool = False
) -> DataFrame:
    """Rows whose ``name`` column contains, or with ``prefix`` starts with, a process name."""
    if is_literal_sized(registry):
        test = program_starts_with if prefix else program_matches
        return df.filter(test(name, registry))
    return (
        join_program_signature(df, name, registry, "_hit", prefix=prefix)
        .filter("_hit IS NOT NULL")
        .drop("_hit")
    )


# --- signature of an event, attributes of a signature -------------------------


def is_literal_sized(registry: Registry) -> bool:
    return (
        max(len(registry), len(registry.domains()), len(registry.process_names()))
        <= LITERAL_LIMIT
    )


def with_signature_id(df: DataFrame, host: str, program: str, registry: Registry) -> DataFrame:
    """Add ``signature_id``: by column ``host`` where it has a match, else by ``program``."""
    if is_literal_sized(registry):
        found = F.coalesce(host_signature(host, registry), program_signature(program, registry))
        return df.withColumn("signature_id", found)
    df = join_host_signature(df, host, registry, "_by_host")
    df = join_program_signature(df, program, registry, "_by_program")
    return df.withColumn("signature_id", F.coalesce("_by_host", "_by_program")).drop(
        "_by_host", "_by_program"
    )


def with_signature_info(df: DataFrame, registry: Registry) -> DataFrame:
    """Add ``signature``: name, risk base and tags of ``signature_id``, null without one."""
    if is_literal_sized(registry) and len(registry):
        info = ", ".join(
            f"{sql_text(sig.id)}, named_struct('name', {sql_text(sig.name)}, "
            f"'risk_base', {sig.risk_base}, "
            f"'tags', CAST(array({sql_texts(sig.tags)}) AS array<string>))"
            for sig in registry.all()
        )
        return df.withColumn("signature", F.expr(f"map({info})[signature_id]"))
    table = registry.frame(df.sparkSession).select(
        F.col("id").alias("_id"), F.struct("name", "risk_base", "tags").alias("signature")
    )
    texts = (text for sig in registry.all() for text in (sig.id, sig.name, *sig.tags))
    return lookup_join(df, table, texts, F.col("signature_id") == F.col("_id")).drop("_id")


# --- sensitive patterns -------------------------------------------------------


# Pattern -> whether it is a valid regular expression, for patterns tried so far.
_KNOWN: dict[str, bool] = {}


def usable_patterns(spark: SparkSession, registry: Registry) -> Registry:
    """The registry without patterns that are no valid regular expressions.

    Patterns not seen before are tried in one go; only if that fails, one by one.
    """
    patterns = {p.pattern for sig in registry.all() for p in sig.dlp_patterns}
    new = sorted(patterns - _KNOWN.keys())
    if new:
        fine = _compiles(spark, new)
        _KNOWN.update((p, fine or _compiles(spark, [p])) for p in new)
    bad = {p for p in patterns if not _KNOWN[p]}
    if not bad:
        return registry
    return Registry.of(
        Signature(
            **{
                **vars(sig),
                "dlp_patterns": tuple(p for p in sig.dlp_patterns if p.pattern not in bad),
            }
        )
        for sig in registry.all()
    )


def _compiles(spark: SparkSession, patterns: list[str]) -> bool:
    probe = ", ".join(f"'' RLIKE {sql_text(spark_regex(p))}" for p in patterns)
    try:
        spark.range(1).select(F.expr(f"array({probe})")).collect()
    except PySparkException:
        return False
    return True


_NO_MATCHES = f"CAST(array() AS array<{DLP_MATCH}>)"


def _severity(text: str) -> str:
    return text if text in ("critical", "high") else "low"


def dlp_matches(signature_id: str, text: str, registry: Registry) -> Column:
    """Every pattern of the matched signature found in column ``text``, in signature order."""
    cases = [
        f"WHEN {sql_text(sig.id)} THEN array_compact(array({', '.join(_hit_sql(text, sig))}))"
        for sig in registry.all()
        if sig.dlp_patterns
    ]
    found = f"CASE {signature_id} {' '.join(cases)} END" if cases else "NULL"
    return F.expr(f"coalesce({found}, {_NO_MATCHES})")


def _hit_sql(text: str, sig: Signature) -> list[str]:
    return [
        f"CASE WHEN {text} RLIKE {sql_text(spark_regex(p.pattern))} THEN named_struct("
        f"'pattern_id', {sql_text(p.id)}, 'description', {sql_text('DLP match: ' + p.id)}, "
        f"'severity', '{_severity(p.severity)}') END"
        for p in sig.dlp_patterns
    ]


def with_dlp_matches(df: DataFrame, text: str, registry: Registry) -> DataFrame:
    """Add ``dlp_matches`` of the matched signature in column ``text``.

    Each pattern is a literal, compiled once per task, in the branch of its
    signature. Branches of more patterns than one projection should hold go to
    several, of which a row takes the one with its signature.
    """
    registry = usable_patterns(df.sparkSession, registry)
    steps: list[list[Signature]] = [[]]
    for sig in registry.all():
        if sum(len(s.dlp_patterns) for s in steps[-1]) >= PATTERNS_PER_STEP:
            steps.append([])
        steps[-1].append(sig)
    if len(steps) == 1:
        return df.withColumn("dlp_matches", dlp_matches("signature_id", text, registry))
    names = [f"_dlp_{k}" for k in range(len(steps))]
    for name, step in zip(names, steps, strict=True):
        df = df.withColumn(name, dlp_matches("signature_id", text, Registry.of(step)))
    return df.withColumn("dlp_matches", F.concat(*names)).drop(*names)


def all_pattern_hits(df: DataFrame, text: str, registry: Registry) -> DataFrame:
    """One row per input row and signature pattern found anywhere in column ``text``."""
    registry = usable_patterns(df.sparkSession, registry)
    hits = [
        f"CASE WHEN {text} RLIKE {sql_text(spark_regex(p.pattern))} THEN named_struct("
        f"'signature_id', {sql_text(sig.id)}, 'pattern_id', {sql_text(p.id)}, "
        f"'severity', '{_severity(p.severity)}') END"
        for sig in registry.all()
        for p in sig.dlp_patterns
    ]
    return (
        spread(df)
        .withColumn("_hit", F.expr(f"explode(array_compact(array({', '.join(hits)})))"))
        .select(*df.columns, "_hit.*")
    )
