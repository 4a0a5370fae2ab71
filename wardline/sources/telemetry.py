"""EVENT rows from telemetry tables.

Every function takes a raw table (batch or stream) and the registry, and keeps
only rows that concern a registered service. All but ``visit_events`` and
``dns_events`` are row by row: filters on the scan, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.network import (
    HTTP_PORTS,
    http_headers_sql,
    is_http_request,
    netstat_peer_sql,
    payload_protocol,
    peer_address_sql,
    peer_port_sql,
)
from wardline.functions.text import binary_name_sql, extract_host_sql, shell_command_sql
from wardline.operators.contains import join_pattern_owner
from wardline.operators.dedup import top_n_per_group
from wardline.operators.matching import (
    host_matches,
    is_literal_sized,
    join_host_signature,
    keep_host_matches,
    keep_program_matches,
    program_matches,
    sql_texts,
    url_matches,
    with_computed,
)
from wardline.operators.ranges import join_range_owner
from wardline.operators.secrets import secret_lines
from wardline.registry import Registry
from wardline.schemas import as_events
from wardline.session import configure

# Fixed value: visits read per browser profile.
VISITS_PER_PROFILE = 10_000


def process_events(processes: DataFrame, registry: Registry) -> DataFrame:
    """``host, ts, pid, name, argv, exe_path``: processes whose name contains a known one."""
    found = keep_program_matches(processes, "name", registry).withColumn(
        "cmdline", F.array_join("argv", " ")
    )
    return as_events(
        found,
        source="process",
        type_="process",
        key=["host", "CAST(pid AS string)", "name", "cmdline"],
    )


def shell_events(lines: DataFrame, registry: Registry, *, fish_prefix: bool = False) -> DataFrame:
    """``host, ts, shell, history_file, line_number, line``: lines whose program starts with a known name.

    Each line is an event of its own, however often the command is repeated. A
    numbered line is known by its place in the history, whose time is that of the
    file; a line without a number is known by its time. ``fish_prefix`` also reads
    fish's ``- cmd: `` lines, which otherwise never match.
    """
    lines = lines.withColumn(
        "_place", F.col("line_number").cast("string") if "line_number" in lines.columns else F.lit(None).cast("string")
    ).drop("line_number")
    if is_literal_sized(registry):
        # most lines hold no known name at all: skip those before any parsing
        lines = lines.filter(program_matches("line", registry))
    command = shell_command_sql("line")
    if fish_prefix:
        command = f"regexp_replace({command}, '^- cmd: ', '')"
    parsed = with_computed(lines, command=command).filter("command <> ''")
    named = with_computed(parsed, _program=binary_name_sql("command"))
    found = keep_program_matches(named, "_program", registry, prefix=True)
    return as_events(
        found,
        source="shell_history",
        type_="shell_history",
        key=["host", "history_file", "_place", "command"],
        timed="_place IS NULL",
    )


def latest_visits(visits: DataFrame, per_profile: int | None = VISITS_PER_PROFILE) -> DataFrame:
    """The latest visits of each ``host, browser, profile``; Firefox needs a visit time.

    ``None`` keeps all visits, without a shuffle.
    """
    usable = visits.filter((F.col("browser") != "Firefox") | F.col("visit_ts").isNotNull())
    if per_profile is None:
        return usable
    return top_n_per_group(
        usable,
        ["host", "browser", "profile"],
        [F.col("visit_ts").desc_nulls_last(), F.col("url"), F.col("title")],
        per_profile,
    )


def visit_events(
    visits: DataFrame, registry: Registry, *, per_profile: int | None = VISITS_PER_PROFILE
) -> DataFrame:
    """``host, browser, profile, visit_ts, url, title``: latest visits to known services.

    The limit belongs to a whole table; parts of one, as micro-batches, take ``None``.
    """
    recent = latest_visits(visits, per_profile)
    if is_literal_sized(registry):
        found = recent.filter(url_matches("url", registry))
    else:
        recent = with_computed(recent, _host=extract_host_sql("url"))
        found = keep_host_matches(recent, "_host", registry)
    found = found.withColumn("ts", F.col("visit_ts"))
    return as_events(
        found,
        source="browser_history",
        type_="browser_history",
        key=["host", "browser", "profile", "url"],
    )


def parse_netstat(lines: DataFrame) -> DataFrame:
    """``host, ts, line`` -> ``host, ts, remote_ip, port`` of TCP lines in addr.port style."""
    peers = with_computed(lines, _peer=netstat_peer_sql("line")).filter("_peer <> ''")
    return peers.selectExpr(
        "host",
        "ts",
        f"{peer_address_sql('_peer')} AS remote_ip",
        f"{peer_port_sql('_peer')} AS port",
    ).filter("port BETWEEN 0 AND 65535")


def netstat_events(
    lines: DataFrame, registry: Registry, *, ranges: DataFrame | None = None
) -> DataFrame:
    """``host, ts, line``: connections to known hosts in listings of the system."""
    return connection_events(parse_netstat(lines), registry, ranges=ranges)


def _network_events(found: DataFrame) -> DataFrame:
    return as_events(
        found,
        source="network",
        type_="network_connection",
        key=[
            "host", "protocol", "remote_host", "coalesce(remote_ip, '')", "CAST(port AS string)",
        ],
    )


def connection_events(
    connections: DataFrame, registry: Registry, *, ranges: DataFrame | None = None
) -> DataFrame:
    """``host, ts, remote_ip, port``: connections whose remote address is a known host.

    With ``ranges`` (cidr, owner), also those to an address in one of them.
    """
    named = connections.withColumn("remote_host", F.col("remote_ip"))
    found = _known(named, registry, ranges)
    return _network_events(found.withColumn("protocol", F.lit("tcp")))


def _known(df: DataFrame, registry: Registry, ranges: DataFrame | None) -> DataFrame:
    """Rows whose ``remote_host`` is covered or, with ``ranges``, whose ``remote_ip`` lies in one."""
    if ranges is None:
        return keep_host_matches(df, "remote_host", registry)
    owned = join_range_owner(df, "remote_ip", ranges, "_owner")
    in_range = F.col("_owner").isNotNull()
    if is_literal_sized(registry):
        return owned.filter(in_range | host_matches("remote_host", registry)).drop("_owner")
    owned = join_host_signature(owned, "remote_host", registry, "_hit")
    return owned.filter(in_range | F.col("_hit").isNotNull()).drop("_owner", "_hit")


def reachable_domains(answers: DataFrame, registry: Registry) -> DataFrame:
    """``host, ts, domain, resolved`` -> latest resolving answer per machine and registry domain."""
    resolving = answers.filter("resolved")
    domains = list(registry.domains())
    if domains and is_literal_sized(registry):
        resolving = resolving.filter(F.expr(f"domain IN ({sql_texts(domains)})"))
    else:
        # the whole name must be registered, not only a suffix of it
        table = registry.frame(answers.sparkSession).select(F.explode("domains").alias("domain"))
        resolving = resolving.join(table.distinct(), "domain", "left_semi")
    return resolving.groupBy("host", "domain").agg(F.max("ts").alias("ts"))


def dns_events(answers: DataFrame, registry: Registry) -> DataFrame:
    """One event per machine and registry domain that resolves there."""
    found = reachable_domains(answers, registry).select(
        "host",
        "ts",
        F.col("domain").alias("remote_host"),
        F.lit(None).cast("string").alias("remote_ip"),
        F.lit(443).alias("port"),
        F.lit("dns").alias("protocol"),
    )
    return _network_events(found)


def http_events(
    payloads: DataFrame,
    registry: Registry,
    *,
    ranges: DataFrame | None = None,
    agents: DataFrame | None = None,
) -> DataFrame:
    """``host, ts, dst_ip, port, payload``: requests to a known host or with an authorization.

    With ``ranges`` (cidr, owner) or ``agents`` (pattern, owner), also those to such an
    address, or of a client whose user agent contains a pattern.
    """
    configure(payloads.sparkSession)
    requests = payloads.filter(
        (F.length("payload") > 0)
        & F.col("port").isin(HTTP_PORTS)
        & F.is_valid_utf8("payload")
        & is_http_request(F.col("payload"))
    )
    headers = with_computed(requests, _headers=http_headers_sql("payload"))
    named = F.col("_headers")["host"]
    parsed = headers.select(
        "host",
        "ts",
        F.when(named != "", named).otherwise(F.col("dst_ip")).alias("remote_host"),
        F.col("dst_ip").alias("remote_ip"),
        "port",
        payload_protocol(F.col("port")).alias("protocol"),
        F.when(F.size("_headers") > 0, F.col("_headers")).alias("http_headers"),
    )
    has_auth = F.coalesce(F.map_contains_key("http_headers", "authorization"), F.lit(False))
    if ranges is not None:
        parsed = join_range_owner(parsed, "remote_ip", ranges, "_owner")
        has_auth = has_auth | F.col("_owner").isNotNull()
    if agents is not None:
        parsed = parsed.withColumn("_agent", F.col("http_headers")["user-agent"])
        parsed = join_pattern_owner(parsed, "_agent", agents, "_client")
        has_auth = has_auth | F.col("_client").isNotNull()
    if is_literal_sized(registry):
        found = parsed.filter(has_auth | host_matches("remote_host", registry))
    else:
        found = join_host_signature(parsed, "remote_host", registry, "_hit").filter(
            has_auth | F.col("_hit").isNotNull()
        )
    return _network_events(found)


def tls_events(
    names: DataFrame, registry: Registry, *, ranges: DataFrame | None = None
) -> DataFrame:
    """``host, ts, sni, dst_ip, port``: TLS handshakes naming a known host, or with one of ``ranges``."""
    tls = names.filter(payload_protocol(F.col("port")) == "https").select(
        "host",
        "ts",
        F.col("sni").alias("remote_host"),
        F.col("dst_ip").alias("remote_ip"),
        "port",
        F.lit("https").alias("protocol"),
    )
    return _network_events(_known(tls, registry, ranges))


def code_events(files: DataFrame, registry: Registry | None = None, **options) -> DataFrame:
    """``repo, path, mtime, content``: one event per line that holds a secret.

    The event time is the file's mtime (nanoseconds).
    """
    found = (
        secret_lines(files, **options)
        .withColumn("file_path", F.concat_ws("/", "repo", "path"))
        .withColumn("ts", F.timestamp_micros(F.expr("mtime div 1000")))
    )
    return as_events(
        found,
        source="codebase",
        type_="codebase_file",
        key=["file_path", "CAST(line_number AS string)", "matched_text"],
    )
