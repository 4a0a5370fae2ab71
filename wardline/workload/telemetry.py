"""Fleet telemetry derived from the test tables by plain arithmetic on their ids.

The test tables hold no AI hosts, commands or keys. Each function maps one of
them row by row to a raw telemetry table, so sizes grow with the tables. The
oracle states the same arithmetic in its own SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOSTS = [
    "api.openai.com", "chat.openai.com", "evil-openai.com", "API.OPENAI.COM",
    "api.openai.com:443", "localhost", "unknown.internal", "api.anthropic.com",
    "files.oaiusercontent.com", "127.0.0.1", "myres.openai.azure.com", "huggingface.co",
    "10.0.0.7",
]
DNS_NAMES = [
    "api.openai.com", "claude.ai", "localhost", "api.groq.com", "hf.co", "www.openai.com",
    "example.org", "perplexity.ai", "api.mistral.ai", "evil-openai.com", "gemini.google.com",
]
PROGRAMS = [
    "ollama", "ollama_llama_server", "claude", "nginx", "chatgpt-desktop", "python3",
    "my-openai-proxy", "gemini", "local-ai", "mistral-cli", "transformers-serve", "groqd",
    "claude-ollama",
]
SERVICES = [
    "anthropic", "azure-openai", "cohere", "google-ai", "groq", "huggingface", "localai",
    "mistral", "ollama", "openai", "perplexity",
]


# The test tables in use. A declared schema saves a job that looks into the files.
TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def sql_list(values: list) -> str:
    return "array(" + ", ".join(repr(v) for v in values) + ")"


def pick(values: list, index: str) -> str:
    return f"element_at({sql_list(values)}, cast({index} % {len(values)} as int) + 1)"


def derived(df: DataFrame, *columns: str) -> DataFrame:
    """Columns worked out once per row, as if they had been read from a table."""
    return df.selectExpr(f"inline(array(struct({', '.join(columns)})))")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "CAST(ts AS timestamp) AS ts",
        "concat('m', user_id % 40) AS host",
        "event_type",
    )


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(
        _events(spark, sf_dir),
        "host",
        "ts",
        f"{pick(HOSTS, 'event_id')} AS remote_ip",
        f"{pick([443, 80, 8080, 22], 'event_id')} AS port",
    )


# Ranges of the test addresses below; nested ones, both families, one alone, one invalid.
IP_RANGES = {
    "openai": ["10.1.0.0/16", "11.0.0.0/8", "2001:db8:1::/48"],
    "anthropic": ["10.1.112.0/20", "2001:db8::/32", "11.3.35.0/27"],
    "groq": ["12.4.98.9", "2001:DB8:1:0:0::8:0/110", "::ffff:10.2.0.0/112"],
    "mistral": ["12.0.0.0/7", "300.1.1.0/24", "fe80::/10"],
}


def ranged_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections to addresses of both families in several spellings."""
    quad = "concat_ws('.', 10 + event_id % 3, event_id % 5, (event_id * 7) % 256, (event_id * 13) % 256)"
    return derived(
        _events(spark, sf_dir),
        "host",
        "ts",
        f"""CASE event_id % 8
            WHEN 4 THEN concat('2001:db8:', lower(hex(event_id % 3)), '::', lower(hex(event_id % 65536)))
            WHEN 5 THEN concat('2001:0DB8:', hex(event_id % 3), ':0:0:0:', hex(event_id % 16), ':', hex(event_id % 256))
            WHEN 6 THEN concat('::FFFF:', {quad})
            WHEN 7 THEN {pick(['fe80::1%en0', 'api.openai.com', '10.1.2', '[2001:db8::7]', '::1'], 'event_id')}
            ELSE {quad} END AS remote_ip""",
        f"{pick([443, 80, 8080, 22], 'event_id')} AS port",
    )


def many_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten ranges an event, from /12 to /30; every third event repeats the ranges of one network."""
    number = "(event_id * 2654435761 + k * 40503 * event_id) % 4294967296"
    return _events(spark, sf_dir).selectExpr("event_id", "explode(sequence(0, 9)) AS k").selectExpr(
        f"CASE WHEN event_id % 3 = 0 THEN 184549376 + (event_id * 97 + k) % 65536 * 256 ELSE {number} END AS n",
        "12 + (event_id + k * 5) % 19 AS bits",
        "concat('owner-', event_id % 997) AS owner",
    ).selectExpr(
        "concat(n DIV 16777216, '.', n DIV 65536 % 256, '.', n DIV 256 % 256, '.', n % 256, '/', bits) AS cidr", "owner"
    )


def many_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address an event; a third of all is one, another third in one network."""
    return _events(spark, sf_dir).selectExpr(
        "event_id",
        "CASE event_id % 3 WHEN 0 THEN 184549376 + 4711 WHEN 1 THEN 184549376 + (event_id * 7919) % 16777216"
        " ELSE (event_id * 2654435761 + 12345) % 4294967296 END AS n",
    ).selectExpr(
        "event_id", "concat(n DIV 16777216, '.', n DIV 65536 % 256, '.', n DIV 256 % 256, '.', n % 256) AS address"
    )


def netstat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    peer = f"{pick(HOSTS, 'event_id')}"
    port = f"{pick([443, 80, 8080, 22], 'event_id')}"
    local = "concat('192.168.1.5.', 50000 + event_id % 10000)"
    return derived(
        _events(spark, sf_dir),
        "host",
        "ts",
        f"""CASE event_id % 7
            WHEN 0 THEN concat('tcp4       0      0  ', {local}, '  ', {peer}, '.', {port}, '  ESTABLISHED')
            WHEN 1 THEN concat('tcp6  0 0 ', {local}, ' ', {peer}, '.', {port}, ' TIME_WAIT')
            WHEN 2 THEN concat('udp4  0 0 ', {local}, ' ', {peer}, '.', {port})
            WHEN 3 THEN concat('tcp4  0 0 ', {local})
            WHEN 4 THEN 'tcp   0 0 10.0.0.1:5000 10.0.0.9:443 ESTABLISHED'
            WHEN 5 THEN concat('tcp4  0 0 ', {local}, ' ', {peer}, '.', 65000 + event_id % 1000, ' CLOSED')
            ELSE concat('  tcp4\\t0\\t0\\t', {local}, '\\t', {peer}, '.', {port})
        END AS line""",
    )


def dns_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(
        _events(spark, sf_dir),
        "host", "ts", f"{pick(DNS_NAMES, 'event_id')} AS domain", "event_id % 3 <> 0 AS resolved"
    )


def http_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = pick(HOSTS, "event_id")
    key = "md5(cast(event_id as string))"
    return derived(
        _events(spark, sf_dir),
        "host",
        "ts",
        "concat('10.1.', event_id % 200, '.7') AS dst_ip",
        f"{pick([80, 8080, 443, 22], 'event_id')} AS port",
        f"""CASE event_id % 9
            WHEN 0 THEN concat('POST /v1/chat/completions HTTP/1.1\\r\\nHost: ', {site},
                '\\r\\nContent-Type: application/json\\r\\n\\r\\nHost: evil.example.com')
            WHEN 1 THEN concat('POST /api HTTP/1.1\\r\\nHost: unknown.internal\\r\\nAuthorization: Bearer sk-',
                {key}, '\\r\\n\\r\\n')
            WHEN 2 THEN concat('GET / HTTP/1.1\\nHOST:   ', {site}, '  \\nX-Ratio: 1:2\\n\\nbody')
            WHEN 3 THEN 'TRACE / HTTP/1.1\\r\\nHost: api.openai.com\\r\\n\\r\\n'
            WHEN 4 THEN concat(chr(1), chr(2), 'garbage')
            WHEN 5 THEN ''
            WHEN 6 THEN 'GET /\\r\\nHost: a.example.com\\r\\nhost: claude.ai\\r\\nnocolon\\r\\n\\r\\n'
            WHEN 7 THEN 'PUT /x HTTP/1.1\\r\\nAccept: */*\\r\\n\\r\\nHost: api.openai.com'
            ELSE 'DELETE'
        END AS payload""",
    )


def agent_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of clients to hosts that are not known; some name a service's client."""
    agent = pick(["openai-python/1.2 (x86)", "Mozilla/5.0", "my groq-python", "OPENAI-PYTHON/1", "openai-go 0.1 transformers", ""], "event_id")
    return derived(
        _events(spark, sf_dir),
        "host",
        "ts",
        "concat('10.3.', event_id % 200, '.7') AS dst_ip",
        "80 AS port",
        f"""concat('GET / HTTP/1.1\r\nHost: gw', event_id % 5, '.internal\r\n',
            CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('User-Agent: ', {agent}, '\r\n') END, '\r\n') AS payload""",
    )


def many_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern an event; all share most of their grams."""
    return _events(spark, sf_dir).selectExpr(
        "concat('agent-', event_id, '/', event_id % 3) AS pattern", "concat('o', event_id % 113) AS owner"
    )


def agent_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user agent an event; a third of all is one, some are missing."""
    return _events(spark, sf_dir).selectExpr(
        "event_id",
        "CASE event_id % 6 WHEN 0 THEN 'hot client agent-7/1 agent-70/1 (X11)' WHEN 3 THEN 'hot client agent-7/1 agent-70/1 (X11)'"
        " WHEN 1 THEN NULL ELSE concat('Mozilla/5.0 (agent-', (event_id * 31) % 4000, '/', event_id % 3, '; rv) lib/', event_id % 4) END AS agent",
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts to deliver the alerts of some days, some of them noted twice."""
    rows = _events(spark, sf_dir).filter("event_id % 5 = 0").selectExpr(
        "date_format(ts, 'yyyy-MM-dd') AS batch_id",
        f"{pick(['slack', 'pager', 'mail'], 'event_id')} AS channel",
        "CAST(1 + event_id % 4 AS INT) AS attempt",
        "CASE WHEN event_id % 1000 = 0 THEN 'sent' WHEN event_id % 2 = 0 THEN 'failed' ELSE 'sending' END AS state",
        "ts AS at",
    )
    return rows.unionByName(rows.filter("attempt = 2"))


def leaky_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with keys in headers and bodies: plain, in percent form, in base64."""
    key = "md5(cast(event_id as string))"
    head = "concat('POST /v1/c?e=', event_id, ' HTTP/1.1\r\nHost: a.example.com\r\n')"
    return derived(
        _events(spark, sf_dir),
        "event_id",
        f"""concat({head}, CASE event_id % 8
            WHEN 0 THEN concat('Authorization: Bearer sk-', {key}, '\r\n\r\nkey=hf_', {key}, '&x=1')
            WHEN 1 THEN concat('X-Auth: Basic ', base64(encode(concat('user:sk-ant-', {key}), 'utf-8')), '\r\n\r\n')
            WHEN 2 THEN concat('Accept: */*\r\n\r\nq=%73k%2D', {key}, '+%2B&r=%zz')
            WHEN 3 THEN concat('Accept: */*\r\n\r\nq=%73k%2D', {key}, '+%2B%C3%A9')
            WHEN 4 THEN concat('X-A: sk-', {key}, ' and sk-', reverse({key}), '\r\n\r\n', {key}, ' ', {key})
            WHEN 5 THEN concat('\r\n{{"blob":"', base64(encode(concat('AIza', {key}, 'abc é'), 'utf-8')), '","n":1}}')
            WHEN 6 THEN '\r\nnothing here'
            ELSE concat('X-Auth: ', {key}, {key}, '\r\n\r\n')
        END) AS payload""",
    )


def cloud_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit lines in three providers' shapes, lists of records, and lines that cannot be used."""
    site, time = pick(HOSTS, "event_id"), "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    first = (
        f"concat('{{\"eventTime\":\"', {time}, '\",\"eventSource\":\"', {site}, '\",\"eventName\":\"Invoke', event_id % 4,"
        " '\",\"userIdentity\":{\"arn\":\"arn:u', event_id % 7, '\"},\"sourceIPAddress\":\"10.0.0.', event_id % 9,"
        " '\",\"eventID\":\"e', event_id, '\"}')"
    )
    second = (
        f"concat('{{\"timestamp\":', unix_millis(ts) div 1000 * 1000, ',\"insertId\":\"i', event_id, '\",\"protoPayload\":{{\"serviceName\":\"', {site},"
        " '\",\"methodName\":\"Predict\",\"authenticationInfo\":{\"principalEmail\":\"u', event_id % 7, '@x.org\"}}}')"
    )
    return derived(
        _events(spark, sf_dir),
        "host",
        "ts",
        f"""CASE event_id % 10
            WHEN 0 THEN {first} WHEN 1 THEN {second}
            WHEN 2 THEN concat('{{"Records":[', {first}, ',', {second}, ',7]}}')
            WHEN 3 THEN concat('{{"time":"', {time}, '","host":"', {site}, '","operation":"chat","user":null}}')
            WHEN 4 THEN left({first}, 40) WHEN 5 THEN '' WHEN 6 THEN '[1,2]'
            WHEN 7 THEN concat('{{"eventTime":"yesterday","eventSource":"', {site}, '"}}')
            WHEN 8 THEN '{{"Records":[]}}'
            ELSE concat('{{"eventTime":"', {time}, '","eventSource":{{"name":"x"}},"host":" "}}')
        END AS line""",
    )


def tls_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(
        _events(spark, sf_dir),
        "host",
        "ts",
        f"{pick(HOSTS, '(event_id * 5)')} AS sni",
        "concat('10.2.', event_id % 200, '.9') AS dst_ip",
        f"{pick([443, 8443, 80, 993], 'event_id')} AS port",
    )


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = pick(PROGRAMS, "event_id")
    key = "md5(cast(event_id as string))"
    return derived(
        _events(spark, sf_dir),
        "host",
        "ts",
        "1000 + event_id AS pid",
        f"{name} AS name",
        f"""array(concat('/usr/bin/', {name}), '--key', CASE event_id % 5
            WHEN 0 THEN concat('sk-', {key})
            WHEN 1 THEN concat('org-', substr({key}, 1, 24))
            WHEN 2 THEN concat('sk-ant-', {key})
            WHEN 3 THEN concat('AIza', {key}, 'abc')
            ELSE 'none'
        END) AS argv""",
        f"concat('/usr/bin/', {name}) AS exe_path",
    )


def shell_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = "md5(cast(event_id as string))"
    return derived(
        _events(spark, sf_dir),
        "host",
        "ts",
        f"{pick(['bash', 'zsh', 'fish'], 'event_id')} AS shell",
        f"{pick(['/h/.bash_history', '/h/.zsh_history', '/h/fish_history'], 'event_id')} AS history_file",
        "CAST(event_id AS INT) AS line_number",
        f"""CASE event_id % 11
            WHEN 0 THEN '/usr/bin/ollama run x'
            WHEN 1 THEN ': 1700000000:0;ollama run llama3; ls'
            WHEN 2 THEN 'ls -la'
            WHEN 3 THEN ''
            WHEN 4 THEN '   '
            WHEN 5 THEN concat('  claude --key sk-ant-', {key})
            WHEN 6 THEN '- cmd: ollama run x'
            WHEN 7 THEN concat(': 1700000000:0;openai api --key sk-', {key}, ';second')
            WHEN 8 THEN ': no semicolon mistral'
            WHEN 9 THEN concat('mistral chat ', {key})
            ELSE 'my-openai tool'
        END AS line""",
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of all visits belongs to one profile."""
    from_events = derived(
        _events(spark, sf_dir),
        "CASE WHEN event_id % 3 = 0 THEN 'm0' ELSE host END AS host",
        "CASE WHEN event_id % 3 = 0 THEN 'Chrome' ELSE "
        f"{pick(['Chrome', 'Firefox', 'Brave', 'Edge'], 'event_id')} END AS browser",
        "CASE WHEN event_id % 3 = 0 THEN 'p0' ELSE concat('p', event_id % 2) END AS profile",
        "CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END AS visit_ts",
        f"concat(CASE event_id % 3 WHEN 0 THEN 'https://' WHEN 1 THEN 'http://' ELSE 'https://http://' END, "
        f"{pick(HOSTS, 'event_id')}, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('?q=', event_id) "
        "WHEN 2 THEN concat('/c/', event_id, '?x=2') ELSE '#top' END) AS url",
        "CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('title ', event_id) END AS title",
    )
    from_pages = table(spark, sf_dir, "pages").selectExpr(
        "'m1' AS host",
        "'Firefox' AS browser",
        "concat('p', page_id % 3) AS profile",
        "CASE WHEN page_id % 7 = 0 THEN NULL ELSE timestamp_seconds(1705276800 + page_id) END AS visit_ts",
        f"CASE WHEN page_id % 5 = 0 THEN concat('https://', {pick(HOSTS, 'page_id')}, '/p/', page_id) "
        "ELSE url END AS url",
        "concat('page ', page_id) AS title",
    )
    return from_events.unionByName(from_pages)


_FILE_PATH = (
    "concat(CASE doc_id % 9 WHEN 0 THEN 'target/' WHEN 1 THEN '.git/' "
    "WHEN 2 THEN 'node_modules/pkg/' ELSE 'src/' END, "
    f"CASE WHEN doc_id % 23 = 0 THEN '.env' ELSE concat('f', doc_id, '.', "
    f"{pick(['py', 'js', 'ts', 'txt', 'go', 'yaml', 'bin'], 'doc_id')}) END)"
)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = "md5(cast(doc_id as string))"
    return table(spark, sf_dir, "documents").selectExpr(
        "source AS repo",
        f"{_FILE_PATH} AS path",
        "(1704067200 + doc_id) * 1000000000 AS mtime",
        f"""cast(CASE WHEN doc_id % 10 <> 0 THEN text ELSE concat(text, CASE doc_id % 3
                WHEN 0 THEN '\\n' ELSE '\\r\\n' END, CASE (doc_id div 10) % 6
            WHEN 0 THEN concat("const API_KEY = 'sk-", {key}, "';")
            WHEN 1 THEN concat("client = Anthropic(api_key='sk-ant-api01-", {key}, "')")
            WHEN 2 THEN concat("token = 'hf_", {key}, "'\\n// end")
            WHEN 3 THEN concat('API_KEY = "', {key}, '"\\r\\n')
            WHEN 4 THEN concat('k = AIza', {key}, 'abc')
            ELSE concat('a = hf_', {key}, ' sk-', {key}, '\\nmiddle\\nsk-', {key})
        END) END as binary) AS content""",
    )


def scan_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last scan recorded: three files in four, some with an older mtime."""
    return (
        table(spark, sf_dir, "documents")
        .filter("doc_id % 4 <> 0")
        .selectExpr(
            "source AS repo",
            f"{_FILE_PATH} AS path",
            "(1704067200 + doc_id - doc_id % 3) * 1000000000 AS mtime",
        )
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, commit_seq, path``: each file is touched by one or two commits."""
    return table(spark, sf_dir, "documents").selectExpr(
        "source AS repo",
        "explode(array(doc_id % 10, doc_id % 7)) AS commit_seq",
        f"{_FILE_PATH} AS path",
    )


def last_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last scanned commit of every repo but those whose name ends in 0."""
    return (
        table(spark, sf_dir, "documents")
        .filter("source NOT LIKE '%0'")
        .groupBy(F.col("source").alias("repo"))
        .agg((F.max(F.expr("doc_id % 10")) - 3).alias("commit_seq"))
    )


def scored_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings before policy: every mix of service, severity and base risk."""
    critical = F.expr("event_id % 7 = 0")
    high = F.expr("event_id % 5 = 0")
    match = "named_struct('pattern_id', 'p', 'description', 'd', 'severity', '{}')"
    dlp = F.expr(
        "array_compact(array("
        f"CASE WHEN event_id % 7 = 0 THEN {match.format('critical')} END, "
        f"CASE WHEN event_id % 5 = 0 THEN {match.format('high')} END))"
    )
    return _events(spark, sf_dir).select(
        "event_id",
        F.expr(f"CASE WHEN event_id % 12 = 11 THEN NULL ELSE {pick(SERVICES, '(event_id % 12)')} END").alias(
            "signature_id"
        ),
        F.expr("CASE WHEN event_id % 11 = 3 THEN NULL ELSE cast(event_id % 101 as int) END").alias("base"),
        critical.alias("critical"),
        high.alias("high"),
        F.expr("event_id % 3 = 0").alias("unapproved"),
        dlp.alias("dlp_matches"),
    )


def stored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A findings table with a history of its own, one row per event."""
    score = "cast((event_id * 37) % 101 as int)"
    return derived(
        _events(spark, sf_dir),
        "concat('f', event_id) AS id",
        "ts AS timestamp",
        f"CASE WHEN event_id % 12 = 11 THEN NULL ELSE {pick(SERVICES, '(event_id % 12)')} END AS service_id",
        f"CASE WHEN event_id % 12 = 11 THEN NULL ELSE upper({pick(SERVICES, '(event_id % 12)')}) END AS service_name",
        f"{score} AS risk_score",
        f"CASE WHEN {score} <= 25 THEN 'LOW' WHEN {score} <= 50 THEN 'MEDIUM' "
        f"WHEN {score} <= 75 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level",
        "concat('seen <', event_id, '> & \"', event_type, '\"') AS detail",
        f"{pick(['net', 'process', 'browser', 'shell', 'codebase'], 'event_id')} AS source",
        "to_date(ts) AS event_date",
    )


def rewritten_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated writes of the same ids; a third of all writes has one id, some ids have no date."""
    number = "CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 1000 END"
    return derived(
        _events(spark, sf_dir),
        "event_id",
        f"concat('f', {number}) AS id",
        f"CASE WHEN ({number}) % 50 <> 7 THEN date_add(date '2024-01-01', cast(({number}) % 30 as int)) END AS event_date",
        "ts AS timestamp",
        "ts AS written_at",
        "cast((event_id * 37) % 101 as int) AS risk_score",
        f"{pick(['allow', 'warn', 'block'], 'event_id')} AS policy_action",
        "concat('seen ', event_id) AS detail",
        f"{pick(['net', 'process', 'browser', 'shell', 'codebase'], f'({number})')} AS source",
    )
