"""The same queries as DuckDB SQL over the test tables.

The statements restate telemetry, matching, scoring and policy on their own:
hosts by a suffix comparison with every domain, risk and rules as CASE.
"""

from __future__ import annotations

import ipaddress

from wardline.registry import Registry
from wardline.workload.telemetry import DNS_NAMES, HOSTS, IP_RANGES, PROGRAMS, SERVICES

DASH = " — "


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _pick(values: list, index: str) -> str:
    items = ", ".join(_text(v) if isinstance(v, str) else str(v) for v in values)
    return f"([{items}])[CAST({index} % {len(values)} AS INT) + 1]"


def _values(rows: list[tuple]) -> str:
    cells = (
        "(" + ", ".join(_text(c) if isinstance(c, str) else str(c) for c in row) + ")"
        for row in rows
    )
    return "VALUES " + ", ".join(cells)


_SIGNATURES = Registry.bundled().all()
_REGISTRY = f"""
sig(id, name, risk_base, is_local, version) AS ({_values([
    (s.id, s.name, s.risk_base, "local" in s.tags, s.version) for s in _SIGNATURES])}),
dom(domain, sig_id) AS ({_values([(d, s.id) for s in _SIGNATURES for d in s.domains])}),
prog(part, sig_id) AS ({_values([(p, s.id) for s in _SIGNATURES for p in s.process_names])}),
pat(sig_id, place, pattern_id, pattern, severity) AS ({_values([
    (s.id, i, p.id, p.pattern, p.severity)
    for s in _SIGNATURES for i, p in enumerate(s.dlp_patterns)])}),
ev AS (SELECT event_id, ts, 'm' || (user_id % 40) AS host, event_type,
        md5(CAST(event_id AS VARCHAR)) AS key FROM events)"""

# --- telemetry ---------------------------------------------------------------

_PORT = _pick([443, 80, 8080, 22], "event_id")
_SITE = _pick(HOSTS, "event_id")
_LOCAL = "'192.168.1.5.' || (50000 + event_id % 10000)"

_CONNECTIONS = f"connections AS (SELECT host, ts, {_SITE} AS remote_ip, {_PORT} AS port FROM ev)"

_NETSTAT = rf"""
netstat AS (SELECT host, ts, CASE event_id % 7
    WHEN 0 THEN 'tcp4       0      0  ' || {_LOCAL} || '  ' || {_SITE} || '.' || {_PORT} || '  ESTABLISHED'
    WHEN 1 THEN 'tcp6  0 0 ' || {_LOCAL} || ' ' || {_SITE} || '.' || {_PORT} || ' TIME_WAIT'
    WHEN 2 THEN 'udp4  0 0 ' || {_LOCAL} || ' ' || {_SITE} || '.' || {_PORT}
    WHEN 3 THEN 'tcp4  0 0 ' || {_LOCAL}
    WHEN 4 THEN 'tcp   0 0 10.0.0.1:5000 10.0.0.9:443 ESTABLISHED'
    WHEN 5 THEN 'tcp4  0 0 ' || {_LOCAL} || ' ' || {_SITE} || '.' || (65000 + event_id % 1000) || ' CLOSED'
    ELSE '  tcp4' || chr(9) || '0' || chr(9) || '0' || chr(9) || {_LOCAL} || chr(9) || {_SITE} || '.' || {_PORT}
    END AS line FROM ev),
words AS (SELECT host, ts, regexp_split_to_array(regexp_replace(line, '^\s+|\s+$', '', 'g'), '\s+') AS w FROM netstat),
peers AS (SELECT host, ts, regexp_extract(w[5], '^(.*)\.([0-9]+)$', 1) AS remote_ip,
        TRY_CAST(regexp_extract(w[5], '^(.*)\.([0-9]+)$', 2) AS INT) AS port
    FROM words WHERE len(w) >= 5 AND starts_with(w[1], 'tcp')),
parsed AS (SELECT * FROM peers WHERE port BETWEEN 0 AND 65535)"""

_DNS = f"""
answers AS (SELECT host, ts, {_pick(DNS_NAMES, 'event_id')} AS domain, event_id % 3 <> 0 AS resolved FROM ev),
reachable AS (SELECT host, domain, max(ts) AS ts FROM answers
    WHERE resolved AND domain IN (SELECT domain FROM dom) GROUP BY host, domain)"""

_TLS = f"""
tls AS (SELECT host, ts, {_pick(HOSTS, '(event_id * 5)')} AS sni, '10.2.' || (event_id % 200) || '.9' AS dst_ip,
    {_pick([443, 8443, 80, 993], 'event_id')} AS port FROM ev)"""

_CRLF = "chr(13) || chr(10)"
_HTTP = rf"""
payloads AS (SELECT host, ts, '10.1.' || (event_id % 200) || '.7' AS dst_ip,
    {_pick([80, 8080, 443, 22], 'event_id')} AS port, CASE event_id % 9
    WHEN 0 THEN 'POST /v1/chat/completions HTTP/1.1' || {_CRLF} || 'Host: ' || {_SITE} || {_CRLF}
        || 'Content-Type: application/json' || {_CRLF} || {_CRLF} || 'Host: evil.example.com'
    WHEN 1 THEN 'POST /api HTTP/1.1' || {_CRLF} || 'Host: unknown.internal' || {_CRLF}
        || 'Authorization: Bearer sk-' || key || {_CRLF} || {_CRLF}
    WHEN 2 THEN 'GET / HTTP/1.1' || chr(10) || 'HOST:   ' || {_SITE} || '  ' || chr(10) || 'X-Ratio: 1:2'
        || chr(10) || chr(10) || 'body'
    WHEN 3 THEN 'TRACE / HTTP/1.1' || {_CRLF} || 'Host: api.openai.com' || {_CRLF} || {_CRLF}
    WHEN 4 THEN chr(1) || chr(2) || 'garbage'
    WHEN 5 THEN ''
    WHEN 6 THEN 'GET /' || {_CRLF} || 'Host: a.example.com' || {_CRLF} || 'host: claude.ai' || {_CRLF}
        || 'nocolon' || {_CRLF} || {_CRLF}
    WHEN 7 THEN 'PUT /x HTTP/1.1' || {_CRLF} || 'Accept: */*' || {_CRLF} || {_CRLF} || 'Host: api.openai.com'
    ELSE 'DELETE' END AS payload, CASE event_id % 9
    WHEN 0 THEN '{{"host":"' || {_SITE} || '","content-type":"application/json"}}'
    WHEN 1 THEN '{{"host":"unknown.internal","authorization":"Bearer sk-' || key || '"}}'
    WHEN 2 THEN '{{"host":"' || {_SITE} || '","x-ratio":"1:2"}}'
    WHEN 6 THEN '{{"host":"claude.ai"}}' WHEN 7 THEN '{{"accept":"*/*"}}' END AS http_headers FROM ev),
heads AS (SELECT host, ts, dst_ip, port, http_headers,
        list_filter(regexp_split_to_array(regexp_split_to_array(payload, '\r?\n\r?\n')[1], '\r?\n')[2:],
            lambda x: contains(x, ':')) AS lines
    FROM payloads WHERE payload <> '' AND port IN (80, 8080)
        AND regexp_matches(payload, '^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)(\s|$)')),
pairs AS (SELECT *, list_transform(lines, lambda x: {{'k': lower(trim(split_part(x, ':', 1))),
        'v': trim(x[strpos(x, ':') + 1:])}}) AS kv FROM heads),
requests AS (SELECT host, ts, dst_ip, port, http_headers, len(list_distinct(list_transform(kv, lambda x: x.k))) AS n_headers,
        list_filter(kv, lambda x: x.k = 'host')[-1].v AS host_header,
        list_filter(kv, lambda x: x.k = 'authorization')[-1].v AS auth,
        list_filter(kv, lambda x: x.k = 'x-ratio')[-1].v AS x_ratio FROM pairs),
http_seen AS (SELECT *, CASE WHEN host_header <> '' THEN host_header ELSE dst_ip END AS remote_host FROM requests),
http_ev AS (SELECT * FROM http_seen h WHERE auth IS NOT NULL OR EXISTS (
    SELECT 1 FROM dom d WHERE h.remote_host = d.domain OR ends_with(h.remote_host, '.' || d.domain)))"""

_PROCESSES = f"""
processes AS (SELECT host, ts, 1000 + event_id AS pid, {_pick(PROGRAMS, 'event_id')} AS name,
    '/usr/bin/' || {_pick(PROGRAMS, 'event_id')} || ' --key ' || CASE event_id % 5
        WHEN 0 THEN 'sk-' || key WHEN 1 THEN 'org-' || substr(key, 1, 24)
        WHEN 2 THEN 'sk-ant-' || key WHEN 3 THEN 'AIza' || key || 'abc' ELSE 'none' END AS cmdline FROM ev)"""

_SHELL = rf"""
shell_lines AS (SELECT host, ts, event_id AS line_number, {_pick(['bash', 'zsh', 'fish'], 'event_id')} AS shell,
    {_pick(['/h/.bash_history', '/h/.zsh_history', '/h/fish_history'], 'event_id')} AS history_file,
    CASE event_id % 11
        WHEN 0 THEN '/usr/bin/ollama run x' WHEN 1 THEN ': 1700000000:0;ollama run llama3; ls'
        WHEN 2 THEN 'ls -la' WHEN 3 THEN '' WHEN 4 THEN '   '
        WHEN 5 THEN '  claude --key sk-ant-' || key WHEN 6 THEN '- cmd: ollama run x'
        WHEN 7 THEN ': 1700000000:0;openai api --key sk-' || key || ';second'
        WHEN 8 THEN ': no semicolon mistral' WHEN 9 THEN 'mistral chat ' || key
        ELSE 'my-openai tool' END AS line FROM ev),
commands AS (SELECT host, ts, shell, history_file, line_number, trim(CASE WHEN starts_with(line, ': ') AND contains(line, ';')
    THEN split_part(line, ';', 2) ELSE line END) AS command FROM shell_lines),
bins AS (SELECT *, string_split(string_split(command, ' ')[1], '/')[-1] AS bin FROM commands WHERE command <> ''),
shell_ev AS (SELECT * FROM bins b WHERE EXISTS (SELECT 1 FROM prog p WHERE starts_with(b.bin, p.part)))"""

_VISITS = f"""
visits AS (
    SELECT CASE WHEN event_id % 3 = 0 THEN 'm0' ELSE host END AS host,
        CASE WHEN event_id % 3 = 0 THEN 'Chrome' ELSE {_pick(['Chrome', 'Firefox', 'Brave', 'Edge'], 'event_id')} END AS browser,
        CASE WHEN event_id % 3 = 0 THEN 'p0' ELSE 'p' || (event_id % 2) END AS profile,
        CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END AS visit_ts,
        CASE event_id % 3 WHEN 0 THEN 'https://' WHEN 1 THEN 'http://' ELSE 'https://http://' END || {_SITE}
            || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '?q=' || event_id
                WHEN 2 THEN '/c/' || event_id || '?x=2' ELSE '#top' END AS url,
        CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'title ' || event_id END AS title
    FROM ev
    UNION ALL
    SELECT 'm1', 'Firefox', 'p' || (page_id % 3),
        CASE WHEN page_id % 7 = 0 THEN NULL ELSE make_timestamp((1705276800 + page_id) * 1000000) END,
        CASE WHEN page_id % 5 = 0 THEN 'https://' || {_pick(HOSTS, 'page_id')} || '/p/' || page_id ELSE url END,
        'page ' || page_id FROM pages),
ranked AS (SELECT *, row_number() OVER (PARTITION BY host, browser, profile
        ORDER BY visit_ts DESC NULLS LAST, url, title NULLS FIRST) AS place
    FROM visits WHERE browser <> 'Firefox' OR visit_ts IS NOT NULL),
seen AS (SELECT host, browser, profile, visit_ts AS ts, url, title,
        string_split(string_split(regexp_replace(regexp_replace(url, '^(https://)+', ''), '^(http://)+', ''),
            '/')[1], '?')[1] AS site FROM ranked WHERE place <= 10000)"""

_PATH = f"""(CASE doc_id % 9 WHEN 0 THEN 'target/' WHEN 1 THEN '.git/' WHEN 2 THEN 'node_modules/pkg/' ELSE 'src/' END
    || CASE WHEN doc_id % 23 = 0 THEN '.env' ELSE 'f' || doc_id || '.'
        || {_pick(['py', 'js', 'ts', 'txt', 'go', 'yaml', 'bin'], 'doc_id')} END)"""
_FILES = f"""
files AS (SELECT source AS repo, {_PATH} AS path, (1704067200 + doc_id) * 1000000000 AS mtime,
    CASE WHEN doc_id % 10 <> 0 THEN text ELSE text
        || CASE doc_id % 3 WHEN 0 THEN chr(10) ELSE {_CRLF} END
        || CASE (doc_id // 10) % 6
        WHEN 0 THEN 'const API_KEY = ''sk-' || md5(CAST(doc_id AS VARCHAR)) || ''';'
        WHEN 1 THEN 'client = Anthropic(api_key=''sk-ant-api01-' || md5(CAST(doc_id AS VARCHAR)) || ''')'
        WHEN 2 THEN 'token = ''hf_' || md5(CAST(doc_id AS VARCHAR)) || '''' || chr(10) || '// end'
        WHEN 3 THEN 'API_KEY = "' || md5(CAST(doc_id AS VARCHAR)) || '"' || {_CRLF}
        WHEN 4 THEN 'k = AIza' || md5(CAST(doc_id AS VARCHAR)) || 'abc'
        ELSE 'a = hf_' || md5(CAST(doc_id AS VARCHAR)) || ' sk-' || md5(CAST(doc_id AS VARCHAR)) || chr(10)
            || 'middle' || chr(10) || 'sk-' || md5(CAST(doc_id AS VARCHAR)) END END AS content FROM documents),
state AS (SELECT source AS repo, {_PATH} AS path, (1704067200 + doc_id - doc_id % 3) * 1000000000 AS mtime
    FROM documents WHERE doc_id % 4 <> 0),
changed AS (SELECT f.repo, f.path, f.mtime FROM files f LEFT JOIN state s USING (repo, path)
    WHERE f.mtime > coalesce(s.mtime, 0))"""
_SECRETS = rf"""
wanted AS (SELECT * FROM files WHERE len(list_filter(string_split(path, '/'),
        lambda x: starts_with(x, '.') OR x IN ('node_modules', 'target', 'dist'))) = 0
    AND regexp_extract(string_split(path, '/')[-1], '^.+\.([^.]*)$', 1) IN ('js', 'ts', 'jsx', 'tsx', 'py', 'rb',
        'go', 'rs', 'java', 'kt', 'php', 'cs', 'env', 'toml', 'yaml', 'yml', 'json')),
split_lines AS (SELECT repo, path, mtime, unnest(regexp_split_to_array(content, '\r?\n')) AS line,
        generate_subscripts(regexp_split_to_array(content, '\r?\n'), 1) AS line_number FROM wanted),
classified AS (SELECT repo, path, mtime, CAST(line_number AS INT) AS line_number, CASE
    WHEN regexp_matches(line, 'sk-[A-Za-z0-9]{{20,}}') THEN 'openai_key'
    WHEN regexp_matches(line, 'sk-ant-[A-Za-z0-9\-_]{{20,}}') THEN 'anthropic_key'
    WHEN regexp_matches(line, 'AIza[0-9A-Za-z\-_]{{35}}') THEN 'google_ai_key'
    WHEN regexp_matches(line, 'hf_[A-Za-z0-9]{{20,}}') THEN 'huggingface_key'
    WHEN regexp_matches(line, '(?i)(api[_\-]?key|secret)["\s]*[:=]["\s]*[A-Za-z0-9\-_]{{16,}}') THEN 'generic_api_key'
    END AS matched_text FROM split_lines),
secret AS (SELECT * FROM classified WHERE matched_text IS NOT NULL)"""

# --- matching, scoring, policy -------------------------------------------------

_LEVEL = (
    "CASE WHEN {0} <= 25 THEN 'LOW' WHEN {0} <= 50 THEN 'MEDIUM' "
    "WHEN {0} <= 75 THEN 'HIGH' ELSE 'CRITICAL' END"
)
_HOST_SIG = (
    "(SELECT min(d.sig_id) FROM dom d WHERE {0} = d.domain OR ends_with({0}, '.' || d.domain))"
)
_PROGRAM_SIG = "(SELECT min(p.sig_id) FROM prog p WHERE contains({0}, p.part))"


def _id(source: str, *key: str) -> str:
    time = [] if source == "shell_history" else ["CAST(epoch_us(ts) AS VARCHAR)"]
    parts = [f"coalesce({part}, chr(2))" for part in (*key, *(time or ["NULL"]))]
    return f"sha256(concat_ws(chr(1), '{source}', {', '.join(parts)}))"


def _matched(
    source: str, table: str, sig: str, text: str, detail: str, *key: str, payload: str = "NULL"
) -> str:
    """SELECT of matched events; ``payload`` is the JSON of the event's own fields."""
    return f"""SELECT {_id(source, *key)} AS finding_id, ts, '{source}' AS source, {sig} AS signature_id,
        CAST({text} AS VARCHAR) AS scanned, {detail} AS tail, CAST(NULL AS VARCHAR) AS code_match,
        CAST({payload} AS VARCHAR) AS payload FROM {table}"""


_NETWORK_KEY = ("host", "protocol", "remote_host", "coalesce(remote_ip, '')", "CAST(port AS VARCHAR)")


def _network(table: str, headers: str = "NULL") -> str:
    payload = f"""rtrim(CAST(to_json({{'type': 'network_connection', 'remote_host': remote_host, 'remote_ip': remote_ip,
        'port': port, 'protocol': protocol}}) AS VARCHAR), '}}') || ',"http_headers":' || coalesce({headers}, 'null')
        || ',"body_snippet":null}}'"""
    return _matched(
        "network", table, _HOST_SIG.format("remote_host"), "NULL",
        f"'{DASH}connection to ' || remote_host || ':' || port", *_NETWORK_KEY, payload=payload,
    )


_EVENTS = {
    "connections": _network("(SELECT host, ts, 'tcp' AS protocol, remote_ip AS remote_host, remote_ip, port FROM connections)"),
    "parsed": _network("(SELECT host, ts, 'tcp' AS protocol, remote_ip AS remote_host, remote_ip, port FROM parsed)"),
    "dns": _network("(SELECT host, ts, 'dns' AS protocol, domain AS remote_host, NULL AS remote_ip, 443 AS port FROM reachable)"),
    "tls": _network("(SELECT host, ts, 'https' AS protocol, sni AS remote_host, dst_ip AS remote_ip, port FROM tls WHERE port IN (443, 8443))"),
    "http": _network(
        "(SELECT host, ts, 'http' AS protocol, remote_host, dst_ip AS remote_ip, port, http_headers FROM http_ev)", "http_headers"
    ),
    "processes": _matched(
        "process", "processes", _PROGRAM_SIG.format("name"), "cmdline",
        f"'{DASH}process ''' || name || ''' running (pid ' || pid || ')'",
        "host", "CAST(pid AS VARCHAR)", "name", "cmdline",
        payload="to_json({'type': 'process', 'pid': pid, 'name': name, 'cmdline': cmdline, 'exe_path': '/usr/bin/' || name})",
    ),
    "shell": _matched(
        "shell_history", "shell_ev", _PROGRAM_SIG.format("bin"), "command",
        f"'{DASH}found in ' || shell || ' history: `' || command || '`'",
        "host", "history_file", "CAST(line_number AS VARCHAR)", "command",
        payload="to_json({'type': 'shell_history', 'command': command, 'shell': shell, 'history_file': history_file})",
    ),
    "visits": _matched(
        "browser_history", "seen", _HOST_SIG.format("site"), "NULL",
        f"'{DASH}visited via ' || browser || ': ' || url",
        "host", "browser", "profile", "url",
        payload="to_json({'type': 'browser_history', 'url': url, 'title': title, 'browser': browser})",
    ),
    "code": f"""SELECT {_id("codebase", "repo || '/' || path", "CAST(line_number AS VARCHAR)", "matched_text")} AS finding_id,
        ts, 'codebase' AS source, CAST(NULL AS VARCHAR) AS signature_id, CAST(NULL AS VARCHAR) AS scanned,
        'DLP match ''' || matched_text || ''' in ' || repo || '/' || path || ':' || line_number AS tail,
        matched_text AS code_match, CAST(to_json({{'type': 'codebase_file', 'file_path': repo || '/' || path,
            'line_number': line_number, 'matched_text': matched_text}}) AS VARCHAR) AS payload FROM (SELECT *, make_timestamp(mtime // 1000) AS ts FROM secret)""",
}


def _findings(*events: str) -> str:
    """CTEs from raw events to governed findings, table ``found``."""
    union = "\nUNION ALL\n".join(_EVENTS[name] for name in events)
    return rf"""
raw_events AS ({union}),
hits AS (SELECT e.*, s.name AS service_name, s.risk_base, s.is_local,
        CASE WHEN code_match IS NOT NULL THEN [{{'p': code_match, 's': 'critical'}}]
        ELSE coalesce((SELECT list({{'p': p.pattern_id, 's': p.severity}} ORDER BY p.place) FROM pat p
            WHERE p.sig_id = e.signature_id AND regexp_matches(e.scanned, p.pattern)), []) END AS m
    FROM raw_events e LEFT JOIN sig s ON s.id = e.signature_id
    WHERE e.signature_id IS NOT NULL OR e.code_match IS NOT NULL),
scored AS (SELECT *, CAST(trunc(least(coalesce(risk_base, 30) * CASE
        WHEN len(list_filter(m, lambda x: x.s = 'critical')) > 0 THEN 2.0
        WHEN len(list_filter(m, lambda x: x.s = 'high')) > 0 THEN 1.5 ELSE 1.0 END, 100)) AS INT) AS base_score FROM hits),
ruled AS (SELECT *, CASE WHEN is_local THEN 'allow-local-models' WHEN len(m) > 0 THEN 'block-dlp-critical'
        WHEN base_score >= 76 THEN 'block-critical-score' ELSE 'warn-unapproved-cloud-ai' END AS matched_rule FROM scored),
found AS (SELECT *, CASE matched_rule WHEN 'block-dlp-critical' THEN 95 ELSE base_score END AS risk_score,
        CASE matched_rule WHEN 'allow-local-models' THEN 'allow' WHEN 'warn-unapproved-cloud-ai' THEN 'warn'
            ELSE 'block' END AS policy_action,
        CASE WHEN code_match IS NOT NULL THEN tail ELSE service_name || tail END AS detail,
        array_to_string(list_transform(m, lambda x: x.p), ',') AS dlp FROM ruled)"""


_FLAT = f"""SELECT finding_id, CAST(ts AS VARCHAR) AS ts, source, signature_id, service_name, risk_score,
    {_LEVEL.format('risk_score')} AS risk_level, dlp, detail, policy_action, matched_rule FROM found"""


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",".join([_REGISTRY, *ctes]) + "\n" + select


def _flat(*ctes: str, events: list[str]) -> str:
    return _with(*ctes, _findings(*events), select=_FLAT)


# --- scored inputs and history ---------------------------------------------------

_SERVICE = f"CASE WHEN event_id % 12 = 11 THEN NULL ELSE {_pick(SERVICES, '(event_id % 12)')} END"
_INPUTS = f"""
inputs AS (SELECT i.*, s.is_local, s.id IN ('localai', 'ollama', 'huggingface') AS is_open,
        s.id NOT IN ('localai', 'ollama') AS is_cloud, base_score AS score
    FROM (SELECT event_id, {_SERVICE} AS signature_id, event_id % 7 = 0 OR event_id % 5 = 0 AS has_dlp,
        CAST(trunc(least(coalesce(CASE WHEN event_id % 11 = 3 THEN NULL ELSE event_id % 101 END, 30)
            * CASE WHEN event_id % 7 = 0 THEN 2.0 WHEN event_id % 5 = 0 THEN 1.5 ELSE 1.0 END, 100)) AS INT) AS base_score
        FROM events) i LEFT JOIN sig s ON s.id = i.signature_id)"""
_BUNDLED_RULE = """CASE WHEN coalesce(is_local, false) THEN 'allow-local-models' WHEN has_dlp THEN 'block-dlp-critical'
    WHEN score >= 76 THEN 'block-critical-score' ELSE 'warn-unapproved-cloud-ai' END"""
_BUNDLED_ACTION = """CASE WHEN coalesce(is_local, false) THEN 'allow' WHEN has_dlp OR score >= 76 THEN 'block' ELSE 'warn' END"""
_STRICT_RULE = """CASE WHEN coalesce(is_open, false) THEN 'approved'
    WHEN has_dlp AND coalesce(signature_id, 'unknown') <> 'openai' THEN 'no-secrets'
    WHEN coalesce(is_cloud, false) AND score >= 90 THEN 'high-cloud' END"""
_STRICT_ACTION = f"""CASE {_STRICT_RULE} WHEN 'approved' THEN 'allow' WHEN 'no-secrets' THEN 'block'
    WHEN 'high-cloud' THEN 'block' ELSE CASE WHEN score >= 80 THEN 'block' WHEN score >= 50 THEN 'warn' ELSE 'allow' END END"""
_POLICIES = f"""
governed AS (
    SELECT 'bundled' AS policy_id, event_id, {_BUNDLED_RULE} AS matched_rule, {_BUNDLED_ACTION} AS policy_action,
        CASE WHEN {_BUNDLED_RULE} = 'block-dlp-critical' THEN 95 ELSE score END AS risk_score FROM inputs
    UNION ALL
    SELECT 'strict', event_id, {_STRICT_RULE}, {_STRICT_ACTION},
        CASE WHEN {_STRICT_RULE} = 'no-secrets' THEN 99 ELSE score END FROM inputs)"""
_GOVERNED = f"""SELECT policy_id, event_id, risk_score, {_LEVEL.format('risk_score')} AS risk_level,
    policy_action, matched_rule FROM governed"""

_SCORE = "CAST((event_id * 37) % 101 AS INT)"
_HISTORY = f"""
history AS (SELECT 'f' || event_id AS id, ts AS timestamp, {_SERVICE} AS service_id, upper({_SERVICE}) AS service_name,
    {_SCORE} AS risk_score, {_LEVEL.format(_SCORE)} AS risk_level,
    'seen <' || event_id || '> & "' || event_type || '"' AS detail,
    {_pick(['net', 'process', 'browser', 'shell', 'codebase'], 'event_id')} AS source FROM events)"""
_REPORT = (
    "SELECT id, CAST(timestamp AS VARCHAR) AS timestamp, source, service_name, risk_score, "
    "risk_level, detail FROM history"
)


def _rfc3339(ts: str, zone: str) -> str:
    return (
        f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN '' "
        f"WHEN epoch_us({ts}) % 1000 = 0 THEN '.' || lpad(CAST((epoch_us({ts}) % 1000000) // 1000 AS VARCHAR), 3, '0') "
        f"ELSE '.' || lpad(CAST(epoch_us({ts}) % 1000000 AS VARCHAR), 6, '0') END || '{zone}')"
    )


def _pad(text: str, width: int) -> str:
    return f"CASE WHEN length({text}) < {width} THEN rpad({text}, {width}, ' ') ELSE {text} END"


def _escaped(text: str) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = f"replace({text}, '{raw}', '{entity}')"
    return text


_SHOWN = "coalesce(service_name, 'unknown')"
_COLOR = (
    "CASE risk_level WHEN 'CRITICAL' THEN '#f44336' WHEN 'HIGH' THEN '#ff9800' "
    "WHEN 'MEDIUM' THEN '#ffc107' ELSE '#4caf50' END"
)


def _html(service: str, time: str) -> str:
    return (
        f"'<tr><td style=\"background:' || {_COLOR} || ';color:#fff;font-weight:bold;padding:4px 8px\">' || risk_level "
        f"|| '</td><td>' || {service} || '</td><td>' || {_escaped('detail')} "
        f"|| '</td><td style=\"color:#888;font-size:0.9em\">' || {time} || '</td></tr>'"
    )


_ALL_CTES = (_CONNECTIONS, _NETSTAT, _DNS, _TLS, _HTTP, _PROCESSES, _SHELL, _VISITS, _FILES, _SECRETS)
_SCAN_ALL = ["connections", "parsed", "dns", "processes", "shell", "visits", "code"]
_SOME = (*_ALL_CTES, _findings(*_SCAN_ALL, "http", "tls"))
_LEVEL_F = _LEVEL.format("risk_score")
_DLP_JSON_ITEM = (
    "{'pattern_id': x.p, 'description': CASE WHEN code_match IS NULL THEN 'DLP match: ' || x.p "
    "ELSE 'Pattern ''' || x.p || ''' found in source file' END, 'severity': x.s}"
)

_EVENT_JSON = (
    """('{"id":"' || finding_id || '","source":"' || source || '","timestamp":' || coalesce('"' || """
    + _rfc3339("ts", "Z")
    + """ || '"', 'null') || ',"payload":' || payload || '}')"""
)
_DLP_JSON = f"CAST(to_json(list_transform(m, lambda x: {_DLP_JSON_ITEM})) AS VARCHAR)"
_FLAT_JSON = f"""CAST(to_json({{'id': finding_id, 'timestamp': {_rfc3339("ts", "Z")}, 'signature_id': signature_id,
    'service_name': service_name, 'risk_score': risk_score, 'risk_level': lower({_LEVEL_F}),
    'dlp_matches': list_transform(m, lambda x: {_DLP_JSON_ITEM}), 'detail': detail,
    'policy_action': policy_action, 'matched_rule': matched_rule}}) AS VARCHAR)"""

_SARIF_RESULT = f"""CASE WHEN code_match IS NULL THEN CAST(to_json({{'ruleId': coalesce(signature_id, 'wardline/unknown'),
        'level': CASE {_LEVEL_F} WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN 'note' ELSE 'error' END,
        'message': {{'text': detail}}}}) AS VARCHAR)
    ELSE CAST(to_json({{'ruleId': 'wardline/unknown',
        'level': CASE {_LEVEL_F} WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN 'note' ELSE 'error' END,
        'message': {{'text': detail}},
        'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': regexp_extract(tail, ' in (.*):[0-9]+$', 1)}},
            'region': {{'startLine': CAST(regexp_extract(tail, ':([0-9]+)$', 1) AS INT)}}}}}}]}}) AS VARCHAR) END"""

_SARIF_HEAD = """('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":'
    || '{"name":"wardline","version":"0.1.0","informationUri":""}' || '},"results":[')"""


def _part(parts: int) -> str:
    return f"CAST('0x' || substr(md5(finding_id), 1, 8) AS BIGINT) % {parts}"


def _sarif_logs(run: str, parts: int) -> str:
    return _with(
        _FILES,
        _SECRETS,
        _findings("code"),
        select=f"""SELECT run_id, doc_id, CAST(count(*) AS INT) AS n_results,
            {_SARIF_HEAD} || string_agg(result, ',' ORDER BY finding_id) || ']}}]}}' AS sarif
            FROM (SELECT finding_id, {_part(parts)} AS doc_id, strftime(ts, '{run}') AS run_id, {_SARIF_RESULT} AS result
                FROM found) GROUP BY run_id, doc_id""",
    )


_TIME = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
_FIRST = f"""('{{"eventTime":"' || {_TIME} || '","eventSource":"' || {_SITE} || '","eventName":"Invoke' || (event_id % 4)
    || '","userIdentity":{{"arn":"arn:u' || (event_id % 7) || '"}},"sourceIPAddress":"10.0.0.' || (event_id % 9)
    || '","eventID":"e' || event_id || '"}}')"""
_SECOND = f"""('{{"timestamp":' || (epoch_ms(ts) // 1000 * 1000) || ',"insertId":"i' || event_id
    || '","protoPayload":{{"serviceName":"' || {_SITE} || '","methodName":"Predict","authenticationInfo":{{"principalEmail":"u'
    || (event_id % 7) || '@x.org"}}}}}}')"""
_THIRD = f"""('{{"time":"' || {_TIME} || '","host":"' || {_SITE} || '","operation":"chat","user":null}}')"""
_CLOUD = f"""
cloud_rec AS (
    SELECT lower({_SITE}) AS remote_host, 'Invoke' || (event_id % 4) AS operation, 'arn:u' || (event_id % 7) AS actor,
        'e' || event_id AS record_id, date_trunc('second', ts) AS ts, 443 AS port FROM ev WHERE event_id % 10 IN (0, 2)
    UNION ALL SELECT lower({_SITE}), 'Predict', 'u' || (event_id % 7) || '@x.org', 'i' || event_id, date_trunc('second', ts), 443
        FROM ev WHERE event_id % 10 IN (1, 2)
    UNION ALL SELECT lower({_SITE}), 'chat', NULL, '0:' || md5({_THIRD}), date_trunc('second', ts), 443
        FROM ev WHERE event_id % 10 = 3),
cloud_ev AS (SELECT * FROM cloud_rec h WHERE EXISTS (
    SELECT 1 FROM dom d WHERE h.remote_host = d.domain OR ends_with(h.remote_host, '.' || d.domain)))"""
_EVENTS["cloud"] = _matched(
    "cloud_log", "cloud_ev", _HOST_SIG.format("remote_host"), "NULL",
    f"'{DASH}connection to ' || remote_host || ':' || port", "remote_host", "operation", "actor", "record_id",
)
_CLOUD_REJECTS = f"""SELECT host, CAST(ts AS VARCHAR) AS logged_at, CAST(part AS INT) AS part, reason, line FROM (
    SELECT host, ts, 0 AS part, 'not JSON' AS reason, left({_FIRST}, 40) AS line FROM ev WHERE event_id % 10 = 4
    UNION ALL SELECT host, ts, 0, 'not JSON', '' FROM ev WHERE event_id % 10 = 5
    UNION ALL SELECT host, ts, 0, 'no record', '[1,2]' FROM ev WHERE event_id % 10 = 6
    UNION ALL SELECT host, ts, 0, 'no time', '{{"eventTime":"yesterday","eventSource":"' || {_SITE} || '"}}' FROM ev WHERE event_id % 10 = 7
    UNION ALL SELECT host, ts, 0, 'no record', '{{"Records":[]}}' FROM ev WHERE event_id % 10 = 8
    UNION ALL SELECT host, ts, 2, 'no record', '{{"Records":[' || {_FIRST} || ',' || {_SECOND} || ',7]}}' FROM ev WHERE event_id % 10 = 2)"""

_LEAKS = """
texts AS (
    SELECT event_id, 'header:authorization' AS field, 'plain' AS form, 0 AS run, 'Bearer sk-' || key AS searched FROM ev WHERE event_id % 8 = 0
    UNION ALL SELECT event_id, 'body', 'plain', 0, 'key=hf_' || key || '&x=1' FROM ev WHERE event_id % 8 = 0
    UNION ALL SELECT event_id, 'header:x-auth', 'plain', 0, 'Basic ' || to_base64(encode('user:sk-ant-' || key)) FROM ev WHERE event_id % 8 = 1
    UNION ALL SELECT event_id, 'header:x-auth', 'base64', 0, 'user:sk-ant-' || key FROM ev WHERE event_id % 8 = 1
    UNION ALL SELECT event_id, 'body', 'plain', 0, 'q=%73k%2D' || key || '+%2B&r=%zz' FROM ev WHERE event_id % 8 = 2
    UNION ALL SELECT event_id, 'body', 'plain', 0, 'q=%73k%2D' || key || '+%2B%C3%A9' FROM ev WHERE event_id % 8 = 3
    UNION ALL SELECT event_id, 'body', 'percent', 0, 'q=sk-' || key || '++é' FROM ev WHERE event_id % 8 = 3
    UNION ALL SELECT event_id, 'header:x-a', 'plain', 0, 'sk-' || key || ' and sk-' || reverse(key) FROM ev WHERE event_id % 8 = 4
    UNION ALL SELECT event_id, 'body', 'plain', 0, key || ' ' || key FROM ev WHERE event_id % 8 = 4
    UNION ALL SELECT event_id, 'body', 'plain', 0, '{"blob":"' || to_base64(encode('AIza' || key || 'abc é')) || '","n":1}' FROM ev WHERE event_id % 8 = 5
    UNION ALL SELECT event_id, 'body', 'base64', 0, 'AIza' || key || 'abc é' FROM ev WHERE event_id % 8 = 5
    UNION ALL SELECT event_id, 'header:x-auth', 'plain', 0, key || key FROM ev WHERE event_id % 8 = 7),
cut AS (SELECT t.*, p.sig_id, p.pattern_id, p.severity,
        string_split(regexp_replace(searched, '(' || p.pattern || ')', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts
    FROM texts t JOIN pat p ON regexp_matches(searched, p.pattern)),
placed AS (SELECT *, unnest(range(2, len(parts) + 1)) AS i FROM cut),
starts AS (SELECT *, length(split_part(parts[i], chr(2), 1)) AS n,
        1 + list_sum(list_transform(parts[1:i - 1], lambda x: length(replace(x, chr(2), '')))) AS start FROM placed)"""

_AGENT = _pick(["openai-python/1.2 (x86)", "Mozilla/5.0", "my groq-python", "OPENAI-PYTHON/1", "openai-go 0.1 transformers", ""], "event_id")
_AGENTS = f"""
agt(pattern, sig_id) AS ({_values([(a, s.id) for s in _SIGNATURES for a in s.user_agents])}),
agent_req AS (SELECT host, ts, 'gw' || (event_id % 5) || '.internal' AS remote_host, '10.3.' || (event_id % 200) || '.7' AS remote_ip,
    80 AS port, 'http' AS protocol, CASE WHEN event_id % 7 <> 0 THEN {_AGENT} END AS agent FROM ev),
agent_ev AS (SELECT *, (SELECT min(a.sig_id) FROM agt a WHERE contains(agent, a.pattern)) AS owner FROM agent_req)"""
_EVENTS["agents"] = _matched(
    "network", "(SELECT * FROM agent_ev WHERE owner IS NOT NULL)", "owner", "NULL",
    f"'{DASH}connection to ' || remote_host || ':' || port", *_NETWORK_KEY,
)
_MANY_AGENTS = """
WITH texts AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'hot client agent-7/1 agent-70/1 (X11)'
        WHEN 3 THEN 'hot client agent-7/1 agent-70/1 (X11)' WHEN 1 THEN NULL
        ELSE 'Mozilla/5.0 (agent-' || ((event_id * 31) % 4000) || '/' || (event_id % 3) || '; rv) lib/' || (event_id % 4) END AS agent FROM events),
seen AS (SELECT DISTINCT agent FROM texts WHERE agent IS NOT NULL),
found AS (SELECT agent, min('o' || (event_id % 113)) AS owner FROM seen JOIN events
    ON contains(agent, 'agent-' || event_id || '/' || (event_id % 3)) GROUP BY agent)
SELECT event_id, agent, owner FROM texts LEFT JOIN found USING (agent)"""
_ROUTED = """
routed AS (SELECT strftime(timestamp, '%Y-%m-%d') AS batch_id, unnest(CASE risk_level WHEN 'CRITICAL' THEN ['slack', 'pager']
        ELSE ['mail'] END) AS channel FROM history WHERE risk_level IN ('HIGH', 'CRITICAL')),
batches AS (SELECT batch_id, channel, count(*) AS n_alerts FROM routed GROUP BY ALL)"""
_DUE = f"""{_ROUTED},
attempts AS (SELECT strftime(ts, '%Y-%m-%d') AS batch_id, {_pick(['slack', 'pager', 'mail'], 'event_id')} AS channel,
    1 + event_id % 4 AS attempt, event_id % 1000 = 0 AS sent, ts FROM events WHERE event_id % 5 = 0),
tried AS (SELECT batch_id, channel, max(attempt) AS n, bool_or(sent) AS sent, max(ts) AS last FROM attempts GROUP BY ALL)
SELECT batch_id, channel, n_alerts, CAST(coalesce(n, 0) + 1 AS INT) AS attempt FROM batches LEFT JOIN tried USING (batch_id, channel)
WHERE n IS NULL OR (NOT sent AND n < 5 AND epoch_us(TIMESTAMP '2024-01-30') // 1000000 - epoch_us(last) // 1000000 >= 21600 * 2 ** (n - 1))"""

_REWRITTEN = f"""
rewritten AS (SELECT 'f' || n AS id, CASE WHEN n % 50 <> 7 THEN DATE '2024-01-01' + CAST(n % 30 AS INT) END AS event_date,
        ts AS written_at, {_SCORE} AS risk_score, {_pick(['allow', 'warn', 'block'], 'event_id')} AS policy_action,
        'seen ' || event_id AS detail, {_pick(['net', 'process', 'browser', 'shell', 'codebase'], 'n')} AS source
    FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 1000 END AS n FROM events)),
latest AS (SELECT *, CASE WHEN event_date IS NULL THEN first_at ELSE written_at END AS shown FROM (
    SELECT *, min(written_at) OVER (PARTITION BY id) AS first_at,
        row_number() OVER (PARTITION BY id ORDER BY written_at DESC, risk_score DESC, policy_action) AS place FROM rewritten)
    WHERE place = 1)
"""
_LATEST_COLUMNS = """SELECT id, CAST(event_date AS VARCHAR) AS event_date, CAST(written_at AS VARCHAR) AS written_at,
    CAST(shown AS VARCHAR) AS timestamp, risk_score, policy_action, detail FROM latest"""

_DEBOUNCE = f"""
alerts AS (SELECT coalesce(service_id, 'unknown') AS service, epoch_us(timestamp) // 1000000 AS sec,
    count(*) AS n_alerts FROM history WHERE risk_level IN ('HIGH', 'CRITICAL') GROUP BY ALL),
sends(service, sec) AS (
    SELECT service, min(sec) FROM alerts GROUP BY service
    UNION ALL
    SELECT s.service, (SELECT min(a.sec) FROM alerts a WHERE a.service = s.service AND a.sec >= s.sec + 21600)
    FROM sends s WHERE EXISTS (SELECT 1 FROM alerts a WHERE a.service = s.service AND a.sec >= s.sec + 21600))"""


def _bounds() -> list[tuple]:
    """(width, lowest and highest address in hexadecimal, prefix length, owner) of the valid test ranges."""
    rows = []
    for owner, texts in IP_RANGES.items():
        for text in texts:
            try:
                net = ipaddress.ip_network(text, strict=False)
            except ValueError:
                continue
            if net.version == 6 and net[0].ipv4_mapped:
                net = ipaddress.ip_network(f"{net[0].ipv4_mapped}/{net.prefixlen - 96}")
            width = net.max_prefixlen // 4
            rows.append((width, f"{int(net[0]):0{width}x}", f"{int(net[-1]):0{width}x}", net.prefixlen, owner))
    return rows


_OCTETS = ("10 + event_id % 3", "event_id % 5", "(event_id * 7) % 256", "(event_id * 13) % 256")
_QUAD = " || '.' || ".join(f"({part})" for part in _OCTETS)
_QUAD_HEX = " || ".join(f"printf('%02x', {part})" for part in _OCTETS)
_ODD = ["fe80::1%en0", "api.openai.com", "10.1.2", "[2001:db8::7]", "::1"]
_ODD_HEX = [f"{int(ipaddress.ip_address(a)):032x}" if a else "" for a in ("fe80::1", "", "", "2001:db8::7", "::1")]
_RANGED = f"""
rng(width, low, high, bits, owner) AS ({_values(_bounds())}),
ranged AS (SELECT host, ts, {_PORT} AS port, CASE event_id % 8
        WHEN 4 THEN '2001:db8:' || printf('%x', event_id % 3) || '::' || printf('%x', event_id % 65536)
        WHEN 5 THEN '2001:0DB8:' || printf('%X', event_id % 3) || ':0:0:0:' || printf('%X', event_id % 16) || ':'
            || printf('%X', event_id % 256)
        WHEN 6 THEN '::FFFF:' || {_QUAD} WHEN 7 THEN {_pick(_ODD, 'event_id')} ELSE {_QUAD} END AS remote_ip,
    CASE event_id % 8
        WHEN 4 THEN '20010db8' || printf('%04x', event_id % 3) || repeat('0', 16) || printf('%04x', event_id % 65536)
        WHEN 5 THEN '20010db8' || printf('%04x', event_id % 3) || repeat('0', 12) || printf('%04x', event_id % 16)
            || printf('%04x', event_id % 256)
        WHEN 7 THEN {_pick(_ODD_HEX, 'event_id')} ELSE {_QUAD_HEX} END AS hex FROM ev),
owned AS (SELECT host, ts, port, remote_ip, remote_ip AS remote_host, 'tcp' AS protocol,
    (SELECT arg_max(r.owner, r.bits) FROM rng r WHERE r.width = length(hex) AND hex BETWEEN r.low AND r.high) AS owner FROM ranged),
ranged_ev AS (SELECT * FROM owned h WHERE owner IS NOT NULL OR EXISTS (
    SELECT 1 FROM dom d WHERE h.remote_host = d.domain OR ends_with(h.remote_host, '.' || d.domain)))"""
_EVENTS["ranged"] = _matched(
    "network", "ranged_ev", f"coalesce({_HOST_SIG.format('remote_host')}, owner)", "NULL",
    f"'{DASH}connection to ' || remote_host || ':' || port", *_NETWORK_KEY,
)

_MANY = """
WITH addresses AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 184549376 + 4711
        WHEN 1 THEN 184549376 + (event_id * 7919) % 16777216 ELSE (event_id * 2654435761 + 12345) % 4294967296 END AS n FROM events),
numbers AS (SELECT event_id, k, CASE WHEN event_id % 3 = 0 THEN 184549376 + (event_id * 97 + k) % 65536 * 256
        ELSE (event_id * 2654435761 + k * 40503 * event_id) % 4294967296 END AS n, 12 + (event_id + k * 5) % 19 AS bits
    FROM events, range(10) AS r(k)),
nets AS (SELECT bits, n >> (32 - bits) AS prefix, min('owner-' || (event_id % 997)) AS owner FROM numbers GROUP BY ALL),
tried AS (SELECT event_id, n, b AS bits, n >> (32 - b) AS prefix FROM addresses, range(12, 31) AS r(b)),
met AS (SELECT event_id, arg_max(owner, bits) AS owner FROM tried JOIN nets USING (bits, prefix) GROUP BY event_id)
SELECT event_id, (n // 16777216) || '.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.' || (n % 256) AS address, owner
FROM addresses LEFT JOIN met USING (event_id)"""


def oracle_sql() -> dict[str, str]:
    history = f"WITH {_REGISTRY},{_HISTORY}\n"
    report_end = " ORDER BY history.timestamp DESC, id"
    return {
        "visit_findings": _flat(_VISITS, events=["visits"]),
        "latest_visits_per_profile": _with(
            _VISITS,
            select="SELECT host, browser, profile, CAST(visit_ts AS VARCHAR) AS visit_ts, url FROM ranked WHERE place <= 200",
        ),
        "network_findings": _flat(_CONNECTIONS, _NETSTAT, events=["connections", "parsed"]),
        "netstat_connections": _with(
            _NETSTAT, select="SELECT host, CAST(ts AS VARCHAR) AS ts, remote_ip, port FROM parsed"
        ),
        "capture_first_connections": _with(
            _TLS,
            select="""SELECT host, CAST(ts AS VARCHAR) AS ts, sni, dst_ip, port FROM (SELECT *, row_number() OVER (
                PARTITION BY sni, port, epoch_us(ts) // 86400000000 ORDER BY ts, host, sni, dst_ip, port) AS place FROM tls)
                WHERE place = 1""",
        ),
        "dns_reachable_domains": _with(
            _DNS, select="SELECT host, domain, CAST(ts AS VARCHAR) AS ts FROM reachable"
        ),
        "dns_findings": _flat(_DNS, events=["dns"]),
        "tls_name_findings": _flat(_TLS, events=["tls"]),
        "http_log_events": _with(
            _HTTP,
            select=f"""SELECT {_id("network", "host", "'http'", "remote_host", "dst_ip", "CAST(port AS VARCHAR)")} AS event_id,
                CAST(ts AS VARCHAR) AS ts, remote_host, dst_ip AS remote_ip, port, 'http' AS protocol,
                CASE WHEN n_headers > 0 THEN CAST(n_headers AS INT) END AS n_headers, auth AS "authorization", x_ratio FROM http_ev""",
        ),
        "cloud_log_findings": _flat(_CLOUD, events=["cloud"]),
        "cloud_log_rejects": _with(select=_CLOUD_REJECTS),
        "http_dlp_hits": _with(_LEAKS, select="""SELECT event_id, field, form, run, sig_id AS signature_id, pattern_id, severity,
            CAST(start AS INT) AS start, CAST(start + n - 1 AS INT) AS stop FROM starts"""),
        "user_agent_findings": _flat(_AGENTS, events=["agents"]),
        "user_agent_owners": _MANY_AGENTS,
        "alert_routes": f"WITH {_REGISTRY},{_HISTORY},{_ROUTED}\nSELECT * FROM batches",
        "due_deliveries": f"WITH {_REGISTRY},{_HISTORY},{_DUE}",
        "ip_range_findings": _flat(_RANGED, events=["ranged"]),
        "ip_range_owners": _MANY,
        "http_log_findings": _flat(_HTTP, events=["http"]),
        "process_findings": _flat(_PROCESSES, events=["processes"]),
        "shell_findings": _flat(_SHELL, events=["shell"]),
        "secret_lines": _flat(_FILES, _SECRETS, events=["code"]),
        "document_dlp_hits": _with(
            select="""SELECT d.doc_id, p.sig_id AS signature_id, p.pattern_id, p.severity
                FROM documents d JOIN pat p ON regexp_matches(d.text, p.pattern)"""
        ),
        "risk_scores": f"""SELECT event_id, risk_score, {_LEVEL.format('risk_score')} AS risk_level FROM (
            SELECT event_id, CAST(trunc(least(coalesce(CASE WHEN event_id % 11 = 3 THEN NULL ELSE event_id % 101 END, 30)
                * CASE WHEN event_id % 3 = 0 THEN 1.5 ELSE 1.0 END
                * CASE WHEN event_id % 7 = 0 THEN 2.0 WHEN event_id % 5 = 0 THEN 1.5 ELSE 1.0 END, 100)) AS INT)
                AS risk_score FROM events)""",
        "policy_actions": _with(_INPUTS, _POLICIES, select=_GOVERNED),
        "policy_thresholds": _with(
            _INPUTS,
            f"""governed AS (
                SELECT 'none' AS policy_id, event_id, 'warn' AS policy_action, score AS risk_score FROM inputs
                UNION ALL
                SELECT 'thresholds', event_id, CASE WHEN score >= 80 THEN 'block' WHEN score >= 50 THEN 'warn'
                    ELSE 'allow' END, score FROM inputs)""",
            select=f"""SELECT policy_id, event_id, risk_score, {_LEVEL.format('risk_score')} AS risk_level,
                policy_action, CAST(NULL AS VARCHAR) AS matched_rule FROM governed""",
        ),
        "policy_check": _with(
            _INPUTS,
            _POLICIES,
            select="""SELECT policy_id, matched_rule, policy_action, count(*) AS n_findings
                FROM governed GROUP BY policy_id, matched_rule, policy_action""",
        ),
        "all_findings": _flat(*_ALL_CTES, events=[*_SCAN_ALL, "http", "tls"]),
        "scan_counts": _with(
            *_ALL_CTES,
            _findings(*_SCAN_ALL),
            select=f"""SELECT source, risk_level, count(*) AS n_findings FROM (SELECT source, {_LEVEL_F} AS risk_level
                FROM found) GROUP BY source, risk_level""",
        ),
        "findings_last_24h": history + _REPORT
        + " WHERE date_trunc('second', history.timestamp) >= TIMESTAMP '2024-01-29 00:00:00'" + report_end,
        "findings_recent_1000": history + _REPORT + report_end + " LIMIT 1000",
        "findings_since": history + _REPORT
        + " WHERE history.timestamp > TIMESTAMP '2024-01-28 12:30:00' ORDER BY history.timestamp, id",
        "findings_today_count": history
        + "SELECT count(*) AS n_findings FROM history WHERE CAST(timestamp AS DATE) = DATE '2024-01-30'",
        "ci_gate_count": history + "SELECT count(*) AS n_findings FROM history WHERE risk_score >= 51",
        "findings_of_level": history
        + "SELECT service_name AS service, risk_level, detail FROM history WHERE risk_level = 'CRITICAL'",
        "actionable_findings": history
        + "SELECT id, risk_level FROM history WHERE risk_level IN ('HIGH', 'CRITICAL')",
        "findings_latest_by_id": f"WITH {_REWRITTEN}{_LATEST_COLUMNS}",
        "store_latest_by_id": f"WITH {_REWRITTEN}{_LATEST_COLUMNS}",
        "store_last_24h": f"WITH {_REWRITTEN}" + """SELECT id, CAST(shown AS VARCHAR) AS timestamp, source, risk_score, detail
            FROM latest WHERE shown >= TIMESTAMP '2024-01-29 00:00:00'
                AND (event_date IS NULL OR event_date >= DATE '2024-01-29')""",
        "signature_list": history
        + """SELECT s.id, s.version, s.risk_base, s.name, count(h.id) AS n_findings FROM sig s
            LEFT JOIN history h ON h.service_id = s.id GROUP BY s.id, s.version, s.risk_base, s.name ORDER BY s.id""",
        "stale_signatures": history
        + """SELECT id, CAST(last_updated AS VARCHAR) AS last_updated, age_seconds FROM (
            SELECT service_id AS id, max(timestamp) AS last_updated, greatest(epoch_us(TIMESTAMP '2024-02-01') // 1000000
                - epoch_us(max(timestamp)) // 1000000, 0) AS age_seconds
            FROM history WHERE service_id IS NOT NULL GROUP BY service_id) WHERE age_seconds >= 86400""",
        "changed_files": _with(_FILES, select="SELECT repo, path, mtime FROM changed"),
        "changed_files_by_commit": f"""WITH touched AS (SELECT source AS repo, {_PATH} AS path,
                greatest(doc_id % 10, doc_id % 7) AS seq FROM documents),
            latest AS (SELECT repo, path, max(seq) AS seq FROM touched GROUP BY repo, path),
            last AS (SELECT source AS repo, max(doc_id % 10) - 3 AS seq FROM documents
                WHERE NOT ends_with(source, '0') GROUP BY source)
            SELECT t.repo, t.path FROM latest t LEFT JOIN last l USING (repo) WHERE l.seq IS NULL OR t.seq > l.seq""",
        "changed_files_combined": _with(
            _FILES,
            f"""touched AS (SELECT source AS repo, {_PATH} AS path, greatest(doc_id % 10, doc_id % 7) AS seq
                FROM documents WHERE NOT ends_with(source, '5')),
            latest AS (SELECT repo, path, max(seq) AS seq FROM touched GROUP BY repo, path),
            last AS (SELECT source AS repo, max(doc_id % 10) - 3 AS seq FROM documents
                WHERE NOT ends_with(source, '0') GROUP BY source)""",
            select="""SELECT f.repo, f.path FROM files f WHERE (f.repo, f.path) IN (SELECT (t.repo, t.path)
                    FROM latest t LEFT JOIN last l USING (repo) WHERE l.seq IS NULL OR t.seq > l.seq)
                UNION ALL SELECT repo, path FROM changed WHERE ends_with(repo, '5')""",
        ),
        "incremental_secret_lines": _with(
            _FILES,
            _SECRETS,
            select="""SELECT s.repo, s.path, s.mtime, s.line_number, s.matched_text FROM secret s
                WHERE (s.repo, s.path) IN (SELECT (repo, path) FROM changed)""",
        ),
        "findings_json": _with(
            *_SOME,
            select=f"""SELECT finding_id, left(flat, length(flat) - 1) || ',"event":' || {_EVENT_JSON} || '}}' AS json
                FROM (SELECT *, {_FLAT_JSON} AS flat FROM found)""",
        ),
        "sarif_results": _with(*_SOME, select=f"SELECT finding_id, {_SARIF_RESULT} AS result FROM found"),
        "sarif_logs": _sarif_logs("%Y-%m-%d %H:%M", 1),
        "sarif_logs_in_parts": _sarif_logs("%Y-%m-%d %H", 3),
        "scan_report_markdown": _with(
            *_SOME,
            select=f"""SELECT 0 AS place, NULL AS finding_id, '| Risk | Service | Detail |' AS line
                UNION ALL SELECT 1, NULL, '|------|---------|--------|'
                UNION ALL SELECT 2, finding_id, '| ' || ({_LEVEL_F}) || ' | ' || {_SHOWN} || ' | ' || detail || ' |' FROM found""",
        ),
        "scan_report_sarif": _with(
            *_SOME,
            select=f"""SELECT 0 AS place, NULL AS finding_id, {_SARIF_HEAD} AS line
                UNION ALL SELECT 1, finding_id, CASE WHEN finding_id = (SELECT min(finding_id) FROM found) THEN '' ELSE ',' END
                    || {_SARIF_RESULT} FROM found
                UNION ALL SELECT 2, NULL, ']}}]}}'""",
        ),
        "alert_payload": history
        + f"""SELECT batch_id, 0::BIGINT AS doc_id, CAST(count(*) AS INT) AS n_alerts,
                '{{"tool":"wardline","version":"0.1.0","findings":[' || string_agg(item, ',' ORDER BY id) || ']}}' AS payload
            FROM (SELECT id, strftime(timestamp, '%Y-%m-%d %H') AS batch_id, CAST(to_json({{'id': id,
                'timestamp': {_rfc3339('timestamp', 'Z')}, 'risk_level': risk_level, 'risk_score': risk_score,
                'service': service_name, 'detail': detail}}) AS VARCHAR) AS item FROM history
                WHERE risk_level IN ('HIGH', 'CRITICAL')) GROUP BY batch_id""",
        "alert_lines": history
        + f""",
            alerts AS (SELECT id, strftime(timestamp, '%Y-%m-%d') AS batch_id, CAST(to_json({{'id': id,
                'timestamp': {_rfc3339('timestamp', 'Z')}, 'risk_level': risk_level, 'risk_score': risk_score,
                'service': service_name, 'detail': detail}}) AS VARCHAR) AS item FROM history WHERE risk_level IN ('HIGH', 'CRITICAL'))
            SELECT batch_id, 1 AS place, id AS finding_id,
                CASE row_number() OVER (PARTITION BY batch_id ORDER BY id) WHEN 1 THEN '' ELSE ',' END || item AS line FROM alerts
            UNION ALL SELECT DISTINCT batch_id, 0, NULL, '{{"tool":"wardline","version":"0.1.0","findings":[' FROM alerts
            UNION ALL SELECT DISTINCT batch_id, 2, NULL, ']}}' FROM alerts""",
        "report_lines": _with(
            *_SOME,
            select=f"""SELECT finding_id, '[' || {_pad(f'({_LEVEL_F})', 8)} || '] [' || {_pad(
                "(CASE policy_action WHEN 'allow' THEN 'ALLOWED' WHEN 'warn' THEN 'WARN' ELSE 'BLOCKED' END)", 7)}
                || '] (rule: ' || matched_rule || ')  ' || {_pad(_SHOWN, 20)} || '  ' || detail
                || CASE WHEN dlp = '' THEN '' ELSE ' [DLP: ' || replace(dlp, ',', ', ') || ']' END AS line FROM found""",
        ),
        "stored_findings": _with(
            *_SOME,
            select=f"""SELECT finding_id AS id, CAST(ts AS VARCHAR) AS timestamp, signature_id AS service_id, service_name,
                risk_score, {_LEVEL_F} AS risk_level, {_DLP_JSON} AS dlp_matches,
                detail, {_EVENT_JSON} AS raw_event, policy_action, matched_rule,
                CASE source WHEN 'shell_history' THEN 'shell' WHEN 'network' THEN 'net' WHEN 'browser_history' THEN 'browser'
                    ELSE source END AS source, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date
                FROM found""",
        ),
        "stored_report_lines": history
        + f"""SELECT id, '[' || {_pad('risk_level', 8)} || ']  ' || {_pad(_SHOWN, 20)} || ' ' || detail || '  ('
                || {_rfc3339('timestamp', '+00:00')} || ')' AS line,
            CAST(to_json({{'id': id, 'timestamp': {_rfc3339('timestamp', '+00:00')}, 'source': source,
                'service_name': service_name, 'risk_score': risk_score, 'risk_level': risk_level, 'detail': detail}}) AS VARCHAR)
                AS json FROM history""",
        "markdown_rows": history
        + f"SELECT id, '| ' || risk_level || ' | ' || {_SHOWN} || ' | ' || detail || ' |' AS row FROM history",
        "html_rows": history
        + f"""SELECT id, {_html(_SHOWN, "strftime(timestamp, '%Y-%m-%d %H:%M:%S UTC')")} AS scan_row,
            {_html(_escaped(_SHOWN), _escaped(_rfc3339('timestamp', '+00:00')))} AS stored_row FROM history""",
        "alert_debounce": f"WITH RECURSIVE {_REGISTRY.strip()},{_HISTORY},{_DEBOUNCE}\n"
        + """SELECT s.service, CAST(make_timestamp(s.sec * 1000000) AS VARCHAR) AS sent_at, a.n_alerts
            FROM sends s JOIN alerts a USING (service, sec)""",
    }
