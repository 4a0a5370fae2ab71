from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wardline.operators import matching
from wardline.plans.scan import analyze, redact, score_events
from wardline.policy import Policy
from wardline.registry import (
    DlpPattern,
    InvalidSignature,
    Registry,
    Signature,
    lint_signatures,
    parse_signatures,
    signature_list,
)
from wardline.sources import telemetry

BUNDLED = Registry.bundled()
TS = datetime(2024, 1, 1, 12)


def sig(id_="x", base=40, **more):
    return Signature(id=id_, name=id_.title(), version="1.0.0", risk_base=base, **more)


def grown(n: int = 300) -> Registry:
    """The bundled registry plus enough others to take the join path."""
    others = [
        sig(f"z{i}", domains=(f"svc{i}.example.zz", f"zz{i}.tld"), process_names=(f"zzproc{i}",),
            dlp_patterns=(DlpPattern(f"z{i}_key", f"zkey{i}-[a-f]+", "high"),))
        for i in range(n)
    ]
    return Registry.of([*BUNDLED.all(), *others])


HOSTS = [
    "api.openai.com", "openai.com", "a.b.c.openai.com", "evil-openai.com", "API.OPENAI.COM",
    "api.openai.com:443", "localhost", "x.localhost", "127.0.0.1", "0.0.0.0", "1.127.0.0.1",
    "", "com", ".openai.com", "anthropic.com", "claude.ai", "claude.ai#x", None,
]


def plain_host(host, registry):
    if host is None:
        return None
    hits = [s.id for s in registry.all() if any(host == d or host.endswith("." + d) for d in s.domains)]
    return min(hits, default=None)


@pytest.mark.parametrize("registry", [BUNDLED, grown(), Registry.of([sig(domains=("a.b", "b", "a.b"))]), Registry()])
def test_host_signature(spark, registry):
    hosts = spark.createDataFrame([(h,) for h in [*HOSTS, "q.svc7.example.zz", "a.b", "x.a.b", "xa.b"]], "h string")
    want = {r.h: plain_host(r.h, registry) for r in hosts.collect()}
    joined = matching.join_host_signature(hosts, "h", registry, "s").collect()
    assert {r.h: r.s for r in joined} == want
    if len(registry) and matching.is_literal_sized(registry):
        literal = hosts.select("h", matching.host_signature("h", registry).alias("s")).collect()
        assert {r.h: r.s for r in literal} == want
    kept = matching.keep_host_matches(hosts, "h", registry).collect()
    assert {r.h for r in kept} == {h for h, s in want.items() if s}
    assert len(kept) == len({r.h for r in kept})


def test_unmatched_url_forms(spark):
    urls = {
        "https://chatgpt.com/c/1?x=2": True,
        "https://claude.ai#x": False,
        "http://localhost:11434/": False,
        "http://localhost/": True,
        "https://https://http://http://api.openai.com?q": True,
        "http://https://api.openai.com/": False,
        "ftp://api.openai.com/": False,
        "api.openai.com": True,
        "https://evil-openai.com/": False,
        "https://x/api.openai.com": False,
    }
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(
        "url", matching.url_matches("url", BUNDLED).alias("m")
    )
    assert {r.url: r.m for r in rows.collect()} == urls


def test_large_registry_joins_hosts_by_broadcast_hash_join(spark):
    hosts = spark.createDataFrame([("a",)], "h string")
    plan = matching.join_host_signature(hosts, "h", grown(), "s")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bundled_registry_matches_without_join_or_shuffle(spark):
    table = spark.createDataFrame([("m", TS, "api.openai.com", 443)], "host string, ts timestamp, remote_ip string, port int")
    found = analyze(telemetry.connection_events(table, BUNDLED), BUNDLED, Policy.bundled())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


PROGRAMS = ["ollama", "nginx", "my-openai", "claude-ollama", "", "xlocalaix", "zzproc7", "az", None]


def plain_program(name, registry, prefix=False):
    if name is None:
        return None
    test = str.startswith if prefix else str.__contains__
    hits = [s.id for s in registry.all() if any(test(name, p) for p in s.process_names)]
    return min(hits, default=None)


@pytest.mark.parametrize("registry", [BUNDLED, grown(), Registry.of([sig("b", process_names=("", "o")), sig("a", process_names=("ng",))]), Registry()])
@pytest.mark.parametrize("prefix", [False, True])
def test_program_signature(spark, registry, prefix):
    names = spark.createDataFrame([(p,) for p in PROGRAMS], "n string")
    want = {p: plain_program(p, registry, prefix) for p in PROGRAMS}
    joined = matching.join_program_signature(names, "n", registry, "s", prefix=prefix).collect()
    assert {r.n: r.s for r in joined} == want
    kept = matching.keep_program_matches(names, "n", registry, prefix=prefix).collect()
    assert {r.n for r in kept} == {p for p, s in want.items() if s}
    if not prefix and matching.is_literal_sized(registry):
        literal = names.select("n", matching.program_signature("n", registry).alias("s")).collect()
        assert {r.n: r.s for r in literal} == want


@pytest.mark.parametrize("registry", [BUNDLED, grown()])
def test_dlp_matches_of_the_matched_signature_only(spark, registry):
    key = "sk-" + "a" * 20
    org = "org-" + "B" * 24
    rows = spark.createDataFrame(
        [(1, "openai", f"x {key} {org}"), (2, "openai", "none"), (3, "groq", key), (4, None, key), (5, "openai", None)],
        "i int, signature_id string, t string",
    )
    got = {
        r.i: [(m.pattern_id, m.description, m.severity) for m in r.dlp_matches]
        for r in matching.with_dlp_matches(rows, "t", registry).collect()
    }
    assert got == {
        1: [
            ("openai_api_key", "DLP match: openai_api_key", "critical"),
            ("openai_org_id", "DLP match: openai_org_id", "high"),
        ],
        2: [], 3: [], 4: [], 5: [],
    }


def test_unusable_patterns_are_left_out(spark):
    registry = Registry.of(
        [sig(dlp_patterns=(DlpPattern("bad", "([a-", "high"), DlpPattern("odd", "it's\\d", "weird")))]
    )
    usable = matching.usable_patterns(spark, registry)
    assert [p.id for p in usable.get("x").dlp_patterns] == ["odd"]
    assert matching.usable_patterns(spark, BUNDLED) is BUNDLED
    row = spark.createDataFrame([("x", "it's5")], "signature_id string, t string")
    assert matching.with_dlp_matches(row, "t", usable).first() == matching.with_dlp_matches(row, "t", registry).first()
    found = matching.with_dlp_matches(row, "t", usable).first().dlp_matches
    assert [(m.pattern_id, m.severity) for m in found] == [("odd", "low")]


def test_pattern_dialect(spark):
    texts = {
        "(?P<key>ab_[[:digit:]]{2})": ("ab_12", "ab_x1"),
        "(?<the_key>x[[:alpha:]_]z)": ("x_z", "x1z"),
        r"\\(?P<k>q)": ("\\q", "q"),
        r"a\(?P<b": ("aP<b", "ab"),
    }
    for pattern, (hit, miss) in texts.items():
        registry = Registry.of([sig(dlp_patterns=(DlpPattern("p", pattern, "high"),))])
        rows = spark.createDataFrame([("x", hit), ("x", miss)], "signature_id string, t string")
        found = matching.with_dlp_matches(rows, "t", registry).collect()
        assert {r.t: len(r.dlp_matches) for r in found} == {hit: 1, miss: 0}, pattern


@pytest.mark.parametrize("registry", [BUNDLED, grown()])
def test_process_pipeline(spark, registry):
    key = "sk-" + "a1" * 16
    processes = spark.createDataFrame(
        [
            ("m", TS, 4_000_000_000, "chatgpt", ["chatgpt", "--key", key], "/bin/chatgpt"),
            ("m", TS, 2, "nginx", ["nginx"], None),
            ("m", TS, 3, "ollama", ["ollama", "serve"], None),
            ("m", TS, 4, "cohere", ["cohere", "b" * 40], None),
        ],
        "host string, ts timestamp, pid bigint, name string, argv array<string>, exe_path string",
    )
    rows = {
        r.event.name: r
        for r in analyze(telemetry.process_events(processes, registry), registry, Policy.bundled()).collect()
    }
    assert set(rows) == {"chatgpt", "ollama", "cohere"}
    leak = rows["chatgpt"]
    assert leak.detail == "OpenAI — process 'chatgpt' running (pid 4000000000)"
    assert (leak.risk_score, leak.risk_level, leak.policy_action, leak.matched_rule) == (
        95, "CRITICAL", "block", "block-dlp-critical",
    )
    local = rows["ollama"]
    assert (local.risk_score, local.risk_level, local.policy_action) == (20, "LOW", "allow")
    # 55 x 1.5 = 82.5, cut to 82, before the rule pins it
    before = {r.name: r.risk_score for r in score_events(telemetry.process_events(processes, registry), registry).collect()}
    assert before["cohere"] == 82 and before["chatgpt"] == 100


def test_approved_services(spark):
    table = spark.createDataFrame(
        [("m", TS, "api.openai.com", 443), ("m", TS, "claude.ai", 443)],
        "host string, ts timestamp, remote_ip string, port int",
    )
    events = telemetry.connection_events(table, BUNDLED)
    scores = {r.signature_id: r.risk_score for r in score_events(events, BUNDLED, approved_ids=["anthropic"]).collect()}
    assert scores == {"openai": 97, "anthropic": 60}


def test_redaction(spark):
    key = "sk-" + "a1" * 16
    lines = spark.createDataFrame(
        [("m", TS, "bash", "h", f"openai --key {key} run")],
        "host string, ts timestamp, shell string, history_file string, line string",
    )
    found = analyze(telemetry.shell_events(lines, BUNDLED), BUNDLED, Policy.bundled())
    assert key in found.first().detail
    clean = redact(found, BUNDLED).first()
    assert clean.detail == "OpenAI — found in bash history: `openai --key [REDACTED] run`"
    assert clean.event.command == "openai --key [REDACTED] run"


def test_registry_loading(tmp_path, spark):
    (tmp_path / "a.yaml").write_text(
        "id: test-svc\nname: Test Service\nversion: '1.0.0'\nrisk_base: 42\n"
        "domains: [test.example.com]\nprocess_names: [test-cli]\ntags: [test]\n"
    )
    (tmp_path / "b.yaml").write_text("id: bad\nname: Bad\nversion: '1'\nrisk_base: not_a_number\n")
    (tmp_path / "c.yaml").write_text("id: [unclosed")
    (tmp_path / "d.txt").write_text("id: ignored")
    for registry in (Registry.load(str(tmp_path)), Registry.load(str(tmp_path), spark)):
        assert len(registry) == 1
        found = registry.get("test-svc")
        assert (found.risk_base, found.domains, found.user_agents) == (42, ("test.example.com",), ())
        assert registry.get("missing") is None
    (tmp_path / "z.yaml").write_text("id: test-svc\nname: Newer\nversion: '2'\nrisk_base: 1\n")
    assert Registry.load(str(tmp_path)).get("test-svc").name == "Newer"
    lint = {r.path.rsplit("/", 1)[-1]: r for r in lint_signatures(spark, str(tmp_path)).collect()}
    assert lint["a.yaml"].valid and lint["a.yaml"].id == "test-svc"
    assert not lint["b.yaml"].valid and "risk_base" in lint["b.yaml"].error
    assert not lint["c.yaml"].valid
    assert "d.txt" not in lint
    assert len(Registry.load(str(tmp_path / "none"))) == 0
    assert len(Registry.load(str(tmp_path / "none"), spark)) == 0


@pytest.mark.parametrize("doc", ["[]", "id: 1\nname: n\nversion: v\nrisk_base: 1", "id: a\nname: n\nversion: 1.0\nrisk_base: 1", "id: a\nname: n\nversion: v\nrisk_base: 256"])
def test_invalid_signatures(doc):
    with pytest.raises(InvalidSignature):
        parse_signatures(doc)


def test_bundled_registry(spark):
    assert {s.id: s.risk_base for s in BUNDLED.all()} == {
        "anthropic": 60, "azure-openai": 55, "cohere": 55, "google-ai": 60, "groq": 55,
        "huggingface": 50, "localai": 15, "mistral": 55, "ollama": 20, "openai": 65, "perplexity": 50,
    }
    listed = signature_list(BUNDLED.frame(spark)).collect()
    assert [r.id for r in listed] == sorted(BUNDLED.signatures)
    one = BUNDLED.frame(spark).filter(F.col("id") == "openai").first()
    assert [p.id for p in one.dlp_patterns] == ["openai_api_key", "openai_org_id"]


@pytest.mark.parametrize("registry", [BUNDLED, grown()])
def test_row_shapes(spark, registry):
    from pyspark.sql.types import StructType

    from wardline import schemas

    table = spark.createDataFrame(
        [("m", TS, "api.openai.com", 443)], "host string, ts timestamp, remote_ip string, port int"
    )
    events = telemetry.connection_events(table, registry)
    found = analyze(events, registry, Policy.bundled())
    for frame, ddl in ((events, schemas.EVENT), (found, schemas.FINDING), (registry.frame(spark), schemas.SIGNATURE)):
        want = StructType.fromDDL(ddl)
        assert frame.columns == want.names
        assert [f.dataType.simpleString() for f in frame.schema] == [f.dataType.simpleString() for f in want]
