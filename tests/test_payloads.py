"""Places of sensitive patterns against Python's own search."""

import base64
import re
from urllib.parse import quote

from wardline.operators import payloads
from wardline.registry import DlpPattern, Registry, Signature

KEY, OTHER = "sk-" + "A1b2" * 6, "hf_" + "Zz9" * 8
REGISTRY = Registry.of(
    [
        Signature("a", "A", "1", 10, dlp_patterns=(DlpPattern("sk", "sk-[A-Za-z0-9]{20,}", "critical"),)),
        Signature("b", "B", "1", 10, dlp_patterns=(DlpPattern("hf", "hf_[A-Za-z0-9]{20,}", "odd"), DlpPattern("word", r"(?i)\bsecret\b", "high"))),
    ]
)


def hits(spark, *texts):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "k int, payload string, field_of_mine string")
    rows = payloads.payload_hits(df, REGISTRY).collect()
    assert not rows or "field_of_mine" in rows[0].asDict()
    return sorted((r.k, r.field, r.form, r.run, r.pattern_id, r.start, r.stop) for r in rows)


def request(body="", **headers):
    lines = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in headers.items())
    return f"POST / HTTP/1.1\r\n{lines}\r\n{body}"


def places(text, pattern):
    return [(m.start() + 1, m.end()) for m in re.finditer(pattern, text)]


def test_places_in_plain_texts(spark):
    body = f"x {KEY} é日 {KEY}, Secret secret {OTHER}"
    got = hits(spark, request(body, Authorization=f"Bearer {KEY}"))
    want = [(0, "header:authorization", "plain", 0, "sk", 8, 7 + len(KEY))]
    for name, pattern in (("sk", "sk-[A-Za-z0-9]{20,}"), ("hf", "hf_[A-Za-z0-9]{20,}"), ("word", r"(?i)\bsecret\b")):
        want += [(0, "body", "plain", 0, name, *place) for place in places(body, pattern)]
    assert got == sorted(want) and len(got) == 6


def test_percent_and_base64_forms(spark):
    coded = base64.b64encode(f"user:{KEY} é".encode()).decode()
    got = hits(
        spark,
        request(f"q={quote(KEY, safe='').replace('-', '%2D')}+%2B", X_A=f"Basic {coded}"),
        request(f"{coded} {base64.b64encode((OTHER + ' ').encode()).decode()}"),
    )
    assert got == [
        (0, "body", "percent", 0, "sk", 3, 2 + len(KEY)),
        (0, "header:x-a", "base64", 0, "sk", 6, 5 + len(KEY)),
        (1, "body", "base64", 0, "sk", 6, 5 + len(KEY)),
        (1, "body", "base64", 1, "hf", 1, len(OTHER)),
    ]


def test_broken_forms_and_marks_in_the_text(spark):
    assert hits(spark, request(f"%zz%4 {'A' * 17} ====", X_B="A" * 16), request(), "GET", "", None, "TRACE /\r\n\r\n" + KEY) == []
    got = hits(spark, request(f"\x01\x02 {KEY} \x01{KEY}"))
    assert [g[5:] for g in got] == [(4, 3 + len(KEY)), (6 + len(KEY), 5 + 2 * len(KEY))]


def test_no_patterns(spark):
    df = spark.createDataFrame([(1, request(KEY))], "k int, payload string")
    assert payloads.payload_hits(df, Registry.of([])).collect() == []
    bad = Registry.of([Signature("a", "A", "1", 10, dlp_patterns=(DlpPattern("x", "[", "low"),))])
    assert payloads.payload_hits(df, bad).collect() == []


def test_long_bodies(spark):
    body = ("word " * 200_000) + KEY
    assert hits(spark, request(body)) == [(0, "body", "plain", 0, "sk", 1_000_001, 1_000_000 + len(KEY))]
