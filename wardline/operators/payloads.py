"""Where sensitive patterns lie in HTTP headers and bodies, also in encoded values.

Every header value and the body is searched as it is, with its percent forms decoded,
and with each run that is base64 of text decoded. A hit names the field, the form, which
of the decoded runs it is, the pattern, and the first and last character (from 1) in the
decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.network import http_headers_sql, is_http_request
from wardline.functions.text import spark_regex
from wardline.operators.matching import sql_text, usable_patterns, with_computed
from wardline.registry import Registry
from wardline.session import configure

#: the least characters of a run that may be base64
BASE64_LEAST = 16
#: what marks a match while its place is worked out; such characters in a text become spaces
OPEN, CLOSE = "\x01", "\x02"


def searched_texts(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """The columns of ``payloads`` and ``field, form, run, searched``: each text to search."""
    configure(payloads.sparkSession)
    requests = payloads.filter(F.is_valid_utf8(text) & is_http_request(F.col(text)))
    parts = with_computed(
        requests,
        _headers=f"map_entries({http_headers_sql(text)})",
        _body=f"get(split({text}, r'\\r?\\n\\r?\\n', 2), 1)",
    )
    fields = parts.selectExpr(
        *payloads.columns,
        "inline(concat(transform(_headers, h -> named_struct('field', concat('header:', h.key), '_value', h.value)),"
        " array(named_struct('field', 'body', '_value', coalesce(_body, '')))))",
    ).filter("_value <> ''")
    # a plus sign is itself in a percent form; what is no valid form is left alone
    percent = "try_url_decode(replace(_value, '+', '%2B'))"
    runs = (
        f"transform(regexp_extract_all(_value, '[A-Za-z0-9+/]{{{BASE64_LEAST},}}={{0,2}}', 0),"
        " run -> try_validate_utf8(try_to_binary(run, 'base64')))"
    )
    decoded = with_computed(
        fields,
        _percent=f"CASE WHEN _value RLIKE '%[0-9A-Fa-f]{{2}}' THEN {percent} END",
        _runs=runs,
    )
    texts = (
        "concat(array(named_struct('form', 'plain', 'run', 0, 'searched', _value),"
        " named_struct('form', 'percent', 'run', 0, 'searched', _percent)),"
        " transform(_runs, (x, k) -> named_struct('form', 'base64', 'run', k, 'searched', x)))"
    )
    found = decoded.selectExpr(*payloads.columns, "field", f"inline({texts})")
    return found.filter("searched IS NOT NULL AND NOT (form = 'base64' AND searched RLIKE r'[\\x00-\\x08]')")


def matches_sql(text: str, pattern: str) -> str:
    """All matches of a pattern as an array of ``start, stop, match``, from the text cut at them."""
    plain = f"translate({text}, '{OPEN}{CLOSE}', '  ')"
    marked = f"regexp_replace({plain}, {sql_text(pattern)}, '{OPEN}$0{CLOSE}')"
    # pieces before, in and after matches take turns
    step = (
        "(s, x) -> named_struct('at', s.at + length(x), 'inside', NOT s.inside, 'found', IF(s.inside AND x <> '',"
        " concat(s.found, array(named_struct('start', s.at + 1, 'stop', s.at + length(x), 'match', x))), s.found))"
    )
    none = "CAST(array() AS array<struct<start:int,stop:int,match:string>>)"
    return (
        f"aggregate(split({marked}, '[{OPEN}{CLOSE}]'), named_struct('at', 0, 'inside', false, 'found', {none}),"
        f" {step}).found"
    )


def payload_hits(payloads: DataFrame, registry: Registry, text: str = "payload") -> DataFrame:
    """The columns of ``payloads`` but the text, and ``field, form, run, signature_id, pattern_id, severity, start, stop``."""
    registry = usable_patterns(payloads.sparkSession, registry)
    kept = [c for c in payloads.columns if c != text]
    hits = [
        f"CASE WHEN searched RLIKE {sql_text(spark_regex(p.pattern))} THEN transform("
        f"{matches_sql('searched', spark_regex(p.pattern))}, m -> named_struct('signature_id', {sql_text(sig.id)},"
        f" 'pattern_id', {sql_text(p.id)}, 'severity', {sql_text(p.severity)}, 'start', m.start, 'stop', m.stop)) END"
        for sig in registry.all()
        for p in sig.dlp_patterns
    ]
    texts = searched_texts(payloads, text).select(*kept, "field", "form", "run", "searched")
    if not hits:
        none = "CAST(array() AS array<struct<signature_id:string,pattern_id:string,severity:string,start:int,stop:int>>)"
        return texts.selectExpr(*kept, "field", "form", "run", f"inline({none})")
    return texts.selectExpr(
        *kept, "field", "form", "run", f"inline(flatten(array_compact(array({', '.join(hits)}))))"
    )
