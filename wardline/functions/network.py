"""Parsing of connection listings and HTTP request texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.text import trim_space_sql

# Request methods and the ports whose payloads are read.
HTTP_METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"]
HTTP_PORTS = [80, 8080]
TLS_PORTS = [443, 8443]


def payload_protocol(port: Column) -> Column:
    """Which parser a payload goes to; null for any other port."""
    return F.when(port.isin(HTTP_PORTS), "http").when(port.isin(TLS_PORTS), "https")


def netstat_peer_sql(line: str) -> str:
    """The peer, as ``addr.port``, of a TCP line of at least five words; else empty."""
    return rf"regexp_extract({line}, r'(?U)^\s*tcp\S*(?:\s+\S+){{3}}\s+(\S*\.\+?[0-9]+)(?!\S)', 1)"


def peer_address_sql(peer: str) -> str:
    return f"left({peer}, length({peer}) - length(substring_index({peer}, '.', -1)) - 1)"


def peer_port_sql(peer: str) -> str:
    """The port, null where it is no number an int can hold."""
    return f"try_cast(substring_index({peer}, '.', -1) AS int)"


def is_http_request(payload: Column) -> Column:
    """The first line opens with a request method."""
    return payload.rlike(r"(?U)^[^\S\n]*(" + "|".join(HTTP_METHODS) + r")(\s|\z)")


def http_headers_sql(payload: str) -> str:
    """Lower-cased header map of a request text; of a repeated name the last wins."""
    lines = rf"split(split({payload}, r'\r?\n\r?\n', 2)[0], r'\r?\n')"
    name = trim_space_sql("substring_index(line, ':', 1)")
    value = trim_space_sql("substring(line, locate(':', line) + 1)")
    return f"""map_from_entries(transform(
        filter({lines}, (line, i) -> i > 0 AND contains(line, ':')),
        line -> named_struct('key', lower({name}), 'value', {value})))"""
