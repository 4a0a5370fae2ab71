"""Hosts, commands, paths and escapes."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions that are scanned, folders that are not.
SCANNED_EXTENSIONS = [
    "js", "ts", "jsx", "tsx", "py", "rb", "go", "rs", "java", "kt", "php", "cs",
    "env", "toml", "yaml", "yml", "json",
]
SKIPPED_FOLDERS = ["node_modules", "target", "dist"]

# Unicode classes and case folding, and \n as the only line end.
REGEX_FLAGS = "(?dU)"

# Named ASCII classes that patterns may use inside brackets.
ASCII_CLASSES = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "digit": "0-9",
    "lower": "a-z",
    "space": r"\t\n\x0b\f\r ",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}

_GROUP_NAME = re.compile(r"(?<!\\)((?:\\\\)*)\(\?P?<[A-Za-z_]\w*>")
_NAMED_CLASS = re.compile(r"\[:(" + "|".join(ASCII_CLASSES) + r"):\]")


def spark_regex(pattern: str) -> str:
    """A signature pattern as Spark's regular expressions have it.

    Groups lose their names, which nothing reads; named classes are spelled out.
    """
    pattern = _GROUP_NAME.sub(r"\1(?:", pattern)
    return REGEX_FLAGS + _NAMED_CLASS.sub(lambda m: ASCII_CLASSES[m[1]], pattern)

# Fixed value: the characters of the Unicode property White_Space.
WHITE_SPACE = (
    "\t\n\u000b\f\r \u0085\u00a0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def trim_space_sql(text: str) -> str:
    """Strip any white space, not only blanks."""
    return f"trim(BOTH '{WHITE_SPACE}' FROM {text})"


def extract_host_sql(url: str) -> str:
    """What stands between the scheme and the first ``/`` or ``?``.

    A port, user info or fragment stays, and case is kept; ``parse_url`` differs.
    """
    return f"regexp_extract({url}, '^(?:https://)*+(?:http://)*+([^/?]*)', 1)"


def last_labels(host: Column, n: int) -> Column:
    """The last ``n`` dot-separated labels, or all of a shorter host."""
    return F.substring_index(host, ".", -n)


def shell_command_sql(line: str) -> str:
    """A history line without its zsh ``: time:elapsed;`` prefix, trimmed.

    Only the second ``;`` field of a prefixed line counts.
    """
    bare = f"coalesce(try_element_at(split({line}, ';'), 2), {line})"
    return trim_space_sql(f"IF(startswith({line}, ': '), {bare}, {line})")


def binary_name_sql(command: str) -> str:
    """Base name of the first word."""
    return rf"substring_index(regexp_extract({command}, r'(?U)^\s*(\S*)', 1), '/', -1)"


def is_noise_path(relative_path: Column) -> Column:
    """Any hidden part (the file name too) or a known build folder."""
    noise = "|".join(SKIPPED_FOLDERS)
    return relative_path.rlike(rf"(^|/)(\.|({noise})(/|\z))")


def file_extension(path: Column) -> Column:
    """Text after the last dot of the file name; a leading dot starts no extension."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1)


def is_scanned_extension(path: Column) -> Column:
    return file_extension(path).isin(SCANNED_EXTENSIONS)


def html_escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def pad_right(text: Column, width: int) -> Column:
    """Pad to ``width``; longer texts stay whole (``rpad`` would cut them)."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def rfc3339(ts: Column, zone: str = "+00:00") -> Column:
    """UTC time with as many fraction digits as it needs: none, 3 or 6."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    fraction = (
        F.when(micros == 0, "")
        .when(micros % 1000 == 0, F.date_format(ts, ".SSS"))
        .otherwise(F.date_format(ts, ".SSSSSS"))
    )
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit(zone))


def at_utc(moment: datetime) -> Column:
    """A literal timestamp; a naive ``datetime`` is taken as UTC."""
    aware = moment if moment.tzinfo else moment.replace(tzinfo=UTC)
    since_epoch = aware - datetime(1970, 1, 1, tzinfo=UTC)
    return F.timestamp_micros(F.lit(since_epoch // timedelta(microseconds=1)))
