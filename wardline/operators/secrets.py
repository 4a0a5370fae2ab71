"""Built-in secret patterns on source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import REGEX_FLAGS, is_noise_path, is_scanned_extension
from wardline.operators.matching import with_computed

# Pattern ids and expressions, in the order they are tried.
SECRET_PATTERNS = {
    "openai_key": r"sk-[A-Za-z0-9]{20,}",
    "anthropic_key": r"sk-ant-[A-Za-z0-9\-_]{20,}",
    "google_ai_key": r"AIza[0-9A-Za-z\-_]{35}",
    "huggingface_key": r"hf_[A-Za-z0-9]{20,}",
    "generic_api_key": r'(?i)(api[_\-]?key|secret)["\s]*[:=]["\s]*[A-Za-z0-9\-_]{16,}',
}

# Any text one of the patterns matches also passes this cheaper test. Beyond ASCII,
# the Kelvin sign lowers to k and the long s uppers to S, as pattern matching has it.
_HINT = (
    "contains(_text, 'sk-') OR contains(_text, 'AIza') OR contains(_text, 'hf_') "
    "OR contains(lower(_text), 'key') OR contains(upper(_text), 'SECRET')"
)


def secret_pattern(line: Column) -> Column:
    """Id of the first pattern found in ``line``, else null."""
    return F.coalesce(
        *[F.when(line.rlike(REGEX_FLAGS + p), name) for name, p in SECRET_PATTERNS.items()]
    )


def secret_lines(files: DataFrame, *, scan_dotenv: bool = False) -> DataFrame:
    """``path, content`` -> the input columns but content, ``line_number``, ``matched_text``.

    Path tests come first, then one cheap test of the whole file; only files
    that pass are split into lines. Files that are not UTF-8 are left out.
    """
    path = F.col("path")
    noise = is_noise_path(path)
    if scan_dotenv:
        noise = noise & ~path.rlike(r"^([^./][^/]*/)*\.env\z")
    wanted = is_scanned_extension(path)
    if scan_dotenv:
        wanted = wanted | path.rlike(r"(^|/)\.env\z")
    kept = [c for c in files.columns if c != "content"]
    lines = (
        with_computed(files.filter(wanted & ~noise), _text="CAST(content AS string)")
        .filter(f"is_valid_utf8(_text) AND ({_HINT})")
        .select(*kept, F.posexplode(F.split("_text", "\r?\n")).alias("_pos", "_line"))
    )
    return (
        lines.withColumn("matched_text", secret_pattern(F.col("_line")))
        .filter("matched_text IS NOT NULL")
        .withColumn("line_number", F.col("_pos") + 1)
        .drop("_pos", "_line")
    )
