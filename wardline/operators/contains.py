"""Texts that contain (or start with) one of many patterns, by an index of rare grams.

A text that contains a pattern contains the pattern's grams: all its runs of three
characters (the whole pattern, if it is shorter). Each pattern stands in the index under
the one of its grams that fewest patterns have, so thousands of patterns that
share "python-" or "client" still stand apart. The grams of the distinct texts meet
the index by an equi join, and what met is then tested as a whole. With ``prefix``
a pattern stands under its first gram, and texts bring theirs only.

An index of few enough bytes is broadcast; otherwise Spark joins by size, and splits frequent
grams. Rows then take their text's answer: the smallest owner of the patterns found. Rows without a text spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3
#: up to here an index is broadcast
BROADCAST_BYTES = 8_000_000
#: bytes of an index row besides its texts
ROW_BYTES = 64


def _grams(text: str) -> str:
    """All grams of a pattern, once each."""
    runs = f"transform(sequence(1, length({text}) - {GRAM - 1}), at -> substring({text}, at, {GRAM}))"
    return f"IF(length({text}) <= {GRAM}, array({text}), array_distinct({runs}))"


def _text_grams(text: str, sizes: list[int], prefix: bool) -> str:
    """The grams of a text of the sizes that occur in the index."""
    last = {n: "1" if prefix else f"length({text}) - {n - 1}" for n in sizes}
    runs = ", ".join(
        f"IF(length({text}) >= {n}, transform(sequence(1, {last[n]}), at -> substring({text}, at, {n})),"
        " CAST(array() AS array<string>))"
        for n in sizes
    )
    return f"array_distinct(flatten(array({runs})))"


def gram_index(patterns: DataFrame, *, prefix: bool = False) -> DataFrame:
    """``pattern, owner`` -> ``gram, pattern, owner``: each pattern once, under its rarest gram.

    Of equal patterns the smallest owner counts; empty ones are left out.
    """
    kept = patterns.filter("pattern <> '' AND owner IS NOT NULL").groupBy("pattern").agg(F.min("owner").alias("owner"))
    if prefix:
        return kept.selectExpr(f"left(pattern, {GRAM}) AS gram", "pattern", "owner")
    grams = kept.selectExpr("pattern", "owner", f"explode({_grams('pattern')}) AS gram")
    times = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = F.min_by("gram", F.struct("n", "gram")).alias("gram")
    return grams.join(times, "gram").groupBy("pattern", "owner").agg(rarest).select("gram", "pattern", "owner")


def owners_of_texts(
    texts: DataFrame, patterns: DataFrame, *, prefix: bool = False, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """From distinct ``_text``: ``_text, _owner`` of those in which a pattern is found.

    A small job looks at the patterns first: the sizes of their grams, and their bytes.
    """
    index = gram_index(patterns, prefix=prefix)
    size = F.length("gram") + F.length("pattern") + F.length("owner") + ROW_BYTES
    seen = index.groupBy(F.length("gram").alias("n")).agg(F.sum(size).alias("size")).collect()
    cut = texts.selectExpr("_text", f"explode({_text_grams('_text', sorted(r.n for r in seen) or [GRAM], prefix)}) AS gram")
    small = sum(r.size for r in seen) <= broadcast_bytes
    test = "startswith(_text, pattern)" if prefix else "contains(_text, pattern)"
    met = cut.join(F.broadcast(index) if small else index, "gram").filter(test)
    return met.groupBy("_text").agg(F.min("owner").alias("_owner"))


def join_pattern_owner(df: DataFrame, text: str, patterns: DataFrame, out: str, **options) -> DataFrame:
    """Add ``out``: the smallest owner of ``patterns`` (pattern, owner) found in column ``text``, null if none is."""
    texts = df.select(F.col(text).alias("_text")).filter("_text IS NOT NULL").distinct()
    found = owners_of_texts(texts, patterns, **options).toDF("_found_text", "_found_owner")
    # rows without a text match nothing, but may be most rows: they spread over all tasks
    nowhere = F.concat(F.lit("\x01"), (F.monotonically_increasing_id() % 1024).cast("string"))
    return (
        df.withColumn("_found_key", F.coalesce(F.col(text), nowhere))
        .join(found, F.col("_found_key") == F.col("_found_text"), "left")
        .select(*df.columns, F.col("_found_owner").alias(out))
    )
