"""Mix sources to target weights by repeating documents.

Words are summed per source, targets follow from the weights, and a source's
repetition rate is its target over its words. A document is taken floor(rate)
times, and once more if a hash of its id, read as a number in [0, 1), is below
the rest. The hash depends on nothing else, so reruns and retries agree.

Targets: sources in code point order, nulls last, get weights from a repeating
cycle and share ``share`` times all words. No target may pass ``cap`` times its
source's words; what is over goes to the others by weight, until none is above.
That is ``least(cap, level * weight)`` for one level, which a few sums over the
table of sources find. Documents are never shuffled; the table of sources is
joined, broadcast only if Spark finds it below its size limit.

Defined cases: a null text has no words; a null source is a source of its own; a
source without words has target 0 and its documents are taken at rate 0. Rows
with a null id draw by their text. Texts of any length are counted whole, where they lie.
Repeated rows draw alike. Empty tables give empty results. ``repeated`` keeps all columns and uses names with ``_mix_`` inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import WORD, numbered, stored

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP, SEED = 1.5, 2.0, "mix"


def word_count(text_col: str) -> Column:
    return F.expr(f"CAST(regexp_count(coalesce(`{text_col}`, ''), r'{WORD}') AS BIGINT)")


def draw(id_col: str, text_col: str, seed: str) -> Column:
    """A number in [0, 1) from the id, or from the text where the id is null."""
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(2**52)


def source_targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
) -> DataFrame:
    """From rows (source, size): one row per source with source_size and target."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(sources, F.col("source").isNull(), F.col("source"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    sources = stored(
        ranked.select(
            "source",
            "source_size",
            F.get(cycle, F.col("_row") % len(weights)).alias("weight"),
            (cap * F.col("source_size")).alias("most"),
        )
    )
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted = share * (total or 0)
    level = wanted / weight if weight else 0.0
    capped = -1
    while True:
        # sources that the level fills up, and what is left for the others
        full = F.expr(f"most <= {level!r}D * weight")
        n, held, rest = sources.agg(
            F.count(F.when(full, 1)),
            F.sum(F.when(full, F.col("most"))),
            F.sum(F.when(~full, F.col("weight"))),
        ).first()
        if n == capped or not rest:
            break
        capped, level = n, (wanted - (held or 0.0)) / rest
    return sources.select(
        "source", "source_size", F.expr(f"least(most, {level!r}D * weight)").alias("target")
    )


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    sizes = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(text_col).alias("size"),
            draw(id_col, text_col, seed).alias("draw"),
        )
    )
    targets = source_targets(sizes, weights, share, cap).withColumnRenamed("source", "_source")
    joined = sizes.join(targets, sizes["source"].eqNullSafe(targets["_source"])).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor("rate") + (F.col("draw") < F.col("rate") - F.floor("rate")).cast("bigint")
    return (
        joined.withColumn("rate", rate)
        .withColumn("copies", copies)
        .withColumn("taken", F.col("size") * F.col("copies"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", "taken")
    )


def repeated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The mix itself: all columns of ``docs``, each document as often as it is taken."""
    seed = options.pop("seed", SEED)
    sizes = docs.select(F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    rates = source_targets(stored(sizes), **options).select(
        F.col("source").alias("_mix_source"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
        .otherwise(0.0)
        .alias("_mix_rate"),
    )
    rate = rates["_mix_rate"]
    copies = (F.floor(rate) + (draw(id_col, text_col, seed) < rate - F.floor(rate)).cast("bigint")).cast("int")
    joined = docs.join(rates, docs[source_col].eqNullSafe(rates["_mix_source"]))
    copy = F.explode(F.array_repeat(F.lit(True), copies)).alias("_mix_copy")
    return joined.select(*(docs[c] for c in docs.columns), copy).drop("_mix_copy")
