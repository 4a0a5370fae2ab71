"""Minimax contiguous sharding: the smallest capacity for which a greedy cut needs few enough shards.

Groups (here: rows of one text) are never split. In the order of their keys they
have running totals; a capacity is feasible if starting each shard where the last
one ended and going as far as the capacity allows reaches the end in time. The
smallest feasible capacity is searched between the mean (or the largest group)
and the mean plus the largest group, where a greedy cut always succeeds. Each
round tries a few dozen capacities at once, so a round of ``shards`` short
aggregates over the table of running totals divides the interval by that number;
the first round tries doubling distances, as the answer is mostly near the mean.

The driver holds one number per shard and capacity tried. Rows are ordered by
(group, id) over range partitions, so a group with a third of all rows is spread
over tasks; slots come from the partitions' row counts.

Defined cases: a null text counts as empty (size 1, checksum 0). Null ids come
first in their group; repeated rows get slots of their own. With fewer groups
than shards some shards stay empty. An empty table gives an empty result. Only
the id and text columns are read. DataFrame functions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import ordered, part_starts, stored

SHARDS = 16
#: capacities tried at once
TRIES = 31


def running_totals(rows: DataFrame) -> DataFrame:
    """From ``ordered`` rows (group, size): per group where it starts and ends in the total."""
    pieces = rows.groupBy("_part", "group").agg(F.sum("size").alias("size"))
    starts = part_starts(pieces.groupBy("_part").agg(F.sum("size").alias("size")), "size")
    here = Window.partitionBy("_part").orderBy("group")
    pieces = pieces.withColumn("end", F.sum("size").over(here)).join(starts, "_part")
    end = F.col("end") + F.col("size_before")
    groups = pieces.groupBy("group").agg(
        F.min(end - F.col("size")).alias("start"), F.max(end).alias("end")
    )
    # in order, so that a search for a place reads few row groups
    return stored(groups.repartitionByRange("end").sortWithinPartitions("end"))


def greedy_ends(totals: DataFrame, capacities: list[int], shards: int) -> list[list[int]]:
    """For each capacity, where a greedy cut ends each of at most ``shards`` shards."""
    ends: list[list[int]] = [[] for _ in capacities]
    at = [0] * len(capacities)
    for _ in range(shards):
        reach = [low + capacity for low, capacity in zip(at, capacities, strict=True)]
        near = totals.where(F.col("end").between(min(at) + 1, max(reach)))
        row = near.agg(
            *(F.max(F.when(F.col("end") <= most, F.col("end"))).alias(f"c{k}") for k, most in enumerate(reach))
        ).first()
        at = [low if end is None else max(low, end) for low, end in zip(at, row, strict=True)]
        for cut, end in zip(ends, at, strict=True):
            cut.append(end)
    return ends


def minimax_cuts(totals: DataFrame, shards: int = SHARDS) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the ends of its greedy shards."""
    total, widest = totals.agg(F.max("end"), F.max(F.col("end") - F.col("start"))).first()
    if total is None:
        return 0, []
    mean = -(-total // shards)
    low, high = max(mean, widest), mean + widest
    best, first = None, True
    while low < high or best is None:
        if first:
            tries = sorted({min(low + (1 << k) - 1, high) for k in range(TRIES)})
        else:
            steps = min(TRIES, high - low + 1)
            tries = sorted({low + (high - low) * k // max(1, steps - 1) for k in range(steps)})
        first = False
        for capacity, ends in zip(tries, greedy_ends(totals, tries, shards), strict=True):
            if ends[-1] == total:
                high, best = capacity, ends
                break
            low = capacity + 1
    return high, best


def shard_of(group: Column, last_groups: list[str]) -> Column:
    """The number of shards whose last group comes before ``group``."""
    return sum(((group > last).cast("int") for last in last_groups), F.lit(0))


def contiguous_shards(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = ordered(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("group"),
        ),
        "group",
        "doc_id",
    )
    totals = running_totals(rows)
    _, ends = minimax_cuts(totals, shards)
    # at most one row per shard
    last = sorted(r["group"] for r in totals.where(F.col("end").isin(ends[:-1])).select("group").collect())
    starts = part_starts(rows.groupBy("_part").agg(F.count("*").alias("_n")), "_n")
    placed = (
        rows.join(starts, "_part")
        .withColumn("shard", shard_of(F.col("group"), last))
        .withColumn("_row", F.col("_n_before") + F.col("_pos"))
    )
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(firsts, "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot")
    )
