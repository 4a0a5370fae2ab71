"""Pack documents into sequences of a fixed length by minimum bin slack.

For one sequence, a bitset holds which sums the lengths at hand can reach; the
fullest sum that fits, with the longest piece in it, is taken and its pieces are
removed. Only the number of pieces of each length matters, and there are at most
``capacity`` lengths, so the plan is made from that histogram whatever the number
of documents: a combination is used as often as its pieces last, which uses up a
length each time. Pieces of a length are then numbered, and number and plan give
each its sequence and its place.

Numbering sorts by length and id over range partitions, so a length that a third
of all rows share is spread over tasks. The histogram and the plan have a bound
that does not depend on the data (``capacity`` lengths; each step of the plan
ends a length or more).

Defined cases: a null text counts as empty, its document is the end id alone.
Null ids sort first; repeated rows are pieces of their own. Empty tables give
empty results. Documents of any length are encoded whole and then cut; the first
piece of a cut document takes the rest, so all others fill a sequence. Only the
id and text columns are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import ordered, ship, stored
from wardline.llm.tokens import encoder

CAPACITY = 2048
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The pieces of each document, whole or cut: doc_id, piece, start, length, ids_crc32."""
    ship(docs.sparkSession)
    names = [c.split()[0] for c in PIECES.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode, struct.pack("<I", end_id)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                low, high = 0, n % capacity or min(n, capacity)
                for piece in range(-(-n // capacity)):
                    rows.append((doc_id, piece, low, high - low, zlib.crc32(ids[4 * low : 4 * high])))
                    low, high = high, high + capacity
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), kind) for c, kind in zip(columns, types, strict=True)], names=names
            )

    narrow = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text")
    return narrow.mapInArrow(cut, PIECES)


def fullest(counts: np.ndarray, room: int) -> dict[int, int]:
    """{length: how many} of a subset of the lengths at hand with the largest sum up to ``room``.

    ``counts[n]`` is the number of pieces of length n. ``reach[k]`` has a bit for
    each sum of the first k bundles; a length with many pieces is bundled in
    powers of two. Walking back through the bitsets finds the subset.
    """
    bundles: list[tuple[int, int]] = []
    reach, limit = [1], (1 << (room + 1)) - 1
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, many = min(int(counts[length]), room // length), 1
        while left:
            many = min(many, left)
            bundles.append((length, many))
            reach.append(reach[-1] | (reach[-1] << (length * many) & limit))
            left, many = left - many, 2 * many
        if reach[-1] >> room & 1:
            break
    total, taken = reach[-1].bit_length() - 1, {}
    for k in range(len(bundles), 0, -1):
        if not reach[k - 1] >> total & 1:
            length, many = bundles[k - 1]
            taken[length] = taken.get(length, 0) + many
            total -= length * many
    return taken


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    """(length, first number, after last number, pieces a sequence, first sequence, place).

    Pieces of a length numbered from the first to before the last go, ``pieces a
    sequence`` at a time, to sequences from ``first sequence`` on, at ``place``.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        counts[length] = count
    used, plan, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            taken = fullest(counts, capacity - longest)
            counts[longest] += 1
            taken[longest] = taken.get(longest, 0) + 1
            times = min(int(counts[length]) // many for length, many in taken.items())
            place = 0
            for length, many in sorted(taken.items(), reverse=True):
                first = int(used[length])
                plan.append((length, first, first + many * times, many, sequence, place))
                used[length] += many * times
                counts[length] -= many * times
                place += many * length
            sequence += times
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (stored, with doc_id, piece, length) with sequence_id and offset."""
    spark = pieces.sparkSession
    ship(spark)
    # one row per length: bounded by the capacity
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = sorted(packing_plan(histogram, capacity))
    table = np.array(plan, np.int64).reshape(-1, 6)
    places = spark.sparkContext.broadcast(table)
    rows = ordered(pieces, "length", "doc_id", "piece")
    # the number of a piece among those of its length: those in earlier parts, then its place here
    here = rows.groupBy("_part", "length").agg(F.count("*").alias("_n"), F.min("_pos").alias("_low"))
    before = "OVER (PARTITION BY length ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    starts = here.selectExpr(
        "_part", "length AS _length", "_low", f"coalesce(sum(_n) {before}, 0) AS _before"
    )
    joined = rows.join(
        starts, (rows["_part"] == starts["_part"]) & (rows["length"] == starts["_length"])
    )
    ranked = joined.select(
        *(rows[c] for c in pieces.columns), (F.col("_before") + F.col("_pos") - F.col("_low")).alias("_rank")
    )
    names, length_at = pieces.columns, pieces.columns.index("length")
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id bigint, offset bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = places.value
        # rows of the plan ascend in (length, first number)
        scale = int(plan[:, 2].max()) + 1 if len(plan) else 1
        keys = plan[:, 0] * scale + plan[:, 1]
        for batch in batches:
            length = batch.column(length_at).to_numpy().astype(np.int64)
            rank = batch.column(len(names)).to_numpy().astype(np.int64)
            row = plan[np.searchsorted(keys, length * scale + rank, side="right") - 1]
            turn, slot = np.divmod(rank - row[:, 1], np.maximum(row[:, 3], 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(len(names))]
                + [pa.array(row[:, 4] + turn), pa.array(row[:, 5] + slot * length)],
                names=[*names, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, schema)


def packed(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Encode, cut and pack ``docs``: the pieces with sequence_id and offset."""
    capacity = options.get("capacity", CAPACITY)
    return pack(stored(token_pieces(docs, tokenizer, **options)), capacity)
