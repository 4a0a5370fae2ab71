"""Hard negatives by an inverted multi-index that certifies its answers.

Vectors are cut into two halves, and each half is put to the nearest word of a codebook; a
pair of words is a cell. With the largest distance r of any member's half to its word, no
half x of word c can score more with an anchor's half a than a.c + |a| r. The sum of both
halves' bounds bounds every row of a cell. A multi-sequence heap walks the cells of an anchor
from the highest bound down, without listing them all first:

1. Probe: the cells that come first, until they hold ``PROBE`` rows. The anchor's k-th best
   positive so far is a threshold.
2. The walk goes on while bounds reach the threshold, so that the positives are certain.
3. Each positive opens a window of scores. The walk starts again, now for rows of other
   labels: a probe, whose k-th best per window (else the window's lower end) is a threshold,
4. and the rest of the cells whose bounds reach the lowest threshold of a window.

Anchors ask for cells; a cell's rows, in slices, meet the anchors that asked, in parts. So
both sides of a group are bounded (``SLICE`` rows, about ``PART`` anchors), however many
copies a cell or an anchor's neighbourhood holds, and their scores are one matrix product.
Anchors are a stated query set that meets all rows in blocks; where bounds are loose, as for
vectors of one length without clusters, a certified answer needs nearly all cells.

Codebooks are fitted on at most about ``SAMPLE`` rows chosen by a hash; every row is indexed,
and the radii cover every row, so answers are exact and do not depend on the sample. What
goes to every task is bounded: codebooks, radii, and one count per cell (``WORDS`` squared).

Defined cases: rows with a null label, id or vector, or a null or non-finite component, take no part.
Components become floor(scale * x), at most 2^31 - 1 in size; scores are exact below 2^53.
Shorter vectors count as followed by zeros. Rows that repeat id, label and vector are one row;
rows that share only an id are rows of their own. Equal scores order by id. A positive with a
negative score has an empty window. Empty tables give empty results; only the three named
columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import ship, stored

SAMPLE, WORDS, LEAST_WORDS, CELL_ROWS, ROUNDS = 20_000, 256, 6, 1000, 8
SLICE, PART = 4096, 1024
PROBE = 2000
TOP = 5
#: lower end of a window, in parts of its positive's score
LOW, HIGH = 80, 100

INDEX = "no bigint, id bigint, label bigint, vec binary, cell int, d1 double, d2 double"


@dataclass(frozen=True)
class Codebooks:
    """Words of both halves, how far members lie from them, and the rows of each cell."""

    dim: int
    words: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    rows: np.ndarray

    @property
    def half(self) -> int:
        return (self.dim + 1) // 2


def quantised(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> tuple[DataFrame, int]:
    """Distinct usable rows (no, id, label, vec as little-endian 32-bit integers), and their dimension."""
    ship(vectors.sparkSession)
    usable = vectors.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(label_col).cast("bigint").alias("label"),
        F.col(vec_col).cast("array<double>").alias("v"),
    ).where(
        "id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL"
        " AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    )
    dim = usable.agg(F.max(F.size("v"))).first()[0] or 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, n = batch.column(2), batch.num_rows
            values = column.flatten().to_numpy(zero_copy_only=False)
            whole = np.clip(np.floor(values * scale), -(2**31 - 1), 2**31 - 1).astype("<i4")
            sizes = np.asarray(column.value_lengths())
            table = np.zeros((n, dim), "<i4")
            table[np.arange(dim) < sizes[:, None]] = whole
            packed = pa.array([row.tobytes() for row in table], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["id", "label", "vec"])

    packed = usable.mapInArrow(pack, "id bigint, label bigint, vec binary").distinct()
    return stored(packed.withColumn("no", F.monotonically_increasing_id())), dim


def matrix(column, dim: int, kind: str = "f8") -> np.ndarray:
    """A column of packed vectors as a matrix."""
    packed = b"".join(column.to_pylist())
    return np.frombuffer(packed, "<i4").reshape(len(column), dim).astype(kind)


def _nearest(points: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest word of each point, the first of equals, and its distance."""
    gaps = (words**2).sum(axis=1) - 2 * points @ words.T
    chosen = gaps.argmin(axis=1)
    return chosen, np.sqrt(((points - words[chosen]) ** 2).sum(axis=1))


def codebook(points: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Up to n words by Lloyd's rounds from n different points."""
    points = np.unique(points, axis=0)
    start = np.random.default_rng(seed).permutation(len(points))[:n]
    words = points[np.sort(start)]
    for _ in range(ROUNDS):
        chosen, _ = _nearest(points, words)
        counts = np.bincount(chosen, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, chosen, points)
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
    return words


def build_index(rows: DataFrame, dim: int, sample: int = SAMPLE, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, Codebooks | None]:
    """Every row with its cell, stored, and the codebooks; none for an empty table."""
    n = rows.count()
    if not n:
        return rows, None
    half = (dim + 1) // 2
    part = rows if n <= sample else rows.where(f"pmod(xxhash64(no), 1000003) < {max(1, 1_000_003 * sample // n)}")
    # the hash keeps about `sample` rows; the limit only bounds what the driver can be sent
    found = part.select("vec").limit(2 * sample).toArrow().column(0)
    points = matrix(found, dim)
    size = int(np.clip(round((n / cell_rows) ** 0.5), LEAST_WORDS, WORDS))
    words = (codebook(points[:, :half], size, 1), codebook(points[:, half:], size, 2))
    width = len(words[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column(3), dim)
            first, d1 = _nearest(points[:, :half], words[0])
            second, d2 = _nearest(points[:, half:], words[1])
            cells = pa.array((first * width + second).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(4)), cells, pa.array(d1), pa.array(d2)],
                names=[c.split()[0] for c in INDEX.split(", ")],
            )

    index = stored(rows.select("no", "id", "label", "vec").mapInArrow(place, INDEX))
    # at most WORDS squared rows
    seen = index.groupBy("cell").agg(F.count("*"), F.max("d1"), F.max("d2")).collect()
    radii = (np.zeros(len(words[0])), np.zeros(width))
    counts = np.zeros(len(words[0]) * width, np.int64)
    for cell, count, d1, d2 in seen:
        counts[cell] = count
        radii[0][cell // width] = max(radii[0][cell // width], d1)
        radii[1][cell % width] = max(radii[1][cell % width], d2)
    return index, Codebooks(dim, words, radii, counts)


def walk(books: Codebooks, anchor: np.ndarray) -> Iterator[tuple[float, int]]:
    """(bound, cell) of an anchor, from the highest bound down: a heap over two sorted sequences."""
    halves = (anchor[: books.half], anchor[books.half :])
    bounds = []
    for part, words, radii in zip(halves, books.words, books.radii, strict=True):
        best = words @ part + np.sqrt(part @ part) * radii
        # room for rounding
        bounds.append(best + 1e-9 * (np.abs(words) @ np.abs(part) + 1))
    orders = [np.argsort(-b, kind="stable") for b in bounds]
    first, second = (b[o].tolist() for b, o in zip(bounds, orders, strict=True))
    order0, order1 = (o.tolist() for o in orders)
    width = len(second)
    heap = [(-(first[0] + second[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, order0[i] * width + order1[j]
        # (i, j) comes from (i, j - 1), or from (i - 1, 0) at the start of a sequence
        if j + 1 < width:
            heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(first):
            heapq.heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))


def asked_cells(books: Codebooks, anchor: np.ndarray, probe: int, floor: float, rest: bool) -> list[int]:
    """The cells of the probe, or of the rest of the walk: bounds reach ``floor`` in both."""
    cells, seen = [], 0
    for bound, cell in walk(books, anchor):
        if bound < floor:
            break
        if not books.rows[cell]:
            continue
        if rest == (seen >= probe):
            cells.append(cell)
        elif seen >= probe:
            break
        seen += int(books.rows[cell])
    return cells


def visit(anchors: DataFrame, index: DataFrame, books: Codebooks, rest: bool, windows: bool, probe: int, top: int) -> DataFrame:
    """(no, win, score, other, other_no): each anchor's best rows per window and group of rows, stored.

    ``anchors`` has no, label, vec, floor (bounds below it end the walk; null: none),
    and for windows lows and highs: the ranges of scores. Without windows the rows
    asked for have the anchor's own label, else another one.
    """
    dim = books.dim
    slices = np.maximum(1, -(-books.rows // SLICE))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column(2), dim)
            floors = batch.column(3).to_pylist()
            for k, point in enumerate(points):
                floor = -np.inf if floors[k] is None else floors[k]
                cells = asked_cells(books, point, probe, floor, rest)
                deal = [(c, s) for c in cells for s in range(slices[c])]
                one = batch.slice(k, 1).take(pa.array([0] * len(deal), pa.int64()))
                cell, piece = (pa.array([d[e] for d in deal], pa.int32()) for e in (0, 1))
                yield pa.RecordBatch.from_arrays([*one.columns, cell, piece], ASKED)

    ASKED = ["no", "label", "vec", "floor", "lows", "highs", "cell", "piece"]
    shape = "no bigint, label bigint, vec binary, floor double, lows array<bigint>, highs array<bigint>, cell int, piece int"
    if not windows:
        anchors = anchors.selectExpr("*", "CAST(NULL AS ARRAY<BIGINT>) AS lows", "CAST(NULL AS ARRAY<BIGINT>) AS highs")
    asked = stored(anchors.select(*ASKED[:6]).mapInArrow(ask, shape))
    # one row per cell: at most WORDS squared
    parts = asked.where("piece = 0").groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    parts = F.broadcast(stored(parts))
    asked = asked.join(parts, "cell").withColumn("part", F.expr("CAST(pmod(xxhash64(no), parts) AS INT)"))
    pieces = F.expr(f"greatest(1, ceil(in_cell / {SLICE}))")
    sizes = index.sparkSession.createDataFrame(
        [(int(c), int(books.rows[c])) for c in np.flatnonzero(books.rows)], "cell int, in_cell bigint"
    )
    held = index.join(F.broadcast(sizes), "cell").join(parts, "cell")
    held = held.select(
        "no", "id", "label", "vec", "cell",
        F.expr("pmod(xxhash64(no, 3), 1000003)").alias("mix"), pieces.alias("pieces"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    ).withColumn("piece", F.expr("CAST(mix % pieces AS INT)")).drop("mix", "pieces")
    keys = ["cell", "piece", "part"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return best_rows([])
        right = right.sort_by([("id", "ascending"), ("no", "ascending")])
        return best_of_block(left, right, dim, windows, top)

    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(score, FOUND)
    return stored(best(found, top))


FOUND = "no bigint, win int, score bigint, other bigint, other_no bigint"


def best_rows(parts: list[tuple[np.ndarray, ...]]) -> pa.Table:
    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    columns = [np.concatenate([p[k] for p in parts]) if parts else [] for k in range(5)]
    return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)


def best_of_block(left: pa.Table, right: pa.Table, dim: int, windows: bool, top: int) -> pa.Table:
    """The best ``top`` rows of a block for each anchor, or each window of one."""
    a, b = (matrix(t["vec"].combine_chunks(), dim) for t in (left, right))
    largest = (np.abs(a).max(initial=0) + 1) * (np.abs(b).max(initial=0) + 1) * max(dim, 1)
    if largest < 2**24:
        # sums of integers this small are exact in single precision
        a, b = a.astype("f4"), b.astype("f4")
    scores = np.clip((a @ b.T).astype("f8"), -(2.0**62), 2.0**62).astype(np.int64)
    own, others = (t["no"].to_numpy() for t in (left, right))
    ids = right["id"].to_numpy()
    same = left["label"].to_numpy()[:, None] == right["label"].to_numpy()[None, :]
    found = []

    def take(usable: np.ndarray, win: int) -> None:
        rows, columns = np.nonzero(usable)
        got = scores[rows, columns]
        order = np.lexsort((columns, -got, rows))
        rows, columns, got = rows[order], columns[order], got[order]
        starts = np.searchsorted(rows, rows)
        keep = np.arange(len(rows)) - starts < top
        rows, columns, got = rows[keep], columns[keep], got[keep]
        found.append((own[rows], np.full(len(rows), win, np.int32), got, ids[columns], others[columns]))

    if not windows:
        floors = left["floor"].to_numpy(zero_copy_only=False).astype("f8")
        above = scores >= np.where(np.isnan(floors), -np.inf, floors)[:, None]
        take(same & above & (own[:, None] != others[None, :]), 0)
    else:
        lows, highs = left["lows"].to_pylist(), left["highs"].to_pylist()
        for win in range(max(map(len, lows))):
            low = np.array([x[win] if win < len(x) else 1 for x in lows], np.int64)[:, None]
            high = np.array([x[win] if win < len(x) else 0 for x in highs], np.int64)[:, None]
            take(~same & (scores >= low) & (scores <= high), win)
    return best_rows(found)


def best(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows per anchor and window: scores down, ids up."""
    order = Window.partitionBy("no", "win").orderBy(F.desc("score"), "other", "other_no")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {top}")


def hard_negatives(
    vectors: DataFrame,
    anchors: str,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    top: int = TOP,
    probe: int = PROBE,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """For each row that meets the SQL condition ``anchors`` on ``id`` and ``label``, and each of its first
    ``top`` rows of the same label, the first ``top`` rows of other labels in its window: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score."""
    rows, dim = quantised(vectors, id_col, vec_col, label_col, scale)
    index, books = build_index(rows, dim, cell_rows=cell_rows)
    if books is None:
        return vectors.sparkSession.createDataFrame(
            [],
            "anchor_id bigint, positive_id bigint, rank int, negative_id bigint,"
            " positive_score bigint, negative_score bigint",
        )
    queries = stored(index.where(anchors).select("no", "id", "label", "vec"))

    def searched(asking: DataFrame, windows: bool, floor_of) -> DataFrame:
        first = visit(asking, index, books, False, windows, probe, top)
        again = floor_of(asking, first)
        more = visit(again, index, books, True, windows, probe, top)
        return stored(best(first.drop("rank").union(more.drop("rank")), top))

    def kth(asking: DataFrame, first: DataFrame) -> DataFrame:
        last = first.groupBy("no").agg(F.min(F.when(F.col("rank") == top, F.col("score"))).alias("kth"))
        return asking.join(last, "no", "left").select("no", "label", "vec", F.col("kth").cast("double").alias("floor"))

    no_floor = F.lit(None).cast("double").alias("floor")
    positives = searched(queries.select("no", "label", "vec", no_floor), False, kth)

    # 80 p <= 100 n <= 100 p; none for a negative p
    ends = positives.where("score >= 0").withColumn("low", F.expr(f"ceil(CAST(score AS DECIMAL(38, 0)) * {LOW} / {HIGH})"))
    ends = ends.groupBy("no").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("low").cast("bigint").alias("low"), "score", "other"))).alias("w")
    )
    ends = ends.selectExpr("no", "w.low AS lows", "w.score AS highs", "w.other AS positives")
    asking = stored(queries.join(ends, "no").withColumn("floor", F.array_min("lows").cast("double")))

    def lowest(asking: DataFrame, first: DataFrame) -> DataFrame:
        # a window that is full already needs nothing below its last score
        full = first.where(f"rank = {top}").groupBy("no").agg(F.map_from_entries(F.collect_list(F.struct("win", "score"))).alias("full"))
        lows = F.expr("transform(lows, (x, k) -> greatest(x, coalesce(full[k], x)))")
        found = asking.join(full, "no", "left").withColumn("lows", lows)
        return found.withColumn("floor", F.array_min("lows").cast("double"))

    negatives = searched(asking, True, lowest)
    named = negatives.join(asking.select("no", F.col("id").alias("anchor_id"), "positives", "highs"), "no")
    return named.select(
        "anchor_id",
        F.expr("positives[win]").alias("positive_id"),
        "rank",
        F.col("other").alias("negative_id"),
        F.expr("highs[win]").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
