"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Each document becomes some twenty statistics of its whole text. They are
standardised, and ``FEATURES`` random cosines of them approximate a Gaussian
kernel. The weights solve the ridge normal equations; each task adds up its own
part of these and the parts are summed in two steps, so the driver gets one
matrix of fixed size. A part of the training rows, kept out of the sums, shows
how often label 1 is right at each raw score; pool-adjacent-violators over at
most ``BINS`` bins makes that monotone, and a line through the pools' centres
turns raw scores into scores from 0 to 1.

Label, language, source and id are no inputs of a score. All labelled training
rows are used; there is no sample.

Defined cases: a null text counts as empty; an empty text has all statistics 0
and is scored like any other. A text of any length is measured whole, by itself; further columns are
neither read nor changed. Rows with a null id are scored, never learnt from;
labels that are null are not learnt from. Labels of an id that repeats all count.
Without labels of both kinds every score is the share of label 1, or 0.5 if there
is none. Repeated rows get equal scores. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import ship, stored

FEATURES, RIDGE, WIDTH, SEED, BINS = 384, 1e-3, 3.0, 7, 512
#: of ten parts of the training rows, those kept for calibration
CALIBRATION_PARTS = 2
STATISTICS = 22


def statistics(text: str) -> list[float]:
    """What a text looks like, as numbers of similar size."""
    data = text.encode()
    words = data.split()
    if not words:
        return [0.0] * STATISTICS
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n_chars, n_words, n_bytes = len(text), len(words), len(data)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    wide = int(counts[128:].sum())
    letters = max(1, upper + lower + wide / 2)
    marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    common = counts[[44, 46]].sum()  # comma, full stop
    lengths = np.fromiter(map(len, words), np.int64, n_words)
    distinct = len(set(words))
    again = sum(map(operator.eq, words, words[1:]))
    again_2 = sum(map(operator.eq, words, words[2:]))
    tails = [word[-1] for word in words]
    lines = data.split(b"\n")
    shares = counts[counts > 0] / n_bytes
    half = len(set(words[: n_words // 2])) / max(1, n_words // 2)
    return [
        math.log1p(n_chars),
        math.log1p(n_words),
        math.log1p(len(lines)),
        float(lengths.mean()),
        float(lengths.std()),
        math.log1p(int(lengths.max())),
        10 * upper / letters,
        10 * (marks - common) / n_chars,
        10 * common / n_chars,
        10 * digits / n_chars,
        wide / n_bytes,
        distinct / n_words,
        # share of distinct words for a text of this length
        math.log1p(distinct) / math.log1p(n_words) if n_words > 1 else 1.0,
        half,
        10 * again / n_words,
        10 * again_2 / n_words,
        float(-(shares * np.log2(shares)).sum()),
        len(set(lines)) / len(lines),
        math.log1p(n_words / len(lines)),
        10 * sum(tail in b"!?#$%&*" for tail in tails) / n_words,
        10 * float((lengths == 1).mean()),
        10 * sum(word.isupper() for word in words) / n_words,
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats): one row per document, whole texts, no shuffle."""
    ship(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "stats"]
            )

    narrow = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text")
    return narrow.mapInArrow(measure, "doc_id bigint, stats array<double>")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learnt from; null ids are held out too."""
    third = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3
    return F.coalesce(third == 1, F.lit(True))


class Model:
    """Everything that turns statistics into scores; a few hundred kB whatever the data."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        random = np.random.default_rng(SEED)
        self.turns = random.normal(size=(len(mean), FEATURES)) / WIDTH
        self.shifts = random.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1 + len(mean))
        self.raw, self.share = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random cosines, the statistics themselves, and 1."""
        z = np.clip((stats - self.mean) / self.spread, -5, 5)
        waves = np.sqrt(2 / FEATURES) * np.cos(z @ self.turns + self.shifts)
        return np.hstack([waves, z / 10, np.ones((len(z), 1))])

    def raw_scores(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw_scores(stats), self.raw, self.share)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), STATISTICS)


def normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of x x' and x y over (stats, label), added up by task and then in groups of tasks."""
    size = FEATURES + 1 + STATISTICS
    groups = max(1, math.isqrt(rows.rdd.getNumPartitions()))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total = np.zeros((size, size + 1))
        for batch in batches:
            x = model.features(_matrix(batch["stats"]))
            total += x.T @ np.hstack([x, batch["label"].to_numpy(np.float64)[:, None]])
        group = TaskContext.get().partitionId() % groups
        yield pd.DataFrame({"part": [group], "sums": [total.tobytes()]})

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(sums) for sums in part["sums"])
        return pd.DataFrame({"part": part["part"][:1], "sums": [total.tobytes()]})

    schema = "part int, sums binary"
    sums = rows.select("stats", "label").mapInPandas(add, schema)
    total = np.zeros((size, size + 1))
    for row in sums.groupBy("part").applyInPandas(merge, schema).toLocalIterator():
        total += np.frombuffer(row["sums"]).reshape(size, size + 1)
    return total[:, :-1], total[:, -1]


def isotonic(raw: np.ndarray, ones: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order of raw score: pools' centres and shares of 1."""
    pools: list[list[float]] = []
    for centre, one, n in zip(raw, ones, count, strict=True):
        pools.append([centre * n, float(one), float(n)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    at = np.array([pool[0] / pool[2] for pool in pools])
    share = np.array([pool[1] / pool[2] for pool in pools])
    # beyond the outer centres, and in them, scores still rise a little with the raw score
    ends = np.array([min(raw.min(), at[0]) - 1.0]), np.array([max(raw.max(), at[-1]) + 1.0])
    at = np.concatenate([ends[0], at, ends[1]])
    share = np.concatenate([[share[0] * 0.5], share, [1 - (1 - share[-1]) * 0.5]])
    return at, share


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """Learn from the rows of ``stats`` (doc_id, stats) that ``labels`` names and are not held out."""
    ship(stats.sparkSession)
    wanted = labels.select("doc_id", F.col(label_col).cast("double").alias("label"))
    wanted = wanted.where(F.col("label").isNotNull() & ~held_out())
    part = F.crc32(F.concat(F.lit("calibration:"), F.col("doc_id").cast("string")).cast("binary")) % 10
    rows = stored(stats.join(wanted, "doc_id").select("stats", "label", part.alias("part")))
    sums = [f(F.col("stats")[k]).alias(f"{f.__name__}_{k}") for k in range(STATISTICS) for f in (F.avg, F.stddev_pop)]
    n, share, *moments = rows.agg(F.count("*"), F.avg("label"), *sums).first()
    if not n or share in (0.0, 1.0):
        model = Model(np.zeros(STATISTICS), np.ones(STATISTICS))
        model.share = np.array([0.5 if not n else share])
        return model
    moments = np.array(moments, np.float64).reshape(STATISTICS, 2)
    model = Model(moments[:, 0], moments[:, 1])
    square, product = normal_equations(rows.where(f"part >= {CALIBRATION_PARTS}"), model)
    ridge = RIDGE * max(1.0, square[-1, -1]) * np.eye(len(square))
    ridge[-1, -1] = 1e-9
    model.weights = np.linalg.solve(square + ridge, product)
    bins = _bins(rows.where(f"part < {CALIBRATION_PARTS}"), model)
    if len(bins):
        model.raw, model.share = isotonic(*bins.T)
    return model


def _bins(rows: DataFrame, model: Model) -> np.ndarray:
    """(raw score, sum of labels, rows) in at most ``BINS`` bins of equal width."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = model.raw_scores(_matrix(batch["stats"]))
            at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            yield pd.DataFrame({"bin": at, "raw": raw, "label": batch["label"]})

    scored = rows.mapInPandas(score, "bin int, raw double, label double")
    found = scored.groupBy("bin").agg(F.avg("raw"), F.sum("label"), F.count("*")).collect()
    return np.array(sorted(tuple(row)[1:] for row in found), np.float64).reshape(-1, 3)


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """``stats`` with a score."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = model.scores(_matrix(batch["stats"]))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": np.clip(values, 0, 1)})

    return stats.select("doc_id", "stats").mapInPandas(score, "doc_id bigint, score double")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``least``. No shuffle."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(text.as_py() or "") for text in batch.column(at)]
            if stats:
                yield batch.filter(pa.array(model.scores(np.array(stats)) >= least))

    return docs.mapInArrow(keep, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    stats = stored(document_statistics(docs, id_col, text_col))
    rows = scored(stats, fit(stats, labels))
    return rows.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
