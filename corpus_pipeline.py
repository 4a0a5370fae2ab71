"""From documents to packed training sequences, as five stages of the operators in wardline.llm.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``docs``, whatever they are; documents that a mix repeats are repeated
rows.

Nulls, empty and very long texts, ties and empty tables are defined as in the
operators.
Rows that repeat an id and its text are one document: they stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import exact_dedup, mixing, near_dedup, packing, quality
from wardline.llm.common import free, scratch_tables, stored
from wardline.llm.queries import documents, tokenizer_path


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not in ``dropped`` (id, hash of the text).

    The list of dropped documents is mostly the shorter one; Spark broadcasts it
    where it finds it below its size limit.
    """
    same_text = F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == dropped["h"]
    return docs.join(dropped, docs["doc_id"].eqNullSafe(dropped["doc_id"]) & same_text, "left_anti")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(stored(quality.document_statistics(docs)), labels)
    return quality.accepted(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the document with the smallest id."""
    rows = exact_dedup.exact_duplicates(docs)
    return _without(docs, stored(rows.where("NOT kept").select("doc_id", "h")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest id, of each group of near-duplicates."""
    rows = near_dedup.similar_components(docs)
    return _without(docs, stored(rows.where("NOT kept").select("doc_id", "h")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their target weights."""
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence and the place they go to."""
    return packing.packed(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", classify_quality),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the whole documents table.

    A stage's own tables, and the table that it read, are removed once its result is stored.
    """
    docs, before = documents(spark, sf_dir), []
    for _, stage in STAGES[:-1]:
        with scratch_tables() as made:
            docs = stored(stage(spark, docs, sf_dir))
        free(spark, [*made[:-1], *before])
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
