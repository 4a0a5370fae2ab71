"""What several operators need: scratch tables, global order, shipping this package to workers."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import new_folder

#: white space and words, as expressions for Spark's regular expressions
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: partition number and row number of monotonically_increasing_id()
ROW_BITS = 33


#: folders made within ``scratch_tables``, innermost last
_MADE: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, removed when the driver ends.

    Only where all runs on one machine and that is unset, a local folder.
    """
    path = new_folder(spark, "llm")
    for made in _MADE[-1:]:
        made.append(path)
    return path


def free(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove scratch folders that nothing will read again."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch_tables() -> Iterator[list[str]]:
    """The scratch folders made meanwhile, in order."""
    _MADE.append([])
    try:
        yield _MADE[-1]
    finally:
        _MADE.pop()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files behind it are of no more use, but executors keep them until
    the driver's garbage is collected, so a chain of such steps would fill disks.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def ordered(df: DataFrame, *keys: str | Column) -> DataFrame:
    """``df`` in the global order of ``keys``, stored, with ``_part`` and ``_pos``.

    Rows are range-partitioned and sorted, so a frequent key does not fill one
    task if later keys tell its rows apart. ``_part`` ascends with the keys and
    ``_pos`` counts the rows of a part from 0.
    """
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = ranged.withColumn("_id", F.monotonically_increasing_id())
    return stored(
        ranged.withColumn("_part", F.expr(f"shiftright(_id, {ROW_BITS})"))
        .withColumn("_pos", F.expr(f"_id & {2**ROW_BITS - 1}L"))
        .drop("_id")
    )


def part_starts(parts: DataFrame, *sums: str) -> DataFrame:
    """From one row per ``_part``, the sums of all parts before it, as ``<name>_before``.

    The window has one row per partition of the data, never a row per record.
    """
    before = "OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return parts.selectExpr(
        "_part", *(f"coalesce(sum({name}) {before}, 0) AS {name}_before" for name in sums)
    )


def numbered(df: DataFrame, *keys: str | Column, name: str = "_row") -> DataFrame:
    """``ordered`` with a global row number from 0."""
    rows = ordered(df, *keys)
    starts = part_starts(rows.groupBy("_part").agg(F.count("*").alias("_n")), "_n")
    return (
        rows.join(starts, "_part")
        .withColumn(name, F.col("_n_before") + F.col("_pos"))
        .drop("_n_before", "_part", "_pos")
    )


#: bytes of an Arrow batch: texts are held several times over, on both sides of a worker's pipe
BATCH_BYTES = "8m"


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once for each context, and batches of bounded size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if getattr(context, "_wardline_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    bundle = Path(tempfile.mkdtemp(prefix="wardline-code-")) / "wardline_code.zip"
    with zipfile.ZipFile(bundle, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(bundle))
    context._wardline_shipped = True
