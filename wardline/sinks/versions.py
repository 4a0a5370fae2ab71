"""A small table that is replaced as a whole, on any file store Spark can write."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    """Each version is a folder of its own; a file in ``commits`` makes it the current one.

    A job that dies midway leaves a folder without commit file, which no reader
    sees and the next writer of that version overwrites. A commit removes all but
    the ``KEPT`` newest versions: the one before stays for readers that have
    begun, and for a micro-batch that is replayed.
    """

    KEPT = 2

    schema = ""

    def __init__(self, spark: SparkSession, path: str, schema: str | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema or self.schema

    def version(self, at_most: int | None = None) -> int:
        """Number of the current version (or the last up to ``at_most``), 0 before the first."""
        usable = (v for v in self.versions() if at_most is None or v <= at_most)
        return max(usable, default=0)

    def versions(self) -> list[int]:
        """The committed versions that are still there: ``KEPT`` of them, one more during a commit."""
        files, path = self._folder("commits")
        if not files.exists(path):
            return []
        names = (entry.getPath().getName() for entry in files.listStatus(path))
        return sorted(int(name[1:]) for name in names if name[:1] == "v" and name[1:].isdigit())

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        return _read(self.spark, f"{self.path}/v{version}", self.schema)

    def stage(self, df: DataFrame, version: int | None = None) -> int:
        """Write a version that no reader sees until it is committed; the next of that number replaces it."""
        version = self.version() + 1 if version is None else version
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        return version

    def commit(self, version: int) -> None:
        files, commit = self._folder(f"commits/v{version}")
        files.mkdirs(commit.getParent())
        files.create(commit, True).close()
        for old in self.versions()[: -self.KEPT]:
            for name in (f"commits/v{old}", f"v{old}"):
                files.delete(self._folder(name)[1], True)

    def replace(self, df: DataFrame, version: int | None = None) -> int:
        version = self.stage(df, version)
        self.commit(version)
        return version


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The parquet folder, or no rows where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
