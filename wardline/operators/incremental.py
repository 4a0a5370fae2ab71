"""Which files changed since the last scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.sinks.versions import VersionedTable


FILE_KEY = ["repo", "path"]


def changed_by_mtime(files: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of ``files`` whose mtime is above the recorded one; unknown files count as 0."""
    known = state.select(*FILE_KEY, F.col("mtime").alias("_last"))
    return (
        files.join(known, FILE_KEY, "left")
        .filter(F.col("mtime") > F.coalesce("_last", F.lit(0)))
        .select(*files.columns)
    )


def changed_by_commit(commits: DataFrame, last_commit_seq: DataFrame) -> DataFrame:
    """Distinct ``repo, path`` touched after the last scanned commit of each repo.

    ``commits`` has ``repo, commit_seq, path``; ``last_commit_seq`` has one
    ``repo, commit_seq`` row per repo scanned before. A repo without one is new:
    all its files count as changed.
    """
    last = last_commit_seq.select("repo", F.col("commit_seq").alias("_last"))
    return (
        commits.groupBy("repo", "path")
        .agg(F.max("commit_seq").alias("_seq"))
        .join(last, "repo", "left")
        .filter(F.col("_last").isNull() | (F.col("_seq") > F.col("_last")))
        .select("repo", "path")
    )


def changed_combined(
    files: DataFrame, state: DataFrame, commits: DataFrame, last_commit_seq: DataFrame
) -> DataFrame:
    """``repo, path`` of ``files`` to scan: by commit, else all that is tracked, else by mtime.

    A repo with a commit log and a last scanned commit has the files touched since;
    with a log only, all files of the log; without a log, files with a newer mtime.
    Only narrow rows are joined.
    """
    logged = commits.select("repo").distinct()
    by_mtime = changed_by_mtime(files.select(*FILE_KEY, "mtime"), state)
    by_mtime = by_mtime.join(logged, "repo", "left_anti").select(*FILE_KEY)
    by_commit = files.select(*FILE_KEY).join(
        changed_by_commit(commits, last_commit_seq), FILE_KEY, "left_semi"
    )
    return by_commit.unionByName(by_mtime)


def only_changed(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Keep files listed in ``changed``."""
    return files.join(changed.select(*FILE_KEY), FILE_KEY, "left_semi")


class ScanState(VersionedTable):
    """File -> mtime and last commit of its repo, replaced as a whole after each pass."""

    schema = "repo string, path string, mtime bigint, commit_seq bigint"

    def stage_listing(self, files: DataFrame, commits: DataFrame | None = None) -> tuple[int, DataFrame]:
        """Write what a pass is to look at before it looks: the version to commit at its end, and the listing.

        ``files`` is evaluated once, here. A file that changes later is newer than what
        the next pass finds remembered.
        """
        rows = files
        if commits is None:
            rows = rows.withColumn("commit_seq", F.lit(None).cast("bigint"))
        else:
            newest = commits.groupBy("repo").agg(F.max("commit_seq").cast("bigint").alias("commit_seq"))
            rows = rows.join(newest, "repo", "left")
        version = self.stage(rows.withColumn("mtime", F.col("mtime").cast("bigint")))
        staged = self.spark.read.schema(rows.schema).parquet(f"{self.path}/v{version}")
        return version, staged.drop("commit_seq")

    def save(self, files: DataFrame, commits: DataFrame | None = None) -> int:
        version, _ = self.stage_listing(files.select(*FILE_KEY, "mtime"), commits)
        self.commit(version)
        return version

    def last_commits(self, version: int | None = None) -> DataFrame:
        """``repo, commit_seq`` of the repos scanned by commit before."""
        rows = self.read(version).filter("commit_seq IS NOT NULL")
        return rows.groupBy("repo").agg(F.max("commit_seq").alias("commit_seq"))
