"""Raw tables from files: shell histories, source trees, telemetry logs."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.text import SKIPPED_FOLDERS, is_scanned_extension
from wardline.session import written

# Raw telemetry tables, as logged by a fleet.
TABLES = {
    "processes": "host string, ts timestamp, pid bigint, name string, argv array<string>, exe_path string",
    "shell_lines": "host string, ts timestamp, shell string, history_file string, line_number int, line string",
    "visits": "host string, browser string, profile string, visit_ts timestamp, url string, title string",
    "connections": "host string, ts timestamp, remote_ip string, port int",
    "netstat_lines": "host string, ts timestamp, line string",
    "dns_answers": "host string, ts timestamp, domain string, resolved boolean",
    "http_payloads": "host string, ts timestamp, dst_ip string, port int, payload string",
    "tls_names": "host string, ts timestamp, sni string, dst_ip string, port int",
    "cloud_logs": "host string, ts timestamp, line string",
    "code_files": "repo string, path string, mtime bigint, content binary",
}

LISTED = "uri string, name string, mtime bigint, size bigint"
LISTED_NAMES = ["uri", "name", "mtime", "size"]
#: folders within folders; links to a folder above would go on without end
MOST_LEVELS = 200
#: bytes of files that one task reads
TASK_BYTES = 32_000_000

# End of a history file's name -> shell.
SHELL_OF_FILE = {"bash_history": "bash", "zsh_history": "zsh", "fish_history": "fish"}


def read_table(spark: SparkSession, name: str, path: str, format: str = "parquet") -> DataFrame:
    """A telemetry table with its declared schema (never inferred)."""
    return spark.read.schema(TABLES[name]).format(format).load(path)


def stream_table(
    spark: SparkSession, name: str, path: str, format: str = "parquet", **options: str
) -> DataFrame:
    """The same table as a stream of newly arriving files."""
    return spark.readStream.schema(TABLES[name]).options(**options).format(format).load(path)


def _files_below(spark: SparkSession, root: str, prune: tuple[str, ...]) -> DataFrame:
    """``uri, name, mtime, size``: every file below a folder, or the file itself, whatever its name.

    Spark's own readers leave out names that start with a dot or an underscore.
    Folders are listed level by level: the folders of a level are a table, spread over
    tasks, whose listing gives the files and the folders of the next. No list of folders
    comes to the driver, and a tree wholly below one folder is shared from the level on
    where it branches. Folders named in ``prune``, or with a leading dot, are not entered.
    """
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(root)
    scheme = root[: len(root) - len(base)] if root.endswith(base) else ""
    top = files.get_file_info(base)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    if top.is_file:
        listing = spark.createDataFrame([(top.path, top.base_name, top.mtime_ns, top.size)], LISTED)
        return listing.withColumn("uri", F.concat(F.lit(scheme), "uri"))

    def enters(name: str) -> bool:
        return not name.startswith(".") and name not in prune

    def one_level(batches):
        for batch in batches:
            for folder in batch["uri"]:
                files, _ = fs.FileSystem.from_uri(root)
                rows = []
                for e in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                    name = e.path[len(base) :].lstrip("/")
                    if e.is_file:
                        rows.append((e.path, name, e.mtime_ns, e.size))
                    elif e.type == fs.FileType.Directory and enters(e.base_name):
                        rows.append((e.path, None, None, None))
                yield pd.DataFrame(rows, columns=LISTED_NAMES).astype({"mtime": "Int64", "size": "Int64"})

    levels, frontier = [], spark.createDataFrame([(base,)], "uri string")
    for _ in range(MOST_LEVELS):
        found = written(frontier.mapInPandas(one_level, LISTED))
        levels.append(found.filter("name IS NOT NULL"))
        # one row per folder goes to a task of its own as far as there are tasks
        below = found.filter("name IS NULL").select("uri")
        if below.isEmpty():
            break
        frontier = below.repartition("uri")
    else:
        raise ValueError(f"folders nest more than {MOST_LEVELS} levels below {root}")
    return reduce(DataFrame.union, levels).withColumn("uri", F.concat(F.lit(scheme), "uri"))


def spread_by_bytes(listing: DataFrame, size: str = "size") -> DataFrame:
    """Files dealt to tasks of about ``TASK_BYTES``, but to as many tasks as run at once if there are fewer."""
    total = listing.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    tasks = max(-(-total // TASK_BYTES), listing.sparkSession.sparkContext.defaultParallelism)
    return listing.repartition(int(tasks), F.xxhash64("uri"))


def _with_content(listing: DataFrame) -> DataFrame:
    """``listing`` with each file's bytes; files that are gone by now are left out."""

    def read(batches):
        from pyarrow import fs

        for batch in batches:
            for k in range(len(batch)):
                one = batch.iloc[k : k + 1]
                files, path = fs.FileSystem.from_uri(one["uri"].iloc[0])
                try:
                    with files.open_input_stream(path) as file:
                        yield one.assign(content=[file.read()])
                except FileNotFoundError:
                    continue

    fields = ", ".join(f"`{name}` {kind}" for name, kind in listing.dtypes)
    return listing.mapInPandas(read, f"{fields}, content binary")


def shell_history_files(spark: SparkSession, paths: str | list[str], host: str = "") -> DataFrame:
    """``shell_lines`` from history files or folders of them; the end of the name tells the shell.

    Other files are left out. Histories carry no time per line, so the file's
    modification time stands in; a line is known by its number.
    """
    shell = F.when(F.lit(False), "")
    for name, label in SHELL_OF_FILE.items():
        shell = shell.when(F.col("uri").endswith(name), label)
    paths = [paths] if isinstance(paths, str) else paths
    listing = reduce(DataFrame.union, (_files_below(spark, path, ()) for path in paths))
    listing = listing.withColumn("shell", shell).filter("shell IS NOT NULL")
    found = _with_content(spread_by_bytes(listing))
    lines = found.select(
        F.lit(host).alias("host"),
        F.expr("timestamp_micros(mtime div 1000)").alias("ts"),
        "shell",
        F.col("uri").alias("history_file"),
        F.posexplode(F.split(F.col("content").cast("string"), "\r?\n")).alias("_pos", "line"),
    )
    return lines.select("host", "ts", "shell", "history_file", (F.col("_pos") + 1).alias("line_number"), "line")


class SourceTree:
    """A folder tree of source files: a narrow listing, and contents of what is chosen from it."""

    def __init__(self, spark: SparkSession, root: str, repo: str = ""):
        self.spark, self.root = spark, root
        self.repo = repo or root.split(":", 1)[-1].rstrip("/")

    def listing(self) -> DataFrame:
        """``repo, path, mtime, uri, size`` of files with scanned extensions; paths are relative to the root."""
        files = _files_below(self.spark, self.root, tuple(SKIPPED_FOLDERS))
        wanted = is_scanned_extension(F.col("name")) | F.col("name").rlike(r"(^|/)\.env\z")
        return files.filter(wanted).select(
            F.lit(self.repo).alias("repo"), F.col("name").alias("path"), "mtime", "uri", "size"
        )

    def contents(self, listing: DataFrame) -> DataFrame:
        """``code_files`` of the listed files; no other file is opened."""
        return _with_content(spread_by_bytes(listing)).select("repo", "path", "mtime", "content")


def source_tree(spark: SparkSession, root: str, repo: str = "") -> DataFrame:
    """``code_files`` of a folder tree; ``path`` is relative to the root."""
    tree = SourceTree(spark, root, repo)
    return tree.contents(tree.listing())
