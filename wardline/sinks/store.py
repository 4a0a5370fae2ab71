"""The findings table: append, latest per id, time queries."""

from __future__ import annotations

import hashlib
import re
import uuid
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.text import at_utc, rfc3339
from wardline.sinks.versions import _read

# Short names of the sources, as stored and shown.
SHOWN_SOURCE = {
    "network": "net",
    "process": "process",
    "browser_history": "browser",
    "shell_history": "shell",
    "codebase": "codebase",
    "cloud_log": "cloud",
}

# Fixed value: rows of a report without a time range.
RECENT_ROWS = 1000

STORED = (
    "id string, timestamp timestamp, service_id string, service_name string, "
    "risk_score int, risk_level string, dlp_matches string, detail string, raw_event string, "
    "policy_action string, matched_rule string, written_at timestamp, feed string, "
    "source string, event_date date"
)

#: what reports read, and what says which write of an id is its newest
REPORT_COLUMNS = [
    "id", "timestamp", "source", "service_name", "risk_score", "risk_level", "detail", "event_date",
]
ORDERING = ["id", "event_date", "timestamp", "written_at", "risk_score", "policy_action"]

PAYLOAD_FIELDS = {
    "network_connection": [
        "remote_host", "remote_ip", "port", "protocol", "http_headers", "body_snippet",
    ],
    "process": ["pid", "name", "cmdline", "exe_path"],
    "browser_history": ["url", "title", "browser"],
    "shell_history": ["command", "shell", "history_file"],
    "codebase_file": ["file_path", "line_number", "matched_text"],
}


def shown_source(source: Column) -> Column:
    shown = F.when(F.lit(False), source)
    for name, short in SHOWN_SOURCE.items():
        shown = shown.when(source == name, short)
    return shown.otherwise(source)


def event_json(event: Column) -> Column:
    """The event as JSON: id, source, time and the fields of its own type, nulls kept."""
    keep_nulls = {"ignoreNullFields": "false"}
    document = F.when(F.lit(False), F.lit(None).cast("string"))
    for type_, fields in PAYLOAD_FIELDS.items():
        payload = F.struct(F.lit(type_).alias("type"), *[event[name].alias(name) for name in fields])
        whole = F.struct(
            event["event_id"].alias("id"),
            event["source"].alias("source"),
            rfc3339(event["ts"], "Z").alias("timestamp"),
            payload.alias("payload"),
        )
        document = document.when(event["type"] == type_, F.to_json(whole, keep_nulls))
    return document


def stored_rows(findings: DataFrame) -> DataFrame:
    """FINDING rows in the table's flat form; nested parts as JSON text.

    A finding without a time of its own (a visit never dated) shows that of the
    write and has no date, so that its id names the same partition in every scan.
    """
    time = F.coalesce("ts", F.current_timestamp())
    return findings.select(
        F.col("finding_id").alias("id"),
        time.alias("timestamp"),
        F.col("signature_id").alias("service_id"),
        "service_name",
        "risk_score",
        "risk_level",
        F.to_json("dlp_matches").alias("dlp_matches"),
        "detail",
        event_json(F.col("event")).alias("raw_event"),
        "policy_action",
        "matched_rule",
        F.current_timestamp().alias("written_at"),
        shown_source(F.col("source")).alias("source"),
        F.to_date("ts").alias("event_date"),
    )


def newest_first(written: str, score: str, action: str) -> Column:
    """What orders writes of one id: the last is the one that counts."""
    # of equal writes the smallest action, and one without before any other
    return F.struct(F.col(written), F.col(score), F.col(action).isNull(), _inverse(action))


def _inverse(text: str) -> Column:
    """Text that sorts the other way round, for the few policy actions; others by their hash."""
    return F.when(F.col(text).isNull(), F.lit(None)).otherwise(
        F.concat(F.translate(text, "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"), F.lit("~"))
    )


def stored_latest(stored: DataFrame) -> DataFrame:
    """The newest write of each id.

    One aggregate, which reduces within tasks before the shuffle. An id contains the
    event's time, hence names its date (or that it has none): with the date among the
    keys a filter on it still prunes partitions. A finding without a date keeps the
    time of its first write.
    """
    keys = ["event_date", "id"]
    rest = [c for c in stored.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), newest_first("written_at", "risk_score", "policy_action")).alias("_newest")
    first = [F.min("timestamp").alias("_first")] if "timestamp" in rest else []
    found = stored.groupBy(*keys).agg(newest, *first)
    shown = {c: F.col(f"_newest.{c}") for c in rest}
    if first:
        shown["timestamp"] = F.when(F.col("event_date").isNull(), F.col("_first")).otherwise(F.col("_newest.timestamp"))
    return found.select(*(F.col(c) if c in keys else shown[c].alias(c) for c in stored.columns))


def from_date(start: Column) -> Column:
    """A filter for partitions: dates from ``start`` on, and findings without a date."""
    return F.col("event_date").isNull() | (F.col("event_date") >= F.to_date(start))


def report_columns(stored: DataFrame) -> DataFrame:
    """The seven columns reports read."""
    return stored.select(
        "id", "timestamp", "source", "service_name", "risk_score", "risk_level", "detail"
    )


def recent(stored: DataFrame, n: int = RECENT_ROWS) -> DataFrame:
    """The ``n`` newest findings, newest first."""
    return report_columns(stored).orderBy(F.col("timestamp").desc(), "id").limit(n)


def last_hours(stored: DataFrame, hours: int, as_of: datetime) -> DataFrame:
    """Findings of the last ``hours``, to the whole second and inclusive, newest first."""
    start = F.date_trunc("second", at_utc(as_of)) - F.make_interval(hours=F.lit(hours))
    # the plain bounds carry over to partitions and file statistics
    return report_columns(
        stored.filter(
            from_date(start) & (F.col("timestamp") >= start)
        )
    ).orderBy(F.col("timestamp").desc(), "id")


def since(stored: DataFrame, after: datetime) -> DataFrame:
    """Findings strictly after a time, oldest first."""
    after_ts = at_utc(after)
    return report_columns(
        stored.filter(
            from_date(after_ts) & (F.col("timestamp") > after_ts)
        )
    ).orderBy("timestamp", "id")


def count_on(stored: DataFrame, day: datetime) -> DataFrame:
    """Number of findings on the UTC date of ``day``."""
    date = F.to_date(at_utc(day))
    undated = F.col("event_date").isNull() & (F.to_date("timestamp") == date)
    return stored.filter((F.col("event_date") == date) | undated).agg(F.count("*").alias("n_findings"))


def gate_count(stored: DataFrame, min_score: int = 51) -> DataFrame:
    """Number of findings a build gate would stop at."""
    return stored.filter(F.col("risk_score") >= min_score).agg(F.count("*").alias("n_findings"))


class FindingsStore:
    """Parquet log by feed, source and date, and a compacted table; readers see the newest write per id.

    The compacted table is a bucketed one: its rows lie by hash of the id, one file a
    bucket, sorted by date. What reads it groups by id where the files lie; only the
    newest writes of the log are shuffled to their buckets. Each compaction writes
    a folder of its own (a generation), which counts once Spark has committed it.
    """

    #: generations that are kept: the one before stays for readers that have begun
    KEPT = 2

    def __init__(self, spark: SparkSession, path: str, *, buckets: int = 64):
        self.spark = spark
        self.path = path.rstrip("/")
        self.buckets = buckets

    @property
    def log_path(self) -> str:
        return f"{self.path}/log"

    def append(self, findings: DataFrame, feed: str = "scan") -> None:
        """Write findings. Jobs that run at once each need a ``feed`` of their own."""
        self.append_rows(stored_rows(findings), feed)

    def append_rows(self, rows: DataFrame, feed: str = "scan") -> None:
        """Write rows in the table's flat form.

        Rows of a partition folder are gathered into few files before the write,
        and a folder that is large is split again.
        """
        rows = rows.hint("rebalance", "source", "event_date")
        rows.write.mode("append").partitionBy("source", "event_date").parquet(
            f"{self.log_path}/feed={feed}"
        )

    def log(self) -> DataFrame:
        """Every write, newest or not."""
        return _read(self.spark, self.log_path, STORED)

    def writes(self) -> DataFrame:
        """The compacted table and the log, newest or not."""
        return self.read_compacted().unionByName(self.log())

    def read(self, columns: list[str] | None = None, *, from_day: date | None = None) -> DataFrame:
        """The newest write of each id: these columns of it, and from a day on (with undated ones)."""
        return self._latest(self.log(), columns, from_day)

    def _latest(self, log: DataFrame, columns: list[str] | None = None, from_day: date | None = None) -> DataFrame:
        wanted = columns or log.columns
        read = [c for c in log.columns if c in {*wanted, *ORDERING}]

        def part(df: DataFrame) -> DataFrame:
            return df.select(*read) if from_day is None else df.filter(from_date(F.lit(from_day))).select(*read)

        newest = stored_latest(part(log))
        held = self._compacted()
        if held is not None:
            table, buckets = held
            newest = stored_latest(part(table).unionByName(newest.repartition(buckets, "id")))
        return newest.select(*wanted)

    def recent(self, n: int = RECENT_ROWS) -> DataFrame:
        """The ``n`` newest findings; of dated ones only the newest dates that hold as many are read.

        One number per date comes to the driver.
        """
        dated = self.writes().filter("event_date IS NOT NULL")
        per_day = dated.groupBy("event_date").agg(F.approx_count_distinct("id").alias("n"))
        days, held = [], 0
        for day in sorted(per_day.collect(), reverse=True):
            days.append(day.event_date)
            # the count is approximate: half as many again is always enough
            held += day.n
            if held >= 1.5 * n:
                break
        return recent(self.read(REPORT_COLUMNS, from_day=days[-1] if days else None), n)

    def last_hours(self, hours: int, as_of: datetime) -> DataFrame:
        """``last_hours`` of the store, from the partitions and row groups of those days."""
        first = (as_of if as_of.tzinfo is None else as_of.astimezone(UTC)) - timedelta(hours=hours)
        return last_hours(self.read(REPORT_COLUMNS, from_day=first.date()), hours, as_of)

    def since(self, after: datetime) -> DataFrame:
        first = after if after.tzinfo is None else after.astimezone(UTC)
        return since(self.read(REPORT_COLUMNS, from_day=first.date()), after)

    def count_on(self, day: datetime) -> DataFrame:
        first = day if day.tzinfo is None else day.astimezone(UTC)
        return count_on(self.read(["id", "event_date", "timestamp"], from_day=first.date()), day)

    def compact(self, *, trim: bool = False) -> int:
        """Write the newest rows per id as a new generation; its number.

        Rows of the generation before are not shuffled. ``trim`` then removes the log
        files that are covered; streams of the log must have read them by then.
        """
        covered = self.log().inputFiles()
        log = self.spark.read.schema(STORED).option("basePath", self.log_path)
        rows = self._latest(log.parquet(*covered) if covered else self.spark.createDataFrame([], STORED))
        found = self._generations()
        number = 1 + max((g[0] for g in found), default=0)
        folder = f"g{number}-b{self.buckets}-{uuid.uuid4().hex[:8]}"
        if not found or found[-1][1] != self.buckets:
            rows = rows.repartition(self.buckets, "id")
        (
            rows.write.format("parquet")
            .bucketBy(self.buckets, "id")
            .sortBy("event_date", "id")
            .option("path", f"{self.path}/compacted/{folder}")
            .saveAsTable(self._table(folder))
        )
        files = self._files("compacted")[0]
        for _, _, old in self._generations()[: -self.KEPT]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(old)}")
            files.delete(self._files(f"compacted/{old}")[1], True)
        for name in covered if trim else ():
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, False)
        return number

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _generations(self) -> list[tuple[int, int, str]]:
        """(number, buckets, folder) of the generations that Spark has committed, oldest first."""
        files, path = self._files("compacted")
        if not files.exists(path):
            return []
        names = (entry.getPath().getName() for entry in files.listStatus(path))
        found = (re.fullmatch(r"g(\d+)-b(\d+)-\w+", name) for name in names)
        found = [(int(m[1]), int(m[2]), m[0]) for m in found if m]
        return sorted(g for g in found if files.exists(self._files(f"compacted/{g[2]}/_SUCCESS")[1]))

    def _table(self, folder: str) -> str:
        """The catalog's name of a generation."""
        place = hashlib.md5(f"{self.path}/{folder}".encode()).hexdigest()[:12]
        return f"wardline_findings_{place}"

    def _compacted(self) -> tuple[DataFrame, int] | None:
        found = self._generations()
        if not found:
            return None
        _, buckets, folder = found[-1]
        name = self._table(folder)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({STORED}) USING parquet CLUSTERED BY (id)"
            f" SORTED BY (event_date, id) INTO {buckets} BUCKETS LOCATION '{self.path}/compacted/{folder}'"
        )
        return self.spark.table(name), buckets

    def read_compacted(self) -> DataFrame:
        held = self._compacted()
        return self.spark.createDataFrame([], STORED) if held is None else held[0]

    def stream(self, **options: str) -> DataFrame:
        """New rows of the log as a stream."""
        return self.spark.readStream.schema(STORED).options(**options).parquet(self.log_path)
