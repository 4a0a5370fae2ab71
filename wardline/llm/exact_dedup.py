"""Exact deduplication with a sharded cuckoo-filter index.

An index holds one row per shard: the filter's table and the stored keys (digest,
id that stays, live rows). A change is probed in the shard that its digest names.
A miss in the filter proves that the digest is new; a hit is verified against the
digests stored in its bucket, so false positives of the filter change nothing.
When an insertion finds no place the filter is built again, twice as large, from
the stored keys. Deletions take rows off a digest and remove it with the last.

Rows of one text are combined per Arrow batch before the shuffle, so a text that
fills a third of the table reaches its shard as few rows.

Defined cases: a null text counts as empty. Of equal texts the smallest id stays;
null ids stay only if the group has no other. Rows that repeat an id and its text
are one document and all marked kept. A text of any length is hashed whole where it
lies; only digests are shuffled. Empty tables give empty results. Only the
id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import SPACE, ship, stored

SLOTS = 4
MAX_KICKS = 200
#: rows of documents for each shard of an index
ROWS_PER_SHARD = 50_000

INDEX = (
    "shard int, log2_buckets int, filter binary, digests array<binary>, "
    "keep_ids array<bigint>, live array<bigint>"
)
CHANGES = "shard int, digest binary, doc_id bigint, live bigint"


class CuckooIndex:
    """Digests of one shard with their live rows, behind a cuckoo filter of 16-bit prints."""

    def __init__(self, log2_buckets: int = 4):
        self.content: dict[int, list[list]] = {}
        self.size = 0
        self._resize(log2_buckets)

    def _resize(self, log2_buckets: int) -> None:
        """An empty table of the given size, refilled from the stored keys."""
        keys = [key for bucket in self.content.values() for key in bucket]
        while True:
            self.log2_buckets, self.mask = log2_buckets, (1 << log2_buckets) - 1
            self.table = [[] for _ in range(1 << log2_buckets)]
            if all(self._place(*self._slot(key[0])) for key in keys):
                break
            log2_buckets += 1
        self.content = {}
        for key in keys:
            self.content.setdefault(self._slot(key[0])[0], []).append(key)

    def _slot(self, digest: bytes) -> tuple[int, int]:
        """The home bucket of a digest and its print."""
        bucket, mark = struct.unpack_from("<IH", digest, 4)
        return bucket & self.mask, mark or 1

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & self.mask)

    def _place(self, bucket: int, mark: int) -> bool:
        """Put a print into one of its two buckets, moving others; False if there is no room."""
        for _ in range(MAX_KICKS):
            for place in (bucket, self._other(bucket, mark)):
                if len(self.table[place]) < SLOTS:
                    self.table[place].append(mark)
                    return True
            # the oldest print gives way and goes to its other bucket
            row = self.table[bucket]
            row.append(mark)
            mark = row.pop(0)
            bucket = self._other(bucket, mark)
        return False

    def maybe(self, digest: bytes) -> bool:
        """False proves that the digest is not live."""
        bucket, mark = self._slot(digest)
        return mark in self.table[bucket] or mark in self.table[self._other(bucket, mark)]

    def find(self, digest: bytes) -> list | None:
        """The stored key [digest, id that stays, live rows], verified, or None."""
        if not self.maybe(digest):
            return None
        stored_keys = self.content.get(self._slot(digest)[0], ())
        return next((key for key in stored_keys if key[0] == digest), None)

    def insert(self, digest: bytes, doc_id: int | None, live: int = 1) -> None:
        key = self.find(digest)
        if key is not None:
            key[1] = min((x for x in (key[1], doc_id) if x is not None), default=None)
            key[2] += live
            return
        self.content.setdefault(self._slot(digest)[0], []).append([digest, doc_id, live])
        self.size += 1
        if not self._place(*self._slot(digest)):
            self._resize(self.log2_buckets + 1)

    def delete(self, digest: bytes, live: int = 1) -> None:
        """Take live rows off a digest; unknown digests are ignored."""
        key = self.find(digest)
        if key is None:
            return
        key[2] -= live
        if key[2] > 0:
            return
        bucket, mark = self._slot(digest)
        self.content[bucket].remove(key)
        self.size -= 1
        for place in (bucket, self._other(bucket, mark)):
            if mark in self.table[place]:
                self.table[place].remove(mark)
                return

    def dump(self, shard: int) -> pd.DataFrame:
        marks = np.zeros((len(self.table), SLOTS), "<u2")
        for row, prints in zip(marks, self.table, strict=True):
            row[: len(prints)] = prints
        keys = [key for bucket in self.content.values() for key in bucket]
        digests, keep_ids, live = map(list, zip(*keys, strict=True)) if keys else ([], [], [])
        row = [shard, self.log2_buckets, marks.tobytes(), digests, keep_ids, live]
        return pd.DataFrame([row], columns=[c.split()[0] for c in INDEX.split(", ")])

    @classmethod
    def load(cls, row) -> CuckooIndex:
        """From a row of ``dump``; nothing is placed anew."""
        index = cls(0)
        index.log2_buckets, index.mask = int(row["log2_buckets"]), (1 << int(row["log2_buckets"])) - 1
        marks = np.frombuffer(row["filter"], "<u2").reshape(-1, SLOTS)
        index.table = [[int(mark) for mark in prints if mark] for prints in marks]
        for digest, keep_id, live in zip(row["digests"], row["keep_ids"], row["live"], strict=True):
            keep_id = None if pd.isna(keep_id) else int(keep_id)
            index.content.setdefault(index._slot(digest)[0], []).append([digest, keep_id, int(live)])
        index.size = len(row["digests"])
        return index


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, digest): a hash of the text, SHA-256 with each run of white space made one space."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    normal = F.regexp_replace(text, SPACE, " ")
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.xxhash64(text).alias("h"),
        F.unhex(F.sha2(normal, 256)).alias("digest"),
    )


def _shard(digest: bytes, shards: int) -> int:
    return int.from_bytes(digest[:4], "little") % shards


def _changes(keyed: DataFrame, shards: int, sign: int) -> DataFrame:
    """Rows of one digest combined per batch; ``sign`` is -1 for deletions."""

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[bytes, list] = {}
            for doc_id, digest in zip(batch["doc_id"].tolist(), batch["digest"], strict=True):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                key = found.setdefault(digest, [None, 0])
                key[0] = min((x for x in (key[0], doc_id) if x is not None), default=None)
                key[1] += sign
            yield pd.DataFrame(
                {
                    "shard": [_shard(digest, shards) for digest in found],
                    "digest": list(found),
                    "doc_id": pd.array([key[0] for key in found.values()], dtype="Int64"),
                    "live": [key[1] for key in found.values()],
                }
            )

    return keyed.select("doc_id", "digest").mapInPandas(combine, CHANGES)


def _applied(index: CuckooIndex, changes: pd.DataFrame) -> None:
    for digest, doc_id, live in zip(changes["digest"], changes["doc_id"], changes["live"], strict=True):
        if live > 0:
            index.insert(digest, None if pd.isna(doc_id) else int(doc_id), int(live))
        else:
            index.delete(digest, -int(live))


def build(keyed: DataFrame, shards: int | None = None) -> DataFrame:
    """A new index over the rows of ``digests()``."""
    ship(keyed.sparkSession)
    shards = shards or max(1, -(-keyed.count() // ROWS_PER_SHARD))

    def shard(key: tuple, changes: pd.DataFrame) -> pd.DataFrame:
        index = CuckooIndex()
        _applied(index, changes)
        return index.dump(int(key[0]))

    return _changes(keyed, shards, 1).groupBy("shard").applyInPandas(shard, INDEX)


def update(index: DataFrame, keyed: DataFrame, shards: int, delete: bool = False) -> DataFrame:
    """The index after inserting, or deleting, the rows of ``digests()``.

    ``shards`` is the number the index was built with. An id that stays keeps
    standing for its text until the text's last row is deleted.
    """
    ship(keyed.sparkSession)

    def shard(key: tuple, old: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
        now = CuckooIndex.load(old.iloc[0]) if len(old) else CuckooIndex()
        _applied(now, changes)
        return now.dump(int(key[0]))

    changes = _changes(keyed, shards, -1 if delete else 1)
    return index.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(shard, INDEX)


def entries(index: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of an index."""
    keys = index.select(F.inline(F.arrays_zip("digests", "keep_ids", "live")))
    return keys.toDF("digest", "keep_id", "group_size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, h (of its text), keep_id, group_size, kept, digest."""
    keyed = stored(digests(docs, id_col, text_col))
    groups = stored(entries(build(keyed)))
    return keyed.join(groups, "digest").select(
        "doc_id",
        "h",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "digest",
    )


def digest_of(text: str | None) -> bytes:
    """What ``digests`` makes of one text."""
    import re

    return hashlib.sha256(re.sub(SPACE, " ", text or "").encode()).digest()
