"""Token ids in files of independent zstandard frames with a seek table.

Format of a file, in order:

* one zstandard frame per document (a document of more than ``FRAME_IDS`` ids has
  several): its ids, little-endian unsigned, with zstandard's content checksum;
* a skippable frame, the document index: a header, then per document its id,
  whether the id is null, its first frame, and its number of ids;
* a skippable frame, the seek table of the public seekable format: per frame its
  compressed size, its size, and the low 32 bits of the XXH64 of its content.

A reader takes the two tables from the end of the file and then reads and
decompresses only the frames of the documents it wants. Any zstandard tool can
decompress a whole file.

Documents are range-partitioned by id once and sorted; each task encodes and
writes its range as one file, under a name of its own that is moved to the final
name at the end, so a retried or doubled task leaves one whole file. Folders are
reached through pyarrow's file systems (local paths, HDFS, S3, GCS).

Defined cases: a null text counts as empty and holds just the end id. Null ids
come first. Rows that repeat an id are ordered by a hash of the text. An empty
table gives no file. Long documents are encoded whole. Only id and text are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import part_starts, ship, stored
from wardline.llm.tokens import encoder

# fixed values: the public seekable zstandard format
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
SEEK_HAS_CHECKSUMS = 0x80

INDEX_MAGIC = b"WTOK1\0"
FRAME_IDS = 1 << 18
LEVEL = 3

MANIFEST = "_part bigint, path string, n_docs bigint, n_ids bigint, n_bytes bigint"
DOCUMENTS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


class FrameWriter:
    """Writes documents to an open binary stream, then the two tables."""

    def __init__(self, out, id_bytes: int):
        import zstandard

        self.out, self.id_bytes = out, id_bytes
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress
        self.seek: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.first_frames: list[int] = []
        self.counts: list[int] = []
        self.size = 0

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        import xxhash

        self.doc_ids.append(doc_id)
        self.first_frames.append(len(self.seek))
        self.counts.append(len(ids))
        for start in range(0, len(ids), FRAME_IDS):
            content = ids[start : start + FRAME_IDS].astype(f"<u{self.id_bytes}").tobytes()
            frame = self.pack(content)
            check = xxhash.xxh64_intdigest(content) & 0xFFFFFFFF
            self.seek.append((len(frame), len(content), check))
            self._write(frame)

    def finish(self) -> None:
        nulls = np.array([x is None for x in self.doc_ids], np.uint8)
        index = b"".join(
            (
                INDEX_MAGIC,
                struct.pack("<BQ", self.id_bytes, len(self.doc_ids)),
                np.array([x or 0 for x in self.doc_ids], "<i8").tobytes(),
                nulls.tobytes(),
                np.array(self.first_frames, "<u4").tobytes(),
                np.array(self.counts, "<u8").tobytes(),
            )
        )
        self._write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        rows = np.array(self.seek, "<u4").reshape(-1, 3)
        footer = struct.pack("<IBI", len(rows), SEEK_HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self._write(struct.pack("<II", SKIPPABLE_SEEK, rows.nbytes + len(footer)))
        self._write(rows.tobytes() + footer)


class FrameReader:
    """Reads the tables of a file, and the frames of wanted documents only."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        n_frames, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the end of the file")
        table = 12 * n_frames + 9
        self.seek = np.frombuffer(self._at(size - table, table - 9), "<u4").reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.seek[:, 0], dtype=np.int64)])
        at = int(self.starts[-1])
        kind, length = struct.unpack("<II", self._at(at, 8))
        index = self._at(at + 8, length)
        if kind != SKIPPABLE_INDEX or not index.startswith(INDEX_MAGIC):
            raise ValueError("no document index before the seek table")
        at = len(INDEX_MAGIC)
        self.id_bytes, n = struct.unpack_from("<BQ", index, at)
        at += 9
        self.doc_ids = np.frombuffer(index, "<i8", n, at)
        self.nulls = np.frombuffer(index, np.uint8, n, at + 8 * n).astype(bool)
        self.first_frames = np.frombuffer(index, "<u4", n, at + 9 * n).astype(np.int64)
        self.counts = np.frombuffer(index, "<u8", n, at + 13 * n).astype(np.int64)

    def _at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def ids(self, row: int) -> np.ndarray:
        """The ids of the row-th document; its frames' checksums are verified."""
        import xxhash
        import zstandard

        unpack, parts = zstandard.ZstdDecompressor(), []
        first = int(self.first_frames[row])
        for k in range(first, first - (-int(self.counts[row]) // FRAME_IDS)):
            content = unpack.decompress(
                self._at(int(self.starts[k]), int(self.seek[k, 0])), int(self.seek[k, 1])
            )
            if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.seek[k, 2]:
                raise ValueError(f"frame {k} does not match its checksum")
            parts.append(content)
        return np.frombuffer(b"".join(parts), f"<u{self.id_bytes}").astype("<u4")

    def find(self, doc_id: int) -> list[int]:
        return np.flatnonzero((self.doc_ids == doc_id) & ~self.nulls).tolist()


def open_folder(folder: str):
    """(file system, path) of a folder; pyarrow's local, HDFS, S3 or GCS."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int | None = 2,
    id_bytes: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode, write, and return the stored manifest: a row per file with its first token's place.

    ``id_bytes`` holds the largest id of the vocabulary. Files ascend in ids.
    """
    ship(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, path = open_folder(folder)
        encode = encoder(tokenizer).encode
        end = struct.pack("<I", end_id) if end_id is not None else b""
        part = TaskContext.get().partitionId()
        final, own = f"{path}/part-{part:06d}.wtok", f"{path}/.part-{part:06d}-{uuid.uuid4().hex}"
        files.create_dir(path, recursive=True)
        n_ids, writer, out = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                out = files.open_output_stream(own)
                writer = FrameWriter(out, id_bytes)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(encode(text.as_py() or "") + end, "<u4")
                if len(ids) and int(ids.max()) >> (8 * id_bytes):
                    raise ValueError(f"an id does not fit {id_bytes} bytes")
                n_ids += len(ids)
                writer.add(doc_id, ids)
        if writer is None:
            return
        writer.finish()
        out.close()
        files.move(own, final)
        row = [[part], [f"{folder}/part-{part:06d}.wtok"], [len(writer.counts)], [n_ids], [writer.size]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(row[0]), pa.array(row[1]), *(pa.array(x) for x in row[2:])],
            names=[c.split()[0] for c in MANIFEST.split(", ")],
        )

    narrow = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text")
    keys = ["doc_id", F.xxhash64("text")]
    ranged = narrow.repartitionByRange(*keys).sortWithinPartitions(*keys)
    manifest = stored(ranged.mapInArrow(write, MANIFEST))
    return manifest.join(part_starts(manifest, "n_ids"), "_part")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32. One task per file."""
    ship(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                files, name = open_folder(path)
                with files.open_input_file(name) as file:
                    reader = FrameReader(file)
                    crc = [zlib.crc32(reader.ids(k).tobytes()) for k in range(len(reader.counts))]
                starts = start + np.concatenate([[0], np.cumsum(reader.counts)[:-1]]).astype("i8")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(reader.doc_ids, mask=reader.nulls),
                        pa.array(starts),
                        pa.array(reader.counts),
                        pa.array(crc, pa.int64()),
                    ],
                    names=[c.split()[0] for c in DOCUMENTS.split(", ")],
                )

    n = max(1, manifest.count())
    files = manifest.select("path", F.col("n_ids_before").alias("start")).repartition(n)
    return files.mapInArrow(read, DOCUMENTS)


def read_documents(spark: SparkSession, manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the wanted ids (a one-column table); other frames stay compressed.

    The wanted ids are grouped by the file whose range of ids may hold them, so a
    task opens one file and reads only those frames. Ids and files meet by an equi join on
    buckets of ids, of which each file covers few.
    """
    ship(spark)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, name = open_folder(path)
                with files.open_input_file(name) as file:
                    ids = FrameReader(file)
                known = ids.doc_ids[~ids.nulls]
                if len(known):
                    yield pa.RecordBatch.from_pydict(
                        {"path": [path], "low": [int(known[0])], "high": [int(known[-1])]}
                    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, file, opened = None, None, None
        for batch in batches:
            rows = []
            for path, doc_id in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                if path != opened:
                    if file is not None:
                        file.close()
                    files, name = open_folder(path)
                    file, opened = files.open_input_file(name), path
                    reader = FrameReader(file)
                rows += [(doc_id, reader.ids(k).tolist()) for k in reader.find(doc_id)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x for x, _ in rows], pa.int64()),
                    pa.array([x for _, x in rows], pa.list_(pa.int64())),
                ],
                names=["doc_id", "ids"],
            )

    spans = stored(manifest.select("path").mapInArrow(ranges, "path string, low bigint, high bigint"))
    ids = wanted.toDF("doc_id").where("doc_id IS NOT NULL").distinct()
    n, low, high = spans.agg(F.count("*"), F.min("low"), F.max("high")).first()
    # the files ascend, so together they cover about as many buckets as there are, and one more each
    width = max(1, -(-(high - low + 1) // (4 * n))) if n else 1
    covered = spans.withColumn("bucket", F.expr(f"explode(sequence(low div {width}, high div {width}))"))
    placed = ids.withColumn("bucket", F.expr(f"doc_id div {width}"))
    found = placed.join(covered, "bucket").where("doc_id BETWEEN low AND high")
    placed = found.select("path", "doc_id").repartition("path").sortWithinPartitions("path", "doc_id")
    return placed.mapInArrow(read, "doc_id bigint, ids array<bigint>")
