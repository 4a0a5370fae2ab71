"""Substring deduplication: recurring phrases, automata over them, first occurrences of windows.

A window is ``WINDOW`` consecutive words. In each window the phrase of ``PHRASE``
words with the smallest hash is the window's anchor; equal windows have equal
anchors, and only about one phrase in seven is an anchor at all.

1. Documents with the same words throughout are one; all but the first of them
   repeat it whole.
2. Anchors are sorted over range partitions; those with an equal neighbour recur.
3. Documents meet their recurring phrases. Per shard of documents these phrases,
   as sequences of words, are compiled to an Aho-Corasick automaton, and the
   shard's documents are streamed through it to locate every occurrence. Windows
   whose anchor lies at an occurrence are candidates. An automaton holds only
   phrases of its shard, so the work is in proportion to the documents. Words are spelled with
   ``LETTERS`` characters, as many a word as the shard's different words need, so the
   automaton's nodes have few children and any number of words fits.
4. Candidate windows are sorted by content and place over range partitions; a
   window with an equal one before it starts earlier elsewhere.
5. Words covered by such windows are removed.

Sorting by content and then place splits a window that a third of all documents
hold over tasks. Words and phrases are compared by 64 bits of hash, windows by 95.

Defined cases: a null text has no words; texts with fewer words than a window
keep all. Null ids come last; of different texts with one id the order is that of
their digests. Rows that repeat an id and its text are one document. Empty tables
give empty results. Only the id and text columns are read; texts are used whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import numbered, ship, stored
from wardline.llm.near_dedup import _HASHES, _keyed, forget_words, mixed_bits

WINDOW, PHRASE = 20, 8
#: bytes of text whose phrases share an automaton
SHARD_BYTES = 2_000_000

DOCUMENTS = "doc_id bigint, h bigint, n_words bigint, seq binary, sha string, anchors array<bigint>"
WINDOWS = "w bigint, c int, no bigint, start int"
LATER = "part int, kind int, no bigint, start int, w bigint, c int"

#: the factors of three kinds of hashes, odd, and their inverses modulo 2^64
_FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]
_INVERSES = [pow(factor, -1, 2**64) for factor in _FACTORS]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: characters that words are spelled with for an automaton: few, so that no node has many children
LETTERS, LETTER_BITS, FIRST_LETTER = 64, 6, 0x30


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _powers(kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a factor and of its inverse."""
    if kind not in _POWERS or len(_POWERS[kind][0]) < n:
        size = 1 << max(12, n.bit_length())
        made = []
        for factor in (_FACTORS[kind], _INVERSES[kind]):
            powers = np.full(size, factor, np.uint64)
            powers[0] = 1
            made.append(np.multiply.accumulate(powers))
        if size > 1 << 20:
            # not kept: a worker goes on to other texts
            return made[0][:n], made[1][:n]
        _POWERS[kind] = made[0], made[1]
    return _POWERS[kind][0][:n], _POWERS[kind][1][:n]


def rolling(hashes: np.ndarray, width: int, kind: int) -> np.ndarray:
    """A hash of each ``width`` consecutive words: a polynomial of their hashes, from sums of its terms."""
    n = len(hashes)
    powers, inverses = _powers(kind, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers, out=sums[1:])
    return mixed_bits((sums[width:] - sums[:-width]) * inverses[: n - width + 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values, span = np.minimum(values[:-span], values[span:]), 2 * span
    return np.minimum(values[: len(values) - width + span], values[width - span :])


def anchors_of(phrases: np.ndarray) -> np.ndarray:
    """The anchors of a document's windows; twice if it holds the phrase more than once."""
    found = np.unique(sliding_min(phrases, WINDOW - PHRASE + 1))
    at = np.minimum(np.searchsorted(found, phrases), len(found) - 1)
    times = np.bincount(at[found[at] == phrases], minlength=len(found))
    return np.repeat(found, np.minimum(times, 2))


def word_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its number of words, their digest, and anchors."""
    ship(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, shas, anchors = [], [], [], []
            for text in batch.column(2):
                words = (text.as_py() or "").encode().split()
                joined = b" ".join(words)
                counts.append(len(words))
                digests.append(hashlib.md5(joined).digest())
                shas.append(hashlib.sha256(joined).hexdigest())
                found = np.zeros(0, np.uint64)
                if len(words) >= WINDOW:
                    found = anchors_of(rolling(word_hashes(words), PHRASE, 2))
                anchors.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(shas, pa.string()),
                    pa.array(anchors, pa.list_(pa.int64())),
                ],
                names=[c.split()[0] for c in DOCUMENTS.split(", ")],
            )
        forget_words()

    return _keyed(docs, id_col, text_col).mapInArrow(measure, DOCUMENTS)


def recurring(anchors: DataFrame) -> DataFrame:
    """The rows (anchor, no) whose anchor occurs again.

    The first and the last row of a partition are kept without knowing: a phrase
    too many only makes candidates that find no equal window.
    """

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, like_before = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, no = (batch.column(k).to_numpy() for k in (0, 1))
            if held is not None:
                anchor, no = np.append(held[0], anchor), np.append(held[1], no)
            same = anchor[1:] == anchor[:-1]
            again = np.append(like_before, same[:-1]) | same if len(same) else same
            yield pa.RecordBatch.from_pydict({"no": no[:-1][again], "anchor": anchor[:-1][again]})
            if len(same):
                like_before = bool(same[-1])
            held = anchor[-1:], no[-1:]
        if held is not None:
            yield pa.RecordBatch.from_pydict({"no": held[1], "anchor": held[0]})

    ordered = anchors.repartitionByRange("anchor", "no").sortWithinPartitions("anchor", "no")
    return ordered.mapInArrow(neighbours, "no bigint, anchor bigint")


def spelled(numbers: np.ndarray, letters: int) -> str:
    """Each number as so many characters of a small alphabet, one after another."""
    shifts = np.arange(letters, dtype=np.int64) * LETTER_BITS
    codes = (numbers[:, None] >> shifts & LETTERS - 1) + FIRST_LETTER
    return codes.astype(np.uint8).tobytes().decode("latin-1")


def _automaton(shard: list[tuple]) -> tuple[list[str], int, object | None]:
    """The shard's documents spelled out, the letters of a word, and the automaton of their recurring phrases.

    Words of recurring phrases are numbered from 1, all others are 0. A word has as
    many letters as the numbers need, so any number of different words fits.
    """
    import ahocorasick

    places = []
    for _, hashes, phrases, wanted in shard:
        at = np.minimum(np.searchsorted(wanted, phrases), len(wanted) - 1)
        places.append(np.flatnonzero(wanted[at] == phrases))
    held = [hashes[np.add.outer(at, np.arange(PHRASE))].ravel() for (_, hashes, _, _), at in zip(shard, places, strict=True)]
    known = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]))
    letters = max(1, -(-len(known).bit_length() // LETTER_BITS))
    automaton, texts = ahocorasick.Automaton(ahocorasick.STORE_LENGTH), []
    for (_, hashes, _, _), starts in zip(shard, places, strict=True):
        at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
        numbers = np.where(known[at] == hashes, at + 1, 0) if len(known) else np.zeros(len(hashes), np.int64)
        text = spelled(numbers, letters)
        texts.append(text)
        width = PHRASE * letters
        for start in (letters * starts).tolist():
            automaton.add_word(text[start : start + width])
    if not len(automaton):
        return texts, letters, None
    automaton.make_automaton()
    return texts, letters, automaton


def occurrences(automaton, text: str, letters: int) -> np.ndarray:
    """First words of all phrases that an automaton finds in a spelled text."""
    ends = np.fromiter((end for end, _ in automaton.iter(text)), np.int64) + 1
    # a phrase that is found between the letters of words is none
    return ends[ends % letters == 0] // letters - PHRASE


def _candidates(shard: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Candidate windows of the shard's documents, each streamed through the shard's automaton."""
    texts, letters, automaton = _automaton(shard)
    if automaton is None:
        return
    top = np.uint64(2**64 - 1)
    width = WINDOW - PHRASE + 1
    for (no, hashes, phrases, _), text in zip(shard, texts, strict=True):
        found = occurrences(automaton, text, letters)
        if not len(found):
            continue
        known = np.zeros(len(phrases), bool)
        known[found] = True
        least = sliding_min(phrases, width)
        starts = np.flatnonzero(sliding_min(np.where(known, phrases, top), width) == least)
        if not len(starts):
            continue
        w = rolling(hashes, WINDOW, 0)[starts].view(np.int64)
        c = (rolling(hashes, WINDOW, 1)[starts] >> np.uint64(33)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(w), pa.array(c), pa.array(np.full(len(starts), no)), pa.array(starts.astype(np.int32))],
            names=[x.split()[0] for x in WINDOWS.split(", ")],
        )


def candidate_windows(texts: DataFrame) -> DataFrame:
    """From (no, text, anchors): hashes and places of windows whose anchor recurs."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size = [], 0
        for batch in batches:
            for no, text, anchors in zip(*batch.columns, strict=True):
                hashes = word_hashes(text.as_py().encode().split())
                wanted = np.unique(anchors.values.to_numpy().view(np.uint64))
                shard.append((no.as_py(), hashes, rolling(hashes, PHRASE, 2), wanted))
                size += len(text.as_py())
                if size >= SHARD_BYTES:
                    yield from _candidates(shard)
                    shard, size = [], 0
        yield from _candidates(shard)
        forget_words()

    return texts.mapInArrow(locate, WINDOWS)


def later_windows(windows: DataFrame) -> DataFrame:
    """(no, start) of windows with an equal one earlier; ``windows`` is stored.

    Whether the first row of a partition has an equal one before it shows in the
    last row of the partition before: one row of each per partition.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None

        def rows(kind, no, start, w=None, c=None):
            n = len(no)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(np.full(n, kind, np.int32)),
                    pa.array(no),
                    pa.array(start),
                    pa.nulls(n, pa.int64()) if w is None else pa.array(w),
                    pa.nulls(n, pa.int32()) if c is None else pa.array(c),
                ],
                names=[x.split()[0] for x in LATER.split(", ")],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            w, c, no, start = (batch.column(k).to_numpy() for k in range(4))
            if last is None:
                yield rows(1, no[:1], start[:1], w[:1], c[:1])
            else:
                w, c, no, start = (np.append(a, b) for a, b in zip(last, (w, c, no, start), strict=True))
            # a row that repeats, as documents may, is no earlier place
            moved = (no[1:] != no[:-1]) | (start[1:] != start[:-1])
            same = np.append(False, (w[1:] == w[:-1]) & (c[1:] == c[:-1]) & moved)
            yield rows(0, no[same], start[same])
            last = w[-1:], c[-1:], no[-1:], start[-1:]
        if last is not None:
            yield rows(2, last[2], last[3], last[0], last[1])

    keys = ["w", "c", "no", "start"]
    ranged = windows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    found = stored(ranged.mapInArrow(compare, LATER))
    edges = Window.orderBy("part", "kind")
    first = (
        found.where("kind > 0")
        .withColumn("before", F.lag(F.struct("w", "c", "no", "start")).over(edges))
        .where("kind = 1 AND w = before.w AND c = before.c")
        .where("no <> before.no OR start <> before.start")
    )
    return found.where("kind = 0").select("no", "start").union(first.select("no", "start"))


def kept_words(texts: DataFrame) -> DataFrame:
    """From (no, text, starts): (no, n_removed, kept_sha) after removing what the windows cover."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas = [], []
            for text, starts in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_py().encode().split()
                steps = np.zeros(len(words) + 1, np.int64)
                starts = np.array(starts.as_py(), np.int64)
                np.add.at(steps, starts, 1)
                np.add.at(steps, starts + WINDOW, -1)
                stays = np.cumsum(steps[:-1]) == 0
                removed.append(len(words) - int(stays.sum()))
                kept = b" ".join(w for w, stay in zip(words, stays.tolist(), strict=True) if stay)
                shas.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(shas, pa.string())],
                names=["no", "n_removed", "kept_sha"],
            )

    return texts.mapInArrow(cut, "no bigint, n_removed bigint, kept_sha string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    keyed = _keyed(docs, id_col, text_col)
    sets = stored(word_sequences(docs, id_col, text_col))
    one = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    firsts = sets.groupBy("seq").agg(F.min(one).alias("one"))
    firsts = firsts.selectExpr("seq", "one.doc_id AS first_id", "one.h AS first_h")
    firsts = stored(numbered(firsts, F.col("first_id").isNull(), F.col("first_id"), F.col("seq"), name="no"))

    same_first = F.expr("doc_id <=> first_id AND h = first_h")
    of_firsts = sets.where("size(anchors) > 0").join(firsts, "seq").where(same_first)
    anchors = of_firsts.select(F.explode("anchors").alias("anchor"), "no")
    found = stored(recurring(stored(anchors)))
    phrases = found.groupBy("no").agg(F.collect_set("anchor").alias("anchors"))
    wanted = stored(phrases.join(firsts, "no").select("no", "first_id", "first_h", "anchors"))

    def with_text(rows: DataFrame, *columns: str) -> DataFrame:
        return keyed.join(rows, same_first).select("no", "text", *columns)

    windows = stored(candidate_windows(with_text(wanted, "anchors")))
    starts = later_windows(windows).groupBy("no").agg(F.collect_set("start").alias("starts"))
    cuts = stored(starts.join(firsts, "no").select("no", "first_id", "first_h", "starts"))
    left = stored(kept_words(with_text(cuts, "starts"))).dropDuplicates(["no"])

    whole = F.expr(f"n_words >= {WINDOW} AND NOT (doc_id <=> first_id)")
    return (
        sets.select("doc_id", "n_words", "seq", "sha")
        .join(firsts.join(left, "no", "left"), "seq")
        .select(
            "doc_id",
            "n_words",
            F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        )
    )
