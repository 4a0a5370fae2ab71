"""Alignment of two tokenizers over whole texts, and what their token pairs are worth in the corpus.

A text's tokens of both kinds cover the same bytes. Token ends that both kinds share cut them
into groups. Going along both end arrays at the current index shift, a one-to-one stretch is
measured by exponential probing: slices of doubled length are compared until one differs,
then halved. At the stretch's end an irregular group is resolved token by token, up to the
next shared end, and the shift becomes that of the ends found. Tokens of a group whose bytes
overlap are linked.

Counts over the corpus take two passes. The first handles texts in blocks of up to
``BLOCK_LINKS`` links and writes, beside a row per document, one row per block: the block's
different id pairs, how many of its documents link each, and the documents' pairs as places
in that list. Only the lists are shuffled to be summed, so a pair that nearly every document
holds costs a row per block. The second pass brings each block its counts back, by block.

Defined cases: a null or empty text, or one whose tokens of either kind do not spell it, has
no tokens, zeros, and an empty digest. Special strings in a text are plain text. Texts are used
whole, and one of any length is a block of its own. Repeated rows and rows with a null id are documents
of their own. Empty tables give empty results; only the id and text columns are read.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import ship, stored

#: links after which a block of texts is written
BLOCK_LINKS = 3_000_000
#: runs without white space, or of it, that one word encoder handles in more than linear time
LONG_RUN = re.compile(r"\S{1000}|\s{1000}")
#: an id's decimal digits, at most seven, so that a mark fits behind them
NAME = "S8"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")

ROWS = (
    "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint,"
    " groups_sha256 string, n_pairs int, pairs array<bigint>, n_docs array<int>, places binary"
)
NAMES = [c.strip().split()[0] for c in ROWS.split(",")]


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def may_hold_long_run(text: str) -> bool:
    """Whether a run of a thousand characters is possible, seen from pieces of half that length, then for certain."""
    for at in range(0, len(text) - 499, 500):
        if text.find(" ", at, at + 500) < 0 or text[at : at + 500].isspace():
            return LONG_RUN.search(text) is not None
    return False


class ByteLevelTokens:
    """A byte-level BPE file of the tokenizers library, without its special tokens.

    Where its merges are in the order of their ids, another public library encodes
    the same ids faster; very long words always go to the file's own library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        special = {token["id"] for token in spec.get("added_tokens", [])}
        vocabulary = spec["model"]["vocab"]
        self.bytes = [b""] * (max([*vocabulary.values(), *special]) + 1)
        for token, number in vocabulary.items():
            if number not in special:
                self.bytes[number] = bytes(letters[c] for c in token)
        self.fast = self._ranked(spec, vocabulary)

    def _ranked(self, spec: dict, vocabulary: dict[str, int]):
        import public_tokenizers
        import tiktoken

        from wardline.llm.tokens import GPT_PATTERN_KIND

        merges = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
        ordered = [vocabulary[m] for m in merges] == list(range(256, 256 + len(merges)))
        ordered = ordered and sorted(self.bytes[:256]) == [bytes([k]) for k in range(256)]
        plain = spec.get("normalizer") is None and spec.get("pre_tokenizer") == GPT_PATTERN_KIND
        if not ordered or not plain or spec["model"].get("ignore_merges"):
            return None
        ranks = {token: k for k, token in enumerate(self.bytes) if token}
        return tiktoken.Encoding(
            "ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def spells(self, ids: list[int], whole: bytes) -> bool:
        # every byte is a token and nothing is normalised: the tokens are the text
        return self.fast is not None or b"".join(map(self.bytes.__getitem__, ids)) == whole

    def encode(self, text: str) -> list[int]:
        if self.fast is None or may_hold_long_run(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceTokens:
    """A sentencepiece model; it puts a space before a text by itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes = []
        for number in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(number)
            byte = BYTE_PIECE.fullmatch(piece)
            self.bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())

    def spells(self, ids: list[int], whole: bytes) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids)) == whole

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


class Pair:
    """The two encoders of a worker, with what each id spells."""

    def __init__(self, a: ByteLevelTokens, b: PieceTokens):
        self.a, self.b = a, b
        for made in (a, b):
            made.lengths = np.array([len(token) for token in made.bytes], np.int64)
            made.names = np.array([str(k) for k in range(len(made.bytes))], NAME)

    def tokens(self, text: str):
        """(ids, ends, names) of both kinds; null where either does not spell the text."""
        whole, found = (" " + text).encode(), []
        for t, ids in ((self.a, self.a.encode(" " + text)), (self.b, self.b.encode(text))):
            at = np.array(ids, np.int64)
            ends = t.lengths[at].cumsum()
            if not ids or ends[-1] != len(whole) or not t.spells(ids, whole):
                return None
            found += [at, ends.tolist(), t.names[at]]
        return found


_TOKENS: dict[tuple[str, str], Pair] = {}


def both_tokens(path_a: str, path_b: str) -> Pair:
    """The worker's own encoders for two files, kept between tasks."""
    if (path_a, path_b) not in _TOKENS:
        _TOKENS[path_a, path_b] = Pair(ByteLevelTokens(path_a), PieceTokens(path_b))
    return _TOKENS[path_a, path_b]


#: a window this narrow is gone through one by one
NARROW = 4


def stretch(ends_a: list[int], ends_b: list[int], i: int, j: int) -> int:
    """How many tokens from i and j on end alike one by one."""
    limit = min(len(ends_a) - i, len(ends_b) - j)
    known, step = 0, NARROW
    while known + step <= limit and ends_a[i + known : i + known + step] == ends_b[j + known : j + known + step]:
        known += step
        step *= 2
    # the stretch ends within the next step
    while step > NARROW:
        step //= 2
        if known + step <= limit and ends_a[i + known : i + known + step] == ends_b[j + known : j + known + step]:
            known += step
    while known < limit and ends_a[i + known] == ends_b[j + known]:
        known += 1
    return known


def linked(ends_a: list[int], ends_b: list[int], names_a, names_b):
    """Stretches, links of irregular groups, the number of groups, and the groups as text.

    Stretches are (place in a, place in b, length) one after another, the links of
    irregular groups (place in a, place in b). Both arrays ascend and end alike, in the
    length of the text.
    """
    runs, links, cuts, groups = [], [], [], 0
    i = j = 0
    n = len(ends_a)
    while i < n:
        run = stretch(ends_a, ends_b, i, j)
        if run:
            runs += (i, j, run)
            groups += run
            i += run
            j += run
            if i == n:
                break
        # an irregular group, up to the next end that both share; the token that ends
        # first overlaps no further token of the other kind
        x, y = i, j
        end_a, end_b = ends_a[x], ends_b[y]
        links += (x, y)
        while end_a != end_b:
            if end_a < end_b:
                x += 1
                end_a = ends_a[x]
            else:
                y += 1
                end_b = ends_b[y]
            links += (x, y)
        groups += 1
        i, j = x + 1, y + 1
        cuts += (i, j)
    return runs, links, groups, groups_text(runs, cuts, names_a, names_b)


def groups_text(runs: list[int], cuts: list[int], names_a, names_b) -> str:
    """``a1,a2|b1;a3|b2,b3`` from stretches and the ends of irregular groups."""
    names = [np.asarray(x, NAME).view(np.uint64) for x in (names_a, names_b)]
    # groups ascend in both kinds, so either's ends in order are the groups' ends
    ends = [
        np.sort(np.concatenate([at + 1, np.array(cuts[k::2], np.int64)]))
        for k, at in enumerate(places(runs, []))
    ]
    # a group's tokens of a stand behind the tokens of b of all groups before it, those of b behind its own of a
    before = [np.append(0, ends[1])[:-1], ends[0]]
    spelled = np.zeros(len(names[0]) + len(names[1]), np.uint64)
    for k, last in enumerate("|;"):
        marks = np.full(len(names[k]), ord(",") << 56, np.uint64)
        marks[ends[k] - 1] = ord(last) << 56
        at = np.arange(len(marks)) + np.repeat(before[k], np.diff(ends[k], prepend=0))
        spelled[at] = names[k] | marks
    # a name's eight bytes are its digits, zeros, and the mark after it
    return spelled.tobytes().translate(None, b"\0")[:-1].decode()


def places(runs: list[int], links: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The places in a and in b of all links."""
    runs, links = (np.array(x, np.int64).reshape(-1, k) for x, k in ((runs, 3), (links, 2)))
    at = np.arange(runs[:, 2].sum()) - np.repeat(runs[:, 2].cumsum() - runs[:, 2], runs[:, 2])
    return tuple(np.concatenate([np.repeat(runs[:, k], runs[:, 2]) + at, links[:, k]]) for k in (0, 1))


class Block:
    """Documents whose pairs are written together."""

    def __init__(self, number: int):
        self.number, self.links = number, 0
        self.rows, self.codes, self.times = [], [], []

    def add(self, doc_id, text: str | None, both: Pair) -> None:
        row = [self.number, doc_id, 0, 0, 0, 0, "", 0, None, None, None]
        found = both.tokens(text) if text else None
        if found is not None:
            ids_a, ends_a, names_a, ids_b, ends_b, names_b = found
            runs, links, groups, spelled = linked(ends_a, ends_b, names_a, names_b)
            at_a, at_b = places(runs, links)
            codes, times = np.unique(ids_a[at_a] << 32 | ids_b[at_b], return_counts=True)
            self.codes.append(codes)
            self.times.append(times)
            self.links += len(at_a)
            digest = hashlib.sha256(spelled.encode()).hexdigest()
            row[2:8] = len(ids_a), len(ids_b), groups, len(at_a), digest, len(codes)
        self.rows.append(row)

    def batch(self) -> pa.RecordBatch:
        """The documents' rows, then the block's own: its pairs, and where the documents hold them."""
        none = np.zeros(0, np.int64)
        codes = np.concatenate([*self.codes, none])
        pairs, places = np.unique(codes, return_inverse=True)
        packed = pack(places, np.concatenate([*self.times, none]), [row[7] for row in self.rows])
        own = [self.number, None, None, None, None, None, None, None]
        counts = np.bincount(places, minlength=len(pairs)).astype(np.int32)
        rows = [*self.rows, [*own, pairs, counts, packed]]
        kinds = [pa.int64()] * 6 + [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)], NAMES
        )


def pack(places: np.ndarray, times: np.ndarray, sizes: list[int]) -> bytes:
    """Ascending places of each document as steps, and how often each pair occurs, compressed."""
    import zstandard

    steps = np.diff(places, prepend=0)
    starts = np.cumsum([0, *sizes])[:-1]
    starts = starts[np.array(sizes, bool)] if len(sizes) else starts
    steps[starts] = places[starts]
    raw = steps.astype("<u4").tobytes() + times.astype("<u4").tobytes()
    # bytes of one weight side by side compress better
    planes = np.frombuffer(raw, np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(planes)


def unpack(packed: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and times again, documents one after another."""
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    values = np.frombuffer(planes.reshape(4, -1).T.tobytes(), "<u4").astype(np.int64)
    steps, times = values[: len(values) // 2], values[len(values) // 2 :]
    total = np.cumsum(steps)
    sizes = sizes[sizes > 0]
    starts = np.cumsum([0, *sizes])[:-1]
    # what had been summed up before a document does not count in it
    return total - np.repeat(total[starts] - steps[starts], sizes), times


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, block_links: int) -> DataFrame:
    """A row per document and one per block (which has pairs and no counts of tokens), stored."""
    ship(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both = both_tokens(path_a, path_b)
        # lists of numbers hold no cycles, and there are many
        gc.disable()
        number = TaskContext.get().partitionId() << 33
        block = Block(number)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(doc_id, text.as_py(), both)
                if block.links >= block_links:
                    yield block.batch()
                    number += 1
                    block = Block(number)
        if block.rows:
            yield block.batch()

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(chosen.mapInArrow(measure, ROWS))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n_docs, best): documents that hold a pair linked, and whether no pair of its first id has more."""
    pairs = blocks.where("pairs IS NOT NULL").selectExpr("inline(arrays_zip(pairs, n_docs))").toDF("pair", "n")
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("n_docs"))
    # an id has at most as many partners as the other vocabulary has ids
    of_a = Window.partitionBy(F.expr("shiftright(pair, 32)"))
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(of_a))


def alignments(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_links: int = BLOCK_LINKS,
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    blocks = aligned_blocks(docs, path_a, path_b, id_col, text_col, block_links)
    counts = stored(pair_counts(blocks))
    held = blocks.where("pairs IS NOT NULL").selectExpr("block", "posexplode(pairs) AS (place, pair)")
    known = held.join(counts, "pair").select(F.col("block").alias("home"), "place", "n_docs", "best")
    rows = blocks.drop("pairs", "n_docs")

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.column("places").is_valid()
        listed, packed = left.filter(pc.invert(own)), left.filter(own)["places"][0].as_py()
        sizes = listed["n_pairs"].to_numpy().astype(np.int64)
        places, times = unpack(packed, sizes)
        place = right["place"].to_numpy()
        n_docs, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        n_docs[place] = right["n_docs"].to_numpy()
        best[place] = right["best"].to_numpy(zero_copy_only=False)
        document = np.repeat(np.arange(len(sizes)), sizes)
        sums = [np.zeros(len(sizes), np.int64) for _ in range(2)]
        np.add.at(sums[0], document, times * best[places])
        np.add.at(sums[1], document, times * n_docs[places])
        kept = listed.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        kept = kept.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))
        return kept.append_column("groups_sha256", listed["groups_sha256"])

    shape = (
        "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint,"
        " n_best bigint, count_sum bigint, groups_sha256 string"
    )
    return rows.groupBy("block").cogroup(known.groupBy("home")).applyInArrow(weigh, shape)
