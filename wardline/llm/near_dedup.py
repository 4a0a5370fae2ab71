"""Near-duplicates: b-bit MinHash signatures, a multi-index Hamming join, exact confirmation.

A document's set holds the hashes of its distinct five-word shingles. Documents
with equal sets are one node from the start. A node's signature has ``SLOTS``
slots of 14 bits; two nodes' distance is the number of slots that differ, on
average ``SLOTS * (1 - similarity)``. ``FURTHER`` slots of 4 bits follow, which
only sharpen the distance of pairs that have met.

The first part is split into 16 chunks of four slots. Of two signatures that
differ in at most ``DISTANCE`` = 31 of its slots some chunk differs in at most one
(2 * 16 > 31), so each node is filed under each chunk with each one of its slots
left out: 64 keys, and all pairs within the distance share one. A pair at a
similarity of 0.75 lies beyond it with a chance of 1.46e-5, at 0.6 of 7 in 100; those
beyond are still linked if they share a key. Pairs that have met are tested against
``whole_distance`` of all slots, which a pair at the similarity asked for exceeds
with a chance of at most ``MISS`` = 1e-12.

Pairs of a key are not enumerated:

1. Each node of a key is compared with one node only, its hub: the one that meets
   most others over all its keys; in a group of edited copies that is close to the
   original. Pairs within the distance are confirmed on whole texts, and
   confirmed links joined up to components. A hub's text is sent once for up to
   ``SLICE`` of its neighbours.
2. Keys whose nodes then belong to one component are done. Of the others, nodes
   that share too few shingles with all others left are done as well. The rest is
   written down by its differences from its hub: which of the hub's shingles it
   holds, as bits, and which shingles it has besides. Two nodes of one hub share the
   bits that both set and the further shingles that both have, so their exact
   similarity is known inside a join over hubs, after tests of sizes and distance, and
   only links come out of it, however many near misses a group holds.

So every pair that shares a key is linked, known to be in one component, or
compared. Components are found by alternating large-star and small-star steps.
Hot keys are counted with map-side aggregation, and Spark splits them in joins.

Defined cases: a null text counts as empty; texts without words have an empty set
and are linked with nothing. A text of fewer words than a shingle is one shingle.
A component's id is its smallest document id; null ids count only if there is no
other. Rows that repeat an id and its text are one document. Empty tables give
empty results. Only the id and text columns are read; texts are used whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import numbered, ship, stored

WORDS, SIMILARITY = 5, 75
SLOTS, CHUNK, LANE = 64, 4, 15
CHUNKS, DISTANCE = SLOTS // CHUNK, 2 * (SLOTS // CHUNK) - 1
#: more slots, of 4 bits in fields of 5, twelve to a long; they differ by chance 15 times of 16
FURTHER, FIELD, FIELDS = 192, 5, 12
#: chance that a pair at the threshold differs in more slots than its limit
MISS = 1e-12
#: shingles hashed to slots at once
BLOCK = 512
#: neighbours that a hub's text is sent for at once
SLICE = 256
#: words whose hashes a task keeps
WORD_HASHES = 100_000
#: the fields of a chunk, all bits but the top one of each, and the top ones
LOW_BITS = sum(0x3FFF << LANE * k for k in range(CHUNK))
TOP_BITS = sum(0x4000 << LANE * k for k in range(CHUNK))

LOW_FIELDS = sum(0xF << FIELD * k for k in range(FIELDS))
TOP_FIELDS = sum(0x10 << FIELD * k for k in range(FIELDS))

SETS = "doc_id bigint, h bigint, n_shingles bigint, node binary, sig array<bigint>"

_RANDOM = np.random.default_rng(20)
_STEPS = _RANDOM.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_FLIPS = _RANDOM.integers(0, 2**63, (SLOTS + FURTHER, 1), dtype=np.uint64)
_FACTORS = _RANDOM.integers(1, 2**63, (SLOTS + FURTHER, 1), dtype=np.uint64) | np.uint64(1)
_LANES = np.array([LANE * k for k in range(CHUNK)], np.uint64)
_FIELD_LANES = np.array([FIELD * k for k in range(FIELDS)], np.uint64)


class _WordHashes(dict):
    """Word -> 64-bit hash; forgets all when it gets large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_HASHES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()


def forget_words() -> None:
    """Free what a task has kept; the worker goes on to other tasks, of other operators."""
    _HASHES.clear()


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit sums (a public finaliser of hash functions)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles, A-Z in lower case."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    width = min(n, WORDS)
    sums = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        sums += hashes[k : n - width + 1 + k] * _STEPS[k]
    return np.unique(mixed_bits(sums))


def signature(hashes: np.ndarray) -> np.ndarray:
    """A long for each chunk, four fields of 15 bits with 14-bit slots; then the further slots."""
    least = np.full(SLOTS + FURTHER, 2**64 - 1, np.uint64)
    for start in range(0, len(hashes), BLOCK):
        values = (hashes[start : start + BLOCK] ^ _FLIPS) * _FACTORS
        least = np.minimum(least, values.min(axis=1))
    bits = mixed_bits(least)
    slots = (bits[:SLOTS] >> np.uint64(50)).reshape(CHUNKS, CHUNK) << _LANES
    further = (bits[SLOTS:] >> np.uint64(60)).reshape(-1, FIELDS) << _FIELD_LANES
    return np.concatenate([slots.sum(axis=1), further.sum(axis=1)]).astype(np.int64)


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its set's size, digest (null if empty) and signature."""
    ship(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, signatures = [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py())
                sizes.append(len(found))
                nodes.append(hashlib.md5(found.tobytes()).digest() if len(found) else None)
                signatures.append(signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.binary()),
                    pa.array(signatures, pa.list_(pa.int64())),
                ],
                names=[c.split()[0] for c in SETS.split(", ")],
            )
        forget_words()

    return _keyed(docs, id_col, text_col).mapInArrow(measure, SETS)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(
        f"CAST(`{id_col}` AS BIGINT) AS doc_id",
        f"xxhash64(coalesce(`{text_col}`, '')) AS h",
        f"coalesce(`{text_col}`, '') AS text",
    )


def distinct_sets(sets: DataFrame) -> DataFrame:
    """One row per distinct set, numbered in the order of the smallest id: no, low, h, n, node, sig."""
    one = F.struct(F.col("doc_id").isNull(), "doc_id", "h", "n_shingles", "sig")
    nodes = sets.where("node IS NOT NULL").groupBy("node").agg(F.min(one).alias("one"))
    nodes = nodes.select(
        "node",
        F.col("one.doc_id").alias("low"),
        F.col("one.h").alias("h"),
        F.col("one.n_shingles").alias("n"),
        F.col("one.sig").alias("sig"),
    )
    return stored(numbered(nodes, F.col("low").isNull(), F.col("low"), F.col("node"), name="no"))


def index_keys(nodes: DataFrame) -> DataFrame:
    """(key, tag, no): each chunk with each slot left out; the free field holds which it was, the tag."""
    chunks = nodes.select("no", F.posexplode(F.slice("sig", 1, CHUNKS)).alias("chunk", "bits"))
    variants = ", ".join(
        f"struct((bits & {~(0x7FFF << LANE * k)}L) | shiftleft(CAST(chunk * {CHUNK} + {k} AS BIGINT), {LANE * k}) AS key,"
        f" chunk * {CHUNK} + {k} AS tag)"
        for k in range(CHUNK)
    )
    return chunks.select("no", F.expr(f"inline(array({variants}))")).select("key", "tag", "no")


def distance(a: str, b: str) -> str:
    """The number of slots in which the first parts of two signatures differ, as an expression.

    In a field that differs, adding the largest slot value carries into its top bit.
    """
    return " + ".join(
        f"bit_count((({a}[{k}] ^ {b}[{k}]) + {LOW_BITS}L) & {TOP_BITS}L)" for k in range(CHUNKS)
    )


def further_distance(a: str, b: str) -> str:
    """The same of the further slots."""
    return " + ".join(
        f"bit_count((({a}[{k}] ^ {b}[{k}]) + {LOW_FIELDS}L) & {TOP_FIELDS}L)"
        for k in range(CHUNKS, CHUNKS + FURTHER // FIELDS)
    )


def whole_distance(similarity: int) -> int:
    """Slots that may differ: a pair of this similarity exceeds them with a chance of ``MISS`` at most."""
    chances = np.ones(1)
    for slots, bits in ((SLOTS, 14), (FURTHER, 4)):
        differs = (1 - similarity / 100) * (1 - 0.5**bits)
        for _ in range(slots):
            chances = np.convolve(chances, [1 - differs, differs])
    beyond = np.append(np.cumsum(chances[::-1])[::-1][1:], 0.0)
    return int(np.argmax(beyond <= MISS))


def may_link(a: str, b: str, similarity: int) -> str:
    """Sizes that allow the similarity, and signatures within its distance."""
    sizes = f"100 * least({a}.n, {b}.n) >= {similarity} * greatest({a}.n, {b}.n)"
    near, further = (f(f"{a}.sig", f"{b}.sig") for f in (distance, further_distance))
    return f"{sizes} AND {near} + {further} <= {whole_distance(similarity)}"


def within_distance(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) of node numbers that pass ``may_link``."""
    marks = nodes.select("no", "n", "sig")
    return (
        pairs.join(marks.selectExpr("no AS a", "struct(n, sig) AS x"), "a")
        .join(marks.selectExpr("no AS b", "struct(n, sig) AS y"), "b")
        .where(may_link("x", "y", similarity))
        .select("a", "b")
    )


def texts_of(nodes: DataFrame, keyed: DataFrame) -> DataFrame:
    """(no, text), stored, of one document for each node (no, low, h).

    The list of nodes grows with the documents, so it is never broadcast.
    """
    wanted = nodes.select("no", F.col("low").alias("_low"), F.col("h").alias("_h"))
    found = keyed.join(wanted.hint("merge"), F.expr("doc_id <=> _low AND h = _h"))
    return stored(found.select("no", "text").dropDuplicates(["no"]))


def beside_hubs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """From (hub, no): rows (hub, place, no, text), the hub's own at place 0 before a slice of neighbours.

    Partitions hold whole slices, in order.
    """
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    dealt = pairs.join(sizes, "hub").select(
        "hub", F.expr("CAST(pmod(xxhash64(no, 6), slices) AS INT) AS slice"), "no"
    )
    heads = dealt.select("hub", "slice").distinct().select("hub", "slice", F.col("hub").alias("no"))
    both = dealt.withColumn("place", F.lit(1)).unionByName(heads.withColumn("place", F.lit(0)))
    rows = both.join(texts, "no").repartition("hub", "slice")
    return rows.sortWithinPartitions("hub", "slice", "place").select("hub", "place", "no", "text")


def confirmed(pairs: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """Of pairs (hub, no) those whose whole sets are similar enough, as (a, b)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            linked = []
            for hub, place, no, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                found = shingles(text.as_py())
                if not place:
                    known = found
                    continue
                common = len(np.intersect1d(known, found, assume_unique=True))
                if 100 * common >= similarity * (len(known) + len(found) - common):
                    linked.append((min(hub, no), max(hub, no)))
            yield pa.RecordBatch.from_pydict({"a": [x for x, _ in linked], "b": [x for _, x in linked]}, LINKS)
        forget_words()

    LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return stored(beside_hubs(pairs, texts).mapInArrow(check, "a bigint, b bigint"))


def differences(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (hub, no): (hub, no, bits, more): the hub's shingles that the node holds, and its others."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            rows = []
            for hub, place, no, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                found = shingles(text.as_py())
                if not place:
                    known = found
                    continue
                held = np.isin(known, found, assume_unique=True)
                bits = np.zeros(-(-len(known) // 64) * 64, bool)
                bits[: len(known)] = held
                more = np.setdiff1d(found, known, assume_unique=True)
                rows.append((hub, no, np.packbits(bits, bitorder="little").view(np.int64), more.view(np.int64)))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["hub", "no", "bits", "more"]
            )

    shape = "hub bigint, no bigint, bits array<bigint>, more array<bigint>"
    return stored(beside_hubs(pairs, texts).mapInArrow(compare, shape))


def common(a: str, b: str) -> str:
    """How many shingles two nodes of one hub share, as an expression."""
    bits = f"aggregate(zip_with({a}.bits, {b}.bits, (p, q) -> bit_count(p & q)), 0, (s, n) -> s + n)"
    return f"({bits} + size(array_intersect({a}.more, {b}.more)))"


def shared_sizes(texts: DataFrame) -> DataFrame:
    """(no, shared): how many shingles of each text occur in another of the texts too.

    Shingles are sorted over range partitions; those with an equal neighbour are
    counted. At the edges of a partition a shingle counts without knowing, which
    only raises the bound.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingles(text.as_py()).view(np.int64)
                yield pa.RecordBatch.from_pydict({"shingle": found, "no": np.full(len(found), no)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            shingle, no = (batch.column(k).to_numpy() for k in (0, 1))
            same = shingle[1:] == shingle[:-1]
            # the first row of a batch may equal the last one before, the last row the next
            again = np.append(True, same) | np.append(same, True)
            counted, times = np.unique(no[again], return_counts=True)
            yield pa.RecordBatch.from_pydict({"no": counted, "shared": times})

    rows = stored(texts.mapInArrow(explode, "shingle bigint, no bigint"))
    ranged = rows.repartitionByRange("shingle", "no").sortWithinPartitions("shingle", "no")
    counts = ranged.mapInArrow(count, "no bigint, shared bigint")
    return counts.groupBy("no").agg(F.sum("shared").alias("shared"))


def components(edges: DataFrame) -> DataFrame:
    """(no, root) for every node with an edge (a, b): root is the smallest node of its component."""
    now = stored(edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u > v").distinct())
    state = None
    while True:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        # large star: larger neighbours go to the smallest neighbour
        large = both.join(least, "u").where("v > u").selectExpr("v AS u", "m AS v").distinct()
        large = stored(large.where("u > v"))
        # small star: smaller neighbours and the node go to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").selectExpr("v AS u", "m AS v")
        now = stored(small.union(least).distinct())
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if seen == state:
            return now.toDF("no", "root")
        state = seen


def similar_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: int = SIMILARITY,
) -> DataFrame:
    """One row per document: doc_id, h (of its text), n_shingles, component_id, kept."""
    sets = stored(shingle_sets(docs, id_col, text_col))
    nodes = distinct_sets(sets)
    keyed = _keyed(docs, id_col, text_col)
    keys = index_keys(nodes)
    sizes = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    filed = stored(keys.join(sizes, "key").select("key", "tag", "no", "c"))
    meets = filed.groupBy("no").agg(F.sum("c").alias("meets"))
    filed = stored(filed.join(meets, "no").select("key", "tag", "no", "meets"))
    texts = texts_of(nodes.join(filed.select("no").distinct(), "no"), keyed)

    hubs = filed.groupBy("key").agg(F.max(F.struct("meets", F.expr("-no AS no"))).alias("top"))
    starred = filed.join(hubs.selectExpr("key", "-top.no AS hub"), "key").select("key", "no", "hub")
    starred = stored(starred)
    pairs = starred.where("no <> hub").selectExpr("hub AS a", "no AS b").distinct()
    pairs = within_distance(pairs, nodes, similarity).toDF("hub", "no")
    links = confirmed(pairs, texts, similarity)
    roots = components(links)

    # keys that still hold several components
    placed = stored(starred.join(roots, "no", "left").select("key", "hub", "no", F.coalesce("root", "no").alias("root")))
    open_keys = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"))
    left = placed.join(open_keys.where("r0 < r1").select("key"), "key", "left_semi")
    left = stored(left.select("hub", "no", "root").distinct())
    shared = stored(shared_sizes(texts.join(left.select("no").distinct(), "no", "left_semi")))
    # a node that shares too little with all others can be linked with none of them
    enough = nodes.join(shared, "no").where(f"100 * shared >= {similarity} * n").select("no", "n", "sig", "shared")
    left = left.join(enough, "no")
    several = left.groupBy("hub").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1")
    left = stored(left.join(several.select("hub"), "hub", "left_semi"))
    left = stored(left.join(differences(left.select("hub", "no"), texts), ["hub", "no"]))
    x, y = left.alias("x"), left.alias("y")
    both = "least(x.shared, y.shared)"
    more = x.join(
        y,
        F.expr(
            f"x.hub = y.hub AND x.no < y.no AND x.root <> y.root"
            f" AND 100 * {both} >= {similarity} * (x.n + y.n - {both}) AND {may_link('x', 'y', similarity)}"
            f" AND {100 + similarity} * {common('x', 'y')} >= {similarity} * (x.n + y.n)"
        ),
    )
    links = links.union(stored(more.selectExpr("x.no AS a", "y.no AS b")))
    roots = components(links)

    names = nodes.join(roots, "no", "left").select("node", "low", F.coalesce("root", "no").alias("root"))
    lows = nodes.select(F.col("no").alias("root"), F.col("low").alias("component_id"))
    names = names.join(lows, "root").select("node", "component_id")
    return (
        sets.select("doc_id", "h", "n_shingles", "node")
        .join(names, "node", "left")
        .withColumn("component_id", F.expr("CASE WHEN node IS NULL THEN doc_id ELSE component_id END"))
        .select("doc_id", "h", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))
    )
