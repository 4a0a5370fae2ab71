"""Document fingerprints: homomorphic multiset hashes of paragraphs.

A paragraph (a line that is not empty) is hashed to a wide vector, and a
document's fingerprint is the sum of its paragraphs' vectors, each entry modulo
2^60. So the order of paragraphs does not matter, and the fingerprint after
inserting or deleting a paragraph follows from the old one and the paragraph
(``inserted``, ``deleted``).

The vector has three parts:

* ``EXACT`` entries drawn from the SHA-256 of the paragraph; equal sums mean equal
  multisets of paragraphs;
* ``SIGNS`` hashes of 60 bits of each of its units, two bits to an entry and 30 bits
  apart, so that an entry counts, for each of its bits, in how many units the bit is
  set (a string of Spark's has fewer than 2^30 units, so no count carries over);
* the number of its units.

A unit is a sentence of up to ``SHORT`` characters or a piece of a longer one. Such a
sentence is cut after words whose hash is less than those of the three words before
and after it, so pieces have four words at least, and an edit changes only those near
it. Pieces without enough words (scripts without spaces, long strings) are cut in the
same way by the hashes of their runs of characters, and what repeats itself so much
that this leaves it long, every ``LONG`` characters.

A text and its edited text have their sentences up to the last end before the edit in common. Their
sums are worked out once, and to them are added those of the old rest and of the new
one: units lie within sentences, so the sums of both parts together are the whole's.

Counts are added in fields of ten bits first, six to a long, for at most ``CHUNK`` units
at a time, and then in the fields of 30 bits.

Counted as plus and minus one, the bits are random signs, and the cosine of two
documents' sums of signs is near the share of units that they have in common
(standard error about 1 / sqrt(180)). ``likeness`` is that cosine, 0 if it is
negative, and exactly 1 for equal sums.

Defined cases: a null text counts as empty; empty texts have the zero vector, are
alike with likeness 1 and unlike all others with 0. Null ids come first in the
order; rows that repeat an id and text are one document whose result each of them
gets. A document that is alone is its own next one. An empty table gives an empty
result. Only the id and text columns are read. DataFrame functions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import ordered, stored

EXACT, SIGNS, BITS = 8, 3, 30
MASK = (1 << 60) - 1
#: documents whose fingerprints one window holds
BLOCK = 2048
FIELD = (1 << BITS) - 1
#: narrow fields for few units: their bits, the first bit of each, the units that cannot overflow one
NARROW = 10
NARROW_BITS = sum(1 << NARROW * k for k in range(2 * BITS // NARROW))
CHUNK = (1 << NARROW) - 1
#: characters of a sentence that is one unit, and the most of a piece
SHORT, LONG = 64, 128
SENTENCE_END = r"\n|(?<=[.!?]) |(?<=[。！？])"


def _cut(text: str, space: str, run: int, around: int) -> str:
    """SQL: ``text`` in pieces, cut after a local minimum of the hashes of ``run`` tokens.

    Tokens lie between ``space``; the hash is less than the ``around`` ones on either side.
    """
    tokens = "w" if run == 1 else f"slice(ws, greatest(i - {run - 2}, 1), {run})"
    hashes = f"transform(ws, (w, i) -> xxhash64({tokens}))"
    least = (
        f"i >= {around} AND i < size(ws) - {around + 1} AND hs[i] < hs[i - 1] AND hs[i] < hs[i + 1]"
        f" AND hs[i] < array_min(slice(hs, i - {around - 1}, {around}))"
        f" AND hs[i] < array_min(slice(hs, i + 2, {around}))"
    )
    marked = f"array_join(transform(ws, (w, i) -> IF({least}, concat(w, '\\n'), w)), '{space}')"
    # arrays of one entry stand for names of what is used more than once
    marked = f"transform(array({hashes}), hs -> {marked})[0]"
    return f"split(transform(array(split({text}, '{space}')), ws -> {marked})[0], r'\\n')"


def _units(sentences: str) -> str:
    """SQL: sentences or their pieces, none of them long."""
    steps = [
        (SHORT, _cut("x", " ", 1, 3)),
        (LONG, _cut("x", "", 8, 16)),
        (LONG, rf"split(x, r'(?s)(?<=\G.{{{LONG}}})')"),
    ]
    for most, pieces in steps:
        sentences = f"flatten(transform({sentences}, x -> IF(char_length(x) <= {most}, array(x), {pieces})))"
    return f"filter({sentences}, x -> x <> '')"


def exact_sums(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """``df`` with the ``EXACT`` entries of the lines of ``text_col``, as an array."""
    lines = f"filter(split(`{text_col}`, r'\\n'), x -> x <> '')"
    entries = [
        f"aggregate(_lines, 0L, (a, x) -> (a + (xxhash64(x, {k}) & {MASK}L)) & {MASK}L)" for k in range(EXACT)
    ]
    hashed = df.withColumn("_lines", F.expr(f"transform({lines}, x -> sha2(x, 256))"))
    return hashed.withColumn(name, F.expr(f"array({', '.join(entries)})")).drop("_lines")


def sign_sums(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """``df`` with the entries of the units of ``text_col`` and their number, as an array."""
    sentences = f"filter(split(`{text_col}`, r'{SENTENCE_END}'), x -> x <> '')"
    # units, hashes and narrow sums in steps of their own: each is used by many entries
    steps = df.withColumn("_units", F.expr(_units(sentences)))
    hashes = [
        f"transform(sequence(0, greatest(size(_units) - 1, 0) div {CHUNK}),"
        f" c -> transform(slice(_units, c * {CHUNK} + 1, {CHUNK}), x -> xxhash64(x, {k})))"
        for k in range(SIGNS)
    ]
    steps = steps.withColumns({f"_chunks_{k}": F.expr(text) for k, text in enumerate(hashes)})
    narrow = {
        f"_narrow_{k}_{low}": F.expr(
            f"transform(_chunks_{k}, c -> aggregate(c, 0L, (a, x) -> a + (shiftright(x, {low}) & {NARROW_BITS}L)))"
        )
        for k in range(SIGNS)
        for low in range(NARROW)
    }
    steps = steps.withColumns(narrow)
    entries = []
    for k in range(SIGNS):
        for bit in range(BITS):
            at, low = divmod(bit, NARROW)
            first, second = NARROW * at, BITS + NARROW * at
            entries.append(
                f"aggregate(_narrow_{k}_{low}, 0L, (a, x) -> a + (shiftright(x, {first}) & {CHUNK}L)"
                f" + shiftleft(shiftright(x, {second}) & {CHUNK}L, {BITS}))"
            )
    entries.append("CAST(size(_units) AS BIGINT)")
    made = ["_units", *(f"_chunks_{k}" for k in range(SIGNS)), *narrow]
    return steps.withColumn(name, F.expr(f"array({', '.join(entries)})")).drop(*made)


def fingerprint(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of ``text_col`` as an array of longs."""
    rows = sign_sums(exact_sums(df, text_col, "_exact"), text_col, "_signs")
    return rows.withColumn(name, F.concat("_exact", "_signs")).drop("_exact", "_signs")


def fingerprint_pair(df: DataFrame, text: str, edited: str, common: str, names: tuple[str, str]) -> DataFrame:
    """``df`` with the fingerprints of two texts whose first ``common`` characters are the same.

    The units of the common sentences are hashed and summed once.
    """
    # up to the end of the last sentence that ends among the common characters
    head = rf"regexp_extract(substring(`{text}`, 1, CAST({common} AS INT)), r'(?s)^.*(?:{SENTENCE_END})', 0)"
    rows = df.withColumn("_head", F.expr(head)).withColumns(
        {
            "_rest": F.expr(f"substring(`{text}`, char_length(_head) + 1)"),
            "_new": F.expr(f"substring(`{edited}`, char_length(_head) + 1)"),
        }
    )
    for part in ("_head", "_rest", "_new"):
        rows = sign_sums(rows, part, f"{part}_signs")
    for name, whole, rest in zip(names, (text, edited), ("_rest", "_new"), strict=True):
        rows = exact_sums(rows, whole, "_exact")
        signs = inserted(F.col("_head_signs"), F.col(f"{rest}_signs"))
        rows = rows.withColumn(name, F.concat("_exact", signs)).drop("_exact")
    return rows.drop("_head", "_rest", "_new", "_head_signs", "_rest_signs", "_new_signs")


def inserted(fingerprints: Column, more: Column) -> Column:
    """The fingerprint of both multisets together."""
    return F.zip_with(fingerprints, more, lambda a, b: (a + b).bitwiseAND(F.lit(MASK)))


def deleted(fingerprints: Column, less: Column) -> Column:
    """The fingerprint without the paragraphs of ``less``."""
    return F.zip_with(fingerprints, less, lambda a, b: (a - b).bitwiseAND(F.lit(MASK)))


def as_text(fingerprints: str) -> Column:
    """Fixed-width hex of the entries."""
    return F.expr(f"lower(array_join(transform(`{fingerprints}`, x -> lpad(hex(x), 15, '0')), ''))")


def _signed(name: str, other: str) -> str:
    """Sum over all bits of the products of the sums of signs."""
    na, nb = f"`{name}`[{EXACT + SIGNS * BITS}]", f"`{other}`[{EXACT + SIGNS * BITS}]"
    terms = " + ".join(
        f"(2 * (shiftright(a, {s}) & {FIELD}L) - {na}) * (2 * (shiftright(b, {s}) & {FIELD}L) - {nb})"
        for s in (0, BITS)
    )
    part = f"{EXACT + 1}, {SIGNS * BITS}"
    products = f"zip_with(slice(`{name}`, {part}), slice(`{other}`, {part}), (a, b) -> CAST({terms} AS DOUBLE))"
    return f"aggregate({products}, 0D, (a, x) -> a + x)"


def likeness(name: str, other: str) -> Column:
    """0 to 1, of two columns of fingerprints."""
    dot, left, right = _signed(name, other), _signed(name, name), _signed(other, other)
    return F.expr(
        f"CASE WHEN `{name}` = `{other}` THEN 1D"
        f" ELSE coalesce(least(1D, greatest(0D, ({dot}) / nullif(sqrt({left}) * sqrt({right}), 0D))), 0D) END"
    )


def with_next(keyed: DataFrame) -> DataFrame:
    """From rows (doc_id, h, n): one per (doc_id, h), its place g from 0, next_id and next_h.

    Ascending; the first follows the last.
    """
    rows = ordered(keyed.distinct(), "doc_id", "h")
    parts = rows.groupBy("_part").agg(
        F.count("*").alias("_n"), F.min_by(F.struct("doc_id", "h"), "_pos").alias("head")
    )
    # one row per partition
    all_parts, first = Window.orderBy("_part"), Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.select(
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_n").over(first) - F.col("_n"), F.lit(0)).alias("before"),
        F.coalesce(F.lead("head").over(all_parts), F.first("head").over(first)).alias("after"),
    )
    here = Window.partitionBy("_part").orderBy("_pos")
    following = F.lead(F.struct("doc_id", "h")).over(here)
    rows = rows.withColumn("next", following).join(parts, F.col("_part") == F.col("_p"))
    following = F.coalesce("next", "after")
    return stored(
        rows.select(
            "doc_id",
            "h",
            "n",
            (F.col("before") + F.col("_pos")).alias("g"),
            following["doc_id"].alias("next_id"),
            following["h"].alias("next_h"),
        )
    )


def edited_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, text, edited, n, g: the last quarter replaced by the next text's beginning.

    Whole texts are shuffled once; the beginnings, a quarter of that, once more.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    following = with_next(texts.select("doc_id", "h", F.char_length("text").cast("bigint").alias("n")))
    wanted = following.select(
        F.col("doc_id").alias("own_id"), F.col("h").alias("own_h"), "next_id", "next_h", F.expr("n div 4 AS k")
    )
    same = lambda a, b: F.col(a[0]).eqNullSafe(F.col(b[0])) & (F.col(a[1]) == F.col(b[1]))
    begins = (
        texts.join(wanted, same(("doc_id", "h"), ("next_id", "next_h")))
        .select("own_id", "own_h", F.expr("substring(text, 1, CAST(k AS INT)) AS begin"))
        .groupBy("own_id", "own_h")
        .agg(F.max("begin").alias("begin"))
    )
    places = following.select(F.col("doc_id").alias("p_id"), F.col("h").alias("p_h"), "n", "g")
    return (
        texts.join(begins, same(("doc_id", "h"), ("own_id", "own_h")))
        .join(places, same(("doc_id", "h"), ("p_id", "p_h")))
        .select(
            "doc_id",
            "h",
            "text",
            F.expr("concat(substring(text, 1, CAST(n - n div 4 AS INT)), begin)").alias("edited"),
            "n",
            "g",
        )
    )


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, and their likenesses.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (arrays),
    near_edited, near_next.
    """
    rows = edited_texts(docs, id_col, text_col)
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    rows = fingerprint_pair(rows, "text", "edited", "n - n div 4", ("fp", "efp")).drop("text", "edited")
    rows = stored(rows)
    # the next document's fingerprint: blocks of places, each with a copy of the next block's first
    total = (rows.agg(F.max("g")).first()[0] or 0) + 1
    block, own = F.expr(f"g div {BLOCK}").alias("block"), [rows[c] for c in rows.columns]
    place = F.expr(f"IF(g = 0, {total}, g)")
    heads = rows.where(f"g % {BLOCK} = 0").select("fp", place.alias("g")).dropDuplicates(["g"])
    heads = heads.withColumn("block", F.expr(f"(g - 1) div {BLOCK}"))
    # from the end backwards, the last row so far with a higher place (repeated rows share one)
    back = Window.partitionBy("block").orderBy(F.desc("g"))
    both = rows.select(*own, block, F.lit(True).alias("_real")).unionByName(heads, allowMissingColumns=True)
    both = both.withColumn("next_fp", F.last("fp").over(back.rangeBetween(Window.unboundedPreceding, -1)))
    return both.where("_real").select(
        "doc_id",
        F.col("n").alias("n_chars"),
        "edited_sha256",
        F.col("fp").alias("fingerprint"),
        F.col("efp").alias("edited_fingerprint"),
        likeness("fp", "efp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
    )
