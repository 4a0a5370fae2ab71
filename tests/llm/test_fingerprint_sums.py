"""Fingerprints against a plain version of their sums."""

import hashlib
import math
import re
import struct
import time

import pytest
import xxhash
from conftest_llm import rows_of

from wardline.llm import fingerprints as P

END = r"\n|(?<=[.!?]) |(?<=[。！？])"


def spark_hash(text, number=None):
    value = xxhash.xxh64_intdigest(text.encode(), 42)
    if number is not None:
        value = xxhash.xxh64_intdigest(struct.pack("<i", number), value)
    return value - 2**64 if value >= 2**63 else value


def cut(text, space, run, around):
    """After each token whose hash is below those around it."""
    tokens = text.split(space) if space else list(text)
    hashes = []
    for i in range(len(tokens)):
        if run == 1:
            hashes.append(spark_hash(tokens[i]))
        else:
            start = max(i - (run - 2), 1) - 1
            # an array is hashed entry by entry
            value = 42
            for token in tokens[start : start + run]:
                value = xxhash.xxh64_intdigest(token.encode(), value)
            hashes.append(value - 2**64 if value >= 2**63 else value)
    out = []
    for i, token in enumerate(tokens):
        out.append(token)
        if around <= i < len(tokens) - (around + 1):
            near = hashes[i - around : i] + hashes[i + 1 : i + 1 + around]
            if all(hashes[i] < h for h in near):
                out[-1] += "\n"
    return space.join(out).split("\n")


def units(text):
    found = [s for s in re.split(END, text) if s]
    for most, how in (
        (P.SHORT, lambda x: cut(x, " ", 1, 3)),
        (P.LONG, lambda x: cut(x, "", 8, 16)),
        (P.LONG, lambda x: [x[k : k + P.LONG] for k in range(0, len(x), P.LONG)]),
    ):
        found = [p for s in found for p in ([s] if len(s) <= most else how(s))]
    return [u for u in found if u]


def plain(text):
    entries = [0] * (P.EXACT + P.SIGNS * P.BITS + 1)
    for line in text.split("\n"):
        if line:
            digest = hashlib.sha256(line.encode()).hexdigest()
            for k in range(P.EXACT):
                entries[k] = (entries[k] + (spark_hash(digest, k) & P.MASK)) & P.MASK
    found = units(text)
    for unit in found:
        for k in range(P.SIGNS):
            value = spark_hash(unit, k)
            for bit in range(P.BITS):
                entries[P.EXACT + P.BITS * k + bit] += (value >> bit & 1) + ((value >> bit + P.BITS & 1) << P.BITS)
    entries[-1] = len(found)
    return entries


def plain_likeness(a, b):
    if a == b:
        return 1.0

    def signed(x, y):
        return sum(
            (2 * (p >> s & P.FIELD) - x[-1]) * (2 * (q >> s & P.FIELD) - y[-1])
            for p, q in zip(x[P.EXACT : -1], y[P.EXACT : -1], strict=True)
            for s in (0, P.BITS)
        )

    norm = math.sqrt(signed(a, a)) * math.sqrt(signed(b, b))
    return min(1.0, max(0.0, signed(a, b) / norm)) if norm else 0.0


ODD = [
    "One. Two! Three? Four.",
    "No mark at all " * 40,
    "日本語の文。次の文！最後？" * 30,
    "a" * 700 + "bcd" * 200,
    "First line\n\nsecond. line\n" * 20,
    "Ends with a space. ",
    "。\n! .x. y",
    "word " * 2500,
    "é ß 日 " * 30 + "\n" + "tail. " * 50,
]


def test_sums_of_the_whole_query(spark, docs):
    rows = [(doc_id, text or "") for doc_id, text in rows_of(docs) if doc_id is not None and len(text or "") < 9000]
    rows += list(enumerate(ODD, 100))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in P.fingerprinted(table).collect()}
    ordered = sorted(set(rows))
    assert len(found) == len(ordered)
    for k, (doc_id, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        n = len(text)
        edited = text[: n - n // 4] + following[: n // 4]
        row = found[doc_id, n, hashlib.sha256(edited.encode()).hexdigest()]
        assert list(row.fingerprint) == plain(text), doc_id
        assert list(row.edited_fingerprint) == plain(edited), doc_id
        assert row.near_edited == pytest.approx(plain_likeness(plain(text), plain(edited)), abs=1e-9)
        assert row.near_next == pytest.approx(plain_likeness(plain(text), plain(following)), abs=1e-9)


def test_texts_of_many_units(spark):
    text = "".join(f"Sentence {k}. " for k in range(3000))
    row = P.fingerprint(spark.createDataFrame([(text,)], "text string"), "text", "fp").first()
    assert list(row.fp) == plain(text) and row.fp[-1] > 2 * P.CHUNK


def test_a_long_text_without_spaces(spark):
    began = time.time()
    texts = spark.createDataFrame([(1, "abcdefghij" * 200_000), (2, "word " * 400_000)], "doc_id bigint, text string")
    rows = P.fingerprinted(texts).collect()
    assert len(rows) == 2 and time.time() - began < 120
