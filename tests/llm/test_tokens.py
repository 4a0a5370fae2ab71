"""Encoders, token files and packing."""

import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest_llm import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from wardline.llm import packing, token_files
from wardline.llm.common import scratch_dir
from wardline.llm.queries import tokenizer_path
from wardline.llm.tokens import Encoder

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
ENCODERS = {name: Encoder(tokenizer_path(name)) for name in FILES}

PIECES = ["a", "Word", "naïve", "ÉÈ", "don't", "'s", "...", "?!,", " ", "  ", "\n", "\t", "\x1c", "\xa0", "1", "23", "x9",
          "日本", "é", "́", "İ", "ß", "Σ", "ǅ", "<|endoftext|>", "_", "²", " ", "\r\n", "ſ"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12), st.sampled_from(FILES))
def test_words_encode_as_whole_texts(parts, name):
    text = "".join(parts)
    assert ENCODERS[name].encode(text) == ENCODERS[name].whole(text)


def plain_ids(name, text, end):
    return np.frombuffer(ENCODERS[name].whole(text or ""), "<u4").tolist() + [end]


@pytest.fixture(scope="module")
def written(spark, docs):
    folder = scratch_dir(spark)
    return folder, token_files.write_token_files(docs, folder, tokenizer_path(FILES[0]))


def test_files_hold_all_documents_in_order(docs, written):
    _, manifest = written
    found = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    at = 0
    got = defaultdict(list)
    for row in found:
        assert row.start == at
        at += row.n_tokens
        got[row.doc_id].append((row.n_tokens, row.ids_crc32))
    want = defaultdict(list)
    for doc_id, text in rows_of(docs):
        ids = plain_ids(FILES[0], text, 2)
        want[doc_id].append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_wanted_documents_only(spark, docs, written):
    _, manifest = written
    wanted = spark.createDataFrame([(3,), (13,), (8,), (999,)], "doc_id long")
    found = token_files.read_documents(spark, manifest, wanted).collect()
    texts = defaultdict(list)
    for doc_id, text in rows_of(docs):
        texts[doc_id].append(plain_ids(FILES[0], text, 2))
    assert sorted((r.doc_id, r.ids) for r in found) == sorted((k, x) for k in (3, 8, 13) for x in texts[k])


def test_files_are_standard_frames_and_checked(written, tmp_path):
    import io

    import zstandard

    class Source(io.BytesIO):
        def size(self):
            return len(self.getbuffer())

    _, manifest = written
    files, path = token_files.open_folder(manifest.first()["path"])
    with files.open_input_file(path) as file:
        data = file.read()
    reader = token_files.FrameReader(Source(data))
    whole = b"".join(reader.ids(k).astype("<u2").tobytes() for k in range(len(reader.counts)))
    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)
    assert stream.read(len(whole)) == whole
    broken = bytearray(data)
    row = int(np.argmax(reader.counts))
    broken[int(reader.starts[reader.first_frames[row]]) + 12] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.FrameReader(Source(bytes(broken))).ids(row)


def test_long_documents_have_several_frames():
    import io

    class Source(io.BytesIO):
        def size(self):
            return len(self.getbuffer())

    out = io.BytesIO()
    writer = token_files.FrameWriter(out, 2)
    ids = np.arange(3 * token_files.FRAME_IDS + 5, dtype=np.uint32) % 50_000
    writer.add(5, ids)
    writer.add(None, ids[:0])
    writer.finish()
    reader = token_files.FrameReader(Source(out.getvalue()))
    assert len(reader.seek) == 4 and (reader.ids(0) == ids).all() and not len(reader.ids(1))


def test_packing(docs):
    pieces = packing.token_pieces(docs, tokenizer_path(FILES[1]), capacity=64)
    found = packing.packed(docs, tokenizer_path(FILES[1]), capacity=64).collect()
    assert pieces.count() == len(found)
    sequences, documents = defaultdict(list), defaultdict(list)
    for row in found:
        sequences[row.sequence_id].append((row.offset, row.length))
        documents[row.doc_id].append(row)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(row.length for row in found)
    assert len(sequences) == -(-total // 64)
    for doc_id, text in set(rows_of(docs)):
        ids = plain_ids(FILES[1], text, 0)
        rows = documents[doc_id]
        copies = sum(row.piece == 0 for row in rows)
        assert sum(row.length for row in rows) == copies * len(ids)
        for row in rows:
            part = ids[row.start : row.start + row.length]
            assert row.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            assert row.length == 64 or row.piece == 0


def test_fullest_is_the_best_subset():
    from itertools import product

    rng = np.random.default_rng(2)
    for _ in range(200):
        counts = np.zeros(41, int)
        for length in rng.integers(1, 41, 4):
            counts[length] += rng.integers(1, 4)
        room = int(rng.integers(1, 41))
        lengths = np.flatnonzero(counts)
        sums = {sum(n * x for n, x in zip(lengths, some, strict=True)) for some in product(*(range(counts[n] + 1) for n in lengths))}
        taken = packing.fullest(counts, room)
        assert all(counts[n] >= many for n, many in taken.items())
        assert sum(n * many for n, many in taken.items()) == max(s for s in sums if s <= room)


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(6)
    histogram = {int(n): int(rng.integers(1, 50)) for n in rng.integers(1, 65, 40)}
    plan = packing.packing_plan(histogram, 64)
    used = defaultdict(list)
    for length, first, last, *_ in plan:
        used[length].append((first, last))
    for length, spans in used.items():
        at = 0
        for first, last in sorted(spans):
            assert first == at
            at = last
        assert at == histogram[length]


def test_empty(spark, no_docs):
    assert packing.packed(no_docs, tokenizer_path(FILES[1])).collect() == []
    manifest = token_files.write_token_files(no_docs, scratch_dir(spark), tokenizer_path(FILES[0]))
    assert token_files.read_token_files(manifest).collect() == []
