"""Every operator on texts of some megabytes: with words, without spaces, of one character."""

import hashlib

import pytest
from conftest import SCHEMA

from wardline.llm import (
    exact_dedup,
    fingerprints,
    mixing,
    near_dedup,
    packing,
    quality,
    secrets_scan,
    sharding,
    substring_dedup,
    token_alignment,
    token_files,
)
from wardline.llm.common import scratch_dir
from wardline.llm.queries import tokenizer_path

WORDS = " ".join(f"word{k % 5003} of{k % 17}" for k in range(150_000)) + ".\n"
TEXTS = [WORDS, WORDS + "and more", "ab9Z" * 500_000, "x" * 1_000_000, "日本" * 200_000, "short text here"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, t, "en", f"s{k % 2}", len(t), None, None, None) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def by_id(df):
    rows = {r.doc_id: r for r in df.collect()}
    assert sorted(rows) == list(range(len(TEXTS)))
    return rows


def test_rows_of_one_document(table):
    rows = by_id(secrets_scan.scan_secrets(table))
    assert rows[5].spans == "" and rows[3].n_hex == 0
    mix = by_id(mixing.mixed(table))
    assert mix[0].size == 300_000 and mix[2].size == 1
    shards = by_id(sharding.contiguous_shards(table))
    assert shards[2].size == 2_000_001
    prints = by_id(fingerprints.fingerprinted(table))
    assert prints[0].n_chars == len(WORDS) and prints[0].near_next > 0.99


def test_copies(table):
    exact = by_id(exact_dedup.exact_duplicates(table))
    assert all(r.kept for r in exact.values())
    near = by_id(near_dedup.similar_components(table))
    assert near[1].component_id == 0 and near[2].component_id == 2
    assert near[3].n_shingles == 1
    left = by_id(substring_dedup.without_repeats(table))
    assert left[1].n_removed > 299_000 and left[2].n_removed == 0
    assert left[5].kept_sha256 == hashlib.sha256(TEXTS[5].encode()).hexdigest()


def test_quality(spark, table):
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id bigint, quality int")
    assert all(0 <= r.score <= 1 for r in by_id(quality.quality_scores(table, labels)).values())


def test_tokens(spark, table):
    manifest = token_files.write_token_files(table, scratch_dir(spark), tokenizer_path("word_bpe_49k.json"), end_id=2)
    counts = {r.doc_id: r.n_tokens for r in token_files.read_token_files(manifest).collect()}
    assert counts[0] > 300_000 and counts[5] == 4
    pieces = packing.packed(table, tokenizer_path("byte_bpe_50k.json")).groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in pieces} == set(range(6)) and all(r[1] > 0 for r in pieces)
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    rows = by_id(token_alignment.alignments(table, *paths))
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups and r.n_a for r in rows.values())
