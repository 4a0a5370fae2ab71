"""The corpus pipeline, stage by stage, against brute force."""

import struct
import zlib
from collections import Counter, defaultdict

import brute
import corpus_pipeline
import numpy as np
import pytest
from conftest_llm import rows_of

from wardline.llm import quality
from wardline.llm.common import stored
from wardline.llm.queries import tokenizer_path
from wardline.llm.tokens import Encoder

SF_DIR = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


def ids_of(rows):
    return Counter((r.doc_id, r.text) for r in rows.collect())


def test_quality_stage_keeps_what_scores(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    left = STAGE["quality classifier"](spark, docs, SF_DIR)
    assert left.columns == docs.columns
    kept = ids_of(left)
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    assert kept == Counter({(d, t): 1 for d, t in rows_of(docs) if scores[d] >= 0.5})
    # clean documents stay
    good = [r.doc_id for r in labels.collect() if r.quality == 1]
    ids = {d for d, _ in kept}
    assert np.mean([d in ids for d in good]) > 0.97


def test_exact_stage(spark, docs):
    left = STAGE["exact dedup"](spark, docs, SF_DIR)
    assert left.columns == docs.columns
    groups = brute.equal_texts(rows_of(docs))
    normal = {(i, t): brute.re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows_of(docs)}
    assert ids_of(left) == Counter(r for r in rows_of(docs) if groups[normal[r]][0] == r[0])


def test_near_stage(spark, docs):
    left = STAGE["MinHash near-dedup"](spark, docs, SF_DIR)
    assert left.columns == docs.columns
    rows = rows_of(docs)
    roots = brute.components(rows)
    assert ids_of(left) == Counter(rows[k] for k, root in roots.items() if root == rows[k][0])


def test_mix_stage_repeats_rows(spark, docs):
    left = STAGE["source mixing"](spark, docs, SF_DIR)
    assert left.columns == docs.columns
    once = Counter(rows_of(docs))
    assert all(n <= 2 * once[row] for row, n in ids_of(left).items())


@pytest.fixture(scope="module")
def packed(spark):
    docs = stored(corpus_pipeline.documents(spark, SF_DIR))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF_DIR))
    return docs, corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()


def test_run_packs_what_the_stages_keep(spark, packed):
    docs, pieces = packed
    encoder = Encoder(tokenizer_path("byte_bpe_50k.json"))
    whole = {}
    for doc_id, text in set(rows_of(docs)):
        ids = encoder.whole(text or "") + struct.pack("<I", 0)
        whole[doc_id] = ids
    copies = Counter(d for d, _ in rows_of(docs))
    sequences, seen = defaultdict(list), Counter()
    for p in pieces:
        ids = whole[p.doc_id][4 * p.start : 4 * (p.start + p.length)]
        assert zlib.crc32(ids) == p.ids_crc32
        seen[p.doc_id] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
    assert seen == Counter({d: n * (len(whole[d]) // 4) for d, n in copies.items()})
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    again = corpus_pipeline.run(spark, SF_DIR)
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(tuple(r[c] for c in key) for r in again.collect()) == Counter(tuple(p[c] for c in key) for p in pieces)


def test_stages_on_an_empty_table(spark, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF_DIR).collect() == [], name


def test_tables_of_earlier_stages_are_removed(spark):
    from pathlib import Path

    from wardline.session import scratch_root

    root = Path(scratch_root(spark).removeprefix("file://"))
    before = set(root.iterdir()) if root.exists() else set()
    rows = corpus_pipeline.run(spark, SF_DIR)
    left = set(root.iterdir()) - before
    assert rows.count() > 0
    # the mix that the last stage reads, and that stage's own tables
    assert 0 < len(left) <= 8
