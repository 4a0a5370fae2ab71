"""Exact, near and substring deduplication against brute force."""

import random

import brute
import pandas as pd
import pytest
from conftest_llm import rows_of

from wardline.llm import exact_dedup, near_dedup, substring_dedup


def test_exact_duplicates(docs):
    groups = brute.equal_texts(rows_of(docs))
    found = exact_dedup.exact_duplicates(docs).collect()
    texts = rows_of(docs)
    want = brute.counts(
        (doc_id, *groups[text], doc_id == groups[text][0])
        for doc_id, text in ((i, brute.re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in texts)
    )
    assert brute.counts((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == want


def test_cuckoo_index_grows_and_forgets():
    random.seed(3)
    index, live = exact_dedup.CuckooIndex(1), {}
    for step in range(6000):
        digest = exact_dedup.digest_of(f"text {random.randrange(900)}")
        if random.random() < 0.6:
            index.insert(digest, step)
            live[digest] = live.get(digest, 0) + 1
        elif digest in live:
            index.delete(digest)
            live[digest] -= 1
            if not live[digest]:
                del live[digest]
        else:
            index.delete(digest)
    assert index.size == len(live) and index.log2_buckets > 1
    assert all(index.maybe(d) and index.find(d)[2] == n for d, n in live.items())
    gone = [exact_dedup.digest_of(f"text {k}") for k in range(900)]
    assert all(index.find(d) is None for d in gone if d not in live)
    again = exact_dedup.CuckooIndex.load(index.dump(0).iloc[0])
    assert again.table == index.table and again.size == index.size


def test_index_update(spark, docs):
    keyed = exact_dedup.digests(docs)
    index = exact_dedup.build(keyed.where("doc_id < 10"), shards=3)
    index = exact_dedup.update(index, keyed.where("doc_id >= 10 OR doc_id IS NULL"), 3)
    whole = exact_dedup.entries(exact_dedup.build(keyed, shards=3))
    assert sorted(map(repr, exact_dedup.entries(index).collect())) == sorted(map(repr, whole.collect()))
    index = exact_dedup.update(index, keyed.where("doc_id >= 4"), 3, delete=True)
    left = keyed.where("doc_id < 4 OR doc_id IS NULL").select("digest").distinct()
    assert exact_dedup.entries(index).select("digest").exceptAll(left).count() == 0
    assert exact_dedup.entries(index).count() == left.count()


def test_near_duplicates(docs):
    rows = rows_of(docs)
    roots = brute.components(rows)
    want = brute.counts(
        (rows[k][0], len(brute.shingle_set(rows[k][1])), root, rows[k][0] == root)
        for k, root in roots.items()
    )
    found = near_dedup.similar_components(docs).collect()
    assert brute.counts((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == want


def test_near_duplicate_chains_and_bounds(spark):
    """Texts that differ by one word more each, and pairs just at and below the threshold."""
    random.seed(5)
    rows, base = [], [f"w{random.randrange(5000)}" for _ in range(150)]
    for k in range(60):
        rows.append((k, " ".join(base)))
        base = list(base)
        for _ in range(random.choice((1, 3, 5))):
            base[random.randrange(150)] = f"x{random.randrange(10**6)}"
    for k in range(60, 100, 2):
        plain = [f"p{k}_{i}" for i in range(104)]
        # 100 shingles; a changed word at the end of n words changes n shingles
        cut = 14 if k % 4 else 15
        rows += [(k, " ".join(plain)), (k + 1, " ".join(plain[:-cut] + [f"q{i}" for i in range(cut)]))]
    random.shuffle(rows)
    roots = brute.components(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in near_dedup.similar_components(table).collect()}
    assert found == {rows[k][0]: root for k, root in roots.items()}
    assert len(set(found.values())) > 20


def test_signature_distance_counts_slots():
    from functools import reduce

    a, b = (near_dedup.signature(near_dedup.shingles(t)) for t in ("a b c d e f g", "a b c d e x y z"))

    def slots(sig):
        first = sig[: near_dedup.CHUNKS]
        return [int(x) >> near_dedup.LANE * k & 0x3FFF for x in first for k in range(near_dedup.CHUNK)]

    differ = sum(x != y for x, y in zip(slots(a), slots(b), strict=True))
    counted = reduce(
        lambda n, xy: n + bin((int(xy[0]) ^ int(xy[1])) + near_dedup.LOW_BITS & near_dedup.TOP_BITS).count("1"),
        zip(a[: near_dedup.CHUNKS], b[: near_dedup.CHUNKS], strict=True),
        0,
    )
    assert counted == differ > 0


def test_further_slots_estimate_the_similarity():
    def further(sig):
        return [int(x) >> near_dedup.FIELD * k & 0xF for x in sig[near_dedup.CHUNKS :] for k in range(near_dedup.FIELDS)]

    words = [f"w{k}" for k in range(400)]
    a, b = (near_dedup.signature(near_dedup.shingles(" ".join(w))) for w in (words, words[:340] + ["x"] * 60))
    differ = sum(x != y for x, y in zip(further(a), further(b), strict=True))
    share = 336 / (396 + 396 + 0 - 336 - 55)  # the repeated word makes few distinct shingles
    assert len(further(a)) == near_dedup.FURTHER and abs(differ - near_dedup.FURTHER * (1 - share) * 15 / 16) < 30


def test_components(spark):
    random.seed(8)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)]
    edges += [(k, k + 1) for k in range(400, 440)] + [(500, k) for k in range(501, 560)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    linked = {x for e in edges for x in e if root(x) != x}
    assert {r.no: r.root for r in found} == {x: root(x) for x in linked}


def test_substring_repeats(docs):
    want = brute.without_repeats(rows_of(docs))
    expected = brute.counts((k[0], *want[k]) for k in rows_of(docs))
    found = substring_dedup.without_repeats(docs).collect()
    assert brute.counts((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == expected


def test_substring_repeats_of_shuffled_passages(spark):
    random.seed(4)
    pieces = [[f"v{random.randrange(60)}" for _ in range(n)] for n in (19, 20, 21, 35, 80)]
    rows = []
    for k in range(80):
        text = []
        for _ in range(random.randrange(6)):
            text += random.choice(pieces) + [f"u{random.randrange(10**6)}" for _ in range(random.randrange(4))]
        rows.append((k, " ".join(text)))
    want = brute.without_repeats(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = substring_dedup.without_repeats(table).collect()
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found} == {
        (k[0], *v) for k, v in want.items()
    }


def test_later_windows_across_partitions(spark):
    """A window held by many documents is split over partitions; all but the first are later."""
    rows = [(7, 7, no, 0) for no in range(500)] + [(no + 8, 1, no, 1) for no in range(50)]
    table = spark.createDataFrame(rows, substring_dedup.WINDOWS)
    found = substring_dedup.later_windows(table.repartition(4)).collect()
    assert sorted((r.no, r.start) for r in found) == [(no, 0) for no in range(1, 500)]


@pytest.mark.parametrize(
    "operator",
    [exact_dedup.exact_duplicates, near_dedup.similar_components, substring_dedup.without_repeats],
)
def test_empty(no_docs, operator):
    assert operator(no_docs).collect() == []


def test_changes_combine_copies(docs):
    keyed = exact_dedup.digests(docs).coalesce(1)
    changes = exact_dedup._changes(keyed, 2, 1).toPandas()
    assert isinstance(changes, pd.DataFrame) and changes["live"].max() > 1
    assert changes["live"].sum() == docs.count()


def test_links_at_the_threshold_are_not_pruned():
    for similarity, mean, deviation in ((75, 61, 6.8), (60, 97.6, 7.7), (90, 24.4, 4.7)):
        limit = near_dedup.whole_distance(similarity)
        assert mean + 6.5 * deviation < limit < mean + 9 * deviation
    assert near_dedup.whole_distance(100) == 0
    assert f"<= {near_dedup.whole_distance(60)}" in near_dedup.may_link("x", "y", 60)
