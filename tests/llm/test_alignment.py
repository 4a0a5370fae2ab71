"""Alignment of two tokenizers against a brute-force version by byte ranges."""

import hashlib
from collections import Counter

import pytest
from conftest_llm import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from wardline.llm import token_alignment as T
from wardline.llm.queries import tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def encoders():
    both = T.both_tokens(*PATHS)
    return both.a, both.b


def ranges(ids, spelled):
    out, at = [], 0
    for k in ids:
        out.append((at, at + len(spelled[k])))
        at = out[-1][1]
    return out


def brute(texts):
    """The result's columns after doc_id, from all pairs of byte ranges."""
    a, b = encoders()
    seen, pairs = [], Counter()
    for text in texts:
        ids = (a.tokenizer.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if text and any(b"".join(t.bytes[k] for k in i) != (" " + text).encode() for t, i in ((a, ids[0]), (b, ids[1]))):
            ids = ([], [])
        spans = [ranges(i, t.bytes) for i, t in zip(ids, (a, b), strict=True)]
        links = [
            (x, y)
            for x, (s, e) in zip(ids[0], spans[0], strict=True)
            for y, (s2, e2) in zip(ids[1], spans[1], strict=True)
            if s < e2 and s2 < e
        ]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            sides = [
                ",".join(str(k) for k, (s, e) in zip(i, sp, strict=True) if s >= low and e <= cut)
                for i, sp in zip(ids, spans, strict=True)
            ]
            groups.append("|".join(sides))
            low = cut
        pairs.update(set(links))
        seen.append((ids, links, groups))
    most = Counter()
    for (x, _), n in pairs.items():
        most[x] = max(most[x], n)
    return [
        (
            len(ids[0]),
            len(ids[1]),
            len(groups),
            len(links),
            sum(pairs[p] == most[p[0]] for p in links),
            sum(pairs[p] for p in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if ids[0] else "",
        )
        for ids, links, groups in seen
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("block_links", [1, 300, T.BLOCK_LINKS])
def test_all_cases_against_byte_ranges(docs, block_links):
    short = docs.where("text IS NULL OR length(text) < 3000")
    got = T.alignments(short, *PATHS, block_links=block_links).collect()
    want = rows_of(short)
    expected = [(k, *row) for (k, _), row in zip(want, brute([t for _, t in want]), strict=True)]
    assert sorted(map(str, ((r.doc_id, *(r[c] for c in COLUMNS)) for r in got))) == sorted(map(str, expected))


def test_empty_table(no_docs):
    assert T.alignments(no_docs, *PATHS).collect() == []


def test_special_strings_are_plain_text_and_unspelled_texts_have_none(spark):
    rows = [(1, "a <|endoftext|> b <s> </s> <unk> <0x41>"), (2, "  two  spaces\n\n"), (3, "▁ mark"), (4, "\x00 zero")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in T.alignments(docs, *PATHS).collect()}
    want = brute([t for _, t in rows])
    assert got == {k: row for (k, _), row in zip(rows, want, strict=True)}
    assert got[1][0] > 0 and got[3][0] == 0 and got[3][6] == ""


def test_texts_of_several_megabytes(spark):
    rows = [(1, "ab" * 1_000_000), (2, "word and another, " * 150_000), (3, "\n" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in T.alignments(docs, *PATHS).collect():
        assert r.n_a and r.n_b and r.n_links == r.n_a + r.n_b - r.n_groups


ends = st.lists(st.integers(1, 60), min_size=1, max_size=40, unique=True).map(sorted)


@given(ends, ends)
@settings(max_examples=300, deadline=None)
def test_groups_end_where_both_end(x, y):
    last = max(x[-1], y[-1]) + 1
    x, y = [*x, last], [*y, last]
    runs, links, groups, spelled = T.linked(x, y, [str(k) for k in range(len(x))], [str(k) for k in range(len(y))])
    spans = [list(zip([0, *e[:-1]], e, strict=True)) for e in (x, y)]
    want = {(i, j) for i, (s, e) in enumerate(spans[0]) for j, (s2, e2) in enumerate(spans[1]) if s < e2 and s2 < e}
    at_a, at_b = (p.tolist() for p in T.places(runs, links))
    assert set(zip(at_a, at_b, strict=True)) == want and len(at_a) == len(want)
    assert groups == len(set(x) & set(y)) == len(spelled.split(";"))


@given(ends, ends, st.integers(0, 2_000_000))
@settings(max_examples=100, deadline=None)
def test_groups_are_spelled_from_names_in_one_array(x, y, first):
    last = max(x[-1], y[-1]) + 1
    x, y = [*x, last], [*y, last]
    names = [[str(first + 3 * k) for k in range(len(e))] for e in (x, y)]
    spelled = T.linked(x, y, *(T.np.array(n, T.NAME) for n in names))[3]
    want, at = [], [0, 0]
    for end in sorted(set(x) & set(y)):
        to = [e.index(end) + 1 for e in (x, y)]
        want.append("|".join(",".join(n[i:j]) for n, i, j in zip(names, at, to, strict=True)))
        at = to
    assert spelled == ";".join(want)


@given(st.lists(st.tuples(st.sampled_from("a \n"), st.sampled_from([1, 499, 999, 1000, 1700])), max_size=6))
def test_long_runs_are_seen(parts):
    text = "".join(c * n for c, n in parts)
    assert T.may_hold_long_run(text) == bool(T.LONG_RUN.search(text))


def test_a_stretch_is_measured_in_few_steps():
    class Counted(list):
        slices = 0

        def __getitem__(self, key):
            Counted.slices += isinstance(key, slice)
            return super().__getitem__(key)

    same = list(range(1, 100_001))
    assert T.stretch(Counted(same), same, 0, 0) == 100_000
    assert Counted.slices < 60


@given(st.text(alphabet=st.sampled_from("aZ é\n\t'9.日 s<|>▁"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_the_faster_encoder_gives_the_files_ids(text):
    a, _ = encoders()
    assert a.fast is not None
    assert a.encode(" " + text) == a.tokenizer.encode(" " + text, add_special_tokens=False).ids


@given(st.lists(st.lists(st.integers(0, 10**6), unique=True, max_size=20).map(sorted), max_size=8))
def test_places_come_back(lists):
    import numpy as np

    places = np.array([p for one in lists for p in one], np.int64)
    sizes = [len(one) for one in lists]
    got, times = T.unpack(T.pack(places, places + 1, sizes), np.array(sizes, np.int64))
    assert got.tolist() == places.tolist() and times.tolist() == (places + 1).tolist()
