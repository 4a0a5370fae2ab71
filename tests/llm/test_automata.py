"""Automata over spelled words, rolling hashes, very many words."""

import numpy as np
import pytest

from wardline.llm import substring_dedup as S


def test_rolling_hashes_do_not_depend_on_the_place():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, 60, dtype=np.uint64)
    whole = np.concatenate([rng.integers(0, 2**63, 5000, dtype=np.uint64), words, rng.integers(0, 2**63, 7, dtype=np.uint64)])
    for kind in range(3):
        alone, inside = S.rolling(words, 20, kind), S.rolling(whole, 20, kind)
        assert (inside[5000 : 5000 + len(alone)] == alone).all()
        assert len(np.unique(inside)) == len(inside) == len(whole) - 19
    other = words.copy()
    other[[3, 4]] = other[[4, 3]]
    assert (S.rolling(other, 20, 0)[:4] != S.rolling(words, 20, 0)[:4]).all()


@pytest.mark.parametrize("n", [1, 63, 64, 4095, 300_000])
def test_spelling_tells_numbers_apart(n):
    letters = max(1, -(-n.bit_length() // S.LETTER_BITS))
    text = S.spelled(np.arange(n + 1), letters)
    assert len({text[k : k + letters] for k in range(0, len(text), letters)}) == n + 1


def test_occurrences_start_at_words():
    ahocorasick = pytest.importorskip("ahocorasick")
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    numbers = np.array([5, 5, 5, 5, 5, 5, 5, 5, 5, 5])
    automaton.add_word(S.spelled(numbers[:8], 2))
    automaton.make_automaton()
    assert S.occurrences(automaton, S.spelled(numbers, 2), 2).tolist() == [0, 1, 2]


def test_more_words_than_characters_exist(spark):
    """Over 1.2 million different words in one text, and an edited copy of it."""
    words = [f"w{k}" for k in range(1_250_000)]
    edited = [*words[:600_000], "edit", *words[600_000:]]
    rows = [(1, " ".join(words)), (2, " ".join(edited))]
    found = S.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed) for r in found] == [(1_250_000, 0), (1_250_001, 1_250_000)]


def test_an_empty_automaton_finds_nothing(spark, monkeypatch):
    rows = [(k, " ".join(f"w{i}" for i in range(60)) + f" x{k}") for k in range(3)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sum(r.n_removed for r in S.without_repeats(table).collect()) == 120
    texts = spark.createDataFrame([(1, rows[0][1], [])], "no bigint, text string, anchors array<bigint>")
    assert S.candidate_windows(texts.filter("size(anchors) > 0")).count() == 0
