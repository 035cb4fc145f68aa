import re

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.token_counts import WORD, PieceAutomaton, piece_vocabulary, token_counts
from tests.llm.helpers import ODD_TEXTS, no_docs, odd_docs


def greedy(word, initial, inner):
    n, at, pieces = 0, 0, initial
    while at < len(word):
        end = next((e for e in range(min(len(word), at + 40), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        n, at, pieces = n + 1, end, inner
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5)), st.sets(st.text("abc", min_size=1, max_size=5)), st.lists(st.text("abcd", min_size=1, max_size=12)))
def test_automaton_is_greedy(initial, inner, words):
    a = PieceAutomaton(initial, inner)
    assert [a.count(w) for w in words] == [greedy(w, initial, inner) for w in words]


@pytest.fixture(scope="module")
def vocabulary():
    return piece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def test_counts_against_brute_force(spark, vocabulary):
    initial, inner = map(set, vocabulary)
    rows = token_counts(odd_docs(spark), *vocabulary).collect()
    assert len(rows) == len(ODD_TEXTS) + 1
    by_id = {r.doc_id: r for r in rows}
    for i, text in enumerate(ODD_TEXTS):
        if text and len(text) == 30_000:
            continue  # one long word: only that it is counted
        got = [greedy(w, initial, inner) for w in re.findall(WORD, text or "")]
        r = by_id[i * 3 + 1]
        assert (r.n_words, r.n_unknown, r.n_tokens) == (len(got), got.count(-1), sum(1 if c < 0 else c for c in got))


def test_empty_table(spark, vocabulary):
    assert token_counts(no_docs(spark), *vocabulary).count() == 0
