"""Hashed words and shingles against plain Python."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import letter_words, shingles, space_words
from wareflow.llm.words import LETTERS, NOT_SPACE, chunks, hashed_words, shingle_sets

TEXTS = st.lists(st.text(st.sampled_from("aAbBzZé€09 \t\n\x0b.,-"), max_size=60), min_size=1, max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_told_apart_by_their_hashes(texts):
    for table, words in ((NOT_SPACE, space_words), (LETTERS, letter_words)):
        hashes, first = hashed_words([t.encode() for t in texts], table)
        flat = [w for t in texts for w in words(t)]
        assert len(hashes) == len(flat)
        assert np.diff(first).tolist() == [len(words(t)) for t in texts]
        assert len(set(flat)) == len(set(hashes.tolist())) == len(set(zip(flat, hashes.tolist())))


@settings(max_examples=40, deadline=None)
@given(TEXTS, st.integers(1, 5))
def test_shingle_sets_have_the_right_sizes_and_overlaps(texts, width):
    sets = shingle_sets([t.encode() for t in texts], width)
    plain = [shingles(t, width) for t in texts]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for a, p in zip(sets, plain):
        for b, q in zip(sets, plain):
            assert len(np.intersect1d(a, b)) == len(p & q)


def test_a_place_in_a_batch_does_not_change_a_hash():
    long = b"word " * 60_000
    (alone,) = shingle_sets([b"One two three four five six"], 4)
    held = shingle_sets([long, b"", b"one two three four five six", long], 4)[2]
    assert alone.tolist() == held.tolist()


def test_ranges_of_texts_keep_to_their_bound():
    texts = [b"x" * n for n in (3, 4, 50, 1, 1, 2, 8)]
    assert [texts[a:b] for a, b in chunks(texts, 10)] == [texts[0:2], texts[2:3], texts[3:6], texts[6:7]]
