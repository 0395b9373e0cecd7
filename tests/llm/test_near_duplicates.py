"""Near-duplicates against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

from tests.llm.conftest import rows_of, shingles
from wareflow.llm import near_duplicates as nd
from wareflow.llm.components import components
from wareflow.llm.words import shingle_sets


def expected(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    groups = {}
    for k, (doc_id, _) in enumerate(rows):
        groups.setdefault(root(k), []).append(doc_id)
    out = []
    for k, (doc_id, _) in enumerate(rows):
        ids = [i for i in groups[root(k)] if i is not None]
        component = min(ids) if ids else None
        out.append((doc_id, len(sets[k]), component, component is not None and doc_id == component))
    return sorted(out, key=repr)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed, bases=8, copies=14):
    rng = random.Random(seed)
    rows = []
    for _ in range(bases):
        words = [f"b{rng.randrange(4000)}" for _ in range(rng.randint(20, 120))]
        rows += [edited(rng, words, rng.randint(0, len(words) // 16)) for _ in range(copies)]
    rng.shuffle(rows)
    return list(enumerate(rows))


EDGE = [
    (50, None), (51, ""), (52, " \n"), (53, "One two"), (54, "one\ttwo"), (55, "one two three"), (None, "one two"), (None, "lonely words"),
    (None, "lonely words"), (56, "é a b c d e"), (56, "É a b c d e"), (57, "long " * 40_000), (58, "long " * 39_000), (59, "a b c d e f"), (59, "a b c d e f"),
]


@pytest.mark.parametrize("width", [4, 5])
def test_components(documents, scratch, width):
    rows = corpus(width) + [(k + 1000 if k else k, t) for k, t in EDGE]
    got = nd.near_duplicates(documents(rows), scratch, shingle=width, percent=80)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == expected(rows, width, 80)


def test_one_of_each_component_is_chosen(documents, scratch):
    got = nd.near_duplicates(documents(EDGE), scratch, shingle=4).collect()
    chosen = sorted((r.doc_id for r in got if r.chosen), key=repr)
    # 54 and the null id repeat 53; one of the two lonely rows can't be told from the other
    assert chosen == sorted([50, 51, 52, 53, 55, None, None, 56, 56, 57, 59, 59], key=repr)


def test_blocks_lose_no_link(documents, scratch, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_CLASSES", 5)
    monkeypatch.setattr(nd, "MOST_SENT", 0)
    rows = corpus(9, bases=2, copies=40)
    got = nd.near_duplicates(documents(rows), scratch, shingle=4, percent=80)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == expected(rows, 4, 80)


def test_forest_of_links_is_exact():
    rng = random.Random(4)
    texts = [t for _, t in corpus(2, bases=3, copies=10)]
    sets = shingle_sets([t.encode() for t in texts], 3)
    for across in (False, True):
        block = np.array([rng.randrange(2) if across else 0 for _ in texts])
        block[:2] = (0, 1) if across else (0, 0)
        up = list(range(len(sets)))

        def root(k):
            while up[k] != k:
                k = up[k]
            return k

        links = set()
        for a, b in combinations(range(len(sets)), 2):
            common = len(np.intersect1d(sets[a], sets[b]))
            if 100 * common >= 60 * (len(sets[a]) + len(sets[b]) - common) and (not across or block[a] != block[b]):
                links.add((a, b))
                up[root(a)] = root(b)
        found = nd.forest_of_links(sets, block, 60)
        assert all(tuple(sorted(p)) in links for p in found)
        assert len(found) == len(sets) - len({root(k) for k in range(len(sets))})


def test_tables_miss_no_pair_at_the_threshold():
    """Pairs at a similarity of 0.8 meet in a table of 20 x 20 pairs of three minhashes."""
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(150):
        both = rng.integers(0, 2**63, 160, dtype=np.uint64)
        a = np.concatenate((both, rng.integers(0, 2**63, 20, dtype=np.uint64)))
        b = np.concatenate((both, rng.integers(0, 2**63, 20, dtype=np.uint64)))
        left, right = nd.minhash_keys([a, b], 20, 3)
        met += (left[0] == left[1]).any() and (right[0] == right[1]).any()
        apart, _ = nd.minhash_keys([a, rng.integers(0, 2**63, 180, dtype=np.uint64)], 20, 3)
        assert not (apart[0] == apart[1]).any()
    assert met == 150


def test_long_chains_are_one_component(spark, scratch):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (102, 101)]
    rng = random.Random(2)
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges]
    got = components(spark.createDataFrame([*edges, (None, 5)], "a LONG, b LONG"), scratch)
    assert sorted(map(tuple, got.collect())) == [(k, 0) for k in range(1, 61)] + [(101, 100), (102, 100)]


def test_empty_table_and_no_links(documents, scratch):
    assert nd.near_duplicates(documents([]), scratch).count() == 0
    got = nd.near_duplicates(documents([(1, "a b c d e f"), (2, "g h i j k l")]), scratch)
    assert rows_of(got, "doc_id", "component_id", "kept") == [(1, 1, True), (2, 2, True)]


def templated(n, seed=6, shared=46, own=60):
    """Texts with `shared` words in common and `own` ones of their own, and a near copy of every hundredth."""
    draw = random.Random(seed)
    template = " ".join(f"t{k}" for k in range(shared))
    rows = [(k, template + " " + " ".join(f"w{draw.randrange(10**9)}" for _ in range(own))) for k in range(n)]
    return rows + [(n + k, t + " more") for k, t in rows[::100]]


def test_texts_of_one_template_are_not_compared_with_each_other(documents, scratch, monkeypatch):
    """A chain of some hundred texts with a similarity of 0.27 is cut to the pairs that are alike."""
    monkeypatch.setattr(nd, "BLOCK_CLASSES", 30)
    seen = []
    cut = nd.without_chains
    monkeypatch.setattr(nd, "without_chains", lambda *a: seen.append((a[4], cut(*a))) or seen[-1][1])
    rows = templated(1500)
    got = nd.near_duplicates(documents(rows), scratch, shingle=4, percent=80)
    want = [(k, k if k < 1500 else k - 1500) for k, _ in rows]
    assert rows_of(got, "doc_id", "component_id") == sorted(want, key=repr)
    (before, after), = seen
    assert before.groupBy("group").count().where("count > 100").count() and after.count() < before.count() / 4
    assert after.groupBy("group").count().where("count > 5").count() == 0
