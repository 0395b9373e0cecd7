"""Decontamination against plain Python."""

import random
from collections import Counter

import pytest

from tests.llm.conftest import letter_words, rows_of
from wareflow.llm import decontaminate as dc

COLUMNS = ("doc_id", "n_words", "n_hit", "items", "near_items", "contaminated")


def expected(rows, items, width=13, share=20, reach=26):
    windows = {}
    for item, text in items:
        w = letter_words(text)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).update([] if item is None else [str(item)])
    frequency = Counter(w for _, t in rows for w in letter_words(t))
    anchors = {}
    for window in windows:
        counts = [frequency[w] for w in window]
        if min(counts):
            anchors.setdefault(window[counts.index(min(counts))], []).append(window)
    out = []
    for doc_id, text in rows:
        w, hit, found, near = letter_words(text), set(), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        for k, word in enumerate(w):
            around = set(w[max(0, k - reach) : k + reach + 1])
            for window in anchors.get(word, ()):
                if around.issuperset(window):
                    near |= windows[window]
        out.append((doc_id, len(w), len(hit), sorted(found), sorted(near), len(hit) > 0 and share * len(hit) >= len(w)))
    return sorted(out, key=repr)


def tables(spark, documents, rows, items):
    return documents(rows), spark.createDataFrame([(a, b, 1) for a, b in items], "item_id LONG, text STRING, n LONG").repartition(2)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 13, 14, 30])))) for k in range(12)]
    items += [(None, " ".join(word() for _ in range(15))), (3, "Other text, of item-three"), (90, None), (91, ""), (92, "..."), (93, items[1][1]), (94, "w1")]
    rows = []
    for k in range(60):
        words = [word() for _ in range(rng.choice([5, 40, 300]))]
        for _ in range(rng.randrange(3)):
            own = letter_words(rng.choice(items)[1])
            if k % 4 == 1:
                rng.shuffle(own)
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() for w in own]
        rows.append((k, ",".join(words)))
    rows += [(None, None), (None, rows[0][1]), (None, rows[0][1]), (5, rows[5][1]), (5, "w1 é"), (100, ""), (101, "W1 " * 30_000)]
    return rows, items


@pytest.mark.parametrize("seed", [1, 2])
def test_hits(spark, documents, scratch, seed):
    rows, items = corpus(seed)
    got = dc.decontaminate(*tables(spark, documents, rows, items), scratch)
    assert rows_of(got, *COLUMNS) == expected(rows, items)


def test_blocks_and_whole_index(spark, documents, scratch, monkeypatch):
    monkeypatch.setattr(dc, "MOST_TERMS", 3)
    monkeypatch.setattr(dc, "MOST_WINDOWS", 40)
    monkeypatch.setattr(dc, "SHARD_DOCS", 7)
    monkeypatch.setattr(dc, "CANDIDATES", 50)
    monkeypatch.setattr(dc, "GAP", 64)
    rows, items = corpus(3)
    got = dc.decontaminate(*tables(spark, documents, rows, items), scratch)
    assert rows_of(got, *COLUMNS) == expected(rows, items)


def test_a_passage_that_many_documents_share(spark, documents, scratch):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k, f"a{k} b{k} {passage} c{k}" if k % 3 == 0 else f"p1 p2 x{k} " * 9) for k in range(150)]
    got = dc.decontaminate(*tables(spark, documents, rows, [(7, passage)]), scratch)
    assert rows_of(got, *COLUMNS) == expected(rows, [(7, passage)])


def test_empty_tables(spark, documents, scratch):
    rows, items = corpus(4)
    assert dc.decontaminate(*tables(spark, documents, [], items), scratch).count() == 0
    got = dc.digest(dc.decontaminate(*tables(spark, documents, rows, []), scratch)).collect()
    assert len(got) == len(rows) and not any(r.contaminated or r.n_hit or r.n_items for r in got)
