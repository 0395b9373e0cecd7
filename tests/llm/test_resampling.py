"""Importance resampling against plain Python, and the n-gram table on its own."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import letter_words, rows_of
from wareflow.llm import resampling
from wareflow.llm.numbering import numbered
from wareflow.llm.resampling import NgramTable, resample, tables

COLUMNS = ("doc_id", "n_features", "weight", "score", "rank")


def grams(text, low, high):
    words = letter_words(text)
    return [" ".join(words[k : k + n]) for n in range(low, high + 1) for k in range(len(words) - n + 1)]


def expected(docs, target, low=1, high=1, buckets=10_000, least=20, percent=10, seed=2024):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t in docs for g in grams(t, low, high))
    t = Counter(bucket(g) for x in target for g in grams(x, low, high))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for k, (doc_id, text) in enumerate(docs):
        own = grams(text, low, high)
        weight = sum(gain(bucket(g)) for g in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(own), weight, score, None, len(letter_words(text)) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def made(n, seed):
    draw = random.Random(seed)
    words = ["Á" + "b" * draw.randrange(40) + str(k) for k in range(60)] + ["a", "I", "ß", "日本", "x1"]
    return [" ".join(draw.choice([w, w.upper()]) + draw.choice(["", ",", "\n\t", "__"]) for w in draw.choices(words, k=draw.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("widths", [(1, 1), (1, 3), (2, 2)])
def test_equal_to_plain_python(spark, documents, scratch, widths):
    texts = made(120, 1)
    docs = [*enumerate(texts), (200, None), (201, ""), (202, "!?"), (None, texts[3]), (7, texts[7]), (7, texts[7]), (7, texts[8])]
    target = [*made(9, 2), None, ""]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resample(documents(docs), items, scratch, widths=widths, buckets=97, percent=30)
    assert rows_of(got, *COLUMNS) == expected(docs, target, *widths, buckets=97, percent=30)


def test_ties_in_score_go_to_the_smaller_id(spark, documents, scratch, monkeypatch):
    monkeypatch.setattr(resampling, "noise", lambda doc_id, seed: F.lit(5).cast("long"))
    docs = [(k, "the same " * 12) for k in (9, 3, 7, None, 1, 5, 3, 8, 2, 6)]
    got = resample(documents(docs), documents([]), scratch, percent=50)
    assert [r[0] for r in rows_of(got.where("rank IS NOT NULL").select("rank", "doc_id"), "doc_id", "rank")] == [1, 2, 3, 3, 5]
    assert rows_of(got.where("rank IS NOT NULL"), "rank") == [(k,) for k in range(1, 6)]


def test_empty_tables(spark, documents, scratch):
    assert resample(documents([]), documents([(1, "a b")]), scratch).count() == 0
    assert rows_of(resample(documents([(1, "a " * 30)]), documents([]), scratch, percent=100), "doc_id", "rank") == [(1, 1)]


def test_hashes_are_those_of_the_library():
    draw = np.random.default_rng(3)
    words = [draw.integers(0, 256, n, np.uint8).tobytes() for n in range(90)] * 2
    sizes = np.array([len(w) for w in words])
    table = NgramTable(b"".join(words), np.cumsum(sizes) - sizes, sizes, 10)
    assert table.keys.tolist() == [xxhash.xxh64_intdigest(w) for w in words]
    assert len(set(table.slots.tolist())) == 90 and table.count.sum() == 180


def test_equal_hashes_of_other_bytes_take_other_slots(monkeypatch):
    monkeypatch.setattr(resampling, "short_hashes", lambda lanes, size: np.full(len(size), 12345, np.uint64))
    monkeypatch.setattr(resampling.xxhash, "xxh64_intdigest", lambda x: 12345)
    texts = [b"a b a c b a " + b"z" * 50 + b" " + b"z" * 49 + b"y " + b"z" * 50]
    (table, doc), = tables(texts, 1, 1, 1000)
    assert sorted(table.count[table.owner >= 0].tolist()) == [1, 1, 2, 2, 3] and not doc.any()
    assert [table.bucket[k] for k in table.slots[:3]] == [zlib.crc32(x) % 1000 for x in (b"a", b"b", b"a")]


@pytest.mark.parametrize("block", [1, 16, 1 << 17])
def test_blocks_lose_no_ngram(monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    texts = made(20, 4)
    want = Counter((k, zlib.crc32(g.encode()) % 50) for k, t in enumerate(texts) for g in grams(t, 1, 3))
    got = Counter()
    for table, doc in tables([t.encode() for t in texts], 1, 3, 50):
        got.update(zip(doc.tolist(), table.bucket[table.slots].tolist()))
    assert got == want


@pytest.mark.parametrize("partitions", [1, 7])
def test_numbers_in_groups_of_any_size(spark, scratch, partitions):
    rows = [(k % 5 if k % 3 else 77, k // 4) for k in range(3000)] + [(1000 + k, 0) for k in range(50)]
    table = scratch.keep(spark.createDataFrame(rows, "g long, v long").repartition(partitions), "rows")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in numbered(table, scratch, F.col("g"), [F.col("v").desc()]).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted((g, v) for g, v, _ in got) == sorted(rows)
    for group in {g for g, _ in rows}:
        own = sorted((n, -v) for g, v, n in got if g == group)
        assert [n for n, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)
