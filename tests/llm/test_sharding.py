"""The shuffle into shards: exact sizes, all rows, and the distribution of the draws."""

import zlib
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from wareflow.llm import sharding


@pytest.mark.parametrize("total, marked, drawn", [(50, 20, 10), (30, 1, 29), (10, 10, 4), (10, 0, 4), (1000, 300, 200), (5, 2, 5), (0, 0, 0), (9, 4, 0)])
def test_draws_are_hypergeometric(spark, total, marked, drawn):
    u = sharding._uniform(F.col("id"), F.lit(total))
    draw = sharding.hypergeometric(F.lit(total), F.lit(marked), F.lit(drawn), u)
    n = 4000
    x = np.array([r[0] for r in spark.range(n).select(draw).collect()])
    low, high = max(0, drawn - (total - marked)), min(drawn, marked)
    assert low <= x.min() and x.max() <= high
    p = np.array([comb(marked, k) * comb(total - marked, drawn - k) / comb(total, drawn) for k in range(low, high + 1)])
    seen = np.bincount(x - low, minlength=len(p))
    some = n * p > 5
    chi = ((seen - n * p) ** 2 / (n * p + 1e-300))[some].sum()
    assert chi < some.sum() + 5 * (2 * some.sum()) ** 0.5


def test_matrix_has_its_margins(spark):
    sizes = spark.createDataFrame([(k, (k * 7) % 31) for k in range(60)], "id LONG, n LONG")
    for fan in (4, 64):
        rows = sharding.communication_matrix(sizes, 5, seed=3, fan=fan).collect()
        cells = np.array([r.counts for r in rows])
        assert {r.id: sum(r.counts) for r in rows} == {k: (k * 7) % 31 for k in range(60)}
        total = sum((k * 7) % 31 for k in range(60))
        assert cells.sum(axis=0).tolist() == [total // 5 + (s < total % 5) for s in range(5)]


ROWS = [(k, f"text {k % 7}") for k in range(500)] + [(None, None), (None, None), (3, ""), (3, "é" * 50_000)]


@pytest.mark.parametrize("most_sent", [1_000_000, 0])
def test_rows_are_dealt_exactly(documents, scratch, monkeypatch, most_sent):
    monkeypatch.setattr(sharding, "MOST_SENT", most_sent)
    monkeypatch.setattr(sharding, "RUN", 16)
    got = sharding.shuffle_to_shards(sharding.digests(documents(ROWS, 6)), scratch, shards=7).toPandas()
    want = sorted(((a, len((b or "").encode()) + 8, zlib.crc32((b or "").encode())) for a, b in ROWS), key=repr)
    seen = [(None if np.isnan(a) else int(a), b, c) for a, b, c in zip(got.doc_id, got["size"], got.text_crc32)]
    assert sorted(seen, key=repr) == want
    for shard in range(7):
        slots = sorted(got.slot[got.shard == shard])
        assert slots == list(range(len(slots))) and len(slots) in (72,)


def test_places_are_uniform(documents, scratch):
    """Rows that come together don't stay together, and every row can go anywhere."""
    seen = np.zeros((4, 4))
    for seed in range(12):
        got = sharding.shuffle_to_shards(documents([(k, "x") for k in range(200)], 4).select("doc_id"), scratch, 4, seed).toPandas()
        for doc_id, shard in zip(got.doc_id, got.shard):
            seen[doc_id // 50, shard] += 1
        assert abs(np.corrcoef(got.sort_values(["shard", "slot"]).doc_id, np.arange(200))[0, 1]) < 0.3
    assert (abs(seen - 150) < 60).all()


def test_fewer_rows_than_shards_and_empty_table(documents, scratch, tmp_path):
    placed = sharding.shuffle_to_shards(documents([(1, "a"), (2, "b")]).select("doc_id", "text"), scratch, 5)
    assert sorted((r.shard, r.slot) for r in placed.collect()) == [(0, 0), (1, 0)]
    sharding.write_shards(placed, f"{tmp_path}/shards")
    assert sorted(p.name for p in (tmp_path / "shards").glob("shard=*")) == ["shard=0", "shard=1"]
    assert sharding.shuffle_to_shards(documents([]).select("doc_id"), scratch, 5).count() == 0
