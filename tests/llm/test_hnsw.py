"""Nearest neighbours against brute force: recall, exact scores, and vectors that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wareflow.llm import hnsw


def brute(vectors, ids, query, k):
    own = vectors[ids == query][0]
    d = np.sqrt(((vectors - own) ** 2).sum(axis=1))
    return [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != query][:k]


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 2
    return (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.5).astype(np.float32).astype(float)


def table(spark, rows):
    return spark.createDataFrame([(a, b, 1, 2.0) for a, b in rows], "vec_id LONG, embedding ARRAY<FLOAT>, shard INT, score DOUBLE").repartition(3)


def recall(rows, vectors, ids, k):
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    right = 0
    for query, own in found.items():
        own = sorted(own)
        assert [a for a, *_ in own] == list(range(1, k + 1))
        assert own == sorted(own, key=lambda x: (x[2], x[1]))
        for _, vec_id, score in own:
            assert score == pytest.approx(np.sqrt(((vectors[ids == vec_id][0] - vectors[ids == query][0]) ** 2).sum()), rel=1e-12)
        right += len({x[1] for x in own} & set(brute(vectors, ids, query, k)))
    return right / (k * len(found)), len(found)


@pytest.mark.parametrize("kind", ["clustered", "uniform"])
def test_recall(spark, scratch, kind):
    vectors = clustered(1500, 24, 1) if kind == "clustered" else np.random.default_rng(2).random((1500, 32)).astype(np.float32).astype(float)
    ids = np.arange(1500)
    got = hnsw.nearest(table(spark, [(int(i), v.tolist()) for i, v in zip(ids, vectors)]), F.col("vec_id") % 20 == 0, scratch, shard_rows=600).collect()
    share, n = recall(got, vectors, ids, 10)
    assert n == 75 and share >= 0.95


def test_a_third_of_equal_vectors(spark, scratch):
    vectors = clustered(600, 8, 3)
    vectors[::3] = vectors[0]
    ids = np.arange(600)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, vectors)]
    got = hnsw.nearest(table(spark, rows), F.col("vec_id") % 50 == 0, scratch, shard_rows=250).collect()
    share, _ = recall(got, vectors, ids, 10)
    assert share >= 0.95
    own = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == 0)
    assert own == [(k, 3 * k, 0.0) for k in range(1, 11)]


def test_what_takes_no_part(spark, scratch):
    rows = [
        (0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, []), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]),
        (None, [1.0, 0.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [0.0, 0.0, 1.0]), (9, [0.0, 0.0, 2.0]), (0, [5.0, 5.0]), (10, [0.0, 1.0]), (11, [2.0, 0.0]),
    ]
    got = hnsw.nearest(table(spark, rows), F.col("vec_id") >= 0, scratch, k=3).collect()
    by_query = {q: [(r.vec_id, round(r.score, 6)) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in {r.query_id for r in got}}
    assert set(by_query) == {0, 7, 8, 9, 10, 11}
    assert by_query[0] == [(7, 1.0), (11, 1.0), (10, round(2**0.5, 6))]
    assert by_query[7] == [(11, 0.0), (0, 1.0), (10, round(5**0.5, 6))]
    assert by_query[8] == [(9, 1.0)]


def test_empty_table(spark, scratch):
    assert hnsw.nearest(table(spark, []), F.col("vec_id") % 2 == 0, scratch).count() == 0


def test_blocks_of_queries(spark, scratch):
    vectors = clustered(300, 6, 4)
    rows = hnsw.usable(table(spark, [(i, v.tolist()) for i, v in enumerate(vectors)]), "embedding", "vec_id")
    index = scratch.keep(hnsw.build_index(rows, shard_rows=100), "index")
    one = hnsw.search(index, rows.where("vec_id < 40"), scratch, k=4)
    many = hnsw.search(index, rows.where("vec_id < 40"), scratch, k=4, block_bytes=400)
    assert sorted(one.collect()) == sorted(many.collect()) and one.count() == 160


def test_index_rows_are_neither_copied_nor_shuffled(spark, scratch):
    vectors = clustered(200, 6, 5)
    rows = hnsw.usable(table(spark, [(i, v.tolist()) for i, v in enumerate(vectors)]), "embedding", "vec_id")
    index = scratch.keep(hnsw.build_index(rows, shard_rows=50), "index")
    found = hnsw.searched(index, rows.where("vec_id < 9").toPandas(), 3, 64)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any(x in plan for x in ("Exchange", "Generate", "Join"))
    assert found.groupBy("query_id").count().where(f"count > 3 * {found.rdd.getNumPartitions()}").count() == 0
