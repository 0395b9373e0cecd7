"""Recall at the parameters that op4_nearest runs with: several full shards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_hnsw import recall
from wareflow.llm import hnsw


def made(kind, n, dim):
    rng = np.random.default_rng(5)
    if kind == "uniform":
        return rng.random((n, dim))
    base = rng.normal(size=(n // 500, dim))
    return base[rng.integers(0, len(base), n)] + rng.normal(size=(n, dim)) * 1e-4


@pytest.mark.parametrize("kind", ["uniform", "tight copies"])
def test_recall_of_three_full_shards(spark, scratch, kind):
    n = 3 * hnsw.SHARD_ROWS
    vectors = made(kind, n, 64).astype(np.float32).astype(float)
    rows = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id LONG, embedding ARRAY<FLOAT>")
    got = hnsw.nearest(rows, F.col("vec_id") % 100 == 0, scratch).collect()
    share, queries = recall(got, vectors, np.arange(n), 10)
    print(f"recall of {kind}: {share:.4f} over {queries} queries")
    assert queries == -(-n // 100) and share >= 0.9
