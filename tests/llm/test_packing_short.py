"""Padding of short documents."""

from pyspark.sql import functions as F

from wareflow.llm import packing


def test_short_pieces_leave_little_padding(spark):
    pieces = spark.range(100_000).selectExpr("id AS doc_id", "0L AS start", "9 + id % 3 AS length", "id AS row_")
    packed = packing.pack_pieces(pieces, window=4096)
    windows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k")).collect()
    assert sum(w.k for w in windows) == 100_000 and max(w.n for w in windows) <= 4096
    assert sum(w.n for w in windows) >= 0.99 * 4096 * len(windows)


def test_groups_of_short_pieces_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_PIECES", 1000)
    pieces = spark.range(5000).selectExpr("id AS doc_id", "0L AS start", "1L AS length", "id AS row_")
    packed = packing.pack_pieces(pieces, window=4096, group=500)
    assert packed.selectExpr("shiftright(sequence_id, 32) AS g").distinct().count() == 5 and packed.count() == 5000
