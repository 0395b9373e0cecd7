"""Scratch tables live in the session's shared folder; ranges of rows keep to their bounds."""

import glob

import pyarrow as pa
from pyspark.sql import functions as F

from wareflow.llm import rows
from wareflow.llm.store import Scratch
from wareflow.sources.scratch import shared_folder


def test_tables_are_kept_and_dropped(spark):
    scratch = Scratch(spark)
    kept = scratch.keep(spark.range(10), "ten")
    ((_, path),) = scratch.kept
    assert path.startswith(shared_folder(spark)) and kept.count() == 10
    files = f"{path.removeprefix('file://')}/part-*"
    assert glob.glob(files)
    scratch.drop(kept, spark.range(1))
    assert not glob.glob(files) and not scratch.kept


def test_ranges_of_rows(monkeypatch):
    monkeypatch.setattr(rows, "ROWS", 3)
    monkeypatch.setattr(rows, "BYTES", 10)
    texts = ["a" * 30, None, "bb", "cc", "dd", "e" * 9, "ff", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    parts = [p.column("t").to_pylist() for p in rows.pieces(batch, "t")]
    assert [x for p in parts for x in p] == texts
    assert [len(p) for p in parts] == [1, 3, 1, 1, 2]
    assert list(rows.pieces(batch.slice(0, 0), "t")) == []


def test_rows_are_dropped_by_id_and_text(spark, documents, monkeypatch):
    docs = documents([(1, "a"), (1, "b"), (None, "a"), (None, None), (2, "")])
    gone = docs.where("text = 'a' OR text IS NULL").withColumn("row_", rows.text_key(docs["text"]))
    for most_sent in (10, 0):
        monkeypatch.setattr(rows, "MOST_SENT", most_sent)
        left = rows.without_rows(docs, gone)
        assert left.columns == docs.columns
        assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, "b"), (2, "")]


def test_the_least_of_rows_that_differ_in_other_columns_stays(spark, documents, monkeypatch):
    docs = documents([(1, "a")] * 3 + [(2, "b"), (2, "b"), (None, None), (None, None), (3, "c")], 4)
    docs = docs.withColumns({"lang": F.expr("concat('l', rand(3))"), "a.b": F.lit(1), "n_chars": F.lit(None).cast("long")})
    docs = Scratch(spark).keep(docs, "docs")
    wanted = docs.where("doc_id IS NULL OR doc_id < 3").withColumn("row_", rows.text_key(docs["text"]))
    least = {(r.doc_id, r.text): r.m for r in docs.groupBy("doc_id", "text").agg(F.min("lang").alias("m")).collect()}
    del least[3, "c"]
    for most_sent in (10, 0):
        monkeypatch.setattr(rows, "MOST_SENT", most_sent)
        for n in (1, 5):
            got = rows.rows_once(docs.repartition(n), wanted)
            assert got.dtypes == docs.dtypes
            assert {(r.doc_id, r.text): r.lang for r in got.collect()} == least and got.count() == 3
