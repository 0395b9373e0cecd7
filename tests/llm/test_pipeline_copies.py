"""The pipeline's near-duplicate stage on rows that repeat as a whole, or without ids."""

from collections import Counter

import corpus_pipeline
from tests.llm.conftest import rows_of
from tests.llm.test_near_duplicates import EDGE
from wareflow.llm import rows


def stay(spark, docs):
    return rows_of(corpus_pipeline.drop_copies(spark, docs, ""), "doc_id", "text")


def test_a_text_of_a_third_of_all_rows_without_ids_stays_once(spark, documents):
    other = [(None, f"text number {k} has words of its own {k * 7} {k * 13}") for k in range(40)]
    got = stay(spark, documents([(None, "one text that comes very often here")] * 20 + other))
    assert got == sorted([(None, "one text that comes very often here"), *other], key=repr)


def test_rows_delivered_twice_stay_once(spark, documents, monkeypatch):
    once = [(k, f"text number {k} has words of its own {k * 7} {k * 13}") for k in range(30)]
    assert stay(spark, documents(once * 2)) == sorted(once, key=repr)
    monkeypatch.setattr(rows, "MOST_SENT", 0)
    assert stay(spark, documents(once * 2)) == sorted(once, key=repr)


def test_edges(spark, documents):
    got = Counter(k for k, _ in stay(spark, documents([*EDGE, *EDGE])))
    # 50, 51 and 52 have no shingles, so they are no copies; one of the rows that a null id and one text share stays
    assert got == {50: 2, 51: 2, 52: 2, 53: 1, 55: 1, None: 1, 56: 2, 57: 1, 59: 1}
