"""Documents whose other columns have names that the stages of the pipeline use inside."""

import pytest

import corpus_pipeline
from tests.llm.conftest import rows_of
from wareflow.llm import line_dedup
from wareflow.llm.line_dedup import dedup_lines

OTHERS = {"kept": "concat('kept ', doc_id)", "n_lines": "doc_id + 0.5D", "n_dropped": "doc_id % 2 = 0", "k_": "doc_id", "hits_": "'x'", "own_0": "'y'", "h1": "'z'"}
SMALL = "/root/testdata/sf0.001"


def test_stages_leave_other_columns_alone(spark):
    plain = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = plain.selectExpr("*", *(f"{e} AS {c}" for c, e in OTHERS.items()))
    for name, stage in corpus_pipeline.STAGES[:4]:
        want = stage(spark, plain, SMALL)
        got = stage(spark, docs, SMALL)
        assert got.dtypes == docs.dtypes, name
        want = want.selectExpr("*", *(f"{e} AS {c}" for c, e in OTHERS.items()))
        assert 0 < got.count() and rows_of(got, *docs.columns) == rows_of(want, *docs.columns), name


@pytest.mark.parametrize("kind", ["BOOLEAN", "STRING"])
@pytest.mark.parametrize("most_sent", [1_000_000, 0])
def test_kept_columns_of_any_name(spark, scratch, kind, most_sent):
    rows = [(k, f"shared\nown {k}", "true", k, -k, "h") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, kept STRING, n_lines LONG, n_dropped LONG, hits_ STRING")
    docs = docs.withColumn("kept", docs["kept"].cast(kind.lower()))
    got = dedup_lines(docs, scratch, threshold=3, most_sent=most_sent, keep=tuple(c for c in docs.columns if c != "text"), counts=False)
    value = True if kind == "BOOLEAN" else "true"
    assert rows_of(got, *docs.columns) == [(k, f"own {k}", value, k, -k, "h") for k in range(6)]


def test_names_of_results_are_refused_where_both_are_asked_for(spark, documents, scratch):
    docs = documents([(1, "a")]).withColumnRenamed("n", "n_lines")
    with pytest.raises(ValueError, match="n_lines"):
        line_dedup.dedup_lines(docs, scratch, keep=("doc_id", "n_lines"))
