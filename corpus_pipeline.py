"""From documents to packed training windows: five operators of wareflow.llm as stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again
before the next one. All but the last return the columns of documents; a stage that changes texts
counts their characters anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareflow.llm import decontaminate, line_dedup, near_duplicates, packing, quality
from wareflow.llm.queries import VOCABULARY, table
from wareflow.llm.rows import rows_once, without_rows
from wareflow.llm.store import Scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Each text is measured once, and travels with its figures."""
    scratch = Scratch(spark)
    found, name = quality.with_features(docs)
    measured = scratch.keep(found, "statistics")
    model = quality.fit(measured.select("doc_id", measured[name].alias("features")), table(spark, sf_dir, "labels"), scratch)
    return quality.accepted(measured, model, name, least=0.3)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents share go."""
    others = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    cut = line_dedup.dedup_lines(docs, Scratch(spark), threshold=10, least=1, keep=others, counts=False)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, also where rows repeat with their id and text.

    Rows without shingles, such as empty texts, are in no group and stay.
    """
    scratch = Scratch(spark)
    found = near_duplicates.near_duplicates(docs, scratch, shingle=5, percent=80)
    found = found.where("NOT chosen OR n_shingles > 0").groupBy("doc_id", "row_").agg(F.bool_and("chosen").alias("chosen"), F.count("*").alias("n"))
    found = scratch.keep(found.where("NOT chosen OR n > 1"), "copies")
    stay = without_rows(docs, found.select("doc_id", "row_"))
    return stay.unionByName(rows_once(docs, found.where("chosen").select("doc_id", "row_")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark passages go."""
    scratch = Scratch(spark)
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), scratch, width=13, share=20)
    return without_rows(docs, scratch.keep(found.where("contaminated").select("doc_id", "row_"), "contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed into windows."""
    return packing.pack(docs, Scratch(spark), VOCABULARY, window=4096, end_id=2)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_copies),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: The classifier and packing can't be expressed in SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs, f"stage-{name}")
    return docs
