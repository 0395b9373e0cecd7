"""The operators of this subpackage as queries over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareflow.llm import decontaminate, hnsw, language, licenses, line_dedup, near_duplicates, packing, quality, quality_rules, resampling, sharding, trie, warc
from wareflow.llm.store import Scratch

#: The tokenizer's vocabulary file.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), Scratch(spark), VOCABULARY, window=4096, end_id=2)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled into 24 shards of equal row counts."""
    placed = sharding.shuffle_to_shards(sharding.digests(table(spark, sf_dir, "documents")), Scratch(spark), shards=24)
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with their language, learned from all documents and all pages."""
    model = language.train(table(spark, sf_dir, "documents"))
    return language.identify(table(spark, sf_dir, "pages"), model, Scratch(spark))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all embeddings for every hundredth one."""
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, Scratch(spark), k=10)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the licences that they name or quote."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the component of near copies that they are in."""
    found = near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark), shingle=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the quality that the labels mark."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark), least=0.3)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the benchmark's windows that occur in them."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark), width=13, share=20)
    return decontaminate.digest(found)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"), Scratch(spark), least=0)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten of them share."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), Scratch(spark), threshold=10, least=1, digest=True)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the longer documents drawn by their likeness to the benchmark."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resampling.resample(docs, target, Scratch(spark), widths=(1, 1), buckets=10_000, least_words=20, percent=10, seed=2024)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by rules on words and lines, and by the learned quality of those that pass them."""
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"), Scratch(spark))
    return quality_rules.judge(docs, model, least=0.3, least_words=50, most_repeated=50)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the prefix trie of conversations that share heads."""
    scratch = Scratch(spark)
    turns, lengths = trie.with_shared_heads(trie.ordered_turns(table(spark, sf_dir, "conversations"), scratch), scratch, every=20, most=4)
    return trie.prefix_trie(turns, lengths, scratch).drop("x", "y")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_sharding": op2_sharding,
    "op3_language": op3_language,
    "op4_nearest": op4_nearest,
    "op5_licenses": op5_licenses,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_quality": op7_quality,
    "op8_decontaminate": op8_decontaminate,
    "op9_warc": op9_warc,
    "op10_line_dedup": op10_line_dedup,
    "op11_resampling": op11_resampling,
    "op12_quality_rules": op12_quality_rules,
    "op13_prefix_trie": op13_prefix_trie,
}
