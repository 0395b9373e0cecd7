"""Data-quality audits. All of them reduce to key grain map-side before anything moves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _key_text(keys: Sequence[str]) -> Column:
    """Parts joined by bars; a NULL part is empty but keeps its place."""
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])


def duplicate_keys(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Keys that occur more than once, of several tables in one tagged list."""
    return _union(
        [
            df.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("duplicate_count"))
            .filter(F.col("duplicate_count") > 1)
            .select(
                F.lit(tag).alias("duplicate_type"),
                _key_text(keys).alias("identifier"),
                "duplicate_count",
            )
            for tag, (df, keys) in tables.items()
        ]
    )


def null_audit(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """One row: the row count, and for each column its NULL count under the given name."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col(c).isNull()).alias(name) for c, name in cols.items()],
    )


def key_audit(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Per table: rows, distinct keys, keys used more than once, rows with a NULL in the key."""
    parts = []
    for tag, (df, keys) in tables.items():
        any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            per_key.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
                F.count(F.lit(1)).alias("distinct_keys"),
                F.count_if(F.col("n") > 1).alias("duplicate_keys"),
                F.coalesce(F.sum(F.when(any_null, F.col("n"))), F.lit(0)).alias("null_key_rows"),
            ).withColumn("table_name", F.lit(tag))
        )
    return _union(parts)


def orphan_audit(
    references: Sequence[tuple[str, DataFrame, str, DataFrame, str]],
) -> DataFrame:
    """Per reference (name, child, column, parent, column): child rows whose non-NULL value
    has no parent, and how many distinct values they carry.

    The child is counted per value first, so a value held by most rows is one row by the
    time it is compared.
    """
    parts = []
    for name, child, child_col, parent, parent_col in references:
        used = (
            child.filter(F.col(child_col).isNotNull())
            .groupBy(F.col(child_col).alias("ref"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        known = parent.select(F.col(parent_col).alias("ref"))
        parts.append(
            used.join(known, "ref", "left_anti").agg(
                F.lit(name).alias("reference"),
                F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"),
                F.count(F.lit(1)).alias("orphan_values"),
            )
        )
    return _union(parts)
