"""Stored roll-ups that grow by batches: what a batch adds is aggregated once and never read as lines again.

A roll-up is a folder with one folder for each batch. All its measures can be merged: sums, counts, sums of squares as exact
decimals, and sketches of distinct values. A report merges the batches' rows, whose number follows the groups
and batches and not the lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wareflow.operators.rollups import revenue

#: Measure -> how two values of it become one.
MERGE = {
    "n_lines": F.sum,
    "units": F.sum,
    "revenue": F.sum,
    "price_sum": F.sum,
    "price_squares": F.sum,
    "price_low": F.min,
    "price_high": F.max,
    "customers": F.hll_union_agg,
}
#: Logarithm of a sketch's size: a relative error of 0.8 % at one standard deviation.
SKETCH = 14


def summary(lines: DataFrame, orders: DataFrame, by: Sequence[str] = ("productCode", "month")) -> DataFrame:
    """The measures of a batch of lines by product and month of order (or other columns of lines and orders)."""
    price = F.col("priceEach")
    dated = orders.select("orderNumber", "customerNumber", "status", F.date_format("orderDate", "yyyy-MM").alias("month"))
    return lines.join(dated, "orderNumber").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("quantityOrdered").alias("units"),
        F.sum(revenue()).alias("revenue"),
        F.sum(price).alias("price_sum"),
        F.sum(price * price).alias("price_squares"),
        F.min(price).alias("price_low"),
        F.max(price).alias("price_high"),
        distinct_sketch("customerNumber").alias("customers"),
    )


def append(df: DataFrame, base: str, batch: str) -> None:
    """Add a batch's summary. A batch that is there already is an error, so a job that runs twice counts once."""
    df.write.mode("errorifexists").parquet(f"{base}/batch={batch}")


def merged(spark: SparkSession, base: str, by: Sequence[str]) -> DataFrame:
    """All batches together by some of the columns that they were grouped by."""
    stored = spark.read.option("basePath", base).parquet(base)
    measures = [merge(name).alias(name) for name, merge in MERGE.items()]
    return stored.groupBy(*by).agg(*measures)


def distinct_sketch(col: str | Column) -> Column:
    """Aggregate: a sketch of the distinct values, which can be stored and merged. NULL doesn't count."""
    return F.hll_sketch_agg(col, F.lit(SKETCH))


def distinct_estimate(sketch: str | Column) -> Column:
    """The number of distinct values that a sketch has seen; exact for the first few hundred."""
    return F.hll_sketch_estimate(sketch)
