"""Ranks over groupings of any size, without all groups in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_rank_desc(df: DataFrame, value: str, name: str, ranges: int = 64) -> DataFrame:
    """The rows with their DENSE_RANK by ``value``, largest first, NULL last.

    The distinct values are dealt to ``ranges`` of about equal size, by borders that are approximate
    quantiles; any borders give the same ranks. Each range numbers its own values, and a range
    begins where the ones before it end, which takes one row for each range. A value lies in one range
    only, so ties are never cut, and a value that very many rows share is one row until the ranks go back to the rows.
    """
    values = df.select(F.col(value).alias("value_")).distinct()
    shares = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    borders = values.agg(F.percentile_approx("value_", shares, 100 * ranges)).scalar()
    above = F.size(F.filter(F.col("borders_"), lambda border: border > F.col("value_")))
    place = F.when(F.col("value_").isNull(), ranges).otherwise(above)
    placed = values.withColumn("borders_", borders).select("value_", place.alias("range_"))
    within = Window.partitionBy("range_").orderBy(F.desc_nulls_last("value_"))
    local = placed.withColumn("local_", F.row_number().over(within))
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("range_").agg(F.count(F.lit(1)).alias("n_"))
    starts = sizes.select(F.col("range_").alias("begin_"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    ranked = local.join(starts, F.col("range_") == F.col("begin_")).select("value_", (F.col("local_") + F.col("start_")).alias(name))
    return df.join(ranked, df[value].eqNullSafe(ranked["value_"])).drop("value_")
