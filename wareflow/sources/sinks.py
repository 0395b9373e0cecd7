"""Writers: a report or a cleaned table goes to a path of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str) -> None:
    """One Parquet directory per report."""
    df.write.mode("overwrite").parquet(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """A new version of a table, at a path that does not exist yet: Spark reads lazily, so
    a table must not be written over the files it is being read from.

    Rows are gathered by the partition columns first, or each task would leave a file in each
    folder; adaptive execution cuts a large folder's rows to several files.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def write_lines_by_month(lines: DataFrame, orders: DataFrame, path: str) -> None:
    """Store order lines in a folder for each month of order, so that reports on some orders skip the other months.

    Join them with ``orders_with_month`` on both its columns: a filter on the orders then prunes the
    lines' folders when the query runs (dynamic partition pruning). Lines without an order are in the folder of no month.
    """
    dated = lines.join(orders_with_month(orders).select("orderNumber", "order_month"), "orderNumber", "left")
    write_table(dated, path, ("order_month",))


def orders_with_month(orders: DataFrame) -> DataFrame:
    """Orders with the month that stored lines are partitioned by."""
    return orders.withColumn("order_month", F.date_format("orderDate", "yyyy-MM"))


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Store a table hashed and sorted on a join key.

    Orders and order lines written with the same key and bucket count join without a
    shuffle, which saves moving the lines for every report. A key that holds a large part
    of the rows makes one large bucket that adaptive execution cannot split, so keep such
    tables unbucketed. Rows are dealt to the buckets before they are written: one file each.
    """
    (
        df.repartition(buckets, key)
        .write.bucketBy(buckets, key)
        .sortBy(key)
        .mode("errorifexists")
        .format("parquet")
        .saveAsTable(table)
    )
