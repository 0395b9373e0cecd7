"""Shares, ranks, pivots and top-n over grouped rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareflow.functions.numbers import percent, ratio, rounded, sample_deviation, std_error


def share_of_total(df: DataFrame, by: Sequence[str | Column], digits: int = 2) -> DataFrame:
    """Rows per group and their percentage of all rows.

    The total is a scalar subquery, not a window over all groups, so a grouping with many
    values is never gathered in one task.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "pct", percent(F.col("n"), total, digits)
    )


def share_and_rank(
    df: DataFrame, by: Sequence[str], within: Sequence[str], value: str, digits: int = 2
) -> DataFrame:
    """Sum ``value`` by the ``by`` columns; percentage of the sum of each ``within`` group
    and dense rank in it, largest first. One shuffle serves total and rank."""
    group = Window.partitionBy(*within)
    return (
        df.groupBy(*by)
        .agg(F.sum(value).alias(value))
        .withColumn("pct", percent(F.col(value), F.sum(value).over(group), digits))
        .withColumn("rank", F.dense_rank().over(group.orderBy(F.desc(value))))
    )


def pivot_stats(
    df: DataFrame, key: Sequence[str], pivot_col: str, values: Sequence[str], measure: str
) -> DataFrame:
    """Average, sample deviation and standard error of ``measure`` for each key and each of
    the given pivot values, in one pass of conditional sums. Columns are ``avg_<value>`` (an exact
    quotient), ``std_<value>`` and ``err_<value>`` (doubles) in lower case, unrounded."""
    aggs, means, deviations, errors = [], {}, {}, {}
    for value in values:
        name = value.lower()
        only = F.when(F.col(pivot_col) == value, F.col(measure))
        aggs += [
            F.count(only).alias(f"n_{name}"),
            F.sum(only).alias(f"sum_{name}"),
            F.sum(only * only).alias(f"squares_{name}"),
        ]
        n, total, squares = (F.col(f"{c}_{name}") for c in ("n", "sum", "squares"))
        means[f"avg_{name}"] = ratio(total, n)
        deviations[f"std_{name}"] = sample_deviation(n, total, squares)
        errors[f"err_{name}"] = std_error(F.col(f"std_{name}"), n)
    return df.groupBy(*key).agg(*aggs).withColumns(means | deviations).withColumns(errors)


def spread_of(cols: Sequence[str], as_written: bool = True) -> Column:
    """Largest minus smallest of several columns.

    As written, a missing column counts as 0 for the maximum and as 999999 for the minimum;
    otherwise the result is NULL unless two columns have a value.
    """
    if as_written:
        high = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in cols])
        low = F.least(*[F.coalesce(F.col(c), F.lit(999999)) for c in cols])
        return high - low
    present = sum(F.col(c).isNotNull().cast("int") for c in cols)
    return F.when(present >= 2, F.greatest(*cols) - F.least(*cols))


def pivot_sums(pivot_col: str, values: Mapping[str, str], measure: str) -> list[Column]:
    """Conditional sums, 0 where a group has no row: output name -> pivot value."""
    return [
        F.sum(F.when(F.col(pivot_col) == value, F.col(measure)).otherwise(0)).alias(name)
        for name, value in values.items()
    ]


def top_bottom(
    df: DataFrame, measure: str, n: int, tie_break: str, tags: tuple[str, str]
) -> DataFrame:
    """The ``n`` rows with the smallest and the ``n`` with the largest measure, tagged. Each
    side is a top-n per task merged at the end; ties go to the smaller ``tie_break``."""
    low, high = tags
    least = df.orderBy(F.asc(measure), F.asc(tie_break)).limit(n)
    most = df.orderBy(F.desc(measure), F.asc(tie_break)).limit(n)
    return least.withColumn("sales_rank", F.lit(low)).unionByName(
        most.withColumn("sales_rank", F.lit(high))
    )


def rounded_cols(cols: Mapping[str, str], digits: int = 2) -> list[Column]:
    """Rounded columns under new names: output name -> input column."""
    return [rounded(F.col(c), digits).alias(name) for name, c in cols.items()]
