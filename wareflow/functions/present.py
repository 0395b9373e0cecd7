"""Display formats. Reports carry raw numbers; format only what a person will read."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped(col: str | Column, digits: int = 2) -> Column:
    """Thousands separators and fixed digits, rounded half away from zero.

    ``format_number`` alone rounds half to even, hence the rounding before it.
    """
    return F.format_number(F.round(F.col(col) if isinstance(col, str) else col, digits), digits)


def percent_label(col: str | Column, digits: int = 1) -> Column:
    return F.concat(grouped(col, digits), F.lit("%"))


def in_order(df: DataFrame, ordered: bool, *keys: str | Column) -> DataFrame:
    """The display order, if wanted. At product, customer or order grain a total order costs
    another shuffle and a second run of the last stage, which samples the key ranges."""
    return df.orderBy(*keys) if ordered else df


def text_or(col: Column, missing: str) -> Column:
    """The value as text, or ``missing`` for NULL."""
    return F.coalesce(col.cast("string"), F.lit(missing))


def report(
    df: DataFrame,
    money: Iterable[str] = (),
    counts: Iterable[str] = (),
    percents: Iterable[str] = (),
    labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """Format the named columns as text and rename columns to their display labels."""
    money, counts, percents, labels = set(money), set(counts), set(percents), labels or {}
    shown = []
    for name in df.columns:
        col = F.col(f"`{name}`")
        if name in money:
            col = grouped(col, 2)
        elif name in counts:
            col = grouped(col, 0)
        elif name in percents:
            col = percent_label(col)
        shown.append(col.alias(labels.get(name, name)))
    return df.select(*shown)
