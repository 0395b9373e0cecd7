"""Cleaning: each operator returns a new DataFrame, nothing is changed in place."""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wareflow.functions.text import canonical_sql

ISO = "yyyy-M-d"
DAY_FIRST = "d-M-yyyy"

# What the numbers of a format match; a day or month may have one digit.
_DIGITS = {"yyyy": "[0-9]{4}", "M": "[0-9]{1,2}", "d": "[0-9]{1,2}", "MM": "[0-9]{2}", "dd": "[0-9]{2}"}


def _shape(fmt: str) -> str | None:
    """The regular expression of all texts in a format of numbers, NULL for other formats."""
    tokens = re.findall(r"([A-Za-z])(\1*)|([^A-Za-z]+)", fmt)
    parts = [_DIGITS.get(a + b) if a else re.escape(other) for a, b, other in tokens]
    return None if None in parts else f"^{''.join(parts)}$"


def _date(col: str, fmt: str) -> Column:
    """NULL unless the text, but for blanks around it, is a date in the format. Text of another
    shape is not parsed, since a parse that fails is slow."""
    text = F.trim(F.col(col))
    parsed, shape = F.try_to_date(text, fmt), _shape(fmt)
    return F.when(text.rlike(shape), parsed) if shape else parsed


def normalize_dates(
    df: DataFrame,
    cols: Sequence[str],
    formats: Sequence[str] = (ISO, DAY_FIRST),
    whole_row: bool = False,
) -> DataFrame:
    """Text dates to DATE; what fits none of ``formats`` becomes NULL.

    Every column is judged by itself. ``whole_row=True`` gives the other reading: a row in
    which any of the columns is not in the first format has all of them parsed with the
    remaining formats only, so a date already in the first format is lost there.
    """
    def parse(col: str, fmts: Sequence[str]) -> Column:
        return F.coalesce(*[_date(col, fmt) for fmt in fmts])

    parsed = {c: parse(c, formats) for c in cols}
    if whole_row:
        # a NULL date neither triggers nor prevents the rewrite
        first = _shape(formats[0])
        if first is None:
            raise ValueError("whole_row needs numbers only in the first format")
        off_format = [F.col(c).isNotNull() & ~F.trim(F.col(c)).rlike(first) for c in cols]
        touched = reduce(lambda a, b: a | b, off_format)
        parsed = {
            c: F.when(touched, parse(c, formats[1:])).otherwise(parse(c, formats[:1])) for c in cols
        }
    return df.withColumns(parsed)


def text_date_update(cols: Sequence[str], formats: Sequence[str] = (ISO, DAY_FIRST)) -> tuple[Column, dict[str, Column]]:
    """Which rows have a text date that is not spelled yyyy-MM-dd, and each column's date in that spelling: the
    condition and the values of an update of a stored table (``sources.versions.update``)."""
    odd = [F.col(c).isNotNull() & ~F.col(c).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") for c in cols]
    spelled = {c: F.date_format(F.coalesce(*[_date(c, fmt) for fmt in formats]), "yyyy-MM-dd") for c in cols}
    return reduce(lambda a, b: a | b, odd), spelled


def fold_text(
    df: DataFrame,
    canonical: Mapping[str, Sequence[str]] | None = None,
    collated: Collection[str] = (),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Trim trailing blanks of every text column, give the columns named in ``canonical`` one
    spelling per value whatever the case ('On hold' -> 'On Hold'), and make those named in ``collated``
    compare without regard to case also where their values are not listed. ``columns`` names
    the text columns where they are known; else the schema tells them."""
    known = canonical or {}
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: F.expr(canonical_sql(f"`{c}`", known.get(c, ()), c in collated)) for c in columns})


def override(df: DataFrame, column: str, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Replace ``column`` where a rule (match column, match value, new value) holds; the
    first matching rule wins. Match columns are canonical."""
    chain = F.col(column)
    for match, value, new in reversed(rules):
        chain = F.when(F.col(match) == value, new).otherwise(chain)
    return df.withColumn(column, chain)
