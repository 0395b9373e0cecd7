"""Canonical text, tests on free text, and lists of distinct values.

The source database compares text without regard to case or trailing blanks; Spark
compares bytes. Text columns whose values are listed therefore get one spelling per value when a table is read
(``operators.clean.fold_text``); operators then compare plain columns, so that their filters reach
the scan of a stored table. Columns that also hold other values, such as countries and product names, are collated,
so that comparing, joining and grouping them ignores case and trailing blanks without a list.
Only free text, such as comments, is folded where it is used.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Compares without regard to case and trailing blanks.
COLLATION = "UTF8_LCASE_RTRIM"

_WORDS = re.compile(r"[A-Za-z0-9 ]+(\|[A-Za-z0-9 ]+)*")


def fold(col: str | Column) -> Column:
    """Comparison form of a text column: lower case, no trailing blanks."""
    return F.lower(F.rtrim(col))


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def canonical_sql(expression: str, values: Iterable[str] = (), collate: bool = False) -> str:
    """SQL text of the spelling in ``values`` that a text has but for case and trailing blanks; any other
    text only loses its trailing blanks. ``collate`` makes the result compare without regard to case.

    As text it reaches Spark in one call, however many values there are.
    """
    found = f"rtrim({expression})"
    spelling = {value.rstrip(" ").lower(): value for value in values}
    if spelling:
        pairs = ", ".join(f"{_quoted(k)}, {_quoted(v)}" for k, v in spelling.items())
        found = f"coalesce(try_element_at(map({pairs}), lower({found})), {found})"
    return f"collate({found}, '{COLLATION}')" if collate else found


def least_spelling(col: str | Column) -> Column:
    """Aggregate: of the spellings in a group of a collated column, the least by its bytes."""
    return F.min(plain(col))


def plain(col: str | Column) -> Column:
    """A text that compares by its bytes again."""
    return F.collate(col, "UTF8_BINARY")


def text_in(col: str | Column, values: Iterable[str]) -> Column:
    """IN list on a canonical column. NULL stays unknown: ``~text_in`` drops NULL rows as SQL does."""
    col = F.col(col) if isinstance(col, str) else col
    return col.isin(*values)


def contains_any(col: str | Column, parts: Iterable[str]) -> Column:
    """True when any of ``parts`` occurs in the text, whatever the case."""
    col = F.col(col) if isinstance(col, str) else col
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(F.lower(col), F.lit(part.lower()))
    return found


def matches(col: str | Column, pattern: str) -> Column:
    """Case-insensitive search for a regular expression anywhere in the text.

    A pattern that only lists words (``damag|missing``) becomes substring tests on the
    lower-cased text, which read a long text several times faster than a regular expression.
    """
    col = F.col(col) if isinstance(col, str) else col
    if not _WORDS.fullmatch(pattern):
        return col.rlike(f"(?i){pattern}")
    found = [F.contains(F.lower(col), F.lit(word)) for word in pattern.lower().split("|")]
    return reduce(or_, found)


def name_list(col: str | Column, sep: str = ", ") -> Column:
    """Aggregate: like ``distinct_list``, for rows that a roll-up has made few. Collects a list, so the
    optimiser keeps that roll-up, which it drops below a set."""
    return F.nullif(F.array_join(F.sort_array(F.array_distinct(F.collect_list(col))), sep), F.lit(""))


def distinct_list(col: str | Column, sep: str = ", ") -> Column:
    """Aggregate: sorted distinct values joined by ``sep``; NULL when there are none.

    The set is combined map-side. Use it only on columns whose domain is a dimension
    (warehouse names, product lines, a given list of order numbers): it holds one
    group's distinct values in memory.
    """
    return F.nullif(F.array_join(F.sort_array(F.collect_set(col)), sep), F.lit(""))
