"""Keyword rules as data, and the expression that applies them.

A rule is (pattern, label). Rules are tried in order and the first match wins; text that
is missing or blank gets its own label, and whatever is left gets the last one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wareflow.functions.text import matches, text_in

Rules = Sequence[tuple[str, str]]

# Keyword rules and country lists that results depend on.
EXCEPTION_RULES: Rules = (
    ("sales|budget|credit|offer", "Budgeting Issues"),
    ("wrong|defect|complaint|color|scale|dispute", "Product Quality Issue"),
    ("damag|missing", "Shipping issues"),
    ("mistake", "Mistaken order"),
)
EXCEPTION_BLANK = "No Reason Provided"
EXCEPTION_OTHER = "Other Reasons"

DELAY_RULES: Rules = (
    ("budget|credit|offer|hold", "Previously on hold"),
    ("complaint|color|scale|dispute", "Previously disputed"),
    ("damag|missing", "Shipping issues"),
    ("mistake", "Mistaken order"),
    ("on hold", "Previously on hold"),
)
DELAY_BLANK = "No comment"
DELAY_OTHER = "Irrelevant comments"

FRICTION_ALLOW = "cautious optimism|budget approved|credit cleared"
FRICTION_PROBLEM = "sales|budget|credit|cautions|damag|missing|mistake|cancel|don"

# Class names that appear in results.
NO_REP = "No Rep Assigned"
CLIENT_INACTIVE = "Inactive (Zero Orders)"
CLIENT_DIFFICULT = "Difficult Client"
CLIENT_NORMAL = "Good / Normal Client"
NOT_SHIPPED = "Not shipped"
EARLY = "Early"
LATE = "Late"
ON_TIME = "On time"

# Countries of each region.
REGIONS: Mapping[str, Sequence[str]] = {
    "NA": ("USA", "Canada", "Mexico"),
    "APAC": (
        "Australia", "New Zealand", "Japan", "Singapore", "Hong Kong", "China", "India",
        "South Korea", "Philippines", "Malaysia", "Taiwan",
    ),
    "EMEA": (
        "UK", "France", "Germany", "Spain", "Italy", "Netherlands", "Belgium", "Switzerland",
        "Austria", "Sweden", "Norway", "Denmark", "Finland", "Ireland", "Portugal", "Poland",
        "Russia", "South Africa", "UAE", "Israel", "Egypt",
    ),
}
REGION_OTHER = "Other/Unknown"


def keyword_label(col: str | Column, rules: Rules, blank: str, other: str) -> Column:
    """One CASE expression over the whole text: first matching rule, else blank, else other."""
    col = F.col(col) if isinstance(col, str) else col
    missing = col.isNull() | (F.trim(col) == "")
    if not rules:
        return F.when(missing, blank).otherwise(other)
    (pattern, name), *rest = rules
    chain = F.when(matches(col, pattern), name)
    for pattern, name in rest:
        chain = chain.when(matches(col, pattern), name)
    return chain.when(missing, blank).otherwise(other)


def friction_flag(col: str | Column, allow: str, problem: str) -> Column:
    """1 when the text names a problem and no allowed phrase; 0 otherwise and for NULL."""
    return F.when(matches(col, allow), 0).when(matches(col, problem), 1).otherwise(0)


def region_of(col: str | Column, regions: Mapping[str, Sequence[str]], other: str) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for region, countries in regions.items():
        chain = chain.when(text_in(col, countries), region)
    return chain.otherwise(other)
