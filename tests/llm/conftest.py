"""Small tables and plain-Python restatements that the tests of the operators share."""

from __future__ import annotations

import re

import pytest

from wareflow.llm.store import Scratch

#: Columns that clash with names the operators use inside.
EXTRA = "lang STRING, source STRING, n_chars LONG, row_ LONG, n LONG, digest STRING, id LONG, `group` LONG, shard INT, slot LONG, kept BOOLEAN, label INT, score DOUBLE, features STRING, items STRING"

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture
def scratch(spark):
    return Scratch(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """A function that makes a documents table of (doc_id, text) rows."""

    def make(rows, partitions: int = 3):
        names = EXTRA.split(", ")
        schema = "doc_id LONG, text STRING, " + EXTRA
        full = [(a, b, *[None] * len(names)) for a, b in rows]
        return spark.createDataFrame(full, schema).repartition(partitions) if full else spark.createDataFrame([], schema)

    return make


def lowered(text):
    return (text or "").translate(_LOWER)


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def letter_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def shingles(text, width):
    words = space_words(text)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def rows_of(df, *columns):
    """All rows as sorted tuples of the columns."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
