"""Batches of rows into and out of Arrow functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Row keys up to this many go to every task that drops them; more are joined.
MOST_SENT = 1_000_000
#: Rows and bytes of text that a function sees at once.
ROWS, BYTES = 4096, 2 << 20


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text or binary column; null is empty."""
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in ranges of about BYTES of text, so that memory doesn't follow text length."""
    column = batch.column(text)
    sizes = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    begin, held = 0, 0
    for k, n in enumerate(pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_pylist()):
        if k > begin and (held + n > BYTES or k - begin >= ROWS):
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def map_texts(df: DataFrame, text: str, function: Callable[[pa.RecordBatch], dict[str, Any] | None], schema: StructType | str) -> DataFrame:
    """Apply a function of a batch, which returns columns, to each range of rows."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                found = function(part)
                if found is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x := found[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def text_key(column: Column) -> Column:
    """A 64-bit key of a text; with the id it names a row up to exact repeats."""
    return F.xxhash64(F.coalesce(column, F.lit("")), column.isNull())


def _meeting(docs: DataFrame, keys: DataFrame, text: str, how: str) -> DataFrame:
    keys = keys.select(F.col("doc_id").alias("gone_id_"), F.col("row_").alias("gone_key_")).distinct()
    if keys.limit(MOST_SENT + 1).count() <= MOST_SENT:
        keys = F.broadcast(keys)
    same = docs["doc_id"].eqNullSafe(keys["gone_id_"]) & (text_key(docs[text]) == keys["gone_key_"])
    return docs.join(keys, same, how)


def without_rows(docs: DataFrame, gone: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose id and text key are not in `gone`.

    gone: doc_id and row_ = text_key(text); read twice, so it should be cheap or written.
    """
    return _meeting(docs, gone, text, "left_anti")


def rows_once(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """One row, with all its columns, of each id and text of docs whose keys are in `wanted`.

    wanted: as `gone` of without_rows. Rows that differ in other columns only count as repeats; the one
    whose other columns are least, written as JSON, stays. A task sends at most one row of an id and text.
    """
    found = _meeting(docs, wanted, text, "left_semi")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", text)]
    if not others:
        return found.dropDuplicates(["doc_id", text])
    least = F.min_by(F.struct(*others), F.to_json(F.struct(*others), {"ignoreNullFields": "false"}))
    found = found.groupBy("doc_id", text).agg(least.alias("others_"))
    return found.select(*(F.col(c if c in ("doc_id", text) else f"others_.`{c}`").alias(c) for c in docs.columns))
