"""Row numbers within groups of any size, without a group in one task.

A window function brings a group's rows to one task. Here rows are range-partitioned by group and order,
so that a large group lies in several neighbouring partitions. Each partition numbers its own
rows as they stream by; what a partition must add is known from one line for each partition, which is all that the
driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareflow.llm.store import Scratch


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace `local_` by the row's number in the run of equal `group_` values that it stands in."""
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("group_").to_numpy()
        begin = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1))
        number = np.arange(len(group)) - np.repeat(begin, np.diff(np.append(begin, len(group))))
        if group[0] == last:
            number[: begin[1] if len(begin) > 1 else len(group)] += seen
        last, seen = group[-1], int(number[-1]) + 1
        yield batch.set_column(batch.schema.get_field_index("local_"), "local_", pa.array(number, pa.int64()))


def numbered(table: DataFrame, scratch: Scratch, group: Column, order: list[Column], name: str = "position") -> DataFrame:
    """The table, written anew, with each row's number, from 0, within its group in the given order.

    table: a written one, whose rows come the same way each time they are read. group: a long that is
    never null. Rows that are equal in group and order are numbered in the order they are read.
    """
    keys = [F.col("group_"), *order, F.col("tie_")]
    rows = table.withColumns({"group_": group.cast("long"), "tie_": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie_")
    rows = rows.withColumns({"part_": F.spark_partition_id().cast("long"), "local_": F.lit(0).cast("long")})
    rows = scratch.keep(rows.mapInArrow(_runs, rows.schema), "numbered")
    # The last row of a partition's first and last run: those with the least and the greatest group.
    ends = rows.groupBy("part_").agg(F.min("group_").alias("first"), F.max("group_").alias("last"), F.max(F.struct("group_", "local_")).alias("end"))
    add, before = [], (None, 0)
    for part, first, last, end in sorted(tuple(r) for r in ends.collect()):
        offset = before[1] if before[0] == first else 0
        add.append((part, first, offset))
        before = (last, end["local_"] + 1 + (offset if first == last else 0))
    some = [x for x in add if x[2]]
    if some:  # a row for each partition at most
        added = F.broadcast(rows.sparkSession.createDataFrame(some, "part_ long, group_ long, add_ long"))
        rows = rows.join(added, ["part_", "group_"], "left").withColumn("local_", F.col("local_") + F.coalesce("add_", F.lit(0)))
    return rows.select(*(F.col(f"`{c}`") for c in table.columns), F.col("local_").alias(name))
