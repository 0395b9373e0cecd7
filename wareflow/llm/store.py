"""Tables written once to the folder that driver and executors share, to cut lineage.

The folder is the session's ``spark.checkpoint.dir`` (see ``wareflow.sources.scratch``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from wareflow.sources.scratch import new_path


class Scratch:
    """The tables of one run of an operator.

    ``keep`` writes a table and reads it back; ``drop`` deletes one that no later step reads.
    What the operator's result still reads stays in the shared folder until its owner clears it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.kept: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
        path = new_path(self.spark, tag)
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(path)
        out = self.read(path, df.schema)
        self.kept.append((out, path))
        return out

    def read(self, path: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``keep`` returned; others are left alone."""
        gone = [path for own, path in self.kept if any(own is df for df in tables)]
        self.kept = [(own, path) for own, path in self.kept if path not in gone]
        for path in gone:
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete one scratch table wherever the shared folder lives."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
