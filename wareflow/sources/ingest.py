"""Typed ingest with a reject channel: rows that don't fit are kept with the reason, and counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wareflow.sources.schemas import PRIMARY_KEYS, schema_of

#: Names of the columns beside the declared ones.
REASONS, RAW = "_reasons", "_corrupt_record"


def _reasons(schema: StructType, required: Sequence[str]) -> Column:
    """Names of the columns whose text is not of their type, or is missing where it must not be."""
    found = []
    for f in schema:
        text = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, StringType):
            found.append(F.when(text.isNotNull() & text.try_cast(f.dataType).isNull(), f"{f.name} is not {f.dataType.simpleString()}"))
        if f.name in required:
            found.append(F.when(text.isNull(), f"{f.name} is missing"))
    found.append(F.when(F.col(RAW).isNotNull(), "wrong number of fields"))
    return F.array_compact(F.array(*found))


def read_csv_checked(spark: SparkSession, path: str, schema: StructType, required: Sequence[str] = (), null: str = "NULL", name: str = "ingest") -> tuple[DataFrame, Observation]:
    """The rows of header CSV files with declared types, a column of reasons, empty where the row fits, and the line's text
    where its number of fields is wrong.

    Nothing fails and nothing is lost: a value that doesn't fit is NULL in its typed column, and the row's
    reasons say so. The observation has the numbers of lines, accepted and rejected rows after the first action
    over all rows, from that action's own pass.
    """
    read = spark.read.option("header", True).option("nullValue", null).option("quote", '"').option("escape", '"')
    header = read.csv(path).columns
    missing = set(schema.fieldNames()) - set(header)
    if missing:
        raise ValueError(f"{path} has no columns {sorted(missing)}")
    texts = StructType([StructField(c, StringType()) for c in (*header, RAW)])
    # Fields are counted only where all of them are parsed, whatever columns a query needs.
    raw = read.option("columnPruning", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW).option("enforceSchema", False).schema(texts).csv(path)
    seen = Observation(name)
    fits = F.size(REASONS) == 0
    checked = raw.withColumn(REASONS, _reasons(schema, required)).observe(
        seen, F.count(F.lit(1)).alias("lines"), F.count_if(fits).alias("accepted"), F.count_if(~fits).alias("rejected")
    )
    typed = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema]
    fields = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in schema]))
    return checked.select(*typed, REASONS, F.coalesce(RAW, fields).alias("_line")), seen


def accepted(checked: DataFrame) -> DataFrame:
    """Rows that fit, with the declared columns only."""
    return checked.where(F.size(REASONS) == 0).drop(REASONS, "_line")


def rejected(checked: DataFrame) -> DataFrame:
    """Rows that don't fit: their reasons and their text."""
    return checked.where(F.size(REASONS) > 0).select(F.array_join(REASONS, ", ").alias("reason"), F.col("_line").alias("line"))


def ingest(spark: SparkSession, base: str, table: str, out: str, text_dates: bool = False) -> dict[str, int]:
    """Read a model table's CSV files once and store accepted rows in ``out/accepted``, the others in ``out/rejected``.

    Both come from one stored pass over the files, whose counts are returned: lines, accepted and rejected.
    """
    checked, seen = read_csv_checked(spark, f"{base}/{table}", schema_of(table, text_dates), PRIMARY_KEYS[table], name=table)
    checked.write.mode("errorifexists").parquet(f"{out}/checked")
    stored = spark.read.parquet(f"{out}/checked")
    accepted(stored).write.parquet(f"{out}/accepted")
    rejected(stored).write.parquet(f"{out}/rejected")
    return dict(seen.get)


def by_reason(checked: DataFrame) -> DataFrame:
    """How often each reason occurs; a row with several counts with each."""
    return checked.select(F.explode(REASONS).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))
