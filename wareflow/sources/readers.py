"""Typed scans of the nine tables from Parquet, CSV or a JDBC database."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from wareflow.operators.clean import fold_text
from wareflow.sources.schemas import CANONICAL, COLLATED, FACTS, TABLES, schema_of


def read_parquet(spark: SparkSession, base: str, table: str) -> DataFrame:
    """No footer inference: the declared schema is the contract, filters and columns push down."""
    return spark.read.schema(schema_of(table)).parquet(f"{base}/{table}")


def read_csv(
    spark: SparkSession,
    base: str,
    table: str,
    text_dates: bool = False,
    null: str = "NULL",
    multi_line: bool = False,
) -> DataFrame:
    """Header CSV with declared types, read by column name; a row that does not fit fails the job
    instead of turning into NULLs.

    ``multi_line`` allows line ends in quoted text, at the price of one task for each file.
    """
    schema = schema_of(table, text_dates)
    read = (
        spark.read.option("header", True)
        .option("nullValue", null)
        .option("mode", "FAILFAST")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
    )
    # The first file's header tells the order of the columns; a file that has another one fails.
    header = read.csv(f"{base}/{table}").columns
    missing = set(schema.fieldNames()) - set(header)
    if missing:
        raise ValueError(f"{table} has no columns {sorted(missing)}")
    types = {f.name: f.dataType for f in schema}
    found = StructType([StructField(name, types.get(name, StringType())) for name in header])
    return read.schema(found).option("enforceSchema", False).csv(f"{base}/{table}").select(*schema.fieldNames())


def jdbc_options(
    url: str,
    table: str,
    split_on: str | None = None,
    bounds: tuple[int, int] | None = None,
    splits: int = 1,
    fetch: int = 10_000,
) -> dict[str, str]:
    """Options of a database scan. With ``split_on`` the table is read by ``splits`` parallel
    range queries; without it one task reads everything, so facts need it."""
    if table in FACTS and not split_on:
        raise ValueError(f"{table} is read in parallel: give split_on, bounds and splits")
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch)}
    if split_on:
        if bounds is None:
            raise ValueError("split_on needs bounds")
        options |= {
            "partitionColumn": split_on,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(splits),
        }
    return options


def read_jdbc(spark: SparkSession, url: str, table: str, **split) -> DataFrame:
    """A database table cast to the declared types."""
    raw = spark.read.format("jdbc").options(**jdbc_options(url, table, **split)).load()
    return raw.select(*[raw[f.name].cast(f.dataType).alias(f.name) for f in schema_of(table)])


def _typed_as(options: Mapping[str, Mapping] | None, table: str) -> dict[str, bool]:
    return {k: v for k, v in (options or {}).get(table, {}).items() if k == "text_dates"}


def load(
    spark: SparkSession,
    base: str,
    tables: Iterable[str] = tuple(TABLES),
    fmt: str = "parquet",
    options: Mapping[str, Mapping] | None = None,
) -> dict[str, DataFrame]:
    """All (or the named) tables of a model directory or database, lazily, their text in canonical
    form. ``base`` is the database's address for ``fmt="jdbc"``; ``options`` has further arguments of
    the reader by table."""
    reader = {"parquet": read_parquet, "csv": read_csv, "jdbc": read_jdbc}[fmt]
    return {
        table: fold_text(
            reader(spark, base, table, **(options or {}).get(table, {})),
            CANONICAL.get(table),
            COLLATED.get(table, ()),
            [f.name for f in schema_of(table, **_typed_as(options, table)) if isinstance(f.dataType, StringType)],
        )
        for table in tables
    }
