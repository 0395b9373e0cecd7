"""Updates of a stored table by copy on write.

A table is a folder with ``data/version=<n>/<column>=<value>/`` folders of Parquet files and a manifest for each
version, which names the folders that the version consists of. An update rewrites only folders that
hold a changed row; the others are named again. The manifest is written last and under a name that must
not exist, so a failed write leaves the version before as it was, and of two writers at once one fails.
Readers follow one manifest, so they see one version whatever is written meanwhile; old versions stay readable.

Folders of equal column values in several versions are possible: rows that an update moves to another
value go to a new folder beside the old one.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from urllib.parse import unquote

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _path(spark: SparkSession, text: str) -> tuple[JavaObject, JavaObject]:
    """A path and its file system, wherever the table lives."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    path, files = _path(spark, folder)
    if not files.exists(path):
        return []
    return [s.getPath().getName() for s in files.listStatus(path) if not s.getPath().getName().startswith(("_", "."))]


def versions(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the versions that are complete."""
    return sorted(int(n.removesuffix(".json")) for n in _names(spark, f"{base}/manifest") if n.endswith(".json"))


def _manifest(spark: SparkSession, base: str, version: int) -> dict:
    path, files = _path(spark, f"{base}/manifest/{version}.json")
    stream = files.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _publish(spark: SparkSession, base: str, version: int, manifest: dict) -> None:
    """Write a version's manifest beside its place and move it there, which fails if the place is taken."""
    part, files = _path(spark, f"{base}/manifest/_{version}-{spark.sparkContext.applicationId}")
    place, _ = _path(spark, f"{base}/manifest/{version}.json")
    stream = files.create(part, True)
    try:
        stream.write(bytearray(json.dumps(manifest).encode()))
    finally:
        stream.close()
    if files.exists(place) or not files.rename(part, place):
        raise RuntimeError(f"version {version} of {base} was written by another job")


def _write(df: DataFrame, base: str, version: int, column: str) -> list[str]:
    """Write a version's new folders and return their names."""
    folder = f"{base}/data/version={version}"
    df.hint("rebalance", F.col(column)).write.mode("overwrite").partitionBy(column).parquet(folder)
    return [f"version={version}/{name}" for name in sorted(_names(df.sparkSession, folder))]


def create(df: DataFrame, base: str, partition_by: str) -> int:
    """Store a table as version 0."""
    if versions(df.sparkSession, base):
        raise FileExistsError(base)
    manifest = {"column": partition_by, "schema": df.schema.jsonValue(), "folders": _write(df, base, 0, partition_by)}
    _publish(df.sparkSession, base, 0, manifest)
    return 0


def _of(spark: SparkSession, base: str, manifest: dict) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"])
    if not manifest["folders"]:
        return spark.createDataFrame([], schema)
    read = spark.read.schema(schema).option("basePath", f"{base}/data")
    return read.parquet(*[f"{base}/data/{folder}" for folder in manifest["folders"]])


def read(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """A version of the table, the last one by default. Filters on the partition column prune folders."""
    known = versions(spark, base)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"{base} has versions {known}")
    manifest = _manifest(spark, base, known[-1] if version is None else version)
    names = StructType.fromJson(manifest["schema"]).fieldNames()
    return _of(spark, base, manifest).select(*names)


def update(spark: SparkSession, base: str, where: Column, changes: Mapping[str, Column]) -> int:
    """Set columns in the rows for which ``where`` is true, as a new version; returns its number.

    Both are expressions over the row before the update, whose folder is rewritten as a whole. A row for which ``where`` is NULL stays.
    An update that changes no row makes no version.
    """
    last = versions(spark, base)[-1]
    manifest = _manifest(spark, base, last)
    rows = _of(spark, base, manifest)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/data/(version=\d+/[^/]+)/[^/]+$", 1)
    touched = {unquote(r[0]) for r in rows.where(where).select(folder).distinct().collect()}  # folders only
    if not touched:
        return last
    kept = [f for f in manifest["folders"] if unquote(f) not in touched]
    if len(kept) + len(touched) != len(manifest["folders"]):
        raise RuntimeError(f"folders of {base} don't match its manifest")
    hit = F.coalesce(where, F.lit(False))
    old = _of(spark, base, manifest | {"folders": [f for f in manifest["folders"] if f not in kept]})
    schema = StructType.fromJson(manifest["schema"])
    new = old.select(*[F.when(hit, changes[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in changes else F.col(f.name) for f in schema])
    _publish(spark, base, last + 1, manifest | {"folders": kept + _write(new, base, last + 1, manifest["column"])})
    return last + 1
