"""Copy-on-write updates: what is rewritten, what stays, and what a failure leaves."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wareflow.operators import clean
from wareflow.sources import versions


@pytest.fixture
def base(spark, tmp_path):
    rows = [(k, f"m {k % 5}", k * 10, "2024-01-05" if k % 5 else "5-1-2024") for k in range(50)]
    path = f"{tmp_path}/t able"
    versions.create(spark.createDataFrame(rows, "k INT, month STRING, v BIGINT, d STRING"), path, "month")
    return path


def rows(df):
    return sorted(map(tuple, df.collect()))


def files(base):
    return {str(p.relative_to(base)): p.stat().st_mtime_ns for p in Path(base).rglob("*.parquet")}


def test_untouched_folders_keep_their_files(spark, base):
    before, old = rows(versions.read(spark, base)), files(base)
    assert versions.update(spark, base, F.expr("k IN (2, 7, 12)"), {"v": F.col("v") + 1}) == 1
    assert rows(versions.read(spark, base)) == [(k, m, v + (k in (2, 7, 12)), d) for k, m, v, d in before]
    new = files(base)
    assert {k: new[k] for k in old} == old and len(new) > len(old)
    assert all("version=1" in k and "m 2" in k.replace("%20", " ") for k in set(new) - set(old))
    read = {Path(f).parent.parent.name for f in versions.read(spark, base).inputFiles()}
    assert read == {"version=0", "version=1"} and len(versions.read(spark, base).inputFiles()) < len(new)
    assert rows(versions.read(spark, base, 0)) == before and versions.versions(spark, base) == [0, 1]


def test_a_failed_write_leaves_the_old_version(spark, base):
    before = rows(versions.read(spark, base))
    broken = F.when(F.col("k") == 13, F.raise_error(F.lit("broken")).cast("bigint")).otherwise(F.col("v"))
    with pytest.raises(Exception, match="broken"):
        versions.update(spark, base, F.lit(True), {"v": broken})
    assert versions.versions(spark, base) == [0] and rows(versions.read(spark, base)) == before
    assert versions.update(spark, base, F.col("k") == 13, {"v": F.lit(0)}) == 1
    assert rows(versions.read(spark, base).filter("k = 13")) == [(13, "m 3", 0, "2024-01-05")]


def test_two_writers_of_one_version(spark, base, monkeypatch):
    write = versions._write

    def late(df, path, version, column):
        found = write(df, path, version, column)
        monkeypatch.setattr(versions, "_write", write)
        versions._publish(spark, path, version, versions._manifest(spark, path, 0))
        return found

    monkeypatch.setattr(versions, "_write", late)
    with pytest.raises(RuntimeError, match="another job"):
        versions.update(spark, base, F.col("k") == 1, {"v": F.lit(-1)})
    assert versions.read(spark, base).filter("v = -1").count() == 0


def test_rows_may_move_to_another_folder(spark, base):
    before = rows(versions.read(spark, base))
    versions.update(spark, base, F.col("k") < 3, {"month": F.lit("m 4")})
    want = sorted((k, "m 4" if k < 3 else m, v, d) for k, m, v, d in before)
    assert rows(versions.read(spark, base)) == want
    versions.update(spark, base, F.col("month") == "m 4", {"month": F.lit(None)})
    assert rows(versions.read(spark, base).filter("month IS NULL").select("k")) == [(k,) for k, m, *_ in want if m == "m 4"]
    assert rows(versions.read(spark, base).filter("month = 'm 2'").select("k")) == [(k,) for k, m, *_ in want if m == "m 2"]


def test_updates_that_change_nothing_make_no_version(spark, base):
    assert versions.update(spark, base, F.col("k") > 1000, {"v": F.lit(0)}) == 0
    assert versions.update(spark, base, F.lit(None).cast("boolean"), {"v": F.lit(0)}) == 0
    with pytest.raises(FileNotFoundError):
        versions.read(spark, base, 3)
    with pytest.raises(FileExistsError):
        versions.create(versions.read(spark, base), base, "month")


def test_filters_on_the_partition_column_prune_folders(spark, base):
    versions.update(spark, base, F.col("k") == 2, {"v": F.lit(0)})
    plan = versions.read(spark, base).filter("month = 'm 2'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_dates_of_a_stored_table(spark, base):
    assert versions.update(spark, base, *clean.text_date_update(["d"])) == 1
    assert {r.d for r in versions.read(spark, base).collect()} == {"2024-01-05"}
    assert len([f for f in versions.read(spark, base).inputFiles() if "version=1" in f]) < len(versions.read(spark, base).inputFiles())
    assert versions.update(spark, base, *clean.text_date_update(["d"])) == 1
