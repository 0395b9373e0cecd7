"""Typed ingest with rejects: every line is accepted or rejected, with the reason."""

from datetime import date
from decimal import Decimal

import pytest

from wareflow.sources import ingest, readers
from wareflow.sources.schemas import schema_of

HEAD = "orderNumber,customerNumber,orderDate,requiredDate,shippedDate,status,comments"
GOOD = [
    '1,10,2024-01-05,2024-02-01,NULL,Shipped,"a, ""b"" c"',
    "2,10,2024-1-5,2024-02-01,2024-01-09,Shipped,NULL",
    "3,NULL,NULL,NULL,NULL,NULL,NULL",
]
BAD = {
    "x4,10,2024-01-05,2024-02-01,NULL,Shipped,no": "orderNumber is not bigint",
    "NULL,10,2024-01-05,2024-02-01,NULL,Shipped,no": "orderNumber is missing",
    "5,10,05-01-2024,soon,NULL,Shipped,no": "orderDate is not date, requiredDate is not date",
    "6,10,2024-01-05,2024-02-01": "wrong number of fields",
    "7,10,2024-01-05,2024-02-01,NULL,Shipped,no,more,and more": "wrong number of fields",
    "99999999999999999999,10,2024-01-05,2024-02-01,NULL,Shipped,no": "orderNumber is not bigint",
}


@pytest.fixture
def base(tmp_path):
    folder = tmp_path / "orders"
    folder.mkdir()
    lines = [*GOOD, *BAD]
    (folder / "a.csv").write_text("\n".join([HEAD, *lines[:5]]) + "\n")
    (folder / "b.csv").write_text("\n".join([HEAD, *lines[5:]]) + "\n")
    return str(tmp_path)


def test_accepted_and_rejected_are_all_lines(spark, base, tmp_path):
    counts = ingest.ingest(spark, base, "orders", f"{tmp_path}/out")
    assert counts == {"lines": 9, "accepted": 3, "rejected": 6}
    kept = spark.read.parquet(f"{tmp_path}/out/accepted")
    assert dict(kept.dtypes) == dict((f.name, f.dataType.simpleString()) for f in schema_of("orders"))
    assert {r.orderNumber: (r.orderDate, r.comments) for r in kept.collect()} == {1: (date(2024, 1, 5), 'a, "b" c'), 2: (date(2024, 1, 5), None), 3: (None, None)}
    gone = spark.read.parquet(f"{tmp_path}/out/rejected").collect()
    assert sorted(r.reason for r in gone) == sorted(BAD.values())
    assert any(r.line == "6,10,2024-01-05,2024-02-01" for r in gone) and any('"orderNumber":"x4"' in r.line for r in gone)


def test_reasons_are_counted(spark, base):
    checked, _ = ingest.read_csv_checked(spark, f"{base}/orders", schema_of("orders"), ["orderNumber"])
    got = {r.reason: r.n_rows for r in ingest.by_reason(checked).collect()}
    assert got == {"orderNumber is not bigint": 2, "orderNumber is missing": 1, "orderDate is not date": 1, "requiredDate is not date": 1, "wrong number of fields": 2}


def test_strict_reading_still_fails(spark, base):
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        readers.read_csv(spark, base, "orders").collect()


def test_money_and_missing_columns(spark, tmp_path):
    (tmp_path / "payments").mkdir()
    (tmp_path / "payments" / "a.csv").write_text("amount,customerNumber,checkNumber,paymentDate\n12.50,1,a,2024-01-01\n123456789012,1,b,2024-01-01\n")
    checked, _ = ingest.read_csv_checked(spark, f"{tmp_path}/payments", schema_of("payments"))
    assert [r.amount for r in ingest.accepted(checked).collect()] == [Decimal("12.50")]
    assert [r.reason for r in ingest.rejected(checked).collect()] == ["amount is not decimal(10,2)"]
    with pytest.raises(ValueError, match="orderNumber"):
        ingest.read_csv_checked(spark, f"{tmp_path}/payments", schema_of("orders"))
