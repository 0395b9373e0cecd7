from datetime import date

from tests.conftest import by
from wareflow.operators import clean, quality


def text_dates(spark):
    return spark.createDataFrame(
        [
            (1, "31-01-2004", "2004-02-01"),
            (2, "2004-01-31", "2004-02-01"),
            (3, "31-02-2004", None),
            (4, "2004-01-31", None),
        ],
        "k INT, a STRING, b STRING",
    )


def test_dates_are_judged_by_column(spark):
    got = by(clean.normalize_dates(text_dates(spark), ["a", "b"]), "k")
    assert got[1] == {"k": 1, "a": date(2004, 1, 31), "b": date(2004, 2, 1)}
    assert got[2]["a"] == date(2004, 1, 31)
    assert got[3] == {"k": 3, "a": None, "b": None}


def test_dates_by_row_lose_the_iso_value_beside_a_day_first_one(spark):
    got = by(clean.normalize_dates(text_dates(spark), ["a", "b"], whole_row=True), "k")
    assert got[1] == {"k": 1, "a": date(2004, 1, 31), "b": None}
    assert got[2]["b"] == date(2004, 2, 1)
    assert got[4] == {"k": 4, "a": date(2004, 1, 31), "b": None}


def test_dates_of_one_digit_and_with_blanks(spark):
    df = spark.createDataFrame([("1-2-2004",), (" 2004-02-01 ",), ("2004-2-1",), ("1-2-04",)], "a STRING")
    got = [r.a for r in clean.normalize_dates(df, ["a"]).collect()]
    assert got == [date(2004, 2, 1)] * 3 + [None]


def test_null_parts_of_a_key_keep_their_place(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, "a"), (None, "a")], "x STRING, y STRING")
    got = {r.identifier for r in quality.duplicate_keys({"K": (df, ["x", "y"])}).collect()}
    assert got == {"a|", "|a"}


def test_fold_text_trims_and_unifies_spelling(spark):
    df = spark.createDataFrame([(1, "On hold ", "Norway  "), (2, "ON HOLD", None), (3, "new", " x")], "k INT, s STRING, c STRING")
    got = by(clean.fold_text(df, {"s": ["On Hold", "Shipped"]}), "k")
    assert [got[k]["s"] for k in (1, 2, 3)] == ["On Hold", "On Hold", "new"]
    assert [got[k]["c"] for k in (1, 2, 3)] == ["Norway", None, " x"]


def test_override_changes_matches_only(model):
    got = by(clean.override(model["offices"], "territory", [("country", "Japan", "APAC")]), "officeCode")
    assert {k: v["territory"] for k, v in got.items()} == {"1": "EMEA", "2": "APAC", "3": "NA"}


def test_duplicate_keys_single_and_composite(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1)], "a INT, b INT")
    got = quality.duplicate_keys({"A": (df, ["a"]), "AB": (df, ["a", "b"])}).collect()
    assert {tuple(r) for r in got} == {("A", "1", 3), ("AB", "1|1", 2)}


def test_null_audit(model):
    row = quality.null_audit(model["orders"], {"shippedDate": "no_ship", "status": "no_status"}).first()
    assert (row.total_rows, row.no_ship, row.no_status) == (7, 3, 0)


def test_key_audit_counts_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (None, 1)], "a INT, b INT")
    got = by(quality.key_audit({"t": (df, ["a", "b"]), "empty": (df.limit(0), ["a"])}), "table_name")
    assert got["t"] == {"total_rows": 3, "distinct_keys": 2, "duplicate_keys": 1, "null_key_rows": 1, "table_name": "t"}
    assert got["empty"]["total_rows"] == 0 and got["empty"]["null_key_rows"] == 0


def test_orphan_audit_ignores_null_references(spark):
    child = spark.createDataFrame([(1,), (9,), (9,), (8,), (None,)], "ref INT")
    parent = spark.createDataFrame([(1,), (2,)], "id INT")
    row = quality.orphan_audit([("c", child, "ref", parent, "id")]).first()
    assert (row.orphan_rows, row.orphan_values) == (3, 2)


def test_other_formats_are_parsed_too(spark):
    df = spark.createDataFrame([("3 Feb 2004",), ("2004/02/03",), ("x",), ("20040203",)], "a STRING")
    got = clean.normalize_dates(df, ["a"], ["d MMM yyyy", "yyyy/MM/dd", "yyyyMMdd"]).collect()
    assert [r.a for r in got] == [date(2004, 2, 3), date(2004, 2, 3), None, date(2004, 2, 3)]
