from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wareflow.functions import numbers, present, rules, text


def one(spark, col, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(col.alias("x")).first().x


def test_canonical_text_ignores_case_and_trailing_blanks(spark):
    wanted = F.expr(text.canonical_sql("s", ["On Hold", "Shipped"]))
    assert one(spark, wanted, s="on hold  ") == "On Hold"
    assert one(spark, wanted, s=" on hold") == " on hold"
    assert one(spark, wanted, s="Other ") == "Other"
    assert one(spark, ~text.text_in("s", ["On Hold"]), s=None) is None
    assert one(spark, text.contains_any("s", ["100%", "a_b"]), s="100 a-b") is False
    assert one(spark, text.contains_any("s", ["East", "West"]), s="NORTHWEST") is True


def test_distinct_list_is_sorted_and_null_when_empty(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, None)], "k INT, v STRING")
    got = {r.k: r.v for r in df.groupBy("k").agg(text.distinct_list("v").alias("v")).collect()}
    assert got == {1: "a, b", 2: None}


@pytest.mark.parametrize("value, digits, want", [("0.125", 2, "0.13"), ("2.5", 0, "3"), ("-2.5", 0, "-3")])
def test_rounding_is_half_away_from_zero(spark, value, digits, want):
    got = one(spark, numbers.rounded(F.col("v").cast("decimal(10,4)"), digits), v=value)
    assert got == Decimal(want)


def test_quotients_are_rounded_once(spark):
    """49,996 of ten million is 0.0049996: two steps would make it 0.01."""
    share = numbers.rounded(numbers.ratio(F.col("a"), F.col("b")), 2)
    assert one(spark, share, a=49_996, b=10_000_000) == Decimal("0.00")
    assert one(spark, numbers.percent(F.col("a"), F.col("b")), a=1, b=20_000) == Decimal("0.01")


@pytest.mark.parametrize("size", [10**k for k in (0, 6, 14, 16, 20, 24)])
def test_shares_of_totals_of_any_size(spark, size):
    total = Decimal(size) * 3
    df = spark.createDataFrame([(Decimal(size), total, -Decimal(size))], "a DECIMAL(38,2), b DECIMAL(38,2), c DECIMAL(38,2)")
    a, b, c = (F.col(x) for x in "abc")
    row = df.select(
        numbers.percent(a, b).alias("third"),
        numbers.percent(c, b, 0).alias("minus"),
        numbers.percent(b, a, 1).alias("over"),
        numbers.percent(a - a, b).alias("none"),
        numbers.percent(a, a - a).alias("undefined"),
        numbers.quotient(a + a, b, 3).alias("plain"),
    ).first()
    assert list(row) == [Decimal("33.33"), Decimal(-33), Decimal("300.0"), 0, None, Decimal("0.667")]


@pytest.mark.parametrize("size", [1, 10**16, 10**24])
def test_shares_next_to_a_half_are_rounded_once(spark, size):
    """5 of 100,000 is 0.005 %: half a hundredth goes up, a cent less goes down."""
    row = spark.createDataFrame([(Decimal(5 * size), Decimal(100_000 * size))], "a DECIMAL(38,2), b DECIMAL(38,2)")
    a, b, cent = F.col("a"), F.col("b"), F.lit(Decimal("0.01"))
    got = row.select(numbers.percent(a, b), numbers.percent(a - cent, b), numbers.percent(-a, b)).first()
    assert list(got) == [Decimal("0.01"), Decimal("0.00"), Decimal("-0.01")]


def test_collated_text_groups_joins_and_compares_without_a_list(spark):
    rows = [("Peru", 1), ("PERU  ", 2), ("peru", 3), ("Perú", 4), (None, 5), (" Peru", 6)]
    df = spark.createDataFrame(rows, "s STRING, n INT").withColumn("s", F.expr(text.canonical_sql("s", ["Chile"], collate=True)))
    groups = df.groupBy("s").agg(text.least_spelling("s").alias("shown"), F.sum("n").alias("n")).select("shown", "n")
    assert {tuple(r) for r in groups.collect()} == {("PERU", 6), ("Perú", 4), (None, 5), (" Peru", 6)}
    assert df.filter("s = 'pErU '").count() == 3 and df.filter(text.text_in("s", ["PERU"])).count() == 3
    other = spark.createDataFrame([("PERu",)], "t STRING").withColumn("t", F.expr(text.canonical_sql("t", collate=True)))
    assert df.join(other, df["s"] == other["t"]).count() == 3
    assert df.select(text.plain("s").alias("s")).filter("s = 'Peru'").count() == 1


def test_quotes_in_listed_values(spark):
    wanted = F.expr(text.canonical_sql("s", ["Côte d'Ivoire", "a\\b"]))
    assert one(spark, wanted, s="CÔTE D'IVOIRE ") == "Côte d'Ivoire" and one(spark, wanted, s="A\\B") == "a\\b"


def test_sample_deviation_from_moments(spark):
    values = [Decimal("1.10"), Decimal("2.25"), Decimal("9.99")]
    df = spark.createDataFrame([(v,) for v in values], "v DECIMAL(10,2)")
    v = F.col("v")
    row = df.select(
        numbers.sample_deviation(F.count(v), F.sum(v), F.sum(v * v)).alias("a"),
        F.stddev_samp(v.cast("double")).alias("b"),
    ).first()
    assert row.a == pytest.approx(row.b, abs=1e-9)
    none = df.limit(1).select(numbers.sample_deviation(F.count(v), F.sum(v), F.sum(v * v)).alias("a"))
    assert none.first().a is None


def test_division_by_zero_is_null(spark):
    assert one(spark, numbers.ratio(F.col("a"), F.col("b")), a=1, b=0) is None
    assert one(spark, numbers.percent(F.col("a"), F.col("b")), a=1, b=3) == Decimal("33.33")


def test_display_formats(spark):
    assert one(spark, present.grouped("v"), v=Decimal("1234567.125")) == "1,234,567.13"
    assert one(spark, present.grouped("v", 0), v=Decimal("2.5")) == "3"
    assert one(spark, present.percent_label("v"), v=85.19) == "85.2%"
    assert one(spark, present.text_or(F.col("v"), "NA"), v=None) == "NA"
    assert one(spark, present.text_or(F.col("v").cast("bigint"), "NA"), v=4) == "4"


def test_report_formats_and_labels(spark):
    df = spark.createDataFrame([(Decimal("1234.50"), 7)], "m DECIMAL(10,2), n INT")
    row = present.report(df, money=["m"], labels={"n": "Units sold"}).first()
    assert row.asDict() == {"m": "1,234.50", "Units sold": 7}


@pytest.mark.parametrize(
    "comment, reason",
    [
        ("The SALES manager", "Budgeting Issues"),
        ("wrong offer", "Budgeting Issues"),  # two rules match, the first wins
        ("Wrong color", "Product Quality Issue"),
        ("damaged", "Shipping issues"),
        ("by mistake", "Mistaken order"),
        ("hello", "Other Reasons"),
        ("   ", "No Reason Provided"),
        ("\n", "Other Reasons"),  # only blanks are blank
        (None, "No Reason Provided"),
        ("x" * 100_000 + " defect", "Product Quality Issue"),  # whole text
    ],
)
def test_exception_rules(spark, comment, reason):
    label = rules.keyword_label(
        "c", rules.EXCEPTION_RULES, rules.EXCEPTION_BLANK, rules.EXCEPTION_OTHER
    )
    df = spark.createDataFrame([(comment,)], "c STRING")
    assert df.select(label).first()[0] == reason


def test_delay_rules_put_hold_first(spark):
    label = rules.keyword_label("c", rules.DELAY_RULES, rules.DELAY_BLANK, rules.DELAY_OTHER)
    assert one(spark, label, c="customer on hold, color") == "Previously on hold"


def test_friction_allow_list_precedes_problem_list(spark):
    flag = rules.friction_flag("c", rules.FRICTION_ALLOW, rules.FRICTION_PROBLEM)
    df = spark.createDataFrame([("Credit Cleared, no sales",), ("no SALES",), ("fine",), (None,)], "c STRING")
    assert [r[0] for r in df.select(flag).collect()] == [0, 1, 0, 0]


def test_region_of_country(spark):
    region = rules.region_of("c", rules.REGIONS, rules.REGION_OTHER)
    df = spark.createDataFrame([("Norway",), ("USA",), ("Japan",), ("Peru",), (None,)], "c STRING")
    assert [r[0] for r in df.select(region).collect()] == ["EMEA", "NA", "APAC", "Other/Unknown", "Other/Unknown"]


@pytest.mark.parametrize("pattern", ["damag|missing", "on hold", "dam.g|miss(ing)?", r"\bmissing\b"])
def test_words_and_regular_expressions_agree(spark, pattern):
    texts = ["", "DAMAGED", "is Missing.", "dismissing", "on HOLD", "on\nhold", None, "a" * 9999 + "missing"]
    df = spark.createDataFrame([(t,) for t in texts], "c STRING")
    got = df.select(text.matches("c", pattern).alias("a"), F.col("c").rlike(f"(?i){pattern}").alias("b"))
    assert all(r.a == r.b for r in got.collect())
