"""Stated results of the scalar functions, edge cases first."""

import pytest
from pyspark.sql import functions as F

from tallywake.functions import identity, money, months, text
from tallywake.plans.scalars import last_sync
from tallywake.streaming import replication

STATED = {
    "money": (money.parse, [("1234.56", 123456), ("1,234.56", 123456), ("12,34,567.89", 123456789), ("(1,234.56)", -123456), ("1.234,56", 123456), ("₹ 1,234.56", 123456), ("$1234.56", 123456), ("1,234", 123400), ("12.5", 1250), ("", None), ("N/A", None),
                            ("₹-500", 50000), ("500-", 50000), ("1.234", 123400), ("12.3456", 1234), (".", 0), ("-", None), ("0.125", 12500), ("-42", -4200), ("99999999999999999999", None), (None, None), ("()", None), ("(", None)]),
    "title case": (text.title_case, [("BLUE TOKAI COFFEE", "Blue Tokai Coffee"), ("UPI PAYMENT PVR", "UPI Payment PVR"), ("Uber Eats", "Uber Eats"), ("123", "123"), ("HDFC BANK EMI", "HDFC Bank EMI")]),
    "trim": (text.trim_upper, [("  coffee shop ", "COFFEE SHOP"), (" Tea ", "TEA"), ("", "")]),
    "sanitize": (money.sanitize_input, [("1,2", "12"), ("12.3.4", "12.34"), ("abc", ""), (".5", ".5")]),
    "magnitude": (money.parse_magnitude, [(".", None), ("12.5", 1250), ("", None), ("7", 700)]),
    "edit": (lambda c: money.format_for_editing(c.cast("bigint")), [("123456", "1234.56"), ("5", "0.05"), ("0", "0.00")]),
    "places": (money.decimal_places, [("INR", 2), ("JPY", 0), ("KWD", 3)]),
    "month": (months.parse_month, [("2026-08", "2026-08"), (" 2026-08 ", "2026-08"), ("2026-8", None), ("2026-13", None)]),
    "two months on": (lambda c: months.plus_months(c, 2), [("2026-11", "2027-01"), ("2026-01", "2026-03")]),
    "scheme": (identity.scheme_of, [("h1:abc123#2", "h1"), ("h9:abc#0", None), ("uuid", None)]),
    "derived": (identity.is_content_derived, [("h1:abc123#2", True), ("h7:00ff#0", True), ("h1:xyz#0", False), ("c1", False)]),
    "budget": (lambda c: identity.budget_id(c, F.lit("2026-08")), [("food", "budget:food:2026-08")]),
    "form": (lambda c: money.signed(F.lit(500).cast("bigint"), c), [("INCOME", 500), ("EXPENSE", -500)]),
    "age": (lambda c: last_sync(c.cast("int")), [("0", "JustNow"), ("59", "59 minutes"), ("61", "1 hours"), ("1500", "1 days"), ("4320", "3 days stale"), (None, "Never")]),
    "outcome": (lambda c: replication.outcome_of(c.cast("int")), [("200", "success"), ("404", "terminal"), ("429", "retryable"), ("503", "retryable")]),
    "code": (lambda c: F.hex(replication.salt_of(c)), [("c2FsdA==", "73616C74"), ("!", None)]),
}


@pytest.mark.parametrize("name", sorted(STATED))
def test_stated(spark, name):
    f, rows = STATED[name]
    df = spark.createDataFrame([(k, raw) for k, (raw, _) in enumerate(rows)], "k int, raw string")
    assert [r.x for r in df.select("k", f(F.col("raw")).alias("x")).orderBy("k").collect()] == [want for _, want in rows]
