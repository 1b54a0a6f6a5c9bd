"""Months are strings yyyy-MM, dates strings yyyy-MM-dd; both compare as text."""

from __future__ import annotations

import calendar
import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_month(c: Column) -> Column:
    """A month without blanks around it; null unless it is yyyy-MM with 01 to 12."""
    text = F.trim(c)
    return F.when(text.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$"), text)


def month_of(year: Column, month: Column) -> Column:
    good = year.between(1, 9999) & month.between(1, 12)
    return F.when(good, F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0")))


def month_of_date(date: Column) -> Column:
    return F.substring(date, 1, 7)


def first_day(month: Column) -> Column:
    return F.concat(month, F.lit("-01"))


def last_day(month: Column) -> Column:
    return F.last_day(first_day(month).cast("date")).cast("string")


def plus_months(month: Column, n: int | Column) -> Column:
    return F.date_format(F.add_months(first_day(month).cast("date"), n), "yyyy-MM")


def window(month: str) -> tuple[str, str]:
    """First and last day of a literal month."""
    if not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", month):
        raise ValueError(f"not a month: {month}")
    y, m = map(int, month.split("-"))
    return f"{month}-01", f"{month}-{calendar.monthrange(y, m)[1]:02d}"


def shift(month: str, n: int) -> str:
    y, m = map(int, month.split("-"))
    k = y * 12 + m - 1 + n
    return f"{k // 12:04d}-{k % 12 + 1:02d}"


def preset_window(preset: str, today: str, start: str | None = None, end: str | None = None) -> tuple[str, str] | None:
    """THIS_MONTH, LAST_MONTH or CUSTOM; a custom window without both ends is none."""
    if preset == "CUSTOM":
        return (start, end) if start and end else None
    month = dt.date.fromisoformat(today).strftime("%Y-%m")
    return window(month if preset == "THIS_MONTH" else shift(month, -1))
