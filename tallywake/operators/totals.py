"""Spend totals that follow changes instead of being computed anew.

The total of a category and month is a sum over rows, and a change of a row takes its
old image out and puts its new one in; deletions, moves between categories or months
and new amounts are all that. Totals are kept by the category that rows name, live or
not, so that deleting a category costs nothing here: reading decides what is live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import months
from ..ledger import live
from . import spend

KEY = ["category_id", "year_month"]


def key() -> Column:
    """One text for each total."""
    return F.concat_ws("|", F.coalesce("category_id", F.lit("")), "year_month")


def contributions(rows: DataFrame, sign: int = 1) -> DataFrame:
    """What rows add to their totals: spent_minor and how many they are."""
    month = months.month_of_date(F.col("date")).alias("year_month")
    return spend.expenses(rows).select("category_id", month, (F.col("amount_minor") * -sign).alias("spent_minor"), F.lit(sign).cast("bigint").alias("n"))


def summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*KEY).agg(F.sum("spent_minor").alias("spent_minor"), F.sum("n").alias("n"))


def totals(tx: DataFrame) -> DataFrame:
    """category_id, year_month, spent_minor, n: all totals, from all rows."""
    return summed(contributions(tx))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """What the totals change by, from images of changed rows before and after; rows
    that are in both and equal cancel out, and totals that stay have no row."""
    return summed(contributions(before, -1).unionByName(contributions(after))).where("spent_minor <> 0 or n <> 0")


def applied(old: DataFrame, change: DataFrame) -> DataFrame:
    """Totals after a change; those that no row is left of go."""
    return summed(old.select(*KEY, "spent_minor", "n").unionByName(change)).where("n <> 0")


# What is observed, read from totals

def breakdown(held: DataFrame, categories: DataFrame, month: str) -> DataFrame:
    """``spend.breakdown`` of a month."""
    rows = spend.with_live_category(held.where(F.col("year_month") == month), categories)
    return rows.groupBy(F.coalesce("live_category", F.lit(spend.UNCATEGORISED)).alias("category_id")).agg(F.sum("spent_minor").alias("spent_minor"))


def monthly_spend(held: DataFrame) -> DataFrame:
    """``spend.monthly_spend`` of all months."""
    return held.groupBy("year_month").agg(F.sum("spent_minor").alias("spent_minor"))


def budgets_with_spend(held: DataFrame, budgets: DataFrame, month: str) -> DataFrame:
    """``spend.budgets_with_spend``."""
    spent = held.where((F.col("year_month") == month) & F.col("category_id").isNotNull()).select(F.col("category_id").alias("c"), F.col("spent_minor").alias("s"))
    mine = live(budgets).where(F.col("year_month") == month)
    return mine.join(spent, F.col("category_id") == F.col("c"), "left").select("id", "category_id", "year_month", "limit_minor", F.coalesce("s", F.lit(0)).alias("spent_minor"))
