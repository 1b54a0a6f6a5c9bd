"""Spend, budgets, trends and totals.

Spend is minus the sum of negative amounts of live rows; a row belongs to a live
category or is uncategorised, never both. Each answer is one pass over one
snapshot, so its parts always add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity, months
from ..ledger import live

UNCATEGORISED = "uncategorised"


def expenses(tx: DataFrame, window: tuple[str, str] | None = None) -> DataFrame:
    out = live(tx).where("amount_minor < 0")
    return out.where(F.col("date").between(*window)) if window else out


def with_live_category(tx: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds ``live_category``: the category where it is live, else null. The
    categories are a user's list; Spark decides by size how to join it."""
    cats = live(categories).select(F.col("id").alias("live_category"))
    return tx.join(cats, F.col("category_id") == F.col("live_category"), "left")


def breakdown(tx: DataFrame, categories: DataFrame, window: tuple[str, str] | None) -> DataFrame:
    """category_id, spent_minor; uncategorised is a row if anything was spent so."""
    rows = with_live_category(expenses(tx, window), categories)
    return rows.groupBy(F.coalesce("live_category", F.lit(UNCATEGORISED)).alias("category_id")).agg(F.sum(-F.col("amount_minor")).alias("spent_minor"))


def category_spend(tx: DataFrame, categories: DataFrame, window: tuple[str, str] | None) -> DataFrame:
    rows = expenses(tx, window).join(live(categories).select(F.col("id").alias("c")), F.col("category_id") == F.col("c"), "left_semi")
    return rows.groupBy("category_id").agg(F.sum(-F.col("amount_minor")).alias("spent_minor"))


def uncategorised_spend(tx: DataFrame, categories: DataFrame, window: tuple[str, str] | None) -> DataFrame:
    """One row. Null categories never match, so an anti join keeps them."""
    rows = expenses(tx, window).join(live(categories).select(F.col("id").alias("c")), F.col("category_id") == F.col("c"), "left_anti")
    return rows.agg(F.coalesce(F.sum(-F.col("amount_minor")), F.lit(0)).alias("spent_minor"))


def slices(tx: DataFrame, categories: DataFrame, window: tuple[str, str]) -> DataFrame:
    """The breakdown with category names, largest first."""
    names = live(categories).select("id", "name")
    rows = breakdown(tx, categories, window).join(names, F.col("category_id") == F.col("id"), "left")
    return rows.where("spent_minor > 0").select("category_id", "name", "spent_minor").orderBy(F.desc("spent_minor"), "category_id")


def monthly_spend(tx: DataFrame, window: tuple[str, str] | None = None) -> DataFrame:
    return expenses(tx, window).groupBy(months.month_of_date(F.col("date")).alias("year_month")).agg(F.sum(-F.col("amount_minor")).alias("spent_minor"))


def earliest_date(tx: DataFrame) -> DataFrame:
    return live(tx).agg(F.min("date").alias("earliest"))


def trend(tx: DataFrame, month: str, most: int = 6) -> DataFrame:
    """year_month, spent_minor for up to ``most`` months that end with ``month``;
    it starts with the first month of history, and months without spend are zero."""
    if most < 1:
        raise ValueError("a trend has at least one month")
    floor = months.shift(month, 1 - most)
    first = live(tx).agg(months.month_of_date(F.min("date")).alias("first"))
    start = F.when(F.col("first").isNull() | (F.col("first") > month), F.lit(month)).otherwise(F.greatest("first", F.lit(floor)))
    to_date = lambda c: F.concat(c, F.lit("-01")).cast("date")
    span = first.select(F.explode(F.sequence(to_date(start), to_date(F.lit(month)), F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("year_month"))
    spent = monthly_spend(tx, (months.window(floor)[0], months.window(month)[1]))
    return span.join(spent, "year_month", "left").select("year_month", F.coalesce("spent_minor", F.lit(0)).alias("spent_minor"))


def budgets_with_spend(tx: DataFrame, budgets: DataFrame, month: str) -> DataFrame:
    """Live budgets of a month, each with what its category spent in it."""
    spent = expenses(tx, months.window(month)).where("category_id is not null").groupBy(F.col("category_id").alias("c")).agg(F.sum(-F.col("amount_minor")).alias("s"))
    mine = live(budgets).where(F.col("year_month") == month)
    return mine.join(spent, F.col("category_id") == F.col("c"), "left").select("id", "category_id", "year_month", "limit_minor", F.coalesce("s", F.lit(0)).alias("spent_minor"))


def remaining(limit: Column, spent: Column) -> Column:
    return limit - spent


def fraction(limit: Column, spent: Column) -> Column:
    """Share of the limit as a 32-bit float, not clamped; of a zero limit all or none."""
    share = spent.cast("float") / F.when(limit != 0, limit).cast("float")
    return F.when(limit == 0, F.when(spent > 0, 1.0).otherwise(0.0)).otherwise(share).cast("float")


def status(limit: Column, spent: Column) -> Column:
    near = (limit > 0) & (fraction(limit, spent) >= F.lit(0.9).cast("float"))
    return F.when(spent > limit, "OVER").when(near, "NEAR_LIMIT").otherwise("UNDER")


def progress(tx: DataFrame, budgets: DataFrame, month: str) -> DataFrame:
    limit, spent = F.col("limit_minor"), F.col("spent_minor")
    return budgets_with_spend(tx, budgets, month).select(
        "id", "category_id", "limit_minor", "spent_minor", remaining(limit, spent).alias("remaining_minor"), fraction(limit, spent).alias("fraction"),
        status(limit, spent).alias("status"), (spent == limit).alias("at_limit"),
    )


def over_budget(tx: DataFrame, budgets: DataFrame, month: str) -> DataFrame:
    return progress(tx, budgets, month).where("status = 'OVER'")


def monthly_budgets(tx: DataFrame, budgets: DataFrame, categories: DataFrame, month: str) -> DataFrame:
    """Budgets with spend, and one row more for what no live category has."""
    rest = uncategorised_spend(tx, categories, months.window(month)).select(F.lit(UNCATEGORISED).alias("category_id"), F.lit(None).cast("bigint").alias("limit_minor"), "spent_minor")
    return budgets_with_spend(tx, budgets, month).select("category_id", "limit_minor", "spent_minor").unionByName(rest)


def budget_flags(tx: DataFrame, budgets: DataFrame, month: str) -> DataFrame:
    rows = budgets_with_spend(tx, budgets, month)
    return rows.agg(F.bool_and(F.col("spent_minor") == 0).alias("nothing_counted_yet"), F.bool_or(F.col("spent_minor") > F.col("limit_minor")).alias("any_over"))


def net_total(tx: DataFrame, predicate: Column) -> DataFrame:
    return live(tx).where(predicate).agg(F.coalesce(F.sum("amount_minor"), F.lit(0)).alias("net_minor"))


def by_date(tx: DataFrame, today: str) -> DataFrame:
    """Live rows under their dates: date, header, id, place (newest first), and of the
    date n and net_minor. A date may hold very many rows; they stay rows."""
    yesterday = F.date_sub(F.lit(today).cast("date"), 1).cast("string")
    header = F.when(F.col("date") == today, "Today").when(F.col("date") == yesterday, "Yesterday").otherwise("Dated")
    rows = identity.ranked(live(tx).select("date", "id", "created_at", "amount_minor"), "date", [F.desc("created_at"), "id"], "place")
    dates = live(tx).groupBy(F.col("date").alias("_d")).agg(F.count("*").alias("n"), F.sum("amount_minor").alias("net_minor"))
    return rows.join(dates, F.col("date") == F.col("_d")).select("date", header.alias("header"), "id", "place", "n", "net_minor")


def next_priority(rules: DataFrame) -> DataFrame:
    return live(rules).agg((F.coalesce(F.max("priority"), F.lit(-1)) + 1).alias("next_priority"))
