"""Filters, lookups and orders over the ledger's tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import months
from ..ledger import live
from ..lineage import cut


@dataclass(frozen=True)
class Filter:
    """Categories and an inclusive date window; what is empty does not filter."""

    categories: tuple[str, ...] = ()
    window: tuple[str, str] | None = None

    @property
    def is_active(self) -> bool:
        return bool(self.categories) or self.window is not None

    def predicate(self) -> Column:
        out = F.lit(True)
        if self.categories:
            out = out & F.col("category_id").isin(*self.categories)
        if self.window:
            out = out & F.col("date").between(*self.window)
        return out


@dataclass(frozen=True)
class FilterState:
    """What a user has chosen: categories and a preset with its bounds."""

    categories: tuple[str, ...] = ()
    preset: str | None = None
    start: str | None = None
    end: str | None = None

    def resolve(self, today: str) -> Filter:
        return Filter(self.categories, months.preset_window(self.preset, today, self.start, self.end) if self.preset else None)

    def net_period(self, today: str) -> tuple[str, str | None]:
        """(Month, month), (Range, window) or (Filtered, None): what a net total covers."""
        if self.categories:
            return "Filtered", None
        if self.preset is None or self.preset == "THIS_MONTH":
            return "Month", today[:7]
        if self.preset == "LAST_MONTH":
            return "Month", months.shift(today[:7], -1)
        window = self.resolve(today).window
        return ("Range", "..".join(window)) if window else ("Filtered", None)


def net_period(categories: Column, preset: Column, start: Column, end: Column, today: str) -> Column:
    """``FilterState.net_period`` of columns: a struct of kind and period."""
    month = preset.isNull() | (preset == "THIS_MONTH")
    kind = F.when(F.size(F.coalesce(categories, F.array().cast("array<string>"))) > 0, "Filtered").when(month | (preset == "LAST_MONTH"), "Month").when(start.isNotNull() & end.isNotNull(), "Range").otherwise("Filtered")
    period = F.when(kind == "Range", F.concat(start, F.lit(".."), end)).when(kind == "Month", F.when(month, today[:7]).otherwise(months.shift(today[:7], -1)))
    return F.struct(kind.alias("kind"), period.alias("period"))


def by_id(df: DataFrame, id_: str) -> DataFrame:
    return live(df).where(F.col("id") == id_)


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("date"), F.desc("created_at"), "id")


def placed(df: DataFrame, *order) -> DataFrame:
    """Adds ``place``, from 1, in an order of all rows. Rows are sorted in ranges and
    numbered within them, after the rows of the ranges before; what is broadcast is
    a row for each partition."""
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = cut(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": at}))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_at") + 1).select(*df.columns, "place")


def filtered(tx: DataFrame, f: Filter = Filter()) -> DataFrame:
    return newest_first(live(tx).where(f.predicate()))


def existing_by_hash(tx: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows with one of the hashes, tombstones included."""
    return tx.join(hashes.select("content_hash").distinct(), "content_hash", "left_semi").select("id", "content_hash", F.col("deleted_at").isNotNull().alias("deleted"))


def rule_candidates(tx: DataFrame, uncategorised_only: bool = False, locked: bool = False) -> DataFrame:
    """Live rows that rules may write to, or, if locked, that they may not."""
    out = live(tx).where(F.col("category_locked_by_user") == locked)
    return out.where("category_id is null") if uncategorised_only else out


def pending_changes(df: DataFrame, limit: int = 200) -> DataFrame:
    return df.where("pending_operation is not null").orderBy("id").limit(limit)


def ordered_rules(rules: DataFrame) -> DataFrame:
    return live(rules).orderBy("priority", "id")


def budgets_for(budgets: DataFrame, month: str) -> DataFrame:
    return live(budgets).where(F.col("year_month") == month).orderBy("category_id")


def active_budget(budgets: DataFrame, category: str, month: str) -> DataFrame:
    return live(budgets).where((F.col("category_id") == category) & (F.col("year_month") == month))


def revisions(df: DataFrame) -> DataFrame:
    """What replication needs to know of each row, tombstones included."""
    return df.select("id", "local_revision", "remote_revision")


def tombstones_before(df: DataFrame, before: int) -> DataFrame:
    return df.where(F.col("deleted_at") < before).select("id")


def shadow_of(shadow: DataFrame, table: str, rows: list[str]) -> DataFrame:
    return shadow.where((F.col("table_name") == table) & F.col("row_id").isin(*rows))


def unacknowledged(conflicts: DataFrame) -> DataFrame:
    return conflicts.where("acknowledged_at is null").orderBy(F.desc("resolved_at"), "id")


def conflicts_of(conflicts: DataFrame, table: str, row: str) -> DataFrame:
    return conflicts.where((F.col("table_name") == table) & (F.col("row_id") == row)).orderBy(F.desc("resolved_at"), "id")


def budgetable(categories: DataFrame) -> DataFrame:
    return live(categories).where(~F.col("id").isin("income", "transfers")).orderBy("name")


def domain(tx: DataFrame) -> DataFrame:
    """Rows as callers see them: no replication columns, real dates and times."""
    return live(tx).select(
        "id", "amount_minor", "currency_code", F.col("date").cast("date").alias("date"), "description", "merchant", "category_id", "account_id", "source", "notes",
        "category_locked_by_user", F.timestamp_millis("created_at").alias("created_at"), F.timestamp_millis("updated_at").alias("updated_at"),
    )
