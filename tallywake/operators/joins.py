"""Joins of the ledger with its lists, its shadow and the operation log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ledger import live


def with_category(df: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds ``category_name``, null where the category is not live."""
    names = live(categories).select(F.col("id").alias("_c"), F.col("name").alias("category_name"))
    return df.join(names, F.col("category_id") == F.col("_c"), "left").drop("_c")


def dirty(df: DataFrame, shadow: DataFrame, table: str, limit: int | None = 200) -> DataFrame:
    """Rows that replication has not sent: newer than their shadow; first by id."""
    base = shadow.where(F.col("table_name") == table).select(F.col("row_id").alias("_r"), F.col("remote_revision").alias("_rev"))
    rows = df.join(base, F.col("id") == F.col("_r"), "left").where("local_revision > coalesce(_rev, 0)").drop("_r", "_rev")
    return rows.orderBy("id").limit(limit) if limit else rows


def conflict_display(conflicts: DataFrame, categories: DataFrame) -> DataFrame:
    """Conflicts with category ids shown as names, where the field is one."""
    names = live(categories)
    text = lambda c: F.regexp_extract(c, r'^"(.*)"$', 1)
    is_ref = (F.col("field") == "category_id") | ((F.col("table_name") == "categories") & (F.col("field") == "parent_id"))
    out = conflicts.withColumn("chosen", text("chosen_value")).withColumn("discarded", text("discarded_value"))
    for side in ("chosen", "discarded"):
        n = names.select(F.col("id").alias("_i"), F.col("name").alias("_n"))
        out = out.join(n, is_ref & (F.col(side) == F.col("_i")), "left").withColumn(side, F.coalesce("_n", side)).drop("_i", "_n")
    return out.select("id", "row_id", "field", F.nullif("chosen", F.lit("")).alias("chosen"), F.nullif("discarded", F.lit("")).alias("discarded"), "reason")


def missing_from(local: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Local ids that a snapshot does not have."""
    return local.join(snapshot.select(F.col("row_id").alias("_r")), F.col("id") == F.col("_r"), "left_anti")


def after_cursor(ops: DataFrame, cursor: DataFrame) -> DataFrame:
    """Operations of batches that a device's cursor has not reached."""
    c = cursor.select(F.col("device_id").alias("_d"), F.col("seq").alias("_s"))
    return ops.join(c, F.col("device_id") == F.col("_d"), "left").where("seq > coalesce(_s, 0)").drop("_d", "_s")


def behind_horizon(horizon: DataFrame, cursor: DataFrame) -> DataFrame:
    """One row: whether any device's cursor is behind what was compacted."""
    c = cursor.select("device_id", F.col("seq").alias("_s"))
    return horizon.join(c, "device_id", "left").agg(F.coalesce(F.bool_or(F.coalesce("_s", F.lit(0)) < F.col("horizon")), F.lit(False)).alias("behind"))
