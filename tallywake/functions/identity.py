"""Row identity: content hashes and ids derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .text import trim_upper

SCHEME = "h1"


def content_hash(account: Column, date: Column, minor: Column, description: Column) -> Column:
    whole = F.concat_ws("|", account, date, minor.cast("string"), trim_upper(description))
    return F.substring(F.sha2(whole, 256), 1, 32)


def derived_id(hash_: Column, occurrence: Column) -> Column:
    return F.concat(F.lit(f"{SCHEME}:"), hash_, F.lit("#"), occurrence.cast("string"))


def scheme_of(id_: Column) -> Column:
    found = F.regexp_extract(id_, r"^(h[0-9]+):", 1)
    return F.when(found.isin(SCHEME), found)


def is_content_derived(id_: Column) -> Column:
    return id_.rlike(r"^h[0-9]+:[0-9a-f]+#[0-9]+$")


def budget_id(category: Column, month: Column) -> Column:
    return F.concat(F.lit("budget:"), category, F.lit(":"), month)


#: Rows of one key that a task ranks at once.
HOT = 1 << 20


def ranked(rows: DataFrame, key: str, order: list, name: str = "rank") -> DataFrame:
    """Adds a row's place among those of its key, from 1. Keys of more than ``HOT``
    rows, as many as there are rows by ``HOT`` at most, are ranked over many tasks;
    all others by a window."""
    w = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")
    hot = cut(rows.groupBy(F.col(key).alias("_key")).count().where(F.col("count") > HOT).select("_key"))
    if hot.isEmpty():
        return rows.withColumn(name, w)
    same = F.col(key).eqNullSafe(F.col("_key"))
    few = rows.join(F.broadcast(hot), same, "left_anti").withColumn(name, w)
    return few.unionByName(spread(rows.join(F.broadcast(hot), same, "left_semi"), key, order, name))


def spread(rows: DataFrame, key: str, order: list, name: str = "rank") -> DataFrame:
    """``ranked`` for keys of any size: rows lie in ranges by key and order, are ranked
    within their range, and the first key of a range goes on from where the ranges
    before it left off. A row for each range is broadcast."""
    laid = cut(rows.orderBy(key, *order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    here = laid.withColumn("_r", F.row_number().over(Window.partitionBy("_part", key).orderBy("_at")).cast("long"))
    of = F.struct(F.col(key).alias("k"))
    ends = here.groupBy("_part").agg(F.min(of).alias("_first"), F.max(F.struct(of.alias("k"), F.col("_r").alias("r"))).alias("_last"))
    # Of a key that ends a range, its rows up to there.
    upto = ends.withColumn("_upto", F.sum("_last.r").over(Window.partitionBy("_last.k").orderBy("_part")))
    by_part = Window.orderBy("_part")
    goes_on = F.lag("_last.k").over(by_part).eqNullSafe(F.col("_first"))
    starts = upto.select(F.col("_part").alias("_p"), "_first", F.when(goes_on, F.lag("_upto").over(by_part)).otherwise(0).alias("_before"))
    out = here.join(F.broadcast(starts), F.col("_part") == F.col("_p"))
    return out.withColumn(name, F.col("_r") + F.when(F.col("_first").eqNullSafe(of), F.col("_before")).otherwise(0)).select(*rows.columns, name)


def occurrence(rows: DataFrame, order: list[str], key: str = "content_hash") -> DataFrame:
    """Adds ``occurrence``, counting from 0 how often the key came before."""
    return ranked(rows, key, order, "occurrence").withColumn("occurrence", F.col("occurrence") - 1)
