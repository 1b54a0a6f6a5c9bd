"""Count-aware import: the first k rows with a hash meet the k stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity


def derive_ids(rows: DataFrame, order: str = "row_index") -> DataFrame:
    """Ids from hash and occurrence within the batch."""
    out = identity.occurrence(rows, [order])
    return out.withColumn("id", identity.derived_id(F.col("content_hash"), F.col("occurrence")))


def dedupe(existing: DataFrame, incoming: DataFrame, order: str = "row_index") -> DataFrame:
    """``incoming`` with ``bucket``: duplicate, previously_deleted or inserted.

    Rows of a hash are ranked on both sides and joined rank by rank; stored ones
    in the order of their ids, which the original leaves open. A row whose own id
    is stored already is a duplicate.
    """
    old = identity.ranked(existing, "content_hash", ["id"]).select("content_hash", "rank", F.col("deleted_at").isNotNull().alias("gone"))
    new = identity.ranked(incoming, "content_hash", [order]).join(old, ["content_hash", "rank"], "left")
    bucket = F.when(F.col("gone"), "previously_deleted").when(~F.col("gone"), "duplicate").otherwise("inserted")
    new = new.withColumn("bucket", bucket).drop("gone", "rank")
    taken = existing.select(F.col("id").alias("_i"))
    hit = new.join(taken, F.col("id") == F.col("_i"), "left")
    return hit.withColumn("bucket", F.when((F.col("bucket") == "inserted") & F.col("_i").isNotNull(), "duplicate").otherwise(F.col("bucket"))).drop("_i")


def counters(marked: DataFrame) -> DataFrame:
    return marked.groupBy("bucket").agg(F.count("*").alias("n"))
