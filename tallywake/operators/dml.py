"""Changes as functions of a table: each returns the table after the change.

``changed`` marks the rows that a statement touched, where a caller counts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity


def set_where(df: DataFrame, hit: Column, values: dict[str, Column]) -> DataFrame:
    """Sets columns where ``hit``; adds ``changed``."""
    df = df.withColumn("changed", F.coalesce(hit, F.lit(False)))
    return df.withColumns({k: F.when(F.col("changed"), v).otherwise(F.col(k)) for k, v in values.items()})


def bump(op: str = "UPSERT") -> dict[str, Column]:
    return {"local_revision": F.col("local_revision") + 1, "pending_operation": F.lit(op)}


def insert_ignore(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Adds rows whose key is new; of several new rows with one key, one."""
    new = rows.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(*table.columns)
    return table.unionByName(new)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those with equal keys."""
    return table.join(rows.select(*keys), keys, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def soft_delete(df: DataFrame, hit: Column, now: int, guarded: bool) -> DataFrame:
    """Tombstones; ``guarded`` ones (budgets, rules) only once, and with a new
    updated_at. Transactions are not guarded and keep theirs."""
    values = {"deleted_at": F.lit(now).cast("bigint"), **bump("DELETE")}
    if guarded:
        hit, values = hit & F.col("deleted_at").isNull(), values | {"updated_at": F.lit(now).cast("bigint")}
    return set_where(df, hit, values)


def undo_delete(df: DataFrame, hit: Column) -> DataFrame:
    return set_where(df, hit, {"deleted_at": F.lit(None).cast("bigint"), **bump()})


def update_transaction(tx: DataFrame, hit: Column, values: dict[str, Column], now: int) -> DataFrame:
    """A hand edit: leaves its import batch, and its hash is computed anew."""
    out = set_where(tx, hit, values | {"import_batch_id": F.lit(None).cast("string"), "updated_at": F.lit(now).cast("bigint"), **bump()})
    new = identity.content_hash(F.col("account_id"), F.col("date"), F.col("amount_minor"), F.col("description"))
    return out.withColumn("content_hash", F.when(F.col("changed"), new).otherwise(F.col("content_hash")))


def upsert_rows(table: DataFrame, rows: DataFrame, keep: dict[str, str] | None = None) -> DataFrame:
    """A caller's rows over stored ones (tombstones too): revision one more than
    stored, remote revision kept, alive, pending. ``keep`` names columns whose
    stored value wins: "live" if the stored row lives, "any" always."""
    old = table.select("id", *(F.col(c).alias(f"_{c}") for c in {"local_revision", "remote_revision", "deleted_at", *(keep or {})}))
    out = rows.join(old, "id", "left").withColumns({
        "local_revision": F.coalesce(F.col("_local_revision"), F.lit(0)) + 1,
        "remote_revision": F.col("_remote_revision"),
        "deleted_at": F.lit(None).cast("bigint"),
        "pending_operation": F.lit("UPSERT"),
        **{c: F.coalesce(F.when(F.col("_deleted_at").isNull() | F.lit(how == "any"), F.col(f"_{c}")), F.col(c)) for c, how in (keep or {}).items()},
    })
    return upsert(table, out, ["id"])


def undo_import(tx: DataFrame, batch: str, now: int) -> DataFrame:
    return set_where(tx, (F.col("import_batch_id") == batch) & F.col("deleted_at").isNull(), {"deleted_at": F.lit(now).cast("bigint"), **bump("DELETE")})


def delete_category(categories: DataFrame, budgets: DataFrame, rules: DataFrame, category: str, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A user's live category with its live budgets and rules; no transaction."""
    mine = categories.where((F.col("id") == category) & ~F.col("is_system_defined") & F.col("deleted_at").isNull()).select(F.col("id").alias("_gone"))
    cats = soft_delete(categories, (F.col("id") == category) & ~F.col("is_system_defined"), now, True)

    def cascade(df: DataFrame) -> DataFrame:
        return soft_delete(df.join(F.broadcast(mine), F.col("category_id") == F.col("_gone"), "left"), F.col("_gone").isNotNull(), now, True).drop("_gone")

    return cats, cascade(budgets), cascade(rules)


def reorder(rules: DataFrame, ordered: list[str], now: int) -> DataFrame:
    """Priorities become the places in the list, for live rules."""
    place = F.array_position(F.array(*map(F.lit, ordered)), F.col("id")).cast("int") - 1
    return set_where(rules, (place >= 0) & F.col("deleted_at").isNull(), {"priority": place, "updated_at": F.lit(now).cast("bigint"), **bump()})


def move(ids: list[str], one: str, offset: int) -> list[str]:
    """The list with one element swapped by an offset; out of range, unchanged."""
    if one not in ids or not 0 <= ids.index(one) + offset < len(ids):
        return list(ids)
    out, i = list(ids), ids.index(one)
    out[i], out[i + offset] = out[i + offset], out[i]
    return out


def mark_synced(df: DataFrame, acks: DataFrame) -> DataFrame:
    """Acknowledged rows, if not changed since they were sent."""
    a = acks.select(F.col("id").alias("_i"), F.col("expected").alias("_e"), F.col("remote_revision").alias("_rev"))
    rows = df.join(a, F.col("id") == F.col("_i"), "left")
    return set_where(rows, F.col("_e") == F.col("local_revision"), {"remote_revision": F.col("_rev"), "pending_operation": F.lit(None).cast("string")}).drop("_i", "_e", "_rev")


def remote_tombstone(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Writes tombstones (id, deleted_at, remote_revision) that came from elsewhere."""
    g = gone.select(F.col("id").alias("_i"), F.col("deleted_at").alias("_at"), F.col("remote_revision").alias("_rev"))
    rows = df.join(g, F.col("id") == F.col("_i"), "left")
    values = {"deleted_at": F.col("_at"), "updated_at": F.col("_at"), "local_revision": F.greatest("local_revision", "_rev"), "remote_revision": F.col("_rev"), "pending_operation": F.lit(None).cast("string")}
    return set_where(rows, F.col("_i").isNotNull(), values).drop("_i", "_at", "_rev")


def hard_delete(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_anti")


def drop_categories(categories, tx, budgets, rules, ids: DataFrame):
    """Physical deletion, with what the foreign keys do: budgets and rules go, and
    transactions lose the category."""
    g = ids.select(F.col("id").alias("_g"))
    without = lambda df: df.join(g, F.col("category_id") == F.col("_g"), "left_anti")
    freed = tx.join(g, F.col("category_id") == F.col("_g"), "left").withColumn("category_id", F.when(F.col("_g").isNull(), F.col("category_id"))).drop("_g")
    return hard_delete(categories, ids), freed, without(budgets), without(rules)


def record_conflicts(conflicts: DataFrame, new: DataFrame) -> DataFrame:
    """New conflicts take the place of unacknowledged ones of the same field."""
    key = ["table_name", "row_id", "field"]
    done = conflicts.where("acknowledged_at is not null")
    kept = conflicts.where("acknowledged_at is null").join(new.select(*key).distinct(), key, "left_anti").select(*conflicts.columns)
    return done.unionByName(kept).unionByName(new.select(*conflicts.columns))


def acknowledge(conflicts: DataFrame, hit: Column, now: int) -> DataFrame:
    return set_where(conflicts, hit & F.col("acknowledged_at").isNull(), {"acknowledged_at": F.lit(now).cast("bigint")})


def claimants(budgets: DataFrame) -> DataFrame:
    """One budget for each category and month: a live one first, then the newest."""
    w = Window.partitionBy("category_id", "year_month").orderBy(F.col("deleted_at").isNotNull(), F.desc(F.coalesce("deleted_at", "updated_at")), "id")
    return budgets.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def rekey_transactions(tx: DataFrame) -> DataFrame:
    """Content-derived ids for imported rows that have none yet."""
    imported = (F.col("source") == "CSV_IMPORT") & ~identity.is_content_derived(F.col("id"))
    new = identity.occurrence(tx.where(imported), ["created_at", "id"])
    return tx.where(~imported).withColumn("new_id", F.col("id")).unionByName(new.withColumn("new_id", identity.derived_id(F.col("content_hash"), F.col("occurrence"))).drop("occurrence"))
