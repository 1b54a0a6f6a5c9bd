"""Steps between the versions of the ledger's tables, as functions of its tables.

A step takes the tables by name and returns them after it. Columns come with the
value that existing rows get; new tables are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity
from . import dml

Tables = dict[str, DataFrame]

#: The tables that versions 3 and 6 bring.
REVISIONS = "created_at bigint, updated_at bigint, local_revision bigint, remote_revision bigint, pending_operation string, deleted_at bigint"
VERSION_3 = {
    "category_rules": f"id string, category_id string, merchant_contains string, priority int, {REVISIONS}",
    "budgets": f"id string, category_id string, year_month string, limit_minor bigint, currency_code string, {REVISIONS}",
}
VERSION_6 = {
    "sync_shadow": "table_name string, row_id string, remote_revision bigint, payload string",
    "sync_conflicts": "id string, table_name string, row_id string, field string, resolved_at bigint, chosen_value string, discarded_value string, reason string, acknowledged_at bigint",
}


def with_columns(tables: Tables, name: str, **columns) -> Tables:
    return tables | {name: tables[name].withColumns({c: v for c, v in columns.items() if c not in tables[name].columns})}


def with_tables(tables: Tables, schemas: dict[str, str]) -> Tables:
    """Adds empty tables; those that are there already stay as they are."""
    spark = next(iter(tables.values())).sparkSession
    return {n: spark.createDataFrame([], s) for n, s in schemas.items()} | tables


def null(kind: str):
    return F.lit(None).cast(kind)


def step_1_2(tables: Tables) -> Tables:
    return with_columns(tables, "transactions", import_batch_id=null("string"))


def step_2_3(tables: Tables) -> Tables:
    return with_tables(tables, VERSION_3)


def step_3_4(tables: Tables) -> Tables:
    one = F.lit(1).cast("bigint")
    return with_columns(tables, "categories", local_revision=one, remote_revision=null("bigint"), pending_operation=null("string"), deleted_at=null("bigint"))


def step_4_5(tables: Tables) -> Tables:
    """Hashes of all transactions are computed anew, and imported ones that have no
    content-derived id yet get one, in the order of their making. A budget's id is its
    category and month: of those that share them, one claims it, a live one before
    tombstones, the newest, the smallest id; the others keep theirs."""
    tx = tables["transactions"]
    tx = tx.withColumn("content_hash", identity.content_hash(F.col("account_id"), F.col("date"), F.col("amount_minor"), F.col("description")))
    tx = dml.rekey_transactions(tx).withColumn("id", F.col("new_id")).select(*tx.columns)
    budgets = tables["budgets"]
    first = dml.claimants(budgets).select(F.col("id").alias("_id"))
    key = identity.budget_id(F.col("category_id"), F.col("year_month"))
    budgets = budgets.join(first, F.col("id") == F.col("_id"), "left").withColumn("id", F.when(F.col("_id").isNotNull(), key).otherwise(F.col("id"))).select(*budgets.columns)
    return tables | {"transactions": tx, "budgets": budgets}


def step_5_6(tables: Tables) -> Tables:
    return with_tables(tables, VERSION_6)


def step_6_7(tables: Tables) -> Tables:
    return with_columns(tables, "categories", updated_at=F.lit(0).cast("bigint"))


STEPS = (step_1_2, step_2_3, step_3_4, step_4_5, step_5_6, step_6_7)


def migrate(tables: Tables, version: int) -> Tables:
    """The tables of ``version`` as the newest version has them."""
    for step in STEPS[version - 1 :]:
        tables = step(tables)
    return tables
