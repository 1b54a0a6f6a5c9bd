"""Queries that change tables: each returns what the change leaves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity
from ..ledger import NOW_MS as NOW
from ..operators import dml, imports, migrations
from .registry import query



def number():
    """The order key that an id holds."""
    return F.col("id").cast("bigint")


REV = "local_revision + {0}::INT AS local_revision, CASE WHEN {0} THEN '{1}' ELSE pending_operation END AS pending_operation"
COLS = ["id", "deleted_at", "local_revision", "pending_operation"]

query("snk_insert_ignore", "SELECT id, amount_minor FROM tx WHERE n % 2 = 0 UNION SELECT id, amount_minor FROM tx WHERE n % 3 = 0")(lambda L: dml.insert_ignore(L.tx.where(number() % 2 == 0), L.tx.where(number() % 3 == 0)).select("id", "amount_minor"))
query("snk_upsert", "SELECT id, CASE WHEN n % 3 = 0 THEN 0 ELSE amount_minor END AS amount_minor FROM tx WHERE n % 2 = 0 OR n % 3 = 0")(
    lambda L: dml.upsert(L.tx.where(number() % 2 == 0), L.tx.where(number() % 3 == 0).withColumn("amount_minor", F.lit(0).cast("bigint")), ["id"]).select("id", "amount_minor")
)
H = "(n % 7 = 0)"
query("tx_soft_delete", f"SELECT id, CASE WHEN {H} THEN {NOW} ELSE deleted_at END AS deleted_at, {REV.format(H, 'DELETE')} FROM tx")(lambda L: dml.soft_delete(L.tx, number() % 7 == 0, NOW, False).select(*COLS))
query("tx_undo_delete", f"SELECT id, CASE WHEN NOT {H} THEN deleted_at END AS deleted_at, {REV.format(H, 'UPSERT')} FROM tx")(lambda L: dml.undo_delete(L.tx, number() % 7 == 0).select(*COLS))
query("tx_update", f"""SELECT id, CASE WHEN {H} THEN amount_minor + 1 ELSE amount_minor END AS amount_minor, CASE WHEN NOT {H} THEN import_batch_id END AS import_batch_id, {REV.format(H, 'UPSERT')},
 CASE WHEN {H} THEN substr(sha256(account_id || '|' || date || '|' || (amount_minor + 1) || '|' || upper(trim(description))), 1, 32) ELSE content_hash END AS content_hash FROM tx""")(
    lambda L: dml.update_transaction(L.tx, number() % 7 == 0, {"amount_minor": F.col("amount_minor") + 1}, NOW).select("id", "amount_minor", "import_batch_id", "local_revision", "pending_operation", "content_hash")
)
query("tx_upsert", "SELECT id, CASE WHEN n % 3 = 0 THEN 'UPSERT' ELSE pending_operation END AS pending_operation, local_revision + (n % 3 = 0)::INT AS local_revision, remote_revision, CASE WHEN n % 3 <> 0 THEN deleted_at END AS deleted_at FROM tx")(
    lambda L: dml.upsert_rows(L.tx, L.tx.where(number() % 3 == 0)).select("id", "pending_operation", "local_revision", "remote_revision", "deleted_at")
)
query("undo_import", f"SELECT id, CASE WHEN import_batch_id = 'batch-2' AND deleted_at IS NULL THEN {NOW} ELSE deleted_at END AS deleted_at, coalesce(import_batch_id = 'batch-2' AND deleted_at IS NULL, false) AS changed FROM tx")(
    lambda L: dml.undo_import(L.tx, "batch-2", NOW).select("id", "deleted_at", "changed")
)
query("import_batch_stamp", "SELECT id, 'batch-new' AS import_batch_id FROM tx WHERE source = 'CSV_IMPORT'")(lambda L: L.tx.where("source = 'CSV_IMPORT'").select("id", F.lit("batch-new").alias("import_batch_id")))
query("budget_upsert", "SELECT id, CASE WHEN year_month = '1996-03' THEN 5 ELSE limit_minor END AS limit_minor, local_revision + (year_month = '1996-03')::INT AS local_revision, created_at FROM budgets")(
    lambda L: dml.upsert_rows(L.budgets, L.budgets.where("year_month = '1996-03'").withColumns({"id": identity.budget_id(F.col("category_id"), F.col("year_month")), "limit_minor": F.lit(5).cast("bigint"), "created_at": F.lit(0).cast("bigint")}), {"created_at": "live"}).select("id", "limit_minor", "local_revision", "created_at")
)
query("category_upsert", "SELECT id, 'X' AS name, is_system_defined, local_revision + 1 AS local_revision FROM categories")(
    lambda L: dml.upsert_rows(L.categories, L.categories.withColumns({"name": F.lit("X"), "is_system_defined": F.lit(False)}), {"is_system_defined": "any"}).select("id", "name", "is_system_defined", "local_revision")
)
query("rule_upsert", "SELECT id, 'tea' AS merchant_contains, local_revision + 1 AS local_revision FROM rules WHERE id = 'r1' UNION ALL SELECT id, merchant_contains, local_revision FROM rules WHERE id <> 'r1'")(
    lambda L: dml.upsert_rows(L.rules, L.rules.where("id = 'r1'").withColumn("merchant_contains", F.lit("tea")).where("trim(merchant_contains) <> ''"), {"created_at": "live"}).select("id", "merchant_contains", "local_revision")
)
C = "(category_id = 'FURNITURE' AND deleted_at IS NULL)"
query("category_delete_cascade", f"""SELECT 'categories' AS t, id, CASE WHEN id = 'FURNITURE' THEN {NOW} ELSE deleted_at END AS deleted_at FROM categories
 UNION ALL SELECT 'budgets', id, CASE WHEN {C} THEN {NOW} ELSE deleted_at END FROM budgets UNION ALL SELECT 'rules', id, CASE WHEN {C} THEN {NOW} ELSE deleted_at END FROM rules""")(
    lambda L: _union(zip(("categories", "budgets", "rules"), dml.delete_category(L.categories, L.budgets, L.rules, "FURNITURE", NOW)), "id", "deleted_at")
)


def _union(parts, *cols):
    out = None
    for name, df in parts:
        one = df.select(F.lit(name).alias("t"), *cols)
        out = one if out is None else out.unionByName(one)
    return out


#: The categories that every ledger starts with.
SYSTEM = ["food", "transport", "rent", "utilities", "groceries", "health", "shopping", "entertainment", "transfers", "income", "fees", "uncategorised"]


@query("seed_categories", "SELECT id, deleted_at FROM categories UNION ALL SELECT x, NULL FROM (SELECT unnest(" + repr(SYSTEM) + ") AS x) WHERE x NOT IN (SELECT id FROM categories)")
def seed_categories(L):
    new = L.tx.sparkSession.createDataFrame([(x,) for x in SYSTEM], "id string").select("id", *(F.lit(None).cast(t).alias(c) for c, t in L.categories.dtypes if c != "id"))
    return dml.insert_ignore(L.categories, new.withColumn("is_system_defined", F.lit(True))).select("id", "deleted_at")


ORDER = ["r6", "r3", "r5", "r1"]
RE = "SELECT id, CASE WHEN deleted_at IS NULL AND list_position(" + repr(ORDER) + ", id) > 0 THEN CAST(list_position(" + repr(ORDER) + ", id) - 1 AS INTEGER) ELSE priority END AS priority FROM rules"
query("reorder_dense", RE)(lambda L: dml.reorder(L.rules, ORDER, NOW).select("id", "priority"))
query("rule_reorder", "SELECT id, local_revision + (deleted_at IS NULL AND coalesce(list_position(" + repr(ORDER) + ", id), 0) > 0)::INT AS local_revision FROM rules")(lambda L: dml.reorder(L.rules, ORDER, NOW).select("id", "local_revision"))
query("move_up_down", "SELECT * FROM (VALUES (0, 'r2'), (1, 'r1'), (2, 'r3')) v(place, id)")(lambda L: L.tx.sparkSession.createDataFrame(list(enumerate(dml.move(["r1", "r2", "r3"], "r2", -1))), "place int, id string"))
query("mark_synced", "SELECT id, CASE WHEN n % 2 = 0 AND n % 3 <> 0 THEN 9 ELSE remote_revision END AS remote_revision, CASE WHEN NOT (n % 2 = 0 AND n % 3 <> 0) THEN pending_operation END AS pending_operation FROM tx")(
    lambda L: dml.mark_synced(L.tx, L.tx.where(number() % 2 == 0).select("id", (F.col("local_revision") + (number() % 3 == 0).cast("int")).alias("expected"), F.lit(9).cast("bigint").alias("remote_revision"))).select("id", "remote_revision", "pending_operation")
)
query("apply_remote_tombstone", "SELECT id, CASE WHEN n % 5 = 0 THEN 77 ELSE deleted_at END AS deleted_at, CASE WHEN n % 5 = 0 THEN greatest(local_revision, 3) ELSE local_revision END AS local_revision FROM tx")(
    lambda L: dml.remote_tombstone(L.tx, L.tx.where(number() % 5 == 0).select("id", F.lit(77).cast("bigint").alias("deleted_at"), F.lit(3).cast("bigint").alias("remote_revision"))).select("id", "deleted_at", "local_revision")
)
GONE = "SELECT id FROM categories WHERE deleted_at IS NOT NULL"
query("hard_delete", f"""SELECT 'tx' AS t, id, CASE WHEN category_id NOT IN ({GONE}) THEN category_id END AS category_id FROM tx UNION ALL SELECT 'categories', id, id FROM categories WHERE id NOT IN ({GONE})
 UNION ALL SELECT 'budgets', id, category_id FROM budgets WHERE category_id NOT IN ({GONE}) UNION ALL SELECT 'rules', id, category_id FROM rules WHERE category_id NOT IN ({GONE})""")(lambda L: _hard(L))


def _hard(L):
    cats, tx, budgets, rules = dml.drop_categories(L.categories, L.tx, L.budgets, L.rules, L.categories.where("deleted_at is not null").select("id"))
    return _union((("tx", tx), ("categories", cats.withColumn("category_id", F.col("id"))), ("budgets", budgets), ("rules", rules)), "id", "category_id")


@query("conflict_record", "SELECT id FROM conflicts WHERE acknowledged_at IS NOT NULL OR n9 <> 0 UNION ALL SELECT 'new-' || row_id FROM conflicts WHERE n9 = 0".replace("n9", "(CAST(row_id AS BIGINT) % 18)"))
def conflict_record(L):
    new = L.conflicts.where(F.col("row_id").cast("bigint") % 18 == 0).withColumns({"id": F.concat(F.lit("new-"), "row_id"), "acknowledged_at": F.lit(None).cast("bigint")})
    return dml.record_conflicts(L.conflicts, new).select("id")


query("conflict_acknowledge", f"SELECT id, coalesce(acknowledged_at, {NOW}) AS acknowledged_at FROM conflicts")(lambda L: dml.acknowledge(L.conflicts, F.lit(True), NOW).select("id", "acknowledged_at"))
query("conflict_purge", "SELECT id FROM conflicts WHERE acknowledged_at IS NULL OR acknowledged_at >= 1000000")(lambda L: L.conflicts.where("acknowledged_at is null or acknowledged_at >= 1000000").select("id"))
query("conflict_forget_row", "SELECT id FROM conflicts WHERE NOT (table_name = 'transactions' AND row_id = '27')")(lambda L: L.conflicts.where("not (table_name = 'transactions' and row_id = '27')").select("id"))
query("shadow_forget", "SELECT row_id FROM shadow WHERE NOT (table_name = 'transactions' AND row_id = '4')")(lambda L: L.shadow.where("not (table_name = 'transactions' and row_id = '4')").select("row_id"))

# Windows

RN = "row_number() OVER (PARTITION BY content_hash ORDER BY n)"
query("occurrence_index", f"SELECT id, CAST({RN} - 1 AS BIGINT) AS occurrence FROM tx")(lambda L: identity.occurrence(L.tx.withColumn("n", number()), ["n"]).select("id", "occurrence"))
query("content_derived_id", f"SELECT n AS row_index, 'h1:' || content_hash || '#' || ({RN} - 1) AS id FROM tx")(lambda L: imports.derive_ids(L.tx.withColumn("row_index", number())).select("row_index", "id"))
query("occurrence_index_migration", f"SELECT n, id AS new_id FROM tx WHERE source <> 'CSV_IMPORT' UNION ALL SELECT n, 'h1:' || content_hash || '#' || ({RN} - 1) FROM tx WHERE source = 'CSV_IMPORT'")(
    lambda L: dml.rekey_transactions(L.tx).select(number().alias("n"), "new_id")
)
TWICE = "SELECT category_id, '1996-01' AS year_month, id, deleted_at, updated_at FROM budgets"
query("budget_claimant", f"SELECT id FROM ({TWICE}) QUALIFY row_number() OVER (PARTITION BY category_id ORDER BY deleted_at IS NOT NULL, coalesce(deleted_at, updated_at) DESC, id) = 1")(
    lambda L: dml.claimants(L.budgets.withColumn("year_month", F.lit("1996-01"))).select("id")
)
# A coarse hash, so that rows meet: account, date and sign.
EX = "SELECT account_id || substr(date, 1, 7) AS content_hash, id, deleted_at, n FROM tx WHERE n % 3 = 0"
IN = "SELECT account_id || substr(date, 1, 7) AS content_hash, n FROM tx WHERE n % 3 <> 0"
BUCKETS = f"""SELECT i.n AS row_index, CASE WHEN e.id IS NULL THEN 'inserted' WHEN e.deleted_at IS NOT NULL THEN 'previously_deleted' ELSE 'duplicate' END AS bucket FROM
 (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY n) AS r FROM ({IN})) i LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY id) AS r FROM ({EX})) e ON i.content_hash = e.content_hash AND i.r = e.r"""


def _dedupe(L):
    coarse = L.tx.withColumns({"content_hash": F.concat("account_id", F.substring("date", 1, 7)), "row_index": number()})
    new = imports.derive_ids(coarse.where(number() % 3 != 0).drop("id"))
    return imports.dedupe(coarse.where(number() % 3 == 0), new)


query("quota_match", BUCKETS)(lambda L: _dedupe(L).select("row_index", "bucket"))
query("quota_rank", BUCKETS)(lambda L: _dedupe(L).select("row_index", "bucket"))
query("import_dedupe", f"SELECT bucket, count(*) AS n FROM ({BUCKETS}) GROUP BY 1")(lambda L: imports.counters(_dedupe(L)))


# Migrations, each of tables as the version before has them

query("migration_1_2", "SELECT id, CAST(NULL AS VARCHAR) AS import_batch_id FROM tx")(lambda L: migrations.step_1_2({"transactions": L.tx.drop("import_batch_id")})["transactions"].select("id", "import_batch_id"))
query("migration_3_4", "SELECT id, CAST(1 AS BIGINT) AS local_revision, CAST(NULL AS BIGINT) AS remote_revision, CAST(NULL AS VARCHAR) AS pending_operation, CAST(NULL AS BIGINT) AS deleted_at FROM categories")(
    lambda L: migrations.step_3_4({"categories": L.categories.drop(*REVISED)})["categories"].select("id", *REVISED)
)
REVISED = ("local_revision", "remote_revision", "pending_operation", "deleted_at")
query("migration_6_7", "SELECT id, CAST(0 AS BIGINT) AS updated_at FROM categories")(lambda L: migrations.step_6_7({"categories": L.categories.drop("updated_at")})["categories"].select("id", "updated_at"))


def _columns(tables, names):
    """table_name, column_name and the number of rows of new tables."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(n, c, tables[n].count()) for n in names for c in tables[n].columns], "table_name string, column_name string, n_rows long")


REVISIONS = "'created_at', 'updated_at', 'local_revision', 'remote_revision', 'pending_operation', 'deleted_at'"
query("migration_2_3", f"""SELECT 'category_rules' AS table_name, unnest(['id', 'category_id', 'merchant_contains', 'priority', {REVISIONS}]) AS column_name, 0 AS n_rows
 UNION ALL SELECT 'budgets', unnest(['id', 'category_id', 'year_month', 'limit_minor', 'currency_code', {REVISIONS}]), 0""")(
    lambda L: _columns(migrations.step_2_3({"transactions": L.tx}), ("category_rules", "budgets"))
)
query("migration_5_6", """SELECT 'sync_shadow' AS table_name, unnest(['table_name', 'row_id', 'remote_revision', 'payload']) AS column_name, 0 AS n_rows
 UNION ALL SELECT 'sync_conflicts', unnest(['id', 'table_name', 'row_id', 'field', 'resolved_at', 'chosen_value', 'discarded_value', 'reason', 'acknowledged_at']), 0""")(
    lambda L: _columns(migrations.step_5_6({"transactions": L.tx}), ("sync_shadow", "sync_conflicts"))
)


def _rekeyed(L):
    """Transactions with stale hashes, and budgets with ids of their own, each twice."""
    one = L.budgets.withColumn("id", F.concat(F.lit("a-"), "id"))
    two = L.budgets.withColumns({"id": F.concat(F.lit("b-"), "id"), "updated_at": F.col("updated_at") + 1})
    out = migrations.step_4_5({"transactions": L.tx.withColumn("content_hash", F.lit("stale")), "budgets": one.unionByName(two)})
    return out["transactions"].select("id", "content_hash").unionByName(out["budgets"].select("id", F.lit(None).cast("string").alias("content_hash")))


query("migration_4_5", f"""SELECT id, content_hash FROM tx WHERE source <> 'CSV_IMPORT' UNION ALL SELECT 'h1:' || content_hash || '#' || (row_number() OVER (PARTITION BY content_hash ORDER BY created_at, id) - 1), content_hash FROM tx WHERE source = 'CSV_IMPORT'
 UNION ALL SELECT CASE WHEN row_number() OVER (PARTITION BY category_id, year_month ORDER BY gone, made DESC, i) = 1 THEN key ELSE i END, NULL FROM (
 SELECT p || id AS i, id AS key, category_id, year_month, deleted_at IS NOT NULL AS gone, coalesce(deleted_at, updated_at + d) AS made FROM budgets, (VALUES ('a-', 0), ('b-', 1)) v(p, d))""")(_rekeyed)
