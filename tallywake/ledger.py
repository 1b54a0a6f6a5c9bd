"""The ledger: its tables, and how the given star schema is read as one.

Transactions come from orders and customers, the operation log from events. There
are a few categories, rules and budgets that all share, and besides a category and a
budget of every customer's own and a rule for every part. ``CTES`` says the same in
SQL for the oracle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.identity import budget_id, content_hash

#: (id, name, is_system_defined, deleted_at)
CATEGORIES = [
    ("AUTOMOBILE", "Transport", True, None),
    ("BUILDING", "Rent", True, None),
    ("FURNITURE", "Home", False, None),
    ("HOUSEHOLD", "Groceries", True, None),
    ("MACHINERY", "Tools", False, 1700000000000),
    ("income", "Income", True, None),
    ("transfers", "Transfers", True, None),
]
#: (id, category, needle, priority, deleted_at)
RULES = [
    ("r1", "AUTOMOBILE", " shop 1", 0, None),
    ("r2", "HOUSEHOLD", "urgent", 1, None),
    ("r3", "BUILDING", "  HIGH ", 1, None),
    ("r4", "FURNITURE", "   ", 2, None),
    ("r5", "FURNITURE", "order", 3, 1700000000000),
    ("r6", "FURNITURE", "low order", 3, None),
]
MONTHS = [f"1996-{m:02d}" for m in range(1, 13)]
BUDGETED = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]
TODAY = "1996-03-20"
MONTH = "1996-03"
NOW_MS = 1709000000000
CUTOFF_MS = NOW_MS - 90 * 86400000


@dataclass
class Ledger:
    """The six tables, the operation log, and given tables as they are, as frames."""

    tx: DataFrame
    categories: DataFrame
    rules: DataFrame
    budgets: DataFrame
    shadow: DataFrame
    conflicts: DataFrame
    ops: DataFrame
    customers: DataFrame
    parts: DataFrame
    events: DataFrame


def live(df: DataFrame) -> DataFrame:
    """Rows that are not tombstones."""
    return df.where("deleted_at is null")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    k, u = F.col("o_orderkey"), F.col("o_custkey")

    def when(mod: int, value: Column, other: Column | None = None, key: Column = k) -> Column:
        out = F.when(key % mod == 0, value)
        return out if other is None else out.otherwise(other)

    null = F.lit(None)
    rows = o.join(c, u == F.col("c_custkey")).select(
        k.cast("string").alias("id"),
        (F.when(k % 10 == 0, 1).otherwise(-1) * F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("amount_minor"),
        F.lit("INR").alias("currency_code"),
        F.col("o_orderdate").cast("date").cast("string").alias("date"),
        F.concat(F.lit(" "), F.lower(F.col("o_orderpriority")), F.lit(" order ")).alias("description"),
        when(4, F.concat(F.lit("The Shop "), (u % 50).cast("string"))).alias("merchant"),
        F.when(u % 7 == 1, F.concat(F.lit("own-"), u.cast("string"))).when(u % 7 != 0, F.col("c_mktsegment")).alias("category_id"),
        F.concat(F.lit("acct-"), (u % 20).cast("string")).alias("account_id"),
        when(3, F.lit("MANUAL"), F.lit("CSV_IMPORT")).alias("source"),
        when(8, F.concat(F.lit("note "), (k % 5).cast("string"))).alias("notes"),
        (k % 11 == 0).alias("category_locked_by_user"),
        F.when(k % 3 != 0, F.concat(F.lit("batch-"), (k % 5).cast("string"))).alias("import_batch_id"),
        (k * 1000).alias("created_at"),
        (k * 1000 + (k % 3) * 500).alias("updated_at"),
        (k % 4 + 1).alias("local_revision"),
        F.when(k % 5 != 0, k % 3 + 1).alias("remote_revision"),
        F.when(k % 13 == 0, F.lit("DELETE")).when(k % 6 == 0, F.lit("UPSERT")).alias("pending_operation"),
        when(13, F.lit(1700000000000) + k * 100000).alias("deleted_at"),
    )
    return rows.withColumn("content_hash", content_hash(F.col("account_id"), F.col("date"), F.col("amount_minor"), F.col("description")))


def load(spark: SparkSession, sf_dir: str) -> Ledger:
    tx = transactions(spark, sf_dir)
    customers, parts = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "part"))
    u, k = F.col("c_custkey"), F.col("p_partkey")
    own = F.concat(F.lit("own-"), u.cast("string"))
    categories = spark.createDataFrame(CATEGORIES, "id string, name string, is_system_defined boolean, deleted_at bigint")
    categories = categories.unionByName(customers.select(own.alias("id"), F.col("c_name").alias("name"), F.lit(False).alias("is_system_defined"), F.when(u % 13 == 0, F.lit(1690000000000) + u).alias("deleted_at")))
    categories = categories.select(
        "id", "name", F.lit(None).cast("string").alias("parent_id"), F.length("name").alias("color_argb"), F.lower("id").alias("icon_key"), "is_system_defined",
        F.lit(0).cast("bigint").alias("updated_at"), F.lit(2).cast("bigint").alias("local_revision"), F.lit(1).cast("bigint").alias("remote_revision"),
        F.when(F.col("deleted_at").isNotNull(), "DELETE").alias("pending_operation"), "deleted_at",
    )
    rules = spark.createDataFrame(RULES, "id string, category_id string, merchant_contains string, priority int, deleted_at bigint")
    needle = F.when(k % 4 == 0, F.concat(F.lit("shop "), (k % 60).cast("string"))).otherwise(F.concat(F.upper("p_name"), F.lit(" "), k.cast("string")))
    rules = rules.unionByName(parts.select(
        F.concat(F.lit("p"), k.cast("string")).alias("id"), F.get(F.array(*map(F.lit, BUDGETED)), (k % 4).cast("int")).alias("category_id"), needle.alias("merchant_contains"),
        (k % 50 + 4).cast("int").alias("priority"), F.when(k % 17 == 0, F.lit(1700000000000)).alias("deleted_at"),
    )).select(
        "id", "category_id", "merchant_contains", "priority", F.lit(0).cast("bigint").alias("created_at"), F.lit(0).cast("bigint").alias("updated_at"),
        F.lit(1).cast("bigint").alias("local_revision"), F.lit(None).cast("bigint").alias("remote_revision"), F.lit("UPSERT").alias("pending_operation"), "deleted_at",
    )
    budgets = spark.createDataFrame([(c, m, i, j) for i, c in enumerate(BUDGETED) for j, m in enumerate(MONTHS)], "category_id string, year_month string, i bigint, j bigint").select(
        "category_id", "year_month", ((F.col("j") % 4) * 300000000 + F.col("i") * 100000000).alias("limit_minor"), (F.col("j") * 1000).alias("updated_at"), ((F.col("i") + F.col("j")) % 9 == 8).alias("gone")
    )
    month = F.concat(F.lit("1996-"), F.lpad((u % 12 + 1).cast("string"), 2, "0"))
    limit = F.abs(F.round(F.col("c_acctbal") * 100).cast("bigint"))
    budgets = budgets.unionByName(customers.select(own.alias("category_id"), month.alias("year_month"), limit.alias("limit_minor"), u.cast("bigint").alias("updated_at"), (u % 9 == 8).alias("gone"))).select(
        budget_id(F.col("category_id"), F.col("year_month")).alias("id"), "category_id", "year_month", "limit_minor", F.lit("INR").alias("currency_code"),
        F.lit(0).cast("bigint").alias("created_at"), "updated_at", F.lit(1).cast("bigint").alias("local_revision"),
        F.lit(None).cast("bigint").alias("remote_revision"), F.lit("UPSERT").alias("pending_operation"), F.when(F.col("gone"), F.lit(1600000000000)).alias("deleted_at"),
    )
    n = F.col("id").cast("bigint")
    shadow = tx.where(n % 2 == 0).select(
        F.lit("transactions").alias("table_name"), F.col("id").alias("row_id"), (n % 3 + 1).alias("remote_revision"),
        F.when(n % 26 != 0, F.concat(F.lit('{"notes":"base '), (n % 5).cast("string"), F.lit('"}'))).alias("payload"),
    )
    conflicts = tx.where(n % 9 == 0).select(
        F.concat(F.lit("c"), "id").alias("id"), F.lit("transactions").alias("table_name"), F.col("id").alias("row_id"),
        F.when(n % 2 == 0, F.lit("category_id")).otherwise(F.lit("notes")).alias("field"), (n * 1000).alias("resolved_at"),
        F.when(n % 2 == 0, F.lit('"HOUSEHOLD"')).otherwise(F.lit('"note 1"')).alias("chosen_value"), F.when(n % 4 == 0, F.lit('"gone"')).otherwise(F.lit("null")).alias("discarded_value"),
        F.lit("both devices changed this field; kept the newer value").alias("reason"), F.when(n % 27 == 0, n * 2000).alias("acknowledged_at"),
    )
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = events.select("event_id", "user_id", "event_type", "value", "props")
    k, u = F.col("event_id"), F.col("user_id")
    ops = e.select(
        F.concat(F.lit("dev-"), (k % 4).cast("string")).alias("device_id"), F.call_function("div", k, F.lit(40)).alias("seq"), F.when(k % 97 == 0, 2).otherwise(1).alias("version"),
        F.when(u % 5 == 0, F.lit("budgets")).otherwise(F.lit("transactions")).alias("table_name"), F.concat(F.lit("row-"), (u % 500).cast("string")).alias("row_id"),
        k.alias("remote_revision"), (k * 10).alias("updated_at"), F.when(k % 10 != 0, F.col("props")).alias("payload"),
    )
    return Ledger(tx, categories, rules, budgets, shadow, conflicts, ops, customers, parts, events)


def _values(rows: list[tuple]) -> str:
    def one(x) -> str:
        return "NULL" if x is None else ("true" if x else "false") if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


CTES = f"""WITH tx0 AS (
 SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST((CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE -1 END) * CAST(round(o_totalprice * 100) AS BIGINT) AS BIGINT) AS amount_minor,
  'INR' AS currency_code, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS date, ' ' || lower(o_orderpriority) || ' order ' AS description,
  CASE WHEN o_orderkey % 4 = 0 THEN 'The Shop ' || (o_custkey % 50) END AS merchant, CASE WHEN o_custkey % 7 = 1 THEN 'own-' || o_custkey WHEN o_custkey % 7 <> 0 THEN c_mktsegment END AS category_id,
  'acct-' || (o_custkey % 20) AS account_id, CASE WHEN o_orderkey % 3 = 0 THEN 'MANUAL' ELSE 'CSV_IMPORT' END AS source,
  CASE WHEN o_orderkey % 8 = 0 THEN 'note ' || (o_orderkey % 5) END AS notes, o_orderkey % 11 = 0 AS category_locked_by_user,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'batch-' || (o_orderkey % 5) END AS import_batch_id, o_orderkey * 1000 AS created_at, o_orderkey * 1000 + (o_orderkey % 3) * 500 AS updated_at,
  o_orderkey % 4 + 1 AS local_revision, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 3 + 1 END AS remote_revision,
  CASE WHEN o_orderkey % 13 = 0 THEN 'DELETE' WHEN o_orderkey % 6 = 0 THEN 'UPSERT' END AS pending_operation,
  CASE WHEN o_orderkey % 13 = 0 THEN 1700000000000 + o_orderkey * 100000 END AS deleted_at, o_orderkey AS n
 FROM orders JOIN customer ON o_custkey = c_custkey
), tx AS (
 SELECT *, substr(sha256(account_id || '|' || date || '|' || amount_minor || '|' || upper(trim(description))), 1, 32) AS content_hash FROM tx0
), categories AS (
 SELECT id, name, CAST(NULL AS VARCHAR) AS parent_id, CAST(length(name) AS INTEGER) AS color_argb, lower(id) AS icon_key, is_system_defined, CAST(0 AS BIGINT) AS updated_at,
  CAST(2 AS BIGINT) AS local_revision, CAST(1 AS BIGINT) AS remote_revision, CASE WHEN deleted_at IS NOT NULL THEN 'DELETE' END AS pending_operation, CAST(deleted_at AS BIGINT) AS deleted_at
 FROM (SELECT * FROM (VALUES {_values(CATEGORIES)}) v(id, name, is_system_defined, deleted_at)
  UNION ALL SELECT 'own-' || c_custkey, c_name, false, CASE WHEN c_custkey % 13 = 0 THEN 1690000000000 + c_custkey END FROM customer)
), rules AS (
 SELECT id, category_id, merchant_contains, CAST(priority AS INTEGER) AS priority, CAST(0 AS BIGINT) AS created_at, CAST(0 AS BIGINT) AS updated_at, CAST(1 AS BIGINT) AS local_revision,
  CAST(NULL AS BIGINT) AS remote_revision, 'UPSERT' AS pending_operation, CAST(deleted_at AS BIGINT) AS deleted_at
 FROM (SELECT * FROM (VALUES {_values(RULES)}) v(id, category_id, merchant_contains, priority, deleted_at)
  UNION ALL SELECT 'p' || p_partkey, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD'][p_partkey % 4 + 1], CASE WHEN p_partkey % 4 = 0 THEN 'shop ' || p_partkey % 60 ELSE upper(p_name) || ' ' || p_partkey END,
  p_partkey % 50 + 4, CASE WHEN p_partkey % 17 = 0 THEN 1700000000000 END FROM part)
), budgets AS (
 SELECT 'budget:' || category_id || ':' || year_month AS id, category_id, year_month, CAST(limit_minor AS BIGINT) AS limit_minor, 'INR' AS currency_code,
  CAST(0 AS BIGINT) AS created_at, CAST(updated_at AS BIGINT) AS updated_at, CAST(1 AS BIGINT) AS local_revision, CAST(NULL AS BIGINT) AS remote_revision, 'UPSERT' AS pending_operation,
  CASE WHEN gone THEN 1600000000000 END AS deleted_at
 FROM (SELECT category_id, year_month, (j % 4) * 300000000 + i * 100000000 AS limit_minor, j * 1000 AS updated_at, (i + j) % 9 = 8 AS gone
  FROM (VALUES {_values([(c, m, i, j) for i, c in enumerate(BUDGETED) for j, m in enumerate(MONTHS)])}) v(category_id, year_month, i, j)
  UNION ALL SELECT 'own-' || c_custkey, '1996-' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0'), abs(CAST(round(c_acctbal * 100) AS BIGINT)), c_custkey, c_custkey % 9 = 8 FROM customer)
), shadow AS (
 SELECT 'transactions' AS table_name, id AS row_id, n % 3 + 1 AS remote_revision, CASE WHEN n % 26 <> 0 THEN '{{"notes":"base ' || (n % 5) || '"}}' END AS payload FROM tx WHERE n % 2 = 0
), conflicts AS (
 SELECT 'c' || id AS id, 'transactions' AS table_name, id AS row_id, CASE WHEN n % 2 = 0 THEN 'category_id' ELSE 'notes' END AS field, n * 1000 AS resolved_at,
  CASE WHEN n % 2 = 0 THEN '"HOUSEHOLD"' ELSE '"note 1"' END AS chosen_value, CASE WHEN n % 4 = 0 THEN '"gone"' ELSE 'null' END AS discarded_value,
  'both devices changed this field; kept the newer value' AS reason, CASE WHEN n % 27 = 0 THEN n * 2000 END AS acknowledged_at FROM tx WHERE n % 9 = 0
), ops AS (
 SELECT 'dev-' || (event_id % 4) AS device_id, event_id // 40 AS seq, CASE WHEN event_id % 97 = 0 THEN 2 ELSE 1 END AS version,
  CASE WHEN user_id % 5 = 0 THEN 'budgets' ELSE 'transactions' END AS table_name, 'row-' || (user_id % 500) AS row_id, event_id AS remote_revision, event_id * 10 AS updated_at,
  CASE WHEN event_id % 10 <> 0 THEN props END AS payload FROM events
)
"""
TX = "id, amount_minor, currency_code, date, description, merchant, category_id, account_id, source, notes, category_locked_by_user, import_batch_id, created_at, updated_at, local_revision, remote_revision, pending_operation, deleted_at, content_hash"
