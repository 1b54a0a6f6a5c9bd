"""Queries of the CSV side, over statements that are written from the orders:
one file for each customer, at most a few orders long."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity
from ..lineage import work_dir
from ..operators import imports, rules
from ..sources import statements as S
from . import scalars
from .registry import query

HEAD = "Date,Description,Amount,Balance"


def files(L):
    """path and content of a statement for each customer's account and shop."""
    tx = L.tx.select((F.col("id").cast("bigint") % 400).alias("file"), F.col("id").cast("bigint").alias("n"), "date", "amount_minor")
    euro = lambda c: F.concat((F.abs(c) / 100).cast("decimal(20,2)").cast("string"))
    line = F.concat_ws(",", "date", F.concat(F.lit('"Order, no. '), "n", F.lit('"')), F.concat(F.when(F.col("amount_minor") < 0, "-").otherwise(""), euro(F.col("amount_minor"))), F.lit(""))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\r\n")
    return tx.groupBy("file").agg(text.alias("t")).select(F.concat(F.lit("f"), "file").alias("path"), F.concat(F.lit("My bank\r\n\r\n" + HEAD + "\r\n"), "t", F.lit("\r\n")).cast("binary").alias("content"))


ORDERS = "SELECT 'f' || (n % 400) AS path, 'Order, no. ' || n AS description, date, amount_minor, n FROM tx"
LINES = """SELECT 'f' || (n % 400) AS path, n, date || ',"Order, no. ' || n || '",' || printf('%s%d.%02d', CASE WHEN amount_minor < 0 THEN '-' ELSE '' END, abs(amount_minor) // 100, abs(amount_minor) % 100) || ',' AS line FROM tx"""
CRLF = "chr(13) || chr(10)"
query("src_csv_bytes", f"SELECT path, CAST(strlen(t) AS BIGINT) AS length, sha256(t) AS digest FROM (SELECT path, 'My bank' || {CRLF} || {CRLF} || '{HEAD}' || {CRLF} || string_agg(line, {CRLF} ORDER BY n) || {CRLF} AS t FROM ({LINES}) GROUP BY path)")(lambda L: _read(L))


def _read(L):
    """The statements as files of their own, read as bytes."""
    root = work_dir(L.tx.sparkSession, "statements")
    text = F.regexp_replace(F.col("content").cast("string"), "\r\n$", "")
    files(L).select("path", text.alias("value")).repartition("path").write.partitionBy("path").option("lineSep", "\r\n").text(root)
    out = S.read_files(L.tx.sparkSession, f"{root}/*/*.txt")
    return out.select(F.regexp_extract("path", "path=(f[0-9]+)", 1).alias("path"), "length", F.sha2("content", 256).alias("digest"))


query("csv_decode", "SELECT id, CASE n % 4 WHEN 0 THEN 'NotText' WHEN 1 THEN 'EncodingUnclear' WHEN 2 THEN 'Success' ELSE 'TooLarge' END AS outcome, CASE WHEN n % 4 = 2 THEN description || 'é' END AS text FROM tx")(lambda L: _decoded(L))


def _decoded(L):
    """Descriptions as bytes: with a zero, with a byte that is no UTF-8, whole, none."""
    n, text = F.col("id").cast("bigint"), F.concat("description", F.lit("é")).cast("binary")
    content = F.when(n % 4 == 0, F.concat(text, F.lit(b"\0"))).when(n % 4 == 1, F.concat(text, F.lit(b"\xff"))).when(n % 4 == 2, text)
    return S.decoded(L.tx.select(F.col("id").alias("path"), content.alias("content"))).withColumnRenamed("path", "id")


query("csv_tokenize", f"SELECT path, count(*) + 3 AS n_rows FROM ({ORDERS}) GROUP BY 1")(lambda L: S.cells_of(files(L)).groupBy("path").agg(F.count("*").alias("n_rows")))
query("csv_preview", f"SELECT path, date, description, amount_minor FROM ({ORDERS})")(lambda L: S.rows_of(files(L)).where("reason is null").select("path", "date", "description", "amount_minor"))
for _n, _c, _v in (("inf_date_column", "date_column", "0"), ("inf_date_format", "date_format", "'yyyy-MM-dd'"), ("inf_description", "description_column", "1"), ("inf_money_column", "amount_column", "2"), ("inf_amount_fallback", "amount_sign", "'NEGATIVE_IS_DEBIT'")):
    query(_n, f"SELECT DISTINCT path, {_v} AS {_c} FROM ({ORDERS})")(lambda L, c=_c: S.mappings_of(files(L)).select("path", c))
query("csv_unmapped", f"SELECT DISTINCT path, '3' AS unmapped FROM ({ORDERS})")(lambda L: S.mappings_of(files(L)).select("path", F.array_join("unmapped", ",").alias("unmapped")))
query("csv_apply_mapping", f"SELECT path, -amount_minor AS amount_minor, date FROM ({ORDERS})")(
    lambda L: S.rows_of(files(L), S.Mapping(2, 3, 0, "yyyy-MM-dd", 1, 2, "POSITIVE_IS_DEBIT")).where("reason is null").select("path", "amount_minor", "date")
)


def paired(L):
    """Statements with amounts on two sides; in every other file only one has a name."""
    lines = F.concat_ws(",", "date", F.concat(F.lit("Order "), F.col("id")), F.when(F.col("amount_minor") < 0, (-F.col("amount_minor")).cast("string")).otherwise(""), F.when(F.col("amount_minor") > 0, F.col("amount_minor").cast("string")).otherwise(""))
    rows = L.tx.groupBy((F.col("id").cast("bigint") % 399).alias("f")).agg(F.array_join(F.sort_array(F.collect_list(lines)), "\n").alias("t"))
    head = F.concat(F.lit("Date,Narration,Withdrawal,"), F.when(F.col("f") % 2 == 0, "Deposit").otherwise("Other"), F.lit("\n"))
    return rows.select(F.concat(F.lit("f"), "f").alias("path"), F.concat(head, "t").cast("binary").alias("content"))


PAIRED = "SELECT 'f' || (n % 399) AS path, 'Order ' || n AS description, {0}amount_minor * 100 AS amount_minor FROM tx"
query(
    "inf_debit_credit",
    f"""SELECT DISTINCT path, 2 AS debit_column, 3 AS credit_column, CASE WHEN CAST(substr(path, 2) AS INTEGER) % 2 = 0 THEN '' ELSE 'AMOUNT_COLUMNS' END AS uncertain FROM ({PAIRED.format('')})
 WHERE path IN (SELECT 'f' || (n % 399) FROM tx WHERE amount_minor > 0) AND path IN (SELECT 'f' || (n % 399) FROM tx WHERE amount_minor < 0)""",
)(lambda L: S.mappings_of(paired(L)).where("debit_column is not null").select("path", "debit_column", "credit_column", F.array_join("uncertain", ",").alias("uncertain")))
BOTH = "path IN (SELECT 'f' || (n % 399) FROM tx WHERE amount_minor > 0) AND path IN (SELECT 'f' || (n % 399) FROM tx WHERE amount_minor < 0)"
query("csv_swap_debit_credit", f"SELECT path, description, amount_minor FROM ({PAIRED.format('-')}) WHERE {BOTH}")(
    lambda L: S.rows_of(paired(L), swap=True).join(S.mappings_of(paired(L)).where("debit_column is not null").select("path"), "path", "left_semi").select("path", "description", "amount_minor")
)


query("inf_balance_column", "SELECT DISTINCT 's' || (n // 64) AS path, 2 AS amount_column, 'NEGATIVE_IS_DEBIT' AS amount_sign, '3,4' AS unmapped, 'AMOUNT_COLUMNS,AMOUNT_SIGN' AS uncertain FROM tx")(
    lambda L: S.mappings_of(balanced(L, fee=True)).select("path", "amount_column", "amount_sign", F.array_join("unmapped", ",").alias("unmapped"), F.array_join("uncertain", ",").alias("uncertain"))
)
DAY, MON, YEAR = "substr(date, 9, 2)", "substr(date, 6, 2)", "substr(date, 1, 4)"
query("inf_date_shape", f"SELECT id, CASE n % 7 WHEN 3 THEN false WHEN 4 THEN false WHEN 6 THEN false ELSE true END AS date_like FROM tx")(lambda L: L.tx.select("id", S.date_like(_dates()).alias("date_like")))


def _dates():
    """Dates of orders in seven shapes, three of which are none."""
    n, y, m, d = F.col("id").cast("bigint"), F.substring("date", 1, 4), F.substring("date", 6, 2), F.substring("date", 9, 2)
    shapes = [F.col("date"), F.concat(F.lit(" "), d, F.lit("-"), F.date_format(F.col("date").cast("date"), "MMM"), F.lit("-"), y), F.concat_ws("/", d, m, y), F.concat(F.lit("32/13/"), y), F.concat(y, F.lit("-13-"), d), F.concat_ws(".", m, d, y), F.col("description")]
    return F.get(F.array(*shapes), (n % 7).cast("int"))


def imported(L):
    """Statements mapped, hashed, given ids and met with the stored rows; then
    rules run on what was inserted. (In the original the ids that rules look for
    are those from before re-keying, so that none is found; what is meant is done.)"""
    rows = S.rows_of(files(L)).where("reason is null").withColumn("account_id", F.lit("acct-1")).withColumn("row_index", F.concat_ws(":", "path", F.lpad(F.col("row_index").cast("string"), 9, "0")))
    rows = rows.withColumn("content_hash", identity.content_hash(F.col("account_id"), F.col("date"), F.col("amount_minor"), F.col("description")))
    stored = imports.derive_ids(rows.where("amount_minor % 2 = 0")).select("id", "content_hash", F.when(F.col("amount_minor") % 3 == 0, F.lit(1)).cast("bigint").alias("deleted_at"))
    return imports.dedupe(stored, imports.derive_ids(rows))


IMPORTED = "SELECT CASE WHEN amount_minor % 2 <> 0 THEN 'inserted' WHEN amount_minor % 3 = 0 THEN 'previously_deleted' ELSE 'duplicate' END AS bucket, n FROM tx"
query("csv_import", f"SELECT bucket, count(*) AS n FROM ({IMPORTED}) GROUP BY 1")(lambda L: imports.counters(imported(L)))


def categorised(L):
    new = imported(L).where("bucket = 'inserted'").select("id", F.lit(None).cast("string").alias("merchant"), "description", F.lit(None).cast("string").alias("category_id"), F.lit(False).alias("category_locked_by_user"), F.lit(None).cast("bigint").alias("deleted_at"))
    order = L.rules.limit(1).select(F.lit("o1").alias("id"), F.lit("HOUSEHOLD").alias("category_id"), F.lit("order, no. 1").alias("merchant_contains"), F.lit(1).alias("priority"), F.lit(None).cast("bigint").alias("deleted_at"))
    return rules.assignments(new, order).agg(F.count("*").alias("categorised"))


query("auto_categorise", f"SELECT count(*) AS categorised FROM ({IMPORTED}) WHERE bucket = 'inserted' AND n::VARCHAR LIKE '1%'")(categorised)


# Statements of three layouts, at most 64 orders each: lines before the header and ISO
# dates; a header and day first; no header, with records that are too short.

LAYOUTS = """SELECT *, n // 64 AS f, (n // 64) % 3 AS kind, row_number() OVER (PARTITION BY n // 64 ORDER BY n) - 1 AS spot,
 printf('%s%d.%02d', CASE WHEN amount_minor < 0 THEN '-' ELSE '' END, abs(amount_minor) // 100, abs(amount_minor) % 100) AS cell,
 substr(date, 9, 2) || '/' || substr(date, 6, 2) || '/' || substr(date, 1, 4) AS day_first FROM tx"""
FILE = "'s' || f AS path"


def layouts(L):
    n = F.col("id").cast("bigint")
    tx = L.tx.select(F.call_function("div", n, F.lit(64)).alias("f"), n.alias("n"), "date", "amount_minor").withColumn("kind", F.col("f") % 3)
    cell = F.format_string("%s%d.%02d", F.when(F.col("amount_minor") < 0, "-").otherwise(""), F.call_function("div", F.abs("amount_minor"), F.lit(100)), F.abs("amount_minor") % 100)
    day_first = F.concat_ws("/", F.substring("date", 9, 2), F.substring("date", 6, 2), F.substring("date", 1, 4))
    text = F.concat(F.lit("Order "), "n")
    line = F.when(F.col("kind") == 0, F.concat_ws(",", "date", text, cell, F.lit(""))).when(F.col("kind") == 1, F.concat_ws(",", text, day_first, cell))
    line = line.otherwise(F.when(F.col("n") % 7 == 0, F.concat_ws(",", "date", text)).otherwise(F.concat_ws(",", "date", text, cell, F.lit("x"))))
    # A file is 64 lines at most, whatever the table's size.
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n")
    head = F.when(F.col("f") % 3 == 0, "My bank\n\nDate,Description,Amount,Balance\n").when(F.col("f") % 3 == 1, "Particulars,Txn Date,Amount\n").otherwise("")
    return tx.groupBy("f").agg(lines.alias("t")).select(F.concat(F.lit("s"), "f").alias("path"), F.concat(head, "t").cast("binary").alias("content"))


def _of_file(name: str, column: str, sql: str):
    query(name, f"SELECT {FILE}, {sql} AS {column} FROM ({LAYOUTS}) GROUP BY f, kind")(lambda L: S.mappings_of(layouts(L)).select("path", column))


query(
    "csv_date_candidates",
    f"SELECT {FILE}, CAST(0 AS INTEGER) AS day_first_failures, CAST(count(*) FILTER (substr(date, 9, 2)::INT > 12) AS INTEGER) AS month_first_failures FROM ({LAYOUTS}) WHERE kind = 1 GROUP BY f",
)(lambda L: S.date_candidates(layouts(L)).where("cast(substring(path, 2) as bigint) % 3 = 1"))
# Most records of a file without a header have four cells; the others come every seventh.
_of_file("inf_modal_width", "width", "CAST(CASE kind WHEN 1 THEN 3 ELSE 4 END AS INTEGER)")
_of_file("inf_header_row", "header_row", "CAST(CASE kind WHEN 0 THEN 2 WHEN 1 THEN 0 END AS INTEGER)")
_of_file("inf_first_data_row", "first_row", "CAST(CASE kind WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE min(spot) FILTER (n % 7 <> 0) END AS INTEGER)")
_of_file("modal_hit_rate", "date_rate", "CAST(1 AS DOUBLE)")

query("inf_money_shape", "SELECT id, n % 9 < 8 AND n % 8 <> 6 AS money_like FROM tx")(
    lambda L: scalars.orders(L).select("id", S.money_like(F.when(F.col("n") % 9 == 8, F.concat(F.lit("Rs "), F.col("cents").cast("string"))).otherwise(scalars.written(F.col("cents"), F.col("n")))).alias("money_like"))
)
query(
    "csv_map_row",
    f"""SELECT {FILE}, CAST(spot + CASE kind WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS INTEGER) AS row_index, date, 'Order ' || n AS description, amount_minor, NULL::VARCHAR AS reason
 FROM ({LAYOUTS}) WHERE kind = 0 UNION ALL SELECT {FILE}, CAST(spot AS INTEGER), CASE WHEN n % 7 <> 0 THEN date END, CASE WHEN n % 7 <> 0 THEN 'Order ' || n END,
 CASE WHEN n % 7 <> 0 THEN amount_minor END, CASE WHEN n % 7 = 0 THEN 'expected at least 3 columns, found 2' END FROM ({LAYOUTS}) WHERE kind = 2 AND spot >= (n // 64 * 64 % 7 = 0)::INT""",
)(lambda L: S.rows_of(layouts(L).where("cast(substring(path, 2) as bigint) % 3 <> 1")).select("path", "row_index", "date", "description", "amount_minor", "reason"))
query(
    "csv_failed_rows",
    f"""SELECT {FILE}, CAST(spot + 2 AS INTEGER) AS line, 'Order ' || n || ', ' || day_first || ', ' || cell AS raw, 'unparseable date "' || day_first || '"' AS reason
 FROM ({LAYOUTS}) WHERE kind = 1 AND substr(date, 9, 2)::INT > 12""",
)(lambda L: S.failed_rows(S.rows_of(layouts(L).where("cast(substring(path, 2) as bigint) % 3 = 1"), S.Mapping(0, 1, 1, "MM/dd/yyyy", 0, 2, "NEGATIVE_IS_DEBIT"))))


def signed(L):
    """A statement for each 64 orders, with the side of the ledger in a column."""
    n = F.col("id").cast("bigint")
    mark = F.element_at(F.array(*map(F.lit, ("Dr", " by cr transfer", "debit", "C", "?"))), (n % 5 + 1).cast("int"))
    line = F.concat_ws(",", "date", F.concat(F.lit("Order "), n), F.format_string("%d.%02d", F.call_function("div", F.abs("amount_minor"), F.lit(100)), F.abs("amount_minor") % 100), mark)
    out = L.tx.groupBy(F.call_function("div", n, F.lit(64)).alias("f")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("t"))
    return out.select(F.concat(F.lit("s"), "f").alias("path"), F.col("t").cast("binary").alias("content"))


query("csv_amount", "SELECT 'Order ' || n AS description, CASE n % 5 WHEN 0 THEN -abs(amount_minor) WHEN 2 THEN -abs(amount_minor) ELSE abs(amount_minor) END AS amount_minor FROM tx WHERE n % 5 <> 4")(
    lambda L: S.rows_of(signed(L), S.Mapping(None, 0, 0, "yyyy-MM-dd", 1, 2, "SIGN_COLUMN", 3)).where("reason is null").select("description", "amount_minor")
)


def balanced(L, fee=False):
    """A statement for each 64 orders with a running balance, in which the amounts of
    every other file are debits when positive; or one with a fee besides."""
    from pyspark.sql import Window

    n = F.col("id").cast("bigint")
    tx = L.tx.select(F.call_function("div", n, F.lit(64)).alias("f"), n.alias("n"), "date", "amount_minor")
    tx = tx.withColumn("balance", 900000000000 + F.sum(F.when(F.col("f") % 2 == 0, F.col("amount_minor")).otherwise(-F.col("amount_minor"))).over(Window.partitionBy("f").orderBy("n")))
    euro = lambda c: F.format_string("%s%d.%02d", F.when(c < 0, "-").otherwise(""), F.call_function("div", F.abs(c), F.lit(100)), F.abs(c) % 100)
    columns = [F.lit("1.50"), euro(F.col("amount_minor")), euro(F.col("balance"))] if fee else [euro(F.col("balance")), euro(F.col("amount_minor"))]
    head = "Date,Details,Fee,Value,Closing\n" if fee else "Date,Details,Closing,Value\n"
    line = F.concat_ws(",", "date", F.concat(F.lit("Order "), "n"), *columns)
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n")
    return tx.groupBy("f").agg(lines.alias("t")).select(F.concat(F.lit("s"), "f").alias("path"), F.concat(F.lit(head), "t").cast("binary").alias("content"))


query("balance_lag", f"SELECT DISTINCT 's' || (n // 64) AS path, 3 AS amount_column, CASE n // 64 % 2 WHEN 0 THEN 'NEGATIVE_IS_DEBIT' ELSE 'POSITIVE_IS_DEBIT' END AS amount_sign FROM tx")(
    lambda L: S.mappings_of(balanced(L)).select("path", "amount_column", "amount_sign")
)
