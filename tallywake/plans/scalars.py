"""Queries of the scalar functions, each over a column of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity, money, months, text
from ..ledger import TODAY
from ..operators import merge, reads
from ..streaming import replication
from .registry import query

# Texts of amounts as banks write them: of an order's total, in eight ways by its key.
# The SQL says what has to come out, from the number itself.

CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


def orders(L):
    return L.tx.select("id", F.col("id").cast("bigint").alias("n"), F.abs("amount_minor").alias("cents"), "amount_minor", "date", "category_id", "content_hash", "notes", "category_locked_by_user", "source")


def written(cents, n):
    """An amount of minor units as text."""
    whole, part = F.call_function("div", cents, F.lit(100)), F.lpad((cents % 100).cast("string"), 2, "0")
    plain, grouped = F.concat(whole.cast("string"), F.lit("."), part), F.format_number(whole, 0)
    return (
        F.when(n % 8 == 0, F.concat(grouped, F.lit("."), part))
        .when(n % 8 == 1, F.concat(F.lit("("), plain, F.lit(")")))
        .when(n % 8 == 2, F.concat(F.translate(grouped, ",", "."), F.lit(","), part))
        .when(n % 8 == 3, F.concat(F.lit("₹ "), plain))
        .when(n % 8 == 4, F.concat(F.lit(" -"), plain, F.lit(" ")))
        .when(n % 8 == 5, F.concat(whole.cast("string"), F.lit("."), F.substring(part, 1, 1)))
        .when(n % 8 == 6, "N/A")
        .otherwise(grouped)
    )


query("money_parse", "SELECT id, CASE n % 8 WHEN 1 THEN -c WHEN 4 THEN -c WHEN 5 THEN c - c % 10 WHEN 6 THEN NULL WHEN 7 THEN c - c % 100 ELSE c END AS result FROM (SELECT id, n, abs(amount_minor) AS c FROM tx)")(
    lambda L: orders(L).select("id", money.parse(written(F.col("cents"), F.col("n"))).alias("result"))
)
TYPED = "CASE n % 4 WHEN 0 THEN '12a3.4.5' WHEN 1 THEN '₹' || c || '.' || n % 10 || '.7' WHEN 2 THEN 'abc' ELSE ',' || c END"
SANE = "CASE n % 4 WHEN 0 THEN '123.45' WHEN 1 THEN c || '.' || n % 10 || '7' WHEN 2 THEN '' ELSE CAST(c AS VARCHAR) END"


def typed():
    n, c = F.col("n"), F.col("cents").cast("string")
    return F.when(n % 4 == 0, "12a3.4.5").when(n % 4 == 1, F.concat(F.lit("₹"), c, F.lit("."), (n % 10).cast("string"), F.lit(".7"))).when(n % 4 == 2, "abc").otherwise(F.concat(F.lit(","), c))


query("amount_sanitize", f"SELECT id, {TYPED} AS typed, {SANE} AS result FROM (SELECT id, n, abs(amount_minor) AS c FROM tx)")(lambda L: orders(L).select("id", typed().alias("typed"), money.sanitize_input(typed()).alias("result")))
query("amount_parse_magnitude", "SELECT id, CASE n % 4 WHEN 0 THEN 12345 WHEN 1 THEN c * 100 + n % 10 * 10 + 7 WHEN 2 THEN NULL ELSE c * 100 END AS result FROM (SELECT id, n, abs(amount_minor) AS c FROM tx)")(
    lambda L: orders(L).select("id", money.parse_magnitude(money.sanitize_input(typed())).alias("result"))
)
query("amount_format_edit", "SELECT id, (abs(amount_minor) // 100) || '.' || lpad(CAST(abs(amount_minor) % 100 AS VARCHAR), 2, '0') AS result FROM tx")(lambda L: orders(L).select("id", money.format_for_editing(F.col("cents")).alias("result")))
query("format_money", "SELECT id, 'INR ' || CASE WHEN amount_minor < 0 THEN '-' ELSE '' END || format('{:,}', abs(amount_minor) // 100) || '.' || lpad(CAST(abs(amount_minor) % 100 AS VARCHAR), 2, '0') AS result FROM tx")(
    lambda L: L.tx.select("id", money.display(F.col("amount_minor"), F.col("currency_code")).alias("result"))
)
query("money_arith", "SELECT id, -amount_minor AS negated, abs(amount_minor) AS magnitude, amount_minor + created_at AS plus, amount_minor - 500 AS minus, sign(amount_minor)::INT AS sign FROM tx")(
    lambda L: L.tx.select("id", (-F.col("amount_minor")).alias("negated"), F.abs("amount_minor").alias("magnitude"), (F.col("amount_minor") + F.col("created_at")).alias("plus"), (F.col("amount_minor") - 500).alias("minus"), F.sign("amount_minor").cast("int").alias("sign"))
)
query("form_rules", "SELECT id, CASE WHEN n % 10 = 0 THEN abs(amount_minor) ELSE -abs(amount_minor) END AS result FROM tx")(
    lambda L: orders(L).select("id", money.signed(F.col("cents"), F.when(F.col("n") % 10 == 0, "INCOME").otherwise("EXPENSE")).alias("result"))
)
CODES = ["INR", "JPY", "KWD", "USD", "KRW", "BHD"]
query("decimal_places", f"SELECT c_custkey, CASE {' '.join(f'WHEN c_custkey % 6 = {k} THEN {p}' for k, p in enumerate((2, 0, 3, 2, 0, 3)))} END AS result FROM customer")(
    lambda L: L.customers.select("c_custkey", money.decimal_places(F.get(F.array(*map(F.lit, CODES)), (F.col("c_custkey") % 6).cast("int"))).alias("result"))
)

# Texts

query("trim_upper", "SELECT id, upper(trim(description)) AS result FROM tx")(lambda L: L.tx.select("id", text.trim_upper(F.col("description")).alias("result")))
NAMED = "CASE WHEN p_partkey % 3 = 0 THEN 'UPI ' ELSE '' END || upper(p_name) || CASE WHEN p_partkey % 5 = 0 THEN ' hdfc' WHEN p_partkey % 5 = 1 THEN ' HDFC 42' ELSE '' END"
query("title_case_desc", f"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN x ELSE array_to_string(list_transform(string_split(x, ' '), lambda w: CASE WHEN w IN ('UPI', 'HDFC') THEN w ELSE upper(w[1]) || lower(w[2:]) END), ' ') END AS result
 FROM (SELECT p_partkey, {NAMED} AS x FROM part)""")(lambda L: L.parts.select("p_partkey", text.title_case(_named()).alias("result")))


def _named():
    k = F.col("p_partkey")
    return F.concat(F.when(k % 3 == 0, "UPI ").otherwise(""), F.upper("p_name"), F.when(k % 5 == 0, " hdfc").when(k % 5 == 1, " HDFC 42").otherwise(""))


# Months

MONTH = "substr(date, 1, 7)"
query("ym_parse", f"SELECT id, CASE n % 4 WHEN 0 THEN {MONTH} WHEN 1 THEN {MONTH} END AS result FROM tx")(lambda L: orders(L).select("id", months.parse_month(_month_text()).alias("result")))


def _month_text():
    """Months of orders: as they are, with blanks, without a zero or beyond December."""
    m, n = months.month_of_date(F.col("date")), F.col("n")
    return F.when(n % 4 == 0, m).when(n % 4 == 1, F.concat(F.lit(" "), m, F.lit(" "))).when(n % 4 == 2, F.concat(F.substring(m, 1, 5), F.lit("8"))).otherwise(F.concat(F.substring(m, 1, 5), F.lit("13")))


of_date = lambda L: L.tx.select("id", "date", months.month_of_date(F.col("date")).alias("m"))
query("ym_from", f"SELECT id, {MONTH} AS result FROM tx")(lambda L: of_date(L).select("id", F.col("m").alias("result")))
query("ym_plus_months", f"SELECT id, strftime(CAST({MONTH} || '-01' AS DATE) + to_months(CAST(n % 30 - 10 AS INTEGER)), '%Y-%m') AS result FROM tx")(
    lambda L: of_date(L).select("id", months.plus_months(F.col("m"), (F.col("id").cast("bigint") % 30 - 10).cast("int")).alias("result"))
)
query("ym_date_range", f"SELECT id, {MONTH} || '-01..' || strftime(last_day(CAST(date AS DATE)), '%Y-%m-%d') AS result FROM tx")(lambda L: of_date(L).select("id", F.concat(months.first_day(F.col("m")), F.lit(".."), months.last_day(F.col("m"))).alias("result")))
query("ym_of", "SELECT id, CASE WHEN n % 14 BETWEEN 1 AND 12 AND n % 5 > 0 THEN substr(date, 1, 4) || '-' || lpad(CAST(n % 14 AS VARCHAR), 2, '0') END AS result FROM tx")(
    lambda L: orders(L).select("id", months.month_of(F.when(F.col("n") % 5 == 0, 0).otherwise(F.substring("date", 1, 4).cast("int")), F.col("n") % 14).alias("result"))
)
query("ym_compare", f"SELECT id, CASE WHEN {MONTH} < '1996-03' THEN -1 WHEN {MONTH} = '1996-03' THEN 0 ELSE 1 END AS result FROM tx")(
    lambda L: of_date(L).select("id", F.when(F.col("m") < TODAY[:7], -1).when(F.col("m") == TODAY[:7], 0).otherwise(1).alias("result"))
)
query("ym_display", "SELECT id, strftime(CAST(date AS DATE), '%B %Y') AS result FROM tx")(lambda L: of_date(L).select("id", F.date_format(months.first_day(F.col("m")).cast("date"), "MMMM yyyy").alias("result")))

# Identities

IDS = "CASE n % 4 WHEN 0 THEN 'h1:' || content_hash || '#' || n % 3 WHEN 1 THEN 'h9:' || content_hash || '#0' WHEN 2 THEN 'h1:xyz#0' ELSE id END"


def _ids():
    n, h = F.col("n"), F.col("content_hash")
    return F.when(n % 4 == 0, identity.derived_id(h, n % 3)).when(n % 4 == 1, F.concat(F.lit("h9:"), h, F.lit("#0"))).when(n % 4 == 2, "h1:xyz#0").otherwise(F.col("id"))


query("scheme_of", f"SELECT id, {IDS} AS made, CASE WHEN n % 2 = 0 THEN 'h1' END AS result FROM tx")(lambda L: orders(L).select("id", _ids().alias("made"), identity.scheme_of(_ids()).alias("result")))
query("is_content_derived", "SELECT id, n % 4 < 2 AS result FROM tx")(lambda L: orders(L).select("id", identity.is_content_derived(_ids()).alias("result")))
query("budget_id", f"SELECT id, 'budget:' || category_id || ':' || {MONTH} AS result FROM tx")(lambda L: L.tx.select("id", identity.budget_id(F.col("category_id"), months.month_of_date(F.col("date"))).alias("result")))
query("pairing_code", "SELECT c_custkey, to_base64(unhex(substr(sha256(c_name), 1, 32))) AS code, true AS back FROM customer")(
    lambda L: L.customers.select("c_custkey", F.unhex(F.substring(F.sha2("c_name", 256), 1, 32)).alias("salt")).select("c_custkey", replication.code_of(F.col("salt")).alias("code"), (replication.salt_of(replication.code_of(F.col("salt"))) == F.col("salt")).alias("back"))
)

# Outcomes, ages, payloads

query("run_outcome", "SELECT event_id, CASE WHEN code < 300 THEN 'success' WHEN code = 429 OR code >= 500 THEN 'retryable' ELSE 'terminal' END AS outcome FROM (SELECT event_id, 200 + event_id % 400 AS code FROM events)")(
    lambda L: L.events.select("event_id", replication.outcome_of(200 + F.col("event_id") % 400).alias("outcome"))
)
AGE = "event_id % 7000"
query("last_sync_display", f"""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'Never' WHEN m < 1 THEN 'JustNow' WHEN m < 60 THEN m || ' minutes' WHEN m < 1440 THEN m // 60 || ' hours' ELSE m // 1440 || ' days' || CASE WHEN m >= 4320 THEN ' stale' ELSE '' END END AS result
 FROM (SELECT event_id, {AGE} AS m FROM events)""")(lambda L: L.events.select("event_id", last_sync(F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 7000)).alias("result")))


def last_sync(minutes):
    """Never, JustNow, or how long ago, with a mark after three days."""
    return (
        F.when(minutes.isNull(), "Never").when(minutes < 1, "JustNow").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" minutes")))
        .when(minutes < 1440, F.concat(F.call_function("div", minutes, F.lit(60)).cast("string"), F.lit(" hours")))
        .otherwise(F.concat(F.call_function("div", minutes, F.lit(1440)).cast("string"), F.lit(" days"), F.when(minutes >= 4320, " stale").otherwise("")))
    )


VALUES = """SELECT id, CASE n % 6 WHEN 0 THEN CAST(amount_minor AS VARCHAR) WHEN 1 THEN CAST(category_locked_by_user AS VARCHAR) WHEN 2 THEN 'null' WHEN 3 THEN '"' || date || '"' WHEN 4 THEN amount_minor || '.5' ELSE '"5"' END AS raw, n FROM tx"""
query("json_decode_value", f"SELECT id, raw, CASE n % 6 WHEN 0 THEN 'Number' WHEN 1 THEN 'Flag' WHEN 2 THEN 'None' ELSE 'Text' END AS kind FROM ({VALUES})")(lambda L: orders(L).select("id", _values().alias("raw"), merge.kind_of(_values()).alias("kind")))


def _values():
    n, a = F.col("n"), F.col("amount_minor").cast("string")
    return F.when(n % 6 == 0, a).when(n % 6 == 1, F.col("category_locked_by_user").cast("string")).when(n % 6 == 2, "null").when(n % 6 == 3, F.concat(F.lit('"'), "date", F.lit('"'))).when(n % 6 == 4, F.concat(a, F.lit(".5"))).otherwise('"5"')


# What settles each field of each operation, and how many fields an operation carries

FIELDS = [(t, f, merge.policy(t, f)) for t, fs in merge.SYNCED.items() for f in fs]
POLICIES = "(VALUES " + ", ".join(f"('{t}', '{f}', '{p}')" for t, f, p in FIELDS) + ") v(table_name, field, policy)"
query("field_policies", f"SELECT c.id, c.table_name, c.field, v.policy FROM conflicts c LEFT JOIN {POLICIES} ON v.table_name = c.table_name AND v.field = c.field")(
    lambda L: L.conflicts.select("id", "table_name", "field", F.try_element_at(_policies(), F.concat_ws(".", "table_name", "field")).alias("policy"))
)
query("synced_field_names", f"SELECT o.device_id, o.seq, o.row_id, o.remote_revision, v.names FROM ops o LEFT JOIN (SELECT table_name, string_agg(field, ',' ORDER BY field) AS names FROM {POLICIES} GROUP BY 1) v ON v.table_name = o.table_name")(
    lambda L: L.ops.select("device_id", "seq", "row_id", "remote_revision", F.try_element_at(_names(), F.col("table_name")).alias("names"))
)


def _policies():
    return F.create_map(*(F.lit(x) for t, f, p in FIELDS for x in (f"{t}.{f}", p)))


def _names():
    return F.create_map(*(F.lit(x) for t, fs in merge.SYNCED.items() for x in (t, ",".join(sorted(fs)))))


# What a net total covers, for a filter that each customer has saved: all, last month, a
# range of days, half a range, or one of categories.

START, END = "strftime(date '1996-01-01' + CAST(c_custkey % 90 AS INTEGER), '%Y-%m-%d')", "strftime(date '1996-01-01' + CAST(c_custkey % 90 + c_custkey % 40 AS INTEGER), '%Y-%m-%d')"
query("net_period", f"SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Month' WHEN 1 THEN 'Month' WHEN 2 THEN 'Range' ELSE 'Filtered' END AS kind, CASE c_custkey % 5 WHEN 0 THEN '1996-03' WHEN 1 THEN '1996-02' WHEN 2 THEN {START} || '..' || {END} END AS period FROM customer")(lambda L: _periods(L))


def _periods(L):
    k = F.col("c_custkey")
    first = F.date_add(F.lit("1996-01-01").cast("date"), (k % 90).cast("int"))
    last = F.date_add(first, (k % 40).cast("int"))
    kind = F.when(k % 5 == 1, "LAST_MONTH").when(k % 5 > 1, "CUSTOM")
    saved = L.customers.select(
        "c_custkey", F.when(k % 5 == 4, F.array("c_mktsegment")).alias("categories"), F.when(k % 5 < 4, kind).alias("preset"), first.cast("string").alias("start"), F.when(k % 5 != 3, last.cast("string")).alias("end")
    )
    out = reads.net_period(F.col("categories"), F.col("preset"), F.col("start"), F.col("end"), TODAY)
    return saved.select("c_custkey", out.alias("x")).select("c_custkey", "x.kind", "x.period")
