"""Queries that read: lookups, joins, spend, rules, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import months
from ..ledger import CUTOFF_MS, MONTH, NOW_MS, TODAY, TX, live
from ..operators import joins, reads, rules, spend
from .registry import query

A, Z = months.window(MONTH)
WINDOW = (A, Z)
DOMAIN = "id, amount_minor, date, category_id"
LIVE = "deleted_at IS NULL"


def brief(df):
    return df.select("id", "amount_minor", "date", "category_id")


# Scans, filters, lookups

query("src_table", f"SELECT {TX} FROM tx")(lambda L: L.tx)
query("tx_by_id", f"SELECT {DOMAIN} FROM tx WHERE id = '37' AND {LIVE}")(lambda L: brief(reads.by_id(L.tx, "37")))
query("tx_filtered", f"SELECT {DOMAIN} FROM tx WHERE {LIVE} AND category_id IN ('BUILDING', 'HOUSEHOLD') AND date BETWEEN '{A}' AND '{Z}'")(
    lambda L: brief(reads.filtered(L.tx, reads.Filter(("BUILDING", "HOUSEHOLD"), WINDOW)))
)
query("tx_filter_object", f"SELECT {DOMAIN} FROM tx WHERE {LIVE}")(lambda L: brief(reads.filtered(L.tx, reads.Filter())))
query("date_preset", f"SELECT {DOMAIN} FROM tx WHERE {LIVE} AND date BETWEEN '1996-02-01' AND '1996-02-29'")(
    lambda L: brief(reads.filtered(L.tx, reads.FilterState(preset="LAST_MONTH").resolve(TODAY)))
)
query("sort_tx", f"SELECT {DOMAIN}, row_number() OVER (ORDER BY date DESC, created_at DESC, id) AS place FROM tx WHERE {LIVE}")(
    lambda L: reads.placed(brief(live(L.tx)).withColumn("created_at", F.col("id").cast("bigint") * 1000), F.desc("date"), F.desc("created_at"), "id").drop("created_at")
)


query("existing_by_hash", "SELECT id, content_hash, deleted_at IS NOT NULL AS deleted FROM tx WHERE content_hash IN (SELECT content_hash FROM tx WHERE n % 17 = 0)")(
    lambda L: reads.existing_by_hash(L.tx, L.tx.where(F.col("id").cast("bigint") % 17 == 0))
)
query("rule_candidates", f"SELECT id FROM tx WHERE {LIVE} AND NOT category_locked_by_user AND category_id IS NULL")(lambda L: reads.rule_candidates(L.tx, True).select("id"))
query("locked_candidates", f"SELECT id FROM tx WHERE {LIVE} AND category_locked_by_user")(lambda L: reads.rule_candidates(L.tx, locked=True).select("id"))
query("pending_changes", "SELECT id, pending_operation FROM tx WHERE pending_operation IS NOT NULL ORDER BY id LIMIT 200")(lambda L: reads.pending_changes(L.tx).select("id", "pending_operation"))
query("cat_all", f"SELECT id, name FROM categories WHERE {LIVE}")(lambda L: live(L.categories).orderBy("name").select("id", "name"))
query("cat_by_id", f"SELECT id, name FROM categories WHERE id = 'BUILDING' AND {LIVE}")(lambda L: reads.by_id(L.categories, "BUILDING").select("id", "name"))
query("rules_all", f"SELECT id, category_id, priority FROM rules WHERE {LIVE}")(lambda L: reads.ordered_rules(L.rules).select("id", "category_id", "priority"))
query("rule_by_id", f"SELECT id, category_id FROM rules WHERE id = 'r2' AND {LIVE}")(lambda L: reads.by_id(L.rules, "r2").select("id", "category_id"))
query("sort_rules", f"SELECT id, row_number() OVER (ORDER BY priority, id) AS place FROM rules WHERE {LIVE}")(lambda L: reads.placed(live(L.rules).select("id", "priority"), "priority", "id").select("id", "place"))
query("budgets_for_month", f"SELECT id, category_id, limit_minor FROM budgets WHERE year_month = '{MONTH}' AND {LIVE}")(lambda L: reads.budgets_for(L.budgets, MONTH).select("id", "category_id", "limit_minor"))
query("budgets_all_active", f"SELECT id, limit_minor FROM budgets WHERE {LIVE}")(lambda L: live(L.budgets).select("id", "limit_minor"))
query("budget_by_id", f"SELECT id, limit_minor FROM budgets WHERE id = 'budget:BUILDING:{MONTH}' AND {LIVE}")(lambda L: reads.by_id(L.budgets, f"budget:BUILDING:{MONTH}").select("id", "limit_minor"))
query("budget_find_active", f"SELECT id, limit_minor FROM budgets WHERE category_id = 'HOUSEHOLD' AND year_month = '{MONTH}' AND {LIVE}")(
    lambda L: reads.active_budget(L.budgets, "HOUSEHOLD", MONTH).select("id", "limit_minor")
)
query("row_by_id", "SELECT id, deleted_at FROM tx WHERE id = '13'")(lambda L: L.tx.where("id = '13'").select("id", "deleted_at"))
query("revision_of", "SELECT id, local_revision, remote_revision FROM tx")(lambda L: reads.revisions(L.tx))
query("all_ids", "SELECT id FROM tx")(lambda L: L.tx.select("id"))
query("tombstones_older_than", "SELECT id FROM tx WHERE deleted_at < 1700100000000")(lambda L: reads.tombstones_before(L.tx, 1700100000000))
query("shadow_base", "SELECT * FROM shadow WHERE table_name = 'transactions' AND row_id = '2'")(lambda L: reads.shadow_of(L.shadow, "transactions", ["2"]))
query("shadow_bases", "SELECT * FROM shadow WHERE table_name = 'transactions' AND row_id IN ('2', '3', '4', '26')")(lambda L: reads.shadow_of(L.shadow, "transactions", ["2", "3", "4", "26"]))
query("shadow_count", "SELECT count(*) AS n FROM shadow")(lambda L: L.shadow.agg(F.count("*").alias("n")))
query("conflicts_unack", "SELECT id, field, resolved_at FROM conflicts WHERE acknowledged_at IS NULL")(lambda L: reads.unacknowledged(L.conflicts).select("id", "field", "resolved_at"))
query("sort_conflicts", "SELECT id, resolved_at, row_number() OVER (ORDER BY resolved_at DESC, id) AS place FROM conflicts WHERE acknowledged_at IS NULL")(
    lambda L: reads.placed(L.conflicts.where("acknowledged_at is null").select("id", "resolved_at"), F.desc("resolved_at"), "id")
)
query("conflicts_unack_count", "SELECT count(*) AS n FROM conflicts WHERE acknowledged_at IS NULL")(lambda L: reads.unacknowledged(L.conflicts).agg(F.count("*").alias("n")))
query("conflicts_for_row", "SELECT id, field FROM conflicts WHERE row_id = '18'")(lambda L: reads.conflicts_of(L.conflicts, "transactions", "18").select("id", "field"))
query("conflict_by_id", "SELECT id, row_id FROM conflicts WHERE id = 'c27'")(lambda L: L.conflicts.where("id = 'c27'").select("id", "row_id"))
query("budgetable_categories", f"SELECT id, name FROM categories WHERE {LIVE} AND id NOT IN ('income', 'transfers')")(lambda L: reads.budgetable(L.categories).select("id", "name"))
query("domain_projection", f"SELECT id, amount_minor, CAST(date AS DATE) AS date, description, merchant, category_locked_by_user FROM tx WHERE {LIVE}")(
    lambda L: reads.domain(L.tx).select("id", "amount_minor", "date", "description", "merchant", "category_locked_by_user")
)

# Joins

query("category_in_live", "SELECT id FROM tx WHERE category_id IN (SELECT id FROM categories WHERE deleted_at IS NULL)")(
    lambda L: L.tx.join(live(L.categories).select(F.col("id").alias("c")), F.col("category_id") == F.col("c"), "left_semi").select("id")
)
query("category_not_live", "SELECT id FROM tx WHERE category_id IS NULL OR category_id NOT IN (SELECT id FROM categories WHERE deleted_at IS NULL)")(
    lambda L: L.tx.join(live(L.categories).select(F.col("id").alias("c")), F.col("category_id") == F.col("c"), "left_anti").select("id")
)
NAMED = "LEFT JOIN (SELECT id AS c, name AS category_name FROM categories WHERE deleted_at IS NULL) k ON category_id = c"
query("tx_with_category", f"SELECT id, category_name FROM tx {NAMED} WHERE {LIVE}")(lambda L: joins.with_category(live(L.tx), L.categories).select("id", "category_name"))
query("budget_with_category", f"SELECT id, category_name FROM budgets {NAMED} WHERE {LIVE}")(lambda L: joins.with_category(live(L.budgets), L.categories).select("id", "category_name"))
query("rule_with_category", f"SELECT id, category_name FROM rules {NAMED} WHERE {LIVE}")(lambda L: joins.with_category(live(L.rules), L.categories).select("id", "category_name"))
query("conflict_display", """SELECT f.id, row_id, field, coalesce(k.name, nullif(regexp_extract(chosen_value, '^"(.*)"$', 1), '')) AS chosen,
 nullif(regexp_extract(discarded_value, '^"(.*)"$', 1), '') AS discarded, reason FROM conflicts f
 LEFT JOIN (SELECT * FROM categories WHERE deleted_at IS NULL) k ON field = 'category_id' AND regexp_extract(chosen_value, '^"(.*)"$', 1) = k.id""")(lambda L: joins.conflict_display(L.conflicts, L.categories))
query("dirty_rows", """SELECT t.id, t.local_revision, t.updated_at FROM tx t LEFT JOIN shadow s ON s.table_name = 'transactions' AND s.row_id = t.id
 WHERE t.local_revision > coalesce(s.remote_revision, 0) ORDER BY t.id LIMIT 200""")(lambda L: joins.dirty(L.tx, L.shadow, "transactions").select("id", "local_revision", "updated_at"))
query("limit_200", "SELECT id FROM tx ORDER BY id LIMIT 200")(lambda L: L.tx.select("id").orderBy("id").limit(200))
query("dirty_rows_all", """SELECT 'transactions' AS t, t.id FROM tx t LEFT JOIN shadow s ON s.row_id = t.id WHERE t.local_revision > coalesce(s.remote_revision, 0)
 UNION ALL SELECT 'categories', id FROM categories UNION ALL SELECT 'budgets', id FROM budgets UNION ALL SELECT 'category_rules', id FROM rules""")(
    lambda L: joins.dirty(L.tx, L.shadow, "transactions", None).select(F.lit("transactions").alias("t"), "id")
    .unionByName(joins.dirty(L.categories, L.shadow, "categories", None).select(F.lit("categories").alias("t"), "id"))
    .unionByName(joins.dirty(L.budgets, L.shadow, "budgets", None).select(F.lit("budgets").alias("t"), "id"))
    .unionByName(joins.dirty(L.rules, L.shadow, "category_rules", None).select(F.lit("category_rules").alias("t"), "id"))
)

# Spend

SPENT = f"SELECT *, (SELECT count(*) FROM categories k WHERE k.id = tx.category_id AND k.deleted_at IS NULL) AS known FROM tx WHERE {LIVE} AND amount_minor < 0"
query("category_breakdown", f"SELECT CASE WHEN known > 0 THEN category_id ELSE 'uncategorised' END AS category_id, CAST(sum(-amount_minor) AS BIGINT) AS spent_minor FROM ({SPENT}) WHERE date BETWEEN '{A}' AND '{Z}' GROUP BY 1")(
    lambda L: spend.breakdown(L.tx, L.categories, WINDOW)
)
query("category_spend", f"SELECT category_id, CAST(sum(-amount_minor) AS BIGINT) AS spent_minor FROM ({SPENT}) WHERE known > 0 AND date BETWEEN '{A}' AND '{Z}' GROUP BY 1")(lambda L: spend.category_spend(L.tx, L.categories, WINDOW))
query("uncategorised_spend", f"SELECT CAST(coalesce(sum(-amount_minor), 0) AS BIGINT) AS spent_minor FROM ({SPENT}) WHERE known = 0 AND date BETWEEN '{A}' AND '{Z}'")(lambda L: spend.uncategorised_spend(L.tx, L.categories, WINDOW))
SLICES = f"""SELECT category_id, name, spent_minor FROM (SELECT CASE WHEN known > 0 THEN category_id ELSE 'uncategorised' END AS category_id, CAST(sum(-amount_minor) AS BIGINT) AS spent_minor
 FROM ({SPENT}) WHERE date BETWEEN '{A}' AND '{Z}' GROUP BY 1) LEFT JOIN (SELECT id, name FROM categories) k ON k.id = category_id"""
for _name in ("breakdown_slices", "slice_with_category"):
    query(_name, SLICES)(lambda L: spend.slices(L.tx, L.categories, WINDOW))
query("sort_slices", f"SELECT category_id, row_number() OVER (ORDER BY spent_minor DESC, category_id) AS place FROM ({SLICES})")(
    lambda L: reads.placed(spend.slices(L.tx, L.categories, WINDOW).select("category_id", "spent_minor"), F.desc("spent_minor"), "category_id").select("category_id", "place")
)
query("monthly_spend", f"SELECT substr(date, 1, 7) AS year_month, CAST(sum(-amount_minor) AS BIGINT) AS spent_minor FROM tx WHERE {LIVE} AND amount_minor < 0 GROUP BY 1")(lambda L: spend.monthly_spend(L.tx))
query("substr_month", "SELECT id, substr(date, 1, 7) AS year_month FROM tx")(lambda L: L.tx.select("id", months.month_of_date(F.col("date")).alias("year_month")))
query("earliest_date", f"SELECT min(date) AS earliest FROM tx WHERE {LIVE}")(lambda L: spend.earliest_date(L.tx))
query("has_history", f"SELECT count(*) > 0 AS has_history FROM tx WHERE {LIVE}")(lambda L: spend.earliest_date(L.tx).select(F.col("earliest").isNotNull().alias("has_history")))
TREND = f"""SELECT m AS year_month, CAST(coalesce(s, 0) AS BIGINT) AS spent_minor FROM (SELECT strftime(d, '%Y-%m') AS m FROM (SELECT unnest(generate_series(greatest(date '1995-10-01',
 (SELECT date_trunc('month', min(CAST(date AS DATE))) FROM tx WHERE {LIVE})), date '1996-03-01', interval 1 month)) AS d))
 LEFT JOIN (SELECT substr(date, 1, 7) AS k, sum(-amount_minor) AS s FROM tx WHERE {LIVE} AND amount_minor < 0 GROUP BY 1) ON k = m"""
query("spend_trend", TREND)(lambda L: spend.trend(L.tx, MONTH, 6))
query("trend_has_comparison", f"SELECT count(*) > 1 AS has_comparison FROM ({TREND})")(lambda L: spend.trend(L.tx, MONTH, 6).agg((F.count("*") > 1).alias("has_comparison")))
WITH_SPEND = f"""SELECT b.id, b.category_id, b.limit_minor, CAST(coalesce(sum(-t.amount_minor), 0) AS BIGINT) AS spent_minor FROM budgets b LEFT JOIN tx t
 ON t.category_id = b.category_id AND t.deleted_at IS NULL AND t.amount_minor < 0 AND t.date BETWEEN '{A}' AND '{Z}' WHERE b.year_month = '{MONTH}' AND b.deleted_at IS NULL GROUP BY 1, 2, 3"""
query("budgets_with_spend", WITH_SPEND)(lambda L: spend.budgets_with_spend(L.tx, L.budgets, MONTH).drop("year_month"))
query("sort_budgets", f"SELECT id, row_number() OVER (ORDER BY category_id) AS place FROM ({WITH_SPEND})")(
    lambda L: reads.placed(spend.budgets_with_spend(L.tx, L.budgets, MONTH).select("id", "category_id"), "category_id").select("id", "place")
)
PROGRESS = f"""SELECT *, limit_minor - spent_minor AS remaining_minor, CAST(CASE WHEN limit_minor = 0 THEN (CASE WHEN spent_minor > 0 THEN 1 ELSE 0 END) ELSE CAST(spent_minor AS REAL) / CAST(limit_minor AS REAL) END AS REAL) AS fraction FROM ({WITH_SPEND})"""
STATUS = f"""SELECT id, category_id, limit_minor, spent_minor, remaining_minor, fraction, CASE WHEN spent_minor > limit_minor THEN 'OVER' WHEN limit_minor > 0 AND fraction >= CAST(0.9 AS REAL) THEN 'NEAR_LIMIT' ELSE 'UNDER' END AS status,
 spent_minor = limit_minor AS at_limit FROM ({PROGRESS})"""
query("budget_progress", STATUS)(lambda L: spend.progress(L.tx, L.budgets, MONTH))
query("progress_remaining", f"SELECT id, remaining_minor FROM ({PROGRESS})")(lambda L: spend.progress(L.tx, L.budgets, MONTH).select("id", "remaining_minor"))
query("progress_fraction", f"SELECT id, fraction FROM ({PROGRESS})")(lambda L: spend.progress(L.tx, L.budgets, MONTH).select("id", "fraction"))
query("progress_status", f"SELECT id, status FROM ({STATUS})")(lambda L: spend.progress(L.tx, L.budgets, MONTH).select("id", "status"))
query("progress_at_limit", f"SELECT id, at_limit FROM ({STATUS})")(lambda L: spend.progress(L.tx, L.budgets, MONTH).select("id", "at_limit"))
query("over_budget", f"SELECT * FROM ({STATUS}) WHERE status = 'OVER'")(lambda L: spend.over_budget(L.tx, L.budgets, MONTH))
query("monthly_budgets", f"SELECT category_id, limit_minor, spent_minor FROM ({WITH_SPEND}) UNION ALL SELECT 'uncategorised', NULL, CAST(coalesce(sum(-amount_minor), 0) AS BIGINT) FROM ({SPENT}) WHERE known = 0 AND date BETWEEN '{A}' AND '{Z}'")(
    lambda L: spend.monthly_budgets(L.tx, L.budgets, L.categories, MONTH)
)
query("budget_flags", f"SELECT bool_and(spent_minor = 0) AS nothing_counted_yet, bool_or(spent_minor > limit_minor) AS any_over FROM ({WITH_SPEND})")(lambda L: spend.budget_flags(L.tx, L.budgets, MONTH))
query("net_total_month", f"SELECT CAST(coalesce(sum(amount_minor), 0) AS BIGINT) AS net_minor FROM tx WHERE {LIVE} AND substr(date, 1, 7) = '{MONTH}'")(lambda L: spend.net_total(L.tx, months.month_of_date(F.col("date")) == MONTH))
query("net_total_filtered", f"SELECT CAST(coalesce(sum(amount_minor), 0) AS BIGINT) AS net_minor FROM tx WHERE {LIVE} AND category_id = 'BUILDING'")(lambda L: spend.net_total(L.tx, reads.Filter(("BUILDING",)).predicate()))
query("group_by_date", f"""SELECT date, CASE WHEN date = '{TODAY}' THEN 'Today' WHEN date = '1996-03-19' THEN 'Yesterday' ELSE 'Dated' END AS header, id, row_number() OVER (PARTITION BY date ORDER BY created_at DESC, id) AS place,
 count(*) OVER (PARTITION BY date) AS n, CAST(sum(amount_minor) OVER (PARTITION BY date) AS BIGINT) AS net_minor FROM tx WHERE {LIVE}""")(lambda L: spend.by_date(L.tx, TODAY))
query("next_rule_priority", f"SELECT CAST(coalesce(max(priority), -1) + 1 AS INTEGER) AS next_priority FROM rules WHERE {LIVE}")(lambda L: spend.next_priority(L.rules))

# Rules

PREPARED = "SELECT id, category_id, priority, upper(trim(merchant_contains)) AS needle FROM rules WHERE deleted_at IS NULL AND trim(merchant_contains) <> ''"
MATCHED = f"""SELECT t.id, t.category_id, t.category_locked_by_user, p.id AS rule_id, p.category_id AS rule_category FROM tx t JOIN ({PREPARED}) p ON contains(upper(trim(coalesce(t.merchant, t.description))), p.needle)
 WHERE t.deleted_at IS NULL QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY p.priority, p.id) = 1"""
query("prepare_rules", PREPARED)(lambda L: rules.prepare(L.rules).select("id", "category_id", "priority", "needle"))
for _name in ("rule_match", "first_match"):
    query(_name, f"SELECT id, rule_id, rule_category FROM ({MATCHED})")(lambda L: rules.first_match(live(L.tx), L.rules).where("rule_id is not null").select("id", "rule_id", "rule_category"))
query("apply_rules", f"SELECT id, rule_category AS category_id FROM ({MATCHED}) WHERE NOT category_locked_by_user AND category_id IS DISTINCT FROM rule_category")(lambda L: rules.assignments(L.tx, L.rules))
query("count_locked_matches", f"SELECT count(*) AS locked_skipped FROM ({MATCHED}) WHERE category_locked_by_user AND category_id IS DISTINCT FROM rule_category")(lambda L: rules.locked_matches(L.tx, L.rules))
query("rule_preview", f"SELECT count(*) FILTER (NOT category_locked_by_user) AS changed, count(*) FILTER (category_locked_by_user) AS locked_skipped FROM ({MATCHED}) WHERE category_id IS NULL")(lambda L: rules.preview(L.tx, L.rules, True))
query("rule_apply", f"""SELECT t.id, coalesce(m.rule_category, t.category_id) AS category_id, t.local_revision + (m.id IS NOT NULL)::INT AS local_revision FROM tx t
 LEFT JOIN (SELECT * FROM ({MATCHED}) WHERE NOT category_locked_by_user AND category_id IS DISTINCT FROM rule_category) m ON m.id = t.id""")(
    lambda L: rules.apply(L.tx, rules.assignments(L.tx, L.rules), NOW_MS).select("id", "category_id", "local_revision")
)
query("apply_rule_category", f"SELECT count(*) AS changed FROM ({MATCHED}) WHERE NOT category_locked_by_user AND category_id IS DISTINCT FROM rule_category")(
    lambda L: rules.apply(L.tx, rules.assignments(L.tx, L.rules), NOW_MS).agg(F.count_if("changed").alias("changed"))
)

query("content_hash", "SELECT id, content_hash FROM tx")(lambda L: L.tx.select("id", "content_hash"))
