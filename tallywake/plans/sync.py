"""Queries of the apply path: a device's ledger meets what another device sent."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import ledger
from ..operators.merge import NOTES_MARKER, SYNCED
from ..streaming import replication, sync
from .registry import query

NOW = ledger.NOW_MS
FIELDS = SYNCED["transactions"]


def number():
    return F.col("id").try_cast("bigint")


def changed_payload(**values):
    """A payload of a transaction's fields, some of them changed."""
    return F.to_json(F.struct(*(values.get(f, F.col(f)).alias(f) for f in FIELDS)), {"ignoreNullFields": "false"})


def sent(L):
    """What the other device sent: two of three rows changed or deleted, and new ones."""
    n = number()
    far = changed_payload(
        amount_minor=F.col("amount_minor") - (n % 2) * 100, notes=F.when(n % 7 == 0, "far note").when(n % 5 == 0, F.concat(F.lit("more "), F.coalesce("notes", F.lit("")))).otherwise(F.col("notes")),
        category_id=F.when(n % 6 == 0, "HOUSEHOLD").otherwise(F.col("category_id")), category_locked_by_user=n % 9 == 0,
    )
    old = L.tx.where(n % 3 != 0).select(F.col("id").alias("row_id"), n.alias("n"), far.alias("payload"))
    new = L.tx.where(n % 11 == 0).select(F.concat(F.lit("new-"), "id").alias("row_id"), n.alias("n"), changed_payload().alias("payload"))
    n = F.col("n")
    return old.unionByName(new).select(
        F.lit("far").alias("device_id"), (F.call_function("div", n, F.lit(100)) + 1).alias("seq"), F.when(n % 97 == 0, 2).otherwise(1).alias("version"), F.lit("transactions").alias("table_name"), "row_id",
        (n % 5 + 1).alias("remote_revision"), (n * 1000 + (n % 4) * 400).alias("updated_at"), F.when(n % 10 != 0, F.col("payload")).alias("payload"),
    )


def state(L):
    """The ledger, with a shadow of whole payloads for every other transaction."""
    n = number()
    base = changed_payload(amount_minor=F.col("amount_minor") - (n % 4 == 0).cast("int") * 100, notes=F.when(n % 8 == 0, "base").otherwise(F.col("notes")), category_locked_by_user=F.lit(False))
    shadow = L.tx.where(n % 2 == 0).select(F.lit("transactions").alias("table_name"), F.col("id").alias("row_id"), (n % 3).alias("remote_revision"), base.alias("payload"))
    cursor = L.tx.limit(0).select(F.lit("").alias("device_id"), F.lit(0).cast("bigint").alias("seq"))
    return sync.State({"transactions": L.tx, "categories": L.categories, "budgets": L.budgets, "category_rules": L.rules}, shadow, L.conflicts, cursor)


# The same in SQL: l, r and b are this side, the other and the base of a (amount), t
# (notes), c (category) and k (lock); all other fields are equal on all sides.

SIDES = """SELECT id, n, amount_minor AS la, notes AS lt, category_id AS lc, category_locked_by_user AS lk, updated_at AS lat, local_revision AS lrev, deleted_at IS NOT NULL AS lg,
 amount_minor - n % 2 * 100 AS ra, CASE WHEN n % 7 = 0 THEN 'far note' WHEN n % 5 = 0 THEN 'more ' || coalesce(notes, '') ELSE notes END AS rt,
 CASE WHEN n % 6 = 0 THEN 'HOUSEHOLD' ELSE category_id END AS rc, n % 9 = 0 AS rk, n * 1000 + n % 4 * 400 AS rat, n % 5 + 1 AS rrev, n % 10 = 0 AS rg, n % 2 = 0 AS hb,
 amount_minor - (n % 4 = 0)::INT * 100 AS ba, CASE WHEN n % 8 = 0 THEN 'base' ELSE notes END AS bt, category_id AS bc, false AS bk, CASE WHEN n % 2 = 0 THEN n % 3 ELSE 0 END AS seen FROM tx"""
WIN = "(lat > rat)"  # of equal times the smaller device, 'far' and not 'near'


def same(x: str, y: str) -> str:
    return f"({x} IS NOT DISTINCT FROM {y})"


def step(f: str) -> str:
    """0 equal, 2 theirs alone changed, 1 ours alone, 3 both."""
    return f"CASE WHEN {same('l' + f, 'r' + f)} THEN 0 WHEN hb AND {same('l' + f, 'b' + f)} THEN 2 WHEN hb AND {same('r' + f, 'b' + f)} THEN 1 ELSE 3 END"


HAND = {s: f"(NOT hb OR NOT {same(s + 'a', 'ba')} OR NOT {same(s + 't', 'bt')} OR NOT {same(s + 'k', 'bk')})" for s in "lr"}
NEW = {s: f"(NOT hb OR NOT {same(s + 'c', 'bc')} OR NOT {same(s + 'k', 'bk')})" for s in "lr"}
STEPS = f"""SELECT *, {step('a')} AS sa, {step('t')} AS st,
 CASE WHEN {same('lc', 'rc')} AND lk = rk THEN 0 WHEN NOT {NEW['l']} THEN 2 WHEN NOT {NEW['r']} THEN 1 WHEN lk AND NOT rk THEN 1 WHEN rk AND NOT lk THEN 2 ELSE 3 END AS sc,
 CASE WHEN lg AND rg THEN 'gone' WHEN lg THEN (CASE WHEN {HAND['r']} THEN 'theirs' ELSE 'gone' END) WHEN rg THEN (CASE WHEN {HAND['l']} THEN 'ours' ELSE 'gone' END) ELSE 'both' END AS how
 FROM ({SIDES}) WHERE n % 3 <> 0 AND n % 97 <> 0 AND rrev > seen"""
NOTES = f"""CASE WHEN st < 3 THEN (CASE st WHEN 2 THEN rt ELSE lt END) WHEN lt IS NULL OR rt IS NULL THEN (CASE WHEN {WIN} THEN lt ELSE rt END) WHEN contains(rt, lt) THEN rt WHEN contains(lt, rt) THEN lt
 WHEN lat >= rat THEN lt || chr(10) || '{NOTES_MARKER}' || chr(10) || rt ELSE rt || chr(10) || '{NOTES_MARKER}' || chr(10) || lt END"""
MERGED = f"""SELECT *, CASE how WHEN 'theirs' THEN ra WHEN 'ours' THEN la ELSE CASE WHEN sa = 2 OR (sa = 3 AND NOT {WIN}) THEN ra ELSE la END END AS ma,
 CASE how WHEN 'theirs' THEN rt WHEN 'ours' THEN lt ELSE {NOTES} END AS mt,
 CASE how WHEN 'theirs' THEN rc WHEN 'ours' THEN lc ELSE CASE WHEN sc = 2 OR (sc = 3 AND NOT {WIN}) THEN rc ELSE lc END END AS mc,
 CASE how WHEN 'theirs' THEN rk WHEN 'ours' THEN lk ELSE CASE WHEN sc = 2 THEN rk ELSE lk END END AS mk FROM ({STEPS})"""
DECIDED = f"""SELECT *, greatest(lrev, rrev) + adds::INT AS mrev, CASE WHEN adds THEN (CASE WHEN how = 'gone' THEN 'DELETE' ELSE 'UPSERT' END) END AS pending, greatest(lat, rat) AS mat FROM (
 SELECT *, CASE WHEN how = 'gone' THEN NOT rg WHEN rg THEN true ELSE NOT ({same('ma', 'ra')} AND {same('mt', 'rt')} AND {same('mc', 'rc')} AND mk = rk) END AS adds FROM ({MERGED}))"""
ADDED = "FROM tx WHERE n % 11 = 0 AND n % 97 <> 0"

query("apply_decide", f"""SELECT id AS row_id, how <> 'gone' AS live, mrev AS local_revision, pending AS pending_operation, mat AS updated_at FROM ({DECIDED})
 UNION ALL SELECT 'new-' || id, n % 10 <> 0, n % 5 + 1, NULL, n * 1000 + n % 4 * 400 {ADDED}""")(
    lambda L: sync.decide(replication.readable(sent(L)), L.tx, state(L).shadow, "transactions", "near").select("row_id", F.col("merged").isNotNull().alias("live"), "local_revision", "pending_operation", "updated_at")
)


def applied(L):
    return sync.apply(state(L), sent(L), "near", NOW)




def after_sql(seen: str = "true") -> str:
    """The transactions after the batches that ``seen`` (of n) holds for."""
    return f"""SELECT t.id, CASE WHEN d.how <> 'gone' THEN d.ma ELSE t.amount_minor END AS amount_minor, CASE WHEN d.how <> 'gone' THEN d.mt ELSE t.notes END AS notes,
 CASE WHEN d.how <> 'gone' THEN d.mc ELSE t.category_id END AS category_id, CASE WHEN d.how <> 'gone' THEN d.mk ELSE t.category_locked_by_user END AS category_locked_by_user,
 CASE WHEN d.how IS NULL THEN t.deleted_at WHEN d.how = 'gone' THEN {NOW} END AS deleted_at, coalesce(d.mat, t.updated_at) AS updated_at, coalesce(d.mrev, t.local_revision) AS local_revision,
 coalesce(d.rrev, t.remote_revision) AS remote_revision, CASE WHEN d.how IS NULL THEN t.pending_operation ELSE d.pending END AS pending_operation FROM tx t LEFT JOIN (SELECT * FROM ({DECIDED}) WHERE {seen}) d ON d.id = t.id
 UNION ALL SELECT 'new-' || id, amount_minor, notes, category_id, category_locked_by_user, NULL, n * 1000 + n % 4 * 400, n % 5 + 1, n % 5 + 1, NULL {ADDED} AND n % 10 <> 0 AND {seen}"""


AFTER = after_sql()
COLUMNS = "id, amount_minor, notes, category_id, category_locked_by_user, deleted_at, updated_at, local_revision, remote_revision, pending_operation"
query("apply_ops", AFTER)(lambda L: applied(L).tables["transactions"].select(*COLUMNS.split(", ")))


def shadow_sql(seen: str = "true") -> str:
    """The shadow after them."""
    return f"""SELECT id AS row_id, rrev AS remote_revision, CASE WHEN how <> 'gone' THEN ma END AS amount_minor, CASE WHEN how <> 'gone' THEN mt END AS notes FROM ({DECIDED}) WHERE {seen}
 UNION ALL SELECT 'new-' || id, n % 5 + 1, CASE WHEN n % 10 <> 0 THEN amount_minor END, CASE WHEN n % 10 <> 0 THEN notes END {ADDED} AND {seen}
 UNION ALL SELECT id, seen, ba, bt FROM ({SIDES}) WHERE hb AND id NOT IN (SELECT id FROM ({DECIDED}) WHERE {seen})"""


SHADOW = shadow_sql()
query("record_shadow", SHADOW)(
    lambda L: applied(L).shadow.select("row_id", "remote_revision", F.get_json_object("payload", "$.amount_minor").cast("bigint").alias("amount_minor"), F.from_json("payload", "notes string")["notes"].alias("notes"))
)
NEWER = "both devices changed this field; kept the newer value"
CLEARED = "one device cleared the note while the other edited it; kept the newer version"
query("apply_conflicts", f"""SELECT id AS row_id, 'amount_minor' AS field, ma::VARCHAR AS chosen, (CASE WHEN {WIN} THEN ra ELSE la END)::VARCHAR AS discarded, '{NEWER}' AS reason FROM ({MERGED}) WHERE how = 'both' AND sa = 3
 UNION ALL SELECT id, 'category_id', mc, CASE WHEN {WIN} THEN rc ELSE lc END, CASE WHEN lk THEN 'both devices locked a different category by hand' ELSE 'two rule guesses disagreed on the category' END FROM ({MERGED}) WHERE how = 'both' AND sc = 3
 UNION ALL SELECT id, 'notes', mt, CASE WHEN lt IS NULL OR rt IS NULL THEN (CASE WHEN {WIN} THEN rt ELSE lt END) WHEN lat >= rat THEN rt ELSE lt END,
 CASE WHEN lt IS NULL OR rt IS NULL THEN '{CLEARED}' ELSE 'both devices edited the note differently; kept both' END FROM ({MERGED})
 WHERE how = 'both' AND st = 3 AND (lt IS NULL OR rt IS NULL OR NOT (contains(rt, lt) OR contains(lt, rt)))""")(
    lambda L: applied(L).conflicts.where(f"resolved_at = {NOW}").select("row_id", "field", *(F.from_json(F.concat(F.lit('{"v":'), f"{c}_value", F.lit("}")), "v string")["v"].alias(c) for c in ("chosen", "discarded")), "reason")
)
REACHED = "SELECT 'far' AS device_id, max(n // 100 + 1) AS seq FROM tx WHERE n % 3 <> 0 OR n % 11 = 0"

DIRTY = {
    "categories": "SELECT id, local_revision, deleted_at FROM categories", "budgets": "SELECT id, local_revision, deleted_at FROM budgets", "category_rules": "SELECT id, local_revision, deleted_at FROM rules",
}


def pushed_sql(tx: str) -> str:
    """The first 200 dirty rows of each table by id; nothing but transactions has a shadow."""
    parts = [f"SELECT * FROM (SELECT '{t}' AS table_name, id AS row_id, local_revision AS remote_revision, deleted_at IS NULL AS alive FROM ({sql}) ORDER BY id LIMIT 200)" for t, sql in DIRTY.items()]
    return " UNION ALL ".join([*parts, f"SELECT * FROM (SELECT 'transactions', id, local_revision, deleted_at IS NULL FROM ({tx}) ORDER BY id LIMIT 200)"])


def pushed(s):
    return sync.batch(s, "near", 1).select("table_name", "row_id", "remote_revision", F.col("payload").isNotNull().alias("alive"))


PUSHED = "SELECT id, local_revision, deleted_at FROM tx WHERE local_revision > CASE WHEN n % 2 = 0 THEN n % 3 ELSE 0 END"
query("push", pushed_sql(PUSHED))(lambda L: pushed(state(L)))
# A cycle of a device that is behind what was compacted: the snapshot has what both agreed
# on and covers the first five batches, the rest are pulled; then it sends, and forgets.
LATER = "n >= 500"
SEEN = f"SELECT a.id, a.local_revision, a.deleted_at FROM ({after_sql(LATER)}) a LEFT JOIN ({shadow_sql(LATER)}) s ON s.row_id = a.id WHERE a.local_revision > coalesce(s.remote_revision, 0)"
query("sync_cycle", f"SELECT 'sent' AS what, * FROM ({pushed_sql(SEEN)}) UNION ALL SELECT 'cursor', 'far', '', max(n // 100 + 1), true FROM tx WHERE n % 3 <> 0 OR n % 11 = 0 UNION ALL SELECT 'cursor', 'near', '', 1, true")(lambda L: _cycled(L))


def _cycled(L):
    s = state(L)
    agreed = s.shadow.select("table_name", "row_id", "remote_revision", F.lit(0).cast("bigint").alias("updated_at"), "payload")
    horizon = L.tx.sparkSession.createDataFrame([("far", 5)], "device_id string, horizon bigint")
    out, batch = sync.cycle(s, sent(L), agreed, horizon, "near", 1, NOW, CUT)
    rows = batch.select(F.lit("sent").alias("what"), "table_name", "row_id", "remote_revision", F.col("payload").isNotNull().alias("alive"))
    return rows.unionByName(out.cursor.select(F.lit("cursor").alias("what"), F.col("device_id").alias("table_name"), F.lit("").alias("row_id"), F.col("seq").alias("remote_revision"), F.lit(True).alias("alive")))


def snapshot(L):
    """A snapshot with every third transaction, as this device last agreed on it."""
    s = state(L).shadow.where("try_cast(row_id as bigint) % 6 = 0")
    return s.select("table_name", "row_id", "remote_revision", F.lit(0).cast("bigint").alias("updated_at"), "payload")


query("reconcile", """SELECT 'transactions' AS t, id FROM tx WHERE n % 6 = 0 OR n % 2 <> 0 OR local_revision > n % 3 UNION ALL SELECT 'shadow', id FROM tx WHERE n % 6 = 0
 UNION ALL SELECT 'conflicts', c.id FROM conflicts c JOIN tx t ON t.id = c.row_id WHERE t.n % 6 = 0 OR t.n % 2 <> 0 OR t.local_revision > t.n % 3
 UNION ALL SELECT 'budgets', id FROM budgets UNION ALL SELECT 'categories', id FROM categories""")(lambda L: _reconciled(L))


def _reconciled(L):
    out = sync.reconcile(state(L), snapshot(L), "near", NOW)
    parts = [(t, out.tables[t]) for t in ("transactions", "budgets", "categories")] + [("shadow", out.shadow.withColumn("id", F.col("row_id"))), ("conflicts", out.conflicts)]
    frames = [df.select(F.lit(t).alias("t"), "id") for t, df in parts]
    for f in frames[1:]:
        frames[0] = frames[0].unionByName(f)
    return frames[0]


CUT = 1700100000000
OLD = f"SELECT id FROM tx WHERE deleted_at < {CUT}"
GONE = f"SELECT id FROM categories WHERE deleted_at < {CUT}"
query("tombstone_reap", f"""SELECT 'transactions' AS t, id, CASE WHEN category_id NOT IN ({GONE}) THEN category_id END AS category_id FROM tx WHERE id NOT IN ({OLD})
 UNION ALL SELECT 'shadow', row_id, NULL FROM shadow WHERE row_id NOT IN ({OLD}) UNION ALL SELECT 'conflicts', id, NULL FROM conflicts WHERE (acknowledged_at IS NULL OR acknowledged_at >= {CUT}) AND row_id NOT IN ({OLD})
 UNION ALL SELECT 'categories', id, id FROM categories WHERE id NOT IN ({GONE}) UNION ALL SELECT 'budgets', id, category_id FROM budgets WHERE (deleted_at IS NULL OR deleted_at >= {CUT}) AND category_id NOT IN ({GONE})
 UNION ALL SELECT 'category_rules', id, category_id FROM rules WHERE (deleted_at IS NULL OR deleted_at >= {CUT}) AND category_id NOT IN ({GONE})""")(lambda L: _reaped(L))


def _reaped(L):
    s = state(L)
    s.shadow = L.shadow
    out = sync.reaped(s, CUT)
    none = F.lit(None).cast("string").alias("category_id")
    frames = [df.select(F.lit(t).alias("t"), "id", F.col("id").alias("category_id") if t == "categories" else "category_id") for t, df in out.tables.items()]
    frames += [out.shadow.select(F.lit("shadow").alias("t"), F.col("row_id").alias("id"), none), out.conflicts.select(F.lit("conflicts").alias("t"), "id", none)]
    for f in frames[1:]:
        frames[0] = frames[0].unionByName(f)
    return frames[0]


RESTORED = "SELECT c.*, t.n, t.local_revision, CASE c.field WHEN 'category_id' THEN t.category_id ELSE t.notes END AS now, t.deleted_at IS NOT NULL AS gone FROM conflicts c JOIN tx t ON t.id = c.row_id"
OUTCOME = f"SELECT *, CASE WHEN gone THEN 'ROW_GONE' WHEN '\"' || now || '\"' = chosen_value THEN 'RESTORED' ELSE 'VALUE_CHANGED_SINCE' END AS outcome FROM ({RESTORED})"
# Every eighteenth row has an older conflict of the same field, acknowledged before; of
# every other of these the newer one puts back what the older one chose.
BOTH = f"""SELECT *, outcome = 'RESTORED' AND n % 36 = 0 AS twice FROM ({OUTCOME})"""
AFTERWARDS = f"""SELECT *, CASE WHEN twice THEN 'BUILDING' WHEN outcome = 'RESTORED' THEN (CASE WHEN discarded_value <> 'null' THEN 'gone' END) ELSE now END AS value_after,
 local_revision + (outcome = 'RESTORED')::INT + twice::INT AS revision FROM ({BOTH})"""
query("conflict_restore", f"""SELECT id, row_id, outcome, value_after, CASE WHEN outcome = 'RESTORED' THEN coalesce(acknowledged_at, {NOW}) ELSE acknowledged_at END AS acknowledged_at, revision AS local_revision FROM ({AFTERWARDS})
 UNION ALL SELECT 'd' || id, row_id, CASE WHEN outcome = 'ROW_GONE' THEN outcome WHEN twice THEN 'RESTORED' ELSE 'VALUE_CHANGED_SINCE' END, value_after, 7, revision FROM ({AFTERWARDS}) WHERE n % 18 = 0
 UNION ALL SELECT 'none', NULL, 'NOT_FOUND', NULL, NULL, NULL""")(lambda L: _restored(L))


def with_older(conflicts):
    """Conflicts, and for some of them an older one of the same field."""
    n = F.col("row_id").cast("bigint")
    older = conflicts.where(n % 18 == 0).withColumns({
        "id": F.concat(F.lit("d"), "id"), "resolved_at": F.lit(1).cast("bigint"), "chosen_value": F.when(n % 36 == 0, '"gone"').otherwise('"HOUSEHOLD"'), "discarded_value": F.lit('"BUILDING"'),
        "acknowledged_at": F.lit(7).cast("bigint"),
    })
    return conflicts.unionByName(older)


def _restored(L):
    none = L.tx.sparkSession.createDataFrame([("none",)], "id string")
    s = state(L)
    s.conflicts = with_older(L.conflicts)
    out, outcomes = sync.restored(s, s.conflicts.select("id").unionByName(none), NOW)
    rows = out.tables["transactions"].select(F.col("id").alias("row_id"), "category_id", "notes", "local_revision")
    after = out.conflicts.join(rows, "row_id").select("id", "row_id", F.when(F.col("field") == "notes", F.col("notes")).otherwise(F.col("category_id")).alias("value_after"), "acknowledged_at", "local_revision")
    return outcomes.join(after, "id", "left").select("id", "row_id", "outcome", "value_after", "acknowledged_at", "local_revision")
