"""Queries of the three-way merge and of replication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, merge
from ..operators.merge import NOTES_MARKER
from ..streaming import observed, replication
from .registry import query

JS = "coalesce('\"' || category_id || '\"', 'null')"


def note(k: int) -> str:
    return f"CASE WHEN n % {k} = 0 THEN 'null' ELSE '\"note ' || (n % {k}) || '\"' END"


PAIRS = f"""SELECT id, n % 7 AS la, n % 5 AS ra, 'd' || (n % 3) AS ld, 'd1' AS rd, n % 4 <> 0 AS hb, {note(4)} AS ln, {note(6)} AS rn, CASE WHEN n % 4 <> 0 THEN {note(3)} END AS bn,
 {JS} AS lc, CASE WHEN n % 2 = 0 THEN '"BUILDING"' ELSE {JS} END AS rc, CASE WHEN n % 4 <> 0 THEN (CASE WHEN n % 3 = 0 THEN '"BUILDING"' ELSE {JS} END) END AS bc,
 n % 11 = 0 AS ll, n % 6 = 0 AS rl, CASE WHEN n % 4 <> 0 THEN false END AS bl, n % 8 = 1 AS lg, n % 9 = 1 AS rg FROM tx"""
WIN = "(CASE WHEN la <> ra THEN la > ra ELSE ld < rd END)"
NEWER = "both devices changed this field; kept the newer value"


def out(L, column):
    return merge.pairs(L.tx).select("id", column.alias("x")).select("id", "x.value", "x.discarded", "x.reason")


def notes_of():
    return F.col("local_notes"), F.col("remote_notes"), F.col("base_notes"), F.col("has_base")


query("merge_tiebreak", f"SELECT id, CASE WHEN {WIN} THEN lc ELSE rc END AS value, CASE WHEN {WIN} THEN rc ELSE lc END AS discarded, '{NEWER}' AS reason FROM ({PAIRS})")(
    lambda L: out(L, merge.tiebreak(F.col("local_category"), F.col("remote_category")))
)
CHANGED = "(NOT hb OR {0} IS DISTINCT FROM {1})"
STEP = "CASE WHEN ln = rn THEN 0 WHEN NOT " + CHANGED.format("ln", "bn") + " THEN 2 WHEN NOT " + CHANGED.format("rn", "bn") + " THEN 1 ELSE 3 END"
query("merge_field", f"""SELECT id, CASE WHEN s = 2 OR (s = 3 AND NOT {WIN}) THEN rn ELSE ln END AS value, CASE WHEN s = 3 THEN (CASE WHEN {WIN} THEN rn ELSE ln END) END AS discarded,
 CASE WHEN s = 3 THEN '{NEWER}' END AS reason FROM (SELECT *, {STEP} AS s FROM ({PAIRS}))""")(lambda L: out(L, merge.field(*notes_of())))
NOTE_KIND = "CASE WHEN s <> 3 THEN s WHEN ln = 'null' OR rn = 'null' THEN 4 WHEN contains(rt, lt) THEN 2 WHEN contains(lt, rt) THEN 1 ELSE 5 END"
query("merge_notes", f"""SELECT id, CASE WHEN k = 2 OR (k = 4 AND NOT {WIN}) THEN rn WHEN k = 5 THEN '"' || (CASE WHEN la >= ra THEN lt ELSE rt END) || '\\n{NOTES_MARKER}\\n' || (CASE WHEN la >= ra THEN rt ELSE lt END) || '"' ELSE ln END AS value,
 CASE WHEN k = 4 THEN (CASE WHEN {WIN} THEN rn ELSE ln END) WHEN k = 5 THEN (CASE WHEN la >= ra THEN rn ELSE ln END) END AS discarded,
 CASE k WHEN 4 THEN 'one device cleared the note while the other edited it; kept the newer version' WHEN 5 THEN 'both devices edited the note differently; kept both' END AS reason
 FROM (SELECT *, {NOTE_KIND} AS k FROM (SELECT *, {STEP} AS s, replace(ln, '"', '') AS lt, replace(rn, '"', '') AS rt FROM ({PAIRS})))""")(lambda L: out(L, merge.field(*notes_of(), "MERGE")))
LNEW, RNEW = "(" + CHANGED.format("lc", "bc") + " OR " + CHANGED.format("ll", "bl") + ")", "(" + CHANGED.format("rc", "bc") + " OR " + CHANGED.format("rl", "bl") + ")"
query("merge_category_pair", f"""SELECT id, CASE WHEN k = 2 OR (k = 3 AND NOT {WIN}) THEN rc ELSE lc END AS value, CASE WHEN k = 3 THEN (CASE WHEN {WIN} THEN rc ELSE lc END) END AS discarded,
 CASE WHEN k = 3 THEN (CASE WHEN ll THEN 'both devices locked a different category by hand' ELSE 'two rule guesses disagreed on the category' END) END AS reason, CASE WHEN k = 2 THEN rl ELSE ll END AS locked
 FROM (SELECT *, CASE WHEN lc = rc AND ll = rl THEN 1 WHEN NOT {LNEW} THEN 2 WHEN NOT {RNEW} THEN 1 WHEN ll AND NOT rl THEN 1 WHEN rl AND NOT ll THEN 2 ELSE 3 END AS k FROM ({PAIRS}))""")(
    lambda L: merge.pairs(L.tx).select("id", merge.category_pair(*(F.col(c) for c in ("local_category", "local_lock", "remote_category", "remote_lock", "base_category", "base_lock", "has_base"))).alias("x")).select("id", "x.*")
)


def deletion(L):
    """The side that is left, and whether the deletion stands."""
    p = merge.pairs(L.tx)
    base = {"category_id": F.col("base_category"), "notes": F.col("base_notes")}
    beats = lambda side: merge.delete_beats_edit({"category_id": F.col(f"{side}_category"), "notes": F.col(f"{side}_notes")}, base, F.col("has_base"))
    gone = F.when(F.col("local_gone") & F.col("remote_gone"), True).when(F.col("local_gone"), beats("remote")).when(F.col("remote_gone"), beats("local")).otherwise(False)
    return p.select("id", "local_gone", "remote_gone", gone.alias("deleted"))


DELETED = f"SELECT id, lg AS local_gone, rg AS remote_gone, CASE WHEN lg AND rg THEN true WHEN lg THEN hb AND rn IS NOT DISTINCT FROM bn WHEN rg THEN hb AND ln IS NOT DISTINCT FROM bn ELSE false END AS deleted FROM ({PAIRS})"
query("merge_delete_vs_edit", f"SELECT * FROM ({DELETED}) WHERE local_gone <> remote_gone")(lambda L: deletion(L).where("local_gone <> remote_gone"))
query("merge_both_deleted", f"SELECT * FROM ({DELETED}) WHERE local_gone AND remote_gone")(lambda L: deletion(L).where("local_gone and remote_gone"))


query("to_field_map", """SELECT id, '{"amount_minor":' || amount_minor || ',"category_id":' || coalesce('"' || category_id || '"', 'null') || '}' AS payload FROM tx""")(
    lambda L: L.tx.select("id", replication.payload(["amount_minor", "category_id"]).alias("payload"))
)
query("from_field_map", "SELECT id, amount_minor, category_id FROM tx")(lambda L: replication.from_payload(L.tx.select("id", replication.payload(["amount_minor", "category_id"]).alias("payload")), "amount_minor bigint, category_id string"))
ALL_KINDS = """'{"amount_minor":' || amount_minor || ',"category_locked_by_user":' || category_locked_by_user || ',"notes":' || NOTES || ',"extra":{"a":[1,null,"2"],"b":false}'"""
KEPT = ALL_KINDS.replace("NOTES", """coalesce('"' || notes || '"', 'null')""")
QUOTED = """'"patched"'"""
query("json_patch", f"SELECT id, {ALL_KINDS.replace('NOTES', QUOTED)} || '}}' AS patched, {KEPT} || ',\"limit_minor\":-5}}' AS added FROM tx")(lambda L: _patched(L))


def _patched(L):
    """Objects with values of all kinds: one field that is there, one that is not."""
    extra = F.parse_json(F.lit('{"a": [1, null, "2"], "b": false}')).alias("extra")
    rows = L.tx.select("id", F.to_json(F.struct("amount_minor", "category_locked_by_user", "notes", extra), {"ignoreNullFields": "false"}).alias("payload"))
    return rows.select("id", replication.patch(F.col("payload"), "notes", F.lit('"patched"')).alias("patched"), replication.patch(F.col("payload"), "limit_minor", F.lit("-5")).alias("added"))


# Replication over the operation log

GOOD = "SELECT * FROM ops WHERE version <= 1"
NEWEST = f"SELECT * FROM ({GOOD}) QUALIFY row_number() OVER (PARTITION BY table_name, row_id ORDER BY remote_revision DESC, device_id) = 1"
for _n in ("newest_op_per_row", "newest"):
    query(_n, f"SELECT table_name, row_id, remote_revision, payload FROM ({NEWEST})")(lambda L: replication.newest(replication.readable(L.ops)).select("table_name", "row_id", "remote_revision", "payload"))
query("horizon_per_device", "SELECT device_id, max(seq) AS horizon FROM ops GROUP BY 1")(lambda L: replication.horizon(L.ops))
query("compact_memory", f"SELECT table_name, row_id, remote_revision, payload FROM ({NEWEST}) WHERE payload IS NOT NULL")(
    lambda L: replication.compact(replication.readable(L.ops)).select("table_name", "row_id", "remote_revision", "payload")
)


def cursor(L):
    return replication.horizon(L.ops.where("device_id <> 'dev-3'")).select("device_id", (F.col("horizon") - 2).alias("seq"))


CURSOR = "SELECT device_id, max(seq) - 2 AS seq FROM ops WHERE device_id <> 'dev-3' GROUP BY 1"
query("oplog_vs_cursor", f"SELECT o.device_id, o.seq, o.row_id, o.remote_revision FROM ops o LEFT JOIN ({CURSOR}) c ON o.device_id = c.device_id WHERE o.seq > coalesce(c.seq, 0)")(
    lambda L: joins.after_cursor(L.ops, cursor(L)).select("device_id", "seq", "row_id", "remote_revision")
)
query("horizon_check", f"SELECT bool_or(coalesce(c.seq, 0) < h.horizon) AS behind FROM (SELECT device_id, max(seq) AS horizon FROM ops GROUP BY 1) h LEFT JOIN ({CURSOR}) c ON c.device_id = h.device_id")(lambda L: joins.behind_horizon(replication.horizon(L.ops), cursor(L)))


def renamed(L):
    """The log with the ledger's own ids, so that operations meet stored rows."""
    return replication.newest(replication.readable(L.ops)).withColumn("row_id", F.regexp_replace("row_id", "row-", ""))


OURS = f"SELECT table_name, replace(row_id, 'row-', '') AS row_id, remote_revision, updated_at, payload, device_id FROM ({NEWEST})"
query("apply_idempotent", f"SELECT o.row_id, o.remote_revision FROM ({OURS}) o LEFT JOIN shadow s ON s.table_name = o.table_name AND s.row_id = o.row_id WHERE o.remote_revision > coalesce(s.remote_revision, 0)")(
    lambda L: replication.not_applied(renamed(L), L.shadow).select("row_id", "remote_revision")
)
query("snapshot_missing", f"SELECT id FROM tx WHERE id NOT IN (SELECT row_id FROM ({OURS}) WHERE table_name = 'transactions')")(lambda L: joins.missing_from(L.tx, renamed(L).where("table_name = 'transactions'")).select("id"))
query("reactive_combine", f"SELECT table_name, row_id, remote_revision FROM ({NEWEST}) WHERE payload IS NOT NULL")(
    lambda L: observed.once(L.ops).select("table_name", "row_id", "remote_revision")
)
OP = "device_id, seq, version, table_name, row_id, remote_revision, updated_at, payload"
query("seal_batch")(lambda L: replication.sealed(L.ops))
query("open_batch", f"SELECT {OP} FROM ops")(lambda L: replication.opened(replication.sealed(L.ops)))
query("seal_snapshot")(lambda L: replication.sealed(replication.compact(replication.readable(L.ops))))
query("open_snapshot", f"SELECT {OP} FROM ({NEWEST}) WHERE payload IS NOT NULL")(lambda L: replication.opened(replication.sealed(replication.compact(replication.readable(L.ops)))))
query("derive_key", "SELECT 32 AS bytes")(lambda L: L.tx.sparkSession.createDataFrame([(len(replication.derive_key("correct horse", b"salt" * 4)),)], "bytes int"))
query("snk_disabled", "SELECT 'transport is not configured' AS message")(lambda L: L.tx.sparkSession.createDataFrame([(replication.disabled_message(),)], "message string"))
query("src_prefs", f"SELECT device_id, seq FROM ({CURSOR})")(cursor)
query("schedule", "SELECT '4 hours' AS period")(lambda L: L.tx.sparkSession.createDataFrame([(replication.PERIOD,)], "period string"))
