"""Two devices and one row: what is kept, sent, remembered and recorded."""

import json

import pytest
from pyspark.sql import functions as F

from tallywake import ledger
from tallywake.operators.merge import SYNCED
from tallywake.streaming import sync

SF = "/root/testdata/sf0.001"
OPS = "device_id string, seq long, version int, table_name string, row_id string, remote_revision long, updated_at long, payload string"
NOW, FIELDS = 5000, SYNCED["transactions"]
ROW = dict(amount_minor=-500, currency_code="INR", date="2026-01-05", description="tea", merchant=None, category_id="A", account_id="acct", source="MANUAL", notes=None, category_locked_by_user=False, import_batch_id=None)


@pytest.fixture(scope="module")
def L(spark):
    return ledger.load(spark, SF)


def state(spark, L, rows, shadow=()):
    """Rows are (id, fields, updated_at, local_revision, deleted_at)."""
    tx = spark.createDataFrame(
        [(i, *(x[f] for f in FIELDS), 1, at, rev, None, "UPSERT", gone, "") for i, x, at, rev, gone in rows],
        "id string, " + sync.schema_of("transactions") + ", created_at long, updated_at long, local_revision long, remote_revision long, pending_operation string, deleted_at long, content_hash string",
    ).select(*L.tx.columns)
    none = {"categories": L.categories.limit(0), "budgets": L.budgets.limit(0), "category_rules": L.rules.limit(0)}
    held = spark.createDataFrame([("transactions", i, r, p if p is None else json.dumps(p)) for i, r, p in shadow], "table_name string, row_id string, remote_revision long, payload string")
    return sync.State({"transactions": tx, **none}, held, L.conflicts.limit(0), spark.createDataFrame([], "device_id string, seq long"))


def ops(spark, *rows):
    return spark.createDataFrame([("far", s, v, "transactions", i, r, at, p if p is None else json.dumps(p)) for s, v, i, r, at, p in rows], OPS)


def test_a_far_edit_alone_is_taken_over(spark, L):
    s = state(spark, L, [("x", ROW, 10, 1, None)], [("x", 1, ROW)])
    out = sync.pull(s, ops(spark, (1, 1, "x", 7, 20, ROW | {"notes": "hot"})), "near", NOW)
    r = out.tables["transactions"].first()
    assert (r.notes, r.local_revision, r.remote_revision, r.pending_operation, r.updated_at) == ("hot", 7, 7, None, 20)
    assert json.loads(out.shadow.first().payload)["notes"] == "hot" and out.conflicts.count() == 0
    assert [tuple(c) for c in out.cursor.collect()] == [("far", 1)]
    # The same again changes nothing.
    again = sync.pull(out, ops(spark, (1, 1, "x", 7, 20, ROW | {"notes": "hot"})), "near", NOW)
    assert again.tables["transactions"].first() == r and sync.batch(again, "near", 1).count() == 0


def test_a_conflict_stays_dirty_and_is_recorded(spark, L):
    s = state(spark, L, [("x", ROW | {"amount_minor": -700}, 30, 3, None)], [("x", 1, ROW)])
    out = sync.pull(s, ops(spark, (1, 1, "x", 9, 20, ROW | {"amount_minor": -900, "merchant": "M"})), "near", NOW)
    r = out.tables["transactions"].first()
    assert (r.amount_minor, r.merchant, r.local_revision, r.remote_revision, r.pending_operation) == (-700, "M", 10, 9, "UPSERT")
    c = out.conflicts.collect()
    assert [(x.field, x.chosen_value, x.discarded_value, x.reason) for x in c] == [("amount_minor", "-700", "-900", "both devices changed this field; kept the newer value")]
    sent = sync.batch(out, "near", 4).collect()
    assert [(x.row_id, x.remote_revision, json.loads(x.payload)["amount_minor"]) for x in sent] == [("x", 10, -700)]


def test_deletions(spark, L):
    gone = state(spark, L, [("a", ROW, 10, 2, 99), ("b", ROW, 10, 2, 99), ("c", ROW, 10, 2, None), ("d", ROW | {"notes": "n"}, 10, 2, None)], [(i, 1, ROW) for i in "abcd"])
    far = ops(spark, (1, 1, "a", 5, 20, ROW | {"notes": "edited"}), (1, 1, "b", 5, 20, ROW | {"category_id": "guess"}), (1, 1, "c", 5, 20, None), (1, 1, "d", 5, 20, None), (1, 1, "e", 5, 20, None))
    out = sync.pull(gone, far, "near", NOW)
    got = {r.id: (r.deleted_at, r.pending_operation, r.local_revision) for r in out.tables["transactions"].collect()}
    # An edit comes back, a rule's guess does not; a row nobody touched goes, an edited one stays.
    assert got == {"a": (None, None, 5), "b": (NOW, "DELETE", 6), "c": (NOW, None, 5), "d": (None, "UPSERT", 6)}
    assert {r.row_id: r.payload is None for r in out.shadow.collect()} == {"a": False, "b": True, "c": True, "d": False, "e": True}


def test_a_future_format_is_skipped_but_passed(spark, L):
    s = state(spark, L, [("x", ROW, 10, 1, None)], [("x", 1, ROW)])
    out = sync.pull(s, ops(spark, (3, 2, "x", 7, 20, ROW | {"notes": "odd"})), "near", NOW)
    assert out.tables["transactions"].first().notes is None and [tuple(c) for c in out.cursor.collect()] == [("far", 3)]


def test_only_the_newest_of_a_row(spark, L):
    s = state(spark, L, [], [])
    out = sync.pull(s, ops(spark, (1, 1, "x", 2, 20, ROW | {"notes": "old"}), (2, 1, "x", 4, 21, ROW | {"notes": "new"}), (3, 1, "x", 3, 22, None)), "near", NOW)
    r = out.tables["transactions"].first()
    assert (r.notes, r.created_at, r.deleted_at, out.shadow.first().remote_revision) == ("new", NOW, None, 4)


def test_reconcile(spark, L):
    s = state(spark, L, [("sent", ROW, 10, 2, None), ("new", ROW, 10, 1, None), ("edited", ROW, 10, 5, None), ("there", ROW, 10, 2, None)], [("sent", 2, ROW), ("edited", 2, ROW), ("there", 2, ROW)])
    snapshot = spark.createDataFrame([("transactions", "there", 6, 50, json.dumps(ROW | {"merchant": "Z"})), ("transactions", "other", 1, 50, json.dumps(ROW))], "table_name string, row_id string, remote_revision long, updated_at long, payload string")
    out = sync.reconcile(s, snapshot, "near", NOW)
    assert {r.id: r.merchant for r in out.tables["transactions"].collect()} == {"new": None, "edited": None, "there": "Z", "other": None}
    assert {r.row_id for r in out.shadow.collect()} == {"there", "other"}
    assert {r.row_id for r in sync.batch(out, "near", 1).collect()} == {"new", "edited"}


def test_acknowledging_is_guarded(spark, L):
    s = state(spark, L, [("x", ROW, 10, 3, None), ("y", ROW, 10, 4, None)])
    sent = sync.batch(s, "near", 8)
    later = state(spark, L, [("x", ROW, 10, 3, None), ("y", ROW | {"notes": "meanwhile"}, 11, 5, None)])
    out = sync.acknowledged(later, sent)
    assert {r.id: (r.remote_revision, r.pending_operation) for r in out.tables["transactions"].collect()} == {"x": (3, None), "y": (None, "UPSERT")}
    assert {r.row_id for r in out.shadow.collect()} == {"x"} and {r.row_id for r in sync.batch(out, "near", 9).collect()} == {"y"}
    assert [tuple(c) for c in out.cursor.collect()] == [("near", 8)]


def test_a_cycle_behind_the_horizon(spark, L):
    s = state(spark, L, [("sent", ROW, 10, 2, None), ("old", ROW, 10, 2, 10)], [("sent", 2, ROW), ("old", 2, None)])
    log = ops(spark, (9, 1, "x", 2, 20, ROW))
    snapshot = spark.createDataFrame([("transactions", "snap", 1, 50, json.dumps(ROW))], "table_name string, row_id string, remote_revision long, updated_at long, payload string")
    horizon = spark.createDataFrame([("far", 5)], "device_id string, horizon long")
    out, sent = sync.cycle(s, log, snapshot, horizon, "near", 1, NOW, 100)
    assert {r.id for r in out.tables["transactions"].collect()} == {"snap", "x"}
    assert [tuple(c) for c in out.cursor.collect()] == [("far", 9)] and sent.count() == 0


def test_reaping_lets_a_category_go_last(spark, L):
    s = sync.State({"transactions": L.tx, "categories": L.categories, "budgets": L.budgets, "category_rules": L.rules}, L.shadow, L.conflicts, spark.createDataFrame([], "device_id string, seq long"))
    out = sync.reaped(s, ledger.CUTOFF_MS)
    for t, df in out.tables.items():
        assert df.where(F.col("deleted_at") < ledger.CUTOFF_MS).count() == 0, t
    assert out.tables["transactions"].where("category_id = 'MACHINERY'").count() == 0
    assert out.shadow.join(L.tx.where(F.col("deleted_at") < ledger.CUTOFF_MS), F.col("row_id") == F.col("id")).count() == 0


def test_payloads_are_parsed_once(spark, L):
    """Not once for each field, which made applying slow; odd texts stay what they are."""
    odd = {"notes": 'a "b" \\ c\n\x01 é', "merchant": "it's {\"notes\":null}", "description": ""}
    s = state(spark, L, [("x", ROW | {"account_id": 'q"'}, 30, 3, None), ("y", ROW, 10, 1, None)], [("x", 1, {k: v for k, v in ROW.items() if k != "source"})])
    far = ops(spark, (1, 1, "x", 9, 20, ROW | odd | {"source": "CSV_IMPORT"}), (1, 1, "y", 9, 20, {"amount_minor": "5", "notes": 7}))
    df = sync.decide(far, s.tables["transactions"], s.shadow, "transactions", "near")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 5
    got = {r.row_id: (json.loads(r.merged), [x.field for x in r.found], r.pending_operation) for r in df.collect()}
    merged, found, pending = got["x"]
    assert merged == ROW | odd | {"account_id": 'q"', "source": "MANUAL"} and found == ["source"] and pending == "UPSERT"
    # Without a base all is a change; a value of another kind is none, and the newer one stands.
    merged, found, pending = got["y"]
    assert merged["amount_minor"] is None and merged["notes"] == "7" and merged["description"] is None and pending == "UPSERT"
