"""Replication through files: retries, pruning, rounds, crashes, claims and the stream."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from tallywake import ledger
from tallywake.operators import spend, totals
from tallywake.plans import sync as device
from tallywake.streaming import observed, pull, replication, store, sync
from tallywake.streaming.versions import BUCKET, Versions

SF = "/root/testdata/sf0.001"
OPS = "device_id string, seq long, version int, table_name string, row_id string, remote_revision long, updated_at long, payload string"
HOUR, DAY, NOW = 3_600_000, 86_400_000, 1_000_000_000_000
KEY = b"k" * 32


@pytest.fixture
def s(spark):
    return store.Store(spark, f"file://{tempfile.mkdtemp()}/store", KEY)


def ops(spark, numbers, dev="a", **more):
    """A batch of one operation for each number."""
    return spark.createDataFrame([(dev, n, 1, "transactions", more.get("row", f"row-{dev}-{n}"), more.get("revision", n), 0, more.get("payload", json.dumps({"amount_minor": -n}))) for n in numbers], OPS)


def batches(s):
    return {(r.device_id, r.seq) for r in s.files().select("device_id", "seq").collect()}


def rows(s):
    return {r.row_id: (r.remote_revision, r.payload) for r in s.snapshot().collect()}


def horizon(s):
    return {r.device_id: r.horizon for r in s.horizon().collect()}


def test_a_batch_that_is_written_again_is_there_once(spark, s):
    body = ops(spark, [0]).drop("device_id", "seq")
    assert s.push(body.limit(0), "phone/1", NOW) is None and s.names("seq") == []
    n = s.push(body, "phone/1", NOW)
    assert s.push(body, "phone/1", NOW, n) == n == 1
    assert s.push(body, "phone/1", NOW) == 2 and s.push(body, "tablet", NOW) == 1
    got = s.after(s.files().limit(0).select("device_id", "seq")).collect()
    assert sorted((r.device_id, r.seq, r.row_id, r.payload) for r in got) == [(d, k, "row-a-0", '{"amount_minor": 0}') for d, k in (("phone/1", 1), ("phone/1", 2), ("tablet", 1))]


def test_a_number_is_never_used_twice(s):
    assert [s.reserve("a") for _ in range(3)] == [1, 2, 3] and s.reserve("b") == 1
    # Another writer took the next one between reading and writing.
    s.put("seq", "a", 4)
    read = s.names
    s.names = lambda folder: [x for x in read(folder) if x != ["a", "4"]]
    assert s.reserve("a") == 5


def test_passed_batches_are_pruned_before_they_are_opened(spark, s):
    s.append(ops(spark, range(1, 40)).unionByName(ops(spark, range(1, 20), "b")), NOW)
    cursor = spark.createDataFrame([("a", 36)], "device_id string, seq long")
    new = s.after(cursor)
    assert {(r.device_id, r.seq) for r in new.collect()} == {("a", 37), ("a", 38), ("a", 39)} | {("b", k) for k in range(1, 20)}
    scan = next(x for x in new._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x)
    assert "PartitionFilters: [" in scan and "seq#" in scan.split("PartitionFilters: [")[1].split("]")[0]
    # Files of passed batches could not even be opened.
    for f in list(_files(spark, f"{s.root}/ops/device_id=a/seq=5")):
        out = f.getPath().getFileSystem(spark._jsc.hadoopConfiguration()).create(f.getPath(), True)
        out.write(bytearray(b"{no json"))
        out.close()
    assert s.after(cursor).count() == 22
    with pytest.raises(Exception):
        s.after(cursor.limit(0)).count()


def test_a_frame_and_the_files_say_the_same(spark, s):
    L = ledger.load(spark, SF)
    s.append(L.ops, NOW)
    none = L.ops.limit(0).select("device_id", "seq")
    # Numbers start with 1: without a cursor that is everything.
    assert sorted(map(str, s.after(none).select(*L.ops.columns).collect())) == sorted(map(str, L.ops.where("seq > 0").collect()))


def test_another_key_opens_nothing(spark, s):
    s.append(ops(spark, [1]), NOW)
    other = store.Store(spark, s.root, b"x" * 32)
    with pytest.raises(Exception):
        other.after(s.files().limit(0).select("device_id", "seq")).collect()


def test_the_newest_published_snapshot_is_read(spark, s):
    none, at = ops(spark, []).select("device_id", "seq"), spark.createDataFrame([], store.HORIZON)
    assert s.latest() is None and s.snapshot().count() == 0 and s.horizon().count() == 0
    for n in (1, 2, 10):
        s.write_snapshot(n, ops(spark, [n]), at, none)
        if n > 1:
            assert s.publish(n, NOW)
    s.write_snapshot(11, ops(spark, [11]), at, none)  # half-written: never published
    assert s.latest() == 10 and set(rows(s)) == {"row-a-10"} and not s.publish(10, NOW)


# Compaction


def test_nothing_is_folded_without_a_reason(spark, s):
    s.append(ops(spark, range(1, 61)), NOW)
    assert s.compact("a", NOW + 2 * HOUR) is None  # nobody owns the log
    assert s.elect("a", NOW, 0) and not s.elect("b", NOW, 0)
    assert s.compact("b", NOW + 2 * HOUR) is None
    assert s.compact("a", NOW + HOUR - 1) is None  # all too young
    assert s.compact("a", NOW + 2 * HOUR, threshold=61) is None
    assert len(batches(s)) == 60 and s.latest() is None


def test_two_rounds_fold_and_delete_exactly_what_is_old(spark, s):
    s.elect("a", NOW, 0)
    s.append(ops(spark, range(1, 61)), NOW)
    s.append(ops(spark, range(61, 66)), NOW + 2 * HOUR)
    assert s.compact("a", NOW + 2 * HOUR) == 1
    assert batches(s) == {("a", k) for k in range(61, 66)} and len(rows(s)) == 60 and horizon(s) == {"a": 60}
    s.append(ops(spark, range(1, 60), "b").unionByName(ops(spark, [66], row="row-a-3", payload=None)), NOW + 3 * HOUR)
    assert s.compact("a", NOW + 3 * HOUR) is None  # five are old enough
    assert s.compact("a", NOW + 4 * HOUR) == 2
    assert batches(s) == set() and horizon(s) == {"a": 66, "b": 59}
    assert set(rows(s)) == ({f"row-a-{k}" for k in range(1, 66)} - {"row-a-3"}) | {f"row-b-{k}" for k in range(1, 60)}
    assert s.snapshots() == [(1, NOW + 2 * HOUR), (2, NOW + 4 * HOUR)]


def test_a_crash_between_publishing_and_deleting_loses_nothing(spark, s, monkeypatch):
    s.elect("a", NOW, 0)
    s.append(ops(spark, range(1, 61)).unionByName(ops(spark, [61], row="row-a-5", revision=61, payload=None)), NOW)
    removed = []

    def remove(path, real=s.remove):
        if path.startswith("ops/"):
            if len(removed) == 30:
                raise RuntimeError("lost")
            removed.append(path)
        real(path)

    monkeypatch.setattr(s, "remove", remove)
    with pytest.raises(RuntimeError):
        s.compact("a", NOW + HOUR)
    left = batches(s)
    assert s.latest() == 1 and len(left) == 31 and "row-a-5" not in rows(s)
    whole = rows(s)
    # Even if only the deletion of a row is gone from the log, the row does not come back.
    monkeypatch.undo()
    s.remove("ops/device_id=a/seq=61")
    s.append(ops(spark, range(100, 150)), NOW)
    assert s.compact("a", NOW + HOUR) == 2
    assert batches(s) == set() and rows(s) == whole | {f"row-a-{k}": (k, json.dumps({"amount_minor": -k})) for k in range(100, 150)}


def test_a_crash_before_publishing_folds_again(spark, s, monkeypatch):
    s.elect("a", NOW, 0)
    s.append(ops(spark, range(1, 61)), NOW)
    with monkeypatch.context() as m:
        m.setattr(s, "publish", lambda *x: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            s.compact("a", NOW + HOUR)
    assert s.latest() is None and len(batches(s)) == 60
    assert s.compact("a", NOW + HOUR) == 2 and len(rows(s)) == 60 and batches(s) == set()


def test_who_loses_the_log_deletes_nothing(spark, s, monkeypatch):
    s.elect("b", NOW, 0)
    s.append(ops(spark, range(1, 61)), NOW)
    publish = s.publish

    def late(*x):
        s.put("claims", NOW, "a")
        return publish(*x)

    monkeypatch.setattr(s, "publish", late)
    assert s.compact("b", NOW + HOUR) == 1 and len(batches(s)) == 60


def many(spark, n, dev="a", payload="{}"):
    """A batch of one operation for each number below n, as one frame."""
    return spark.range(1, n + 1, 1, 4).selectExpr(f"'{dev}' as device_id", "id as seq", "1 as version", "'transactions' as table_name", f"concat('row-{dev}-', id) as row_id", "id as remote_revision", "0L as updated_at", f"'{payload}' as payload")


def test_very_many_batches_are_packed_and_each_is_there_once(spark, s):
    n = store.PACKED + 200
    every = many(spark, n).unionByName(many(spark, 50, "b/c"))
    for _ in range(2):  # twice the same
        s.append(every, F.when(F.col("seq") <= 100, NOW).otherwise(NOW + 2 * HOUR))
        assert len({f.getPath().getParent().toString() for f in _files(spark, f"{s.root}/ops") if f.getPath().getName().endswith(".json")}) == 3
        assert s.files().count() == n + 50 and batches(s) == {("a", k) for k in range(1, n + 1)} | {("b/c", k) for k in range(1, 51)}
    got = s.after(spark.createDataFrame([("a", n - 3)], "device_id string, seq long")).collect()
    assert {(r.device_id, r.seq, r.row_id) for r in got} == {("a", k, f"row-a-{k}") for k in range(n - 2, n + 1)} | {("b/c", k, f"row-b/c-{k}") for k in range(1, 51)}
    # One that is sent again alone, and many that are sent again in other company.
    s.append(ops(spark, [7], payload="again"), NOW)
    none = s.files().limit(0).select("device_id", "seq")
    assert s.files().count() == n + 50 and {r.seq for r in s.after(none).where("payload = 'again'").collect()} == {7}
    s.append(many(spark, n + 1, payload="new"), NOW)
    assert s.files().count() == n + 51 and s.after(none).where("payload = 'new'").count() == n + 1 and s.after(none).where("payload = '{}'").count() == 50


def test_packs_are_folded_and_deleted_as_a_whole(spark, s, monkeypatch):
    n = store.PACKED + 200
    s.elect("a", NOW, 0)
    s.append(many(spark, n), F.when(F.col("seq") <= n - 60, NOW).otherwise(NOW + 2 * HOUR))
    assert s.compact("a", NOW + 2 * HOUR) == 1
    assert batches(s) == {("a", k) for k in range(n - 59, n + 1)} and len(rows(s)) == n - 60 and horizon(s) == {"a": n - 60}
    # Left by two crashes one after the other, a folded deletion stays folded.
    s.append(ops(spark, [n + 1], row="row-a-5", revision=n + 1, payload=None), NOW + 2 * HOUR)
    for hours, more in ((4, range(0)), (5, range(n + 2, n + 62))):
        if more:
            s.append(ops(spark, more), NOW + 3 * HOUR)
        with monkeypatch.context() as m:
            for name in ("_delete", "_remove_pack"):
                m.setattr(s, name, lambda *x: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                s.compact("a", NOW + hours * HOUR)
    whole = rows(s)
    assert "row-a-5" not in whole and len(batches(s)) == 121
    s.remove(f"ops/device_id=a/seq={n + 1}")  # only the deletion is gone from the log
    assert s.compact("a", NOW + 6 * HOUR, threshold=1) is None and batches(s) == set() and rows(s) == whole and s.names("packs") == []


# Claims


def test_claims(spark, s):
    assert not s.is_stale(NOW)
    s.put("claims", 1000, "z")
    s.put("claims", 2000, "a")
    assert not s.elect("m", NOW, 0) and s.claims() == [("a", 2000)]
    assert s.elect("a", NOW, 0) and s.take_over("m", NOW, 0) and s.claims() == [("m", NOW)] and not s.elect("a", NOW, 0)


def test_staleness(spark, s):
    s.elect("a", NOW, 0)
    s.append(ops(spark, range(1, 50)), NOW)
    assert not s.is_stale(NOW + 91 * DAY)  # old, but there is not a round's worth
    s.append(ops(spark, [50]), NOW)
    assert s.is_stale(NOW + 91 * DAY) and not s.is_stale(NOW + 90 * DAY)
    assert s.compact("a", NOW + 2 * HOUR) == 1
    assert not s.is_stale(NOW + 90 * DAY + HOUR) and s.is_stale(NOW + 91 * DAY)


# Versions and the stream


def test_a_version_is_seen_whole_or_not(spark):
    v = Versions(spark, f"file://{tempfile.mkdtemp()}", 4)
    df = spark.range(40).selectExpr("cast(id as string) as id", "0 as x")
    v.write(0, {"t": (df, F.col("id")), "u": (df, F.col("id"))})
    b = v.bucket(F.col("id"))
    one = df.where(b == 1).withColumn("x", F.lit(1))
    assert v.newest() == 0 and v.table("t", 0).count() == 40 and {r.id for r in v.table("t", 0, [1]).collect()} == {r.id for r in one.collect()}
    for _ in range(2):  # twice the same
        v.write(1, {"t": (one, F.col("id"))}, {"t": [1]}, 0)
        assert v.newest() == 1 and v.table("t", 1).count() == 40 and v.table("t", 1).where("x = 1").count() == one.count()
    assert v.table("t", 0).where("x = 1").count() == 0 and v.table("u", 1).count() == 40
    # A bucket that loses its rows; and one that was written and not published.
    v.write(2, {"t": (one.limit(0), F.col("id"))}, {"t": [1]}, 1)
    assert v.table("t", 2).count() == 40 - one.count() and v.table("t", 2).columns == ["id", "x"]
    df.withColumn(BUCKET, b).write.partitionBy(BUCKET).parquet(f"{v.root}/data/t/3")
    assert v.newest() == 2


def same(a, b):
    cols = sorted(a.columns)
    return sorted(map(str, a.select(*cols).collect())) == sorted(map(str, b.select(*cols).collect()))


def test_a_stream_of_batches_and_a_batch_that_runs_twice(spark, s):
    L = ledger.load(spark, SF)
    state = device.state(L)
    v = Versions(spark, f"{s.root}/tables", 4)
    pull.start(v, state)
    sent = device.sent(L)
    s.append(sent.where("seq <= 8"), NOW)
    s.append(sent.where("seq <= 3").withColumn("device_id", F.lit("near")), NOW)  # its own are passed over
    checkpoint = f"{s.root}/offsets"
    assert pull.follow(s, v, checkpoint, "near", 5000) == 1
    want = sync.pull(state, sent.where("seq <= 8"), "near", 5000)
    for t in sync.TABLES:
        assert same(v.table(t, 1), want.tables[t]), t
    assert same(v.table("shadow", 1), want.shadow) and same(v.table("conflicts", 1), want.conflicts) and same(v.table("cursor", 1), want.cursor)
    assert same(v.table("totals", 1), totals.totals(v.table("transactions", 1)))
    # The rest, and that micro-batch once more.
    s.append(sent.where("seq > 8"), NOW)
    assert pull.follow(s, v, checkpoint, "near", 6000) == 2
    names = [*sync.TABLES, *pull.OTHERS, "totals"]
    first = {t: sorted(map(str, v.table(t, 2).collect())) for t in names}
    pull.step(v, replication.opened(s.files().where("device_id = 'far' and seq > 8").select("device_id", "seq", "envelope"), KEY), "near", 6000, 2)
    assert first == {t: sorted(map(str, v.table(t, 2).collect())) for t in names}
    assert same(v.table("totals", 2), totals.totals(v.table("transactions", 2)))
    assert pull.follow(s, v, checkpoint, "near", 7000) == 2  # nothing new


def test_a_small_batch_writes_little(spark, s):
    L = ledger.load(spark, SF)
    state = device.state(L)
    v = Versions(spark, f"{s.root}/tables", 64)
    pull.start(v, state)
    sizes = pull.step(v, device.sent(L).where("row_id = '40'"), "near", 5000, 1)
    whole = sum(f.getLen() for f in _files(spark, f"{v.root}/data/transactions/0"))
    assert 0 < sizes["transactions"] < whole / 20 and len(v.manifest(1)["transactions"]["buckets"]) == len(v.manifest(0)["transactions"]["buckets"])


def _files(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    while found.hasNext():
        yield found.next()


# Observed results


def test_only_what_changes_is_emitted(spark):
    root = f"file://{tempfile.mkdtemp()}"
    schema = spark.createDataFrame([], OPS).schema
    put = lambda n, *rs: spark.createDataFrame([(d, 1, v, t, i, r, 0, p) for d, v, t, i, r, p in rs], OPS).coalesce(1).write.parquet(f"{root}/log/{n}") or f"{root}/log/{n}"
    go = lambda: observed.follow(spark, f"{root}/log/*", f"{root}/feed", f"{root}/offsets", schema)
    feed = lambda n: sorted((r.row_id, r.remote_revision, r.before, r.payload) for r in spark.read.parquet(f"{root}/feed/{n}").collect())
    put(0, ("a", 1, "budgets", "x", 1, "A"), ("a", 1, "budgets", "y", 1, "B"), ("a", 1, "budgets", "x", 2, "C"), ("a", 2, "budgets", "w", 9, "future"), ("a", 1, "unknown", "v", 9, "?"))
    assert go() == [0] and feed(0) == [("x", 2, None, "C"), ("y", 1, None, "B")]
    # An older one, one that says the same, an equal revision of a smaller device, a deletion.
    put(1, ("a", 1, "budgets", "x", 1, "old"), ("a", 1, "budgets", "y", 5, "B"))
    assert go()[-1] == 1 and feed(1) == []
    put(2, ("0", 1, "budgets", "x", 2, "D"), ("b", 1, "budgets", "x", 2, "E"), ("a", 1, "budgets", "y", 6, None))
    assert go()[-1] == 2 and feed(2) == [("x", 2, "C", "D"), ("y", 6, "B", None)]
    shown = observed.shown(spark, f"{root}/feed", [0, 1, 2]).collect()
    assert [tuple(r) for r in shown] == [("budgets", "x", 2, "D")]
    assert observed.shown(spark, f"{root}/feed", []).count() == 0


def test_bytes_follow_the_batch(spark):
    """After a large first batch a small one writes little, to the feed and to the state."""
    root = f"file://{tempfile.mkdtemp()}"
    L = ledger.load(spark, SF)
    schema = L.ops.schema
    L.ops.unionByName(L.tx.select(F.lit("dev-9").alias("device_id"), F.lit(1).cast("long").alias("seq"), F.lit(1).alias("version"), F.lit("transactions").alias("table_name"), "id", F.lit(1).cast("long"), F.lit(0).cast("long"), F.repeat(F.col("content_hash"), 20)).toDF(*L.ops.columns)).write.parquet(f"{root}/log")
    observed.follow(spark, f"{root}/log", f"{root}/feed", f"{root}/offsets", schema)
    size = lambda path: sum(f.getLen() for f in _files(spark, path))
    whole, state = size(f"{root}/feed/0"), size(f"{root}/offsets/state")
    L.ops.limit(1).withColumns({"row_id": F.lit("one"), "version": F.lit(1)}).write.mode("append").parquet(f"{root}/log")
    assert observed.follow(spark, f"{root}/log", f"{root}/feed", f"{root}/offsets", schema) == [1]
    assert size(f"{root}/feed/1") < whole / 10 and size(f"{root}/offsets/state") - state < state / 2


# Totals


def test_totals_follow_random_changes(spark):
    L = ledger.load(spark, SF)
    tx = spark.createDataFrame(L.tx.collect(), L.tx.schema)
    held = totals.totals(tx)
    for seed in (1, 2, 3):
        hit = F.xxhash64("id", F.lit(seed)) % 10
        changed = tx.where(hit == 0)
        after = changed.withColumns({
            "amount_minor": F.when(hit == 0, F.col("amount_minor") * (1 - 2 * (F.xxhash64("id") % 2).cast("int"))), "category_id": F.when(F.xxhash64("id", F.lit(seed + 9)) % 3 == 0, F.lit(None)).otherwise(F.col("category_id")),
            "date": F.when(F.xxhash64("id") % 4 == 0, F.lit("1996-03-15")).otherwise(F.col("date")), "deleted_at": F.when(F.xxhash64("id") % 5 == 0, F.lit(1).cast("long")).otherwise(F.col("deleted_at")),
        })
        change = totals.delta(changed, after)
        assert change.count() <= 2 * changed.count()
        held = spark.createDataFrame(totals.applied(held, change).collect(), held.schema)
        tx = spark.createDataFrame(tx.join(changed.select("id"), "id", "left_anti").select(*tx.columns).unionByName(after.select(*tx.columns)).collect(), tx.schema)
        assert same(held, totals.totals(tx))
        month = "1996-03"
        from tallywake.functions import months

        assert same(totals.breakdown(held, L.categories, month), spend.breakdown(tx, L.categories, months.window(month)))
        assert same(totals.monthly_spend(held), spend.monthly_spend(tx)) and same(totals.budgets_with_spend(held, L.budgets, month), spend.budgets_with_spend(tx, L.budgets, month))
    assert totals.delta(tx, tx).count() == 0


# Conflicts put back, and payloads


def test_conflicts_of_one_field_are_put_back_one_after_the_other(spark):
    L = ledger.load(spark, SF)
    tx = L.tx.where("id in ('1', '2', '3')").withColumns({"notes": F.lit("c"), "amount_minor": F.lit(5).cast("long"), "deleted_at": F.when(F.col("id") == "3", F.lit(1).cast("long"))})
    held = [("n1", "1", "notes", 30, '"c"', '"b"', None), ("n2", "1", "notes", 20, '"b"', '"a"', 7), ("n3", "1", "notes", 10, '"x"', '"y"', None), ("m1", "1", "amount_minor", 5, "5", "6", None), ("g", "3", "notes", 1, '"c"', '"b"', None), ("l", "0", "notes", 1, '"c"', '"b"', None), ("o", "2", "notes", 1, '"old"', '"b"', None), ("u", "2", "no_such", 1, '"old"', '"b"', None)]
    conflicts = spark.createDataFrame([(i, "transactions", r, f, at, c, d, "reason", seen) for i, r, f, at, c, d, seen in held], L.conflicts.schema)
    none = {"categories": L.categories.limit(0), "budgets": L.budgets.limit(0), "category_rules": L.rules.limit(0)}
    state = sync.State({"transactions": tx, **none}, L.shadow.limit(0), conflicts, spark.createDataFrame([], "device_id string, seq long"))
    ids = spark.createDataFrame([(h[0],) for h in held] + [("none",), ("n1",)], "id string")
    out, outcomes = sync.restored(state, ids, 5000)
    assert {r.id: r.outcome for r in outcomes.collect()} == {"n1": "RESTORED", "n2": "RESTORED", "n3": "VALUE_CHANGED_SINCE", "m1": "RESTORED", "g": "ROW_GONE", "l": "ROW_GONE", "o": "VALUE_CHANGED_SINCE", "u": "VALUE_CHANGED_SINCE", "none": "NOT_FOUND"}
    before = {r.id: r.local_revision for r in tx.collect()}
    after = {r.id: (r.notes, r.amount_minor, r.local_revision - before[r.id]) for r in out.tables["transactions"].collect()}
    assert after == {"1": ("a", 6, 3), "2": ("c", 5, 0), "3": ("c", 5, 0)}
    assert {r.id: r.acknowledged_at for r in out.conflicts.collect()} == {"n1": 5000, "n2": 7, "n3": None, "m1": 5000, "g": None, "l": None, "o": None, "u": None}


def test_a_patch_keeps_the_kind_of_every_value(spark):
    df = spark.createDataFrame([('{"amount_minor":5,"locked":true,"x":null,"o":{"b":[1,2.5]},"t":"5"}',), ('{}',), (None,)], "j string")
    got = [r[0] for r in df.select(replication.patch(F.col("j"), "notes", F.lit('"n"'))).collect()]
    assert got == ['{"amount_minor":5,"locked":true,"x":null,"o":{"b":[1,2.5]},"t":"5","notes":"n"}', '{"notes":"n"}', None]
    for value in ("7", "true", "null", '"a\\"b"', "[1]"):
        assert json.loads(df.select(replication.patch(F.col("j"), "locked", F.lit(value))).first()[0]) == {"amount_minor": 5, "locked": json.loads(value), "x": None, "o": {"b": [1, 2.5]}, "t": "5"}


def test_a_stream_reads_packs_as_it_reads_folders(spark, s, monkeypatch):
    monkeypatch.setattr(store, "PACKED", 3)
    L = ledger.load(spark, SF)
    state, sent = device.state(L), device.sent(L)
    assert sent.select("seq").distinct().count() > store.PACKED
    v = Versions(spark, f"{s.root}/tables", 4)
    pull.start(v, state)
    s.append(sent, NOW)
    assert len(s.names("packs")) == 1
    assert pull.follow(s, v, f"{s.root}/offsets", "near", 5000) == 1
    want = sync.pull(state, sent, "near", 5000)
    for t, df in {"transactions": want.tables["transactions"], "cursor": want.cursor, "totals": totals.totals(want.tables["transactions"])}.items():
        assert same(v.table(t, 1), df), t
