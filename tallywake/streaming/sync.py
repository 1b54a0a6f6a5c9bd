"""What a device does with the operations of others: merge, write, remember.

All four tables travel as payloads (JSON objects of the fields in ``SYNCED``; null is
a tombstone). Applying is a change of tables: the newest operation of each row that
the shadow has not seen is merged with the stored row over the last agreed payload;
rows, shadow and conflicts after it are returned as frames. A cycle is pull (or
reconcile, behind the horizon), push, acknowledge and reap.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity
from ..lineage import cut
from ..operators import dml, joins, merge
from ..operators.merge import SYNCED
from . import replication

#: Fields that are not texts.
TYPES = {"amount_minor": "bigint", "category_locked_by_user": "boolean", "color_argb": "int", "is_system_defined": "boolean", "limit_minor": "bigint", "priority": "int"}
#: Parents first; rows are reaped and missed the other way round.
TABLES = tuple(sorted(replication.STEPS, key=replication.STEPS.get))
#: The device of what comes from a snapshot, which has no single author.
SNAPSHOT = "sync-snapshot"
KEY = ["table_name", "row_id"]


@dataclass
class State:
    """A device's tables by name, its shadow, conflicts and cursor."""

    tables: dict[str, DataFrame]
    shadow: DataFrame
    conflicts: DataFrame
    cursor: DataFrame


def schema_of(table: str) -> str:
    return ", ".join(f"{f} {TYPES.get(f, 'string')}" for f in SYNCED[table])


def json_text(value: Column) -> Column:
    """A value as JSON text; null as ``null``."""
    inside = F.to_json(F.array(value))
    return F.substring(inside, 2, F.length(inside) - 2)


#: What JSON writes in another way than it is.
ESCAPED = r'["\\\x00-\x1f\x7f]'


def field_texts(values: Column, odd: Column, table: str) -> dict[str, Column]:
    """``json_text`` of each field of a struct. Numbers and truths are their own texts,
    and texts are quoted as they are unless ``odd``: some text has ``ESCAPED`` in it."""
    quoted = lambda v: F.when(v.isNull(), "null").when(odd, json_text(v)).otherwise(F.concat(F.lit('"'), v, F.lit('"')))
    return {f: F.coalesce(values[f].cast("string"), F.lit("null")) if f in TYPES else quoted(values[f]) for f in SYNCED[table]}


def object_of(fields: dict[str, Column]) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{f}":'), v) for f, v in fields.items())), F.lit("}"))


def resolve(sides: DataFrame, table: str) -> DataFrame:
    """``sides`` with ``merged`` (a payload, null for a tombstone) and ``found``, the
    fields that were settled: array of (field, chosen, discarded, reason).

    ``sides`` has local (a struct of the fields, or null), remote and base (payloads or
    null), local_at, remote_at, local_device and remote_device. An edit beats a deletion
    unless it is none, or a rule's guess at the category; that is not recorded.
    """
    names = SYNCED[table]
    # Payloads are parsed once, into columns of their own: in the expression of each
    # field they would be parsed for each field.
    keys_of = lambda s: F.map_keys(F.from_json(s, "map<string,string>"))
    sides = sides.withColumns({"has_base": F.col("base").isNotNull(), "local__values": F.col("local"), "base__keys": keys_of("base"), **{f"{s}__values": F.from_json(s, schema_of(table)) for s in ("remote", "base")}})
    texts = [f for f in names if f not in TYPES]
    sides = sides.withColumns({f"{s}__odd": F.concat_ws("", *(F.col(f"{s}__values")[f] for f in texts)).rlike(ESCAPED) for s in ("local", "remote", "base")})
    parsed = {s: field_texts(F.col(f"{s}__values"), F.col(f"{s}__odd"), table) for s in ("local", "remote", "base")}
    # A side's field that is not there is null; a base's is different from any value.
    parsed["base"] = {f: F.when(F.array_contains("base__keys", f), v) for f, v in parsed["base"].items()}
    sides = sides.withColumns({f"{s}_{f}": v for s in parsed for f, v in parsed[s].items()})
    side = {s: {f: F.col(f"{s}_{f}") for f in names} for s in parsed}
    has = F.col("has_base")
    outcome = {f: merge.field(side["local"][f], side["remote"][f], side["base"][f], has, merge.policy(table, f)) for f in names}
    if table == "transactions":
        category, lock = merge.LOCK_PAIR
        truth = lambda s: side[s][lock] == "true"
        pair = merge.category_pair(side["local"][category], truth("local"), side["remote"][category], truth("remote"), side["base"][category], truth("base"), has)
        outcome[category] = F.struct(pair["value"].alias("value"), pair["discarded"].alias("discarded"), pair["reason"].alias("reason"))
        outcome[lock] = merge.outcome(F.when(pair["locked"], "true").otherwise("false"))
    sides = sides.withColumns({f"out_{f}": v for f, v in outcome.items()})
    stands = {s: merge.delete_beats_edit(side[s], side["base"], has) for s in ("local", "remote")}
    gone = {s: F.col(s).isNull() for s in ("local", "remote")}
    merged = (
        F.when(gone["local"] & gone["remote"], None)
        .when(gone["local"], F.when(~stands["remote"], object_of(side["remote"])))
        .when(gone["remote"], F.when(~stands["local"], object_of(side["local"])))
        .otherwise(object_of({f: F.col(f"out_{f}")["value"] for f in names}))
    )
    settled = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"out_{f}")["value"].alias("chosen"), F.col(f"out_{f}")["discarded"].alias("discarded"), F.col(f"out_{f}")["reason"].alias("reason")) for f in names))
    found = F.when(gone["local"] | gone["remote"], F.slice(settled, 1, 0)).otherwise(F.filter(settled, lambda x: x["reason"].isNotNull()))
    kept = [c for c in sides.columns if not c.startswith(("local_", "remote_", "base_", "out_")) or c in ("local_at", "remote_at", "local_device", "remote_device", "remote_revision", "local_revision")]
    # What the other side does not have yet: anything but what it sent. Its keys are
    # counted only where all values are the same.
    whole = F.coalesce(F.size(keys_of("remote")) == len(names), F.lit(False))
    contributed = F.when(gone["remote"], F.col("merged").isNotNull()).when(~F.col("merged").eqNullSafe(object_of(side["remote"])), True).otherwise(~whole)
    return sides.withColumns({"merged": merged, "found": found}).select(*kept, "merged", "found", contributed.alias("contributed"))


def decide(ops: DataFrame, rows: DataFrame, shadow: DataFrame, table: str, device: str) -> DataFrame:
    """One row for each operation of ``table`` that is new here: row_id, stored
    (whether there is a row), merged, found, updated_at, local_revision (not below
    any revision seen, and one more if this side adds something), remote_revision,
    pending_operation."""
    # One join with the shadow, for what was seen and for what was agreed.
    known = shadow.where(F.col("table_name") == table).select("row_id", F.col("remote_revision").alias("_seen"), F.col("payload").alias("base"))
    mine = replication.newest(ops.where(F.col("table_name") == table)).join(known, "row_id", "left").where("remote_revision > coalesce(_seen, 0)")
    own = rows.select(
        F.col("id").alias("row_id"), F.lit(True).alias("stored"), F.when(F.col("deleted_at").isNull(), F.struct(*SYNCED[table])).alias("local"),
        F.col("updated_at").alias("_at"), F.col("local_revision").alias("_revision"),
    )
    sides = mine.join(own, "row_id", "left").select(
        "row_id", F.coalesce("stored", F.lit(False)).alias("stored"), "local", F.col("payload").alias("remote"), "base", F.coalesce("_at", F.lit(0)).alias("local_at"), F.col("updated_at").alias("remote_at"),
        F.lit(device).alias("local_device"), F.col("device_id").alias("remote_device"), F.col("remote_revision"), F.coalesce("_revision", F.lit(0)).alias("local_revision"),
    )
    out = resolve(sides, table)
    return out.select(
        "row_id", "stored", "merged", "found", F.greatest("local_at", "remote_at").alias("updated_at"),
        (F.greatest("local_revision", "remote_revision") + F.col("contributed").cast("int")).alias("local_revision"), "remote_revision",
        F.when(F.col("contributed"), F.when(F.col("merged").isNull(), "DELETE").otherwise("UPSERT")).alias("pending_operation"),
    )


def written(rows: DataFrame, decided: DataFrame, table: str, now: int) -> DataFrame:
    """The table after its decisions: tombstones on rows that are stored, and rows
    with the merged fields, new ones made now."""
    state = {"updated_at", "local_revision", "remote_revision", "pending_operation"}
    d = decided.select(F.col("row_id").alias("_id"), F.col("merged").isNotNull().alias("_live"), F.from_json("merged", schema_of(table)).alias("_x"), "stored", *(F.col(c).alias(f"_{c}") for c in state))
    kept = rows.join(d.where("stored"), F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    values = {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in state}
    values |= {f: F.when(hit & F.col("_live"), F.col("_x")[f]).otherwise(F.col(f)) for f in SYNCED[table]}
    values["deleted_at"] = F.when(hit & ~F.col("_live"), F.lit(now).cast("bigint")).when(~hit, F.col("deleted_at"))
    old = kept.withColumns(values).select(*rows.columns)
    made = {"id": F.col("_id"), "created_at": F.lit(now).cast("bigint"), **{f: F.col("_x")[f] for f in SYNCED[table]}, **{c: F.col(f"_{c}") for c in state}}
    new = d.where("not stored and _live").select(*(made.get(c, F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))
    out = old.unionByName(new)
    if "content_hash" in rows.columns:
        out = out.withColumn("content_hash", identity.content_hash(F.col("account_id"), F.col("date"), F.col("amount_minor"), F.col("description")))
    return out


def agreed(decided: DataFrame, table: str) -> DataFrame:
    """Shadow rows of a merge: what is agreed now, and the revision that said so."""
    return decided.select(F.lit(table).alias("table_name"), "row_id", "remote_revision", F.col("merged").alias("payload"))


def settled(decided: DataFrame, table: str, now: int) -> DataFrame:
    """Conflicts of a merge. Ids are made of table, row, field and revision, so that
    a job that runs again makes the same."""
    each = decided.select("row_id", "remote_revision", F.explode("found").alias("x"))
    return each.select(
        F.concat_ws(":", F.lit(table), "row_id", "x.field", "remote_revision").alias("id"), F.lit(table).alias("table_name"), "row_id", "x.field", F.lit(now).cast("bigint").alias("resolved_at"),
        F.col("x.chosen").alias("chosen_value"), F.col("x.discarded").alias("discarded_value"), "x.reason", F.lit(None).cast("bigint").alias("acknowledged_at"),
    )


def apply(state: State, ops: DataFrame, device: str, now: int) -> State:
    """Every table after the readable operations. Decisions are made once, and rows,
    shadow and conflicts are all written from them."""
    ops, tables = replication.readable(ops), dict(state.tables)
    decided = {t: cut(decide(ops, state.tables[t], state.shadow, t, device)) for t in TABLES}
    for t, d in decided.items():
        tables[t] = written(state.tables[t], d, t, now)
    shadow = dml.upsert(state.shadow, reduce(DataFrame.unionByName, (agreed(d, t) for t, d in decided.items())), KEY)
    conflicts = dml.record_conflicts(state.conflicts, reduce(DataFrame.unionByName, (settled(d, t, now) for t, d in decided.items())))
    return replace(state, tables=tables, shadow=shadow, conflicts=conflicts)


def advanced(cursor: DataFrame, seen: DataFrame) -> DataFrame:
    """The cursor after batches (device_id, seq), of whatever format version."""
    return cursor.select("device_id", "seq").unionByName(seen.select("device_id", "seq")).groupBy("device_id").agg(F.max("seq").alias("seq"))


def pull(state: State, log: DataFrame, device: str, now: int) -> State:
    """What is new in the log, applied; the cursor moves past all of it."""
    new = joins.after_cursor(log, state.cursor)
    return replace(apply(state, new, device, now), cursor=advanced(state.cursor, new))


def missed(rows: DataFrame, snapshot: DataFrame, shadow: DataFrame, table: str) -> DataFrame:
    """id and verdict of stored rows that a snapshot does not have: kept if they were
    never sent or are newer than what was agreed, else deleted."""
    s = shadow.where(F.col("table_name") == table).select(F.col("row_id").alias("_r"), F.col("remote_revision").alias("_seen"))
    gone = joins.missing_from(rows, snapshot.where(F.col("table_name") == table)).join(s, F.col("id") == F.col("_r"), "left")
    return gone.select("id", F.when(F.col("_r").isNull() | (F.col("local_revision") > F.col("_seen")), "keep").otherwise("delete").alias("verdict"))


def forgotten(state: State, ids: DataFrame, table: str, rows_too: bool = True) -> State:
    """Without the rows ``ids(id)`` of a table, their shadow and their conflicts; or
    without their shadow alone. Foreign keys act: budgets and rules of a category go
    with it, transactions lose it."""
    key = ids.select(F.lit(table).alias("table_name"), F.col("id").alias("row_id"))
    out = replace(state, shadow=state.shadow.join(key, KEY, "left_anti").select(*state.shadow.columns))
    if not rows_too:
        return out
    out = replace(out, conflicts=state.conflicts.join(key, KEY, "left_anti").select(*state.conflicts.columns), tables=dict(state.tables))
    if table != "categories":
        out.tables[table] = dml.hard_delete(state.tables[table], ids).select(*state.tables[table].columns)
        return out
    names = ("categories", "transactions", "budgets", "category_rules")
    for n, df in zip(names, dml.drop_categories(*(state.tables[n] for n in names), ids)):
        out.tables[n] = df.select(*state.tables[n].columns)
    return out


def reconcile(state: State, snapshot: DataFrame, device: str, now: int) -> State:
    """The state after a whole snapshot (table_name, row_id, remote_revision,
    updated_at, payload): its rows are applied like operations, and stored rows that
    it lacks are kept as if new or deleted for good, children before categories."""
    as_ops = snapshot.select(*KEY, "remote_revision", "updated_at", "payload").withColumns({"device_id": F.lit(SNAPSHOT), "seq": F.lit(0).cast("bigint"), "version": F.lit(replication.FORMAT)})
    out = apply(state, as_ops, device, now)
    for t in reversed(TABLES):
        rest = cut(missed(out.tables[t], snapshot, out.shadow, t))
        out = forgotten(out, rest.where("verdict = 'keep'"), t, rows_too=False)
        out = forgotten(out, rest.where("verdict = 'delete'"), t)
    return out


def batch(state: State, device: str, seq: int) -> DataFrame:
    """The operations of one push, of all tables, parents first."""
    parts = [replication.batch(state.tables[t], state.shadow, t, device, seq) for t in TABLES]
    return replication.in_order(reduce(DataFrame.unionByName, parts))


def acknowledged(state: State, sent: DataFrame) -> State:
    """The state after a batch has arrived. A row that changed since it was sent
    stays dirty: neither its revision nor its shadow moves."""
    tables, shadow = dict(state.tables), state.shadow
    for t in TABLES:
        mine = sent.where(F.col("table_name") == t)
        acks = mine.select(F.col("row_id").alias("id"), F.col("remote_revision").alias("expected"), "remote_revision")
        marked = dml.mark_synced(state.tables[t], acks)
        same = marked.where("changed").select(F.col("id").alias("row_id"))
        tables[t] = marked.select(*state.tables[t].columns)
        shadow = dml.upsert(shadow, mine.join(same, "row_id", "left_semi").select(*shadow.columns), KEY)
    own = sent.select("device_id", "seq").distinct()
    return replace(state, tables=tables, shadow=shadow, cursor=advanced(state.cursor, own))


def reaped(state: State, cutoff: int) -> State:
    """Without tombstones before the cutoff, children first, with their shadow and
    conflicts, and without conflicts acknowledged before it."""
    out = state
    for t in ("category_rules", "budgets", "transactions", "categories"):
        out = forgotten(out, out.tables[t].where(F.col("deleted_at") < cutoff).select("id"), t)
    return replace(out, conflicts=out.conflicts.where(F.col("acknowledged_at").isNull() | (F.col("acknowledged_at") >= cutoff)))


def cycle(state: State, log: DataFrame, snapshot: DataFrame | None, horizon: DataFrame | None, device: str, seq: int, now: int, cutoff: int) -> tuple[State, DataFrame]:
    """One cycle: (the state after it, the batch that was pushed). ``horizon``
    (device_id, horizon) says what a snapshot holds; behind it the snapshot is
    reconciled first. One row comes to the driver: whether that is so."""
    if snapshot is not None and joins.behind_horizon(horizon, state.cursor).first()["behind"]:
        state = reconcile(state, snapshot, device, now)
        state = replace(state, cursor=advanced(state.cursor, horizon.select("device_id", F.col("horizon").alias("seq"))))
    state = pull(state, log, device, now)
    sent = cut(batch(state, device, seq))
    return reaped(acknowledged(state, sent), cutoff), sent


def outcomes(asked: DataFrame) -> DataFrame:
    """What putting conflicts back does, one after the other, the newest first.

    ``asked`` has a row for each conflict: table_name, row_id, field, id, resolved_at,
    chosen_value, discarded_value, now (the field's JSON text) and gone (the row is).
    Of a field of a row there may be several, as acknowledged ones stay until they
    are purged; a value that one puts back is what the next one finds. Returns
    table_name, row_id, field, value (after all of them), n (how many were put back)
    and done, an array of (id, outcome).
    """
    each = F.struct((-F.col("resolved_at")).alias("age"), "id", "chosen_value", "discarded_value")
    # Conflicts of one field of one row: a short list.
    lists = asked.groupBy("table_name", "row_id", "field").agg(F.sort_array(F.collect_list(each)).alias("list"), F.first("now").alias("now"), F.bool_or("gone").alias("gone"))
    begun = F.struct(F.col("now").alias("value"), F.lit(0).alias("n"), F.array().cast("array<struct<id:string,outcome:string>>").alias("done"))

    def step(a: Column, c: Column) -> Column:
        fits = F.coalesce(~F.col("gone") & (a["value"] == c["chosen_value"]), F.lit(False))
        said = F.when(F.col("gone"), "ROW_GONE").when(fits, "RESTORED").otherwise("VALUE_CHANGED_SINCE")
        return F.struct(F.when(fits, c["discarded_value"]).otherwise(a["value"]).alias("value"), (a["n"] + fits.cast("int")).alias("n"), F.concat(a["done"], F.array(F.struct(c["id"].alias("id"), said.alias("outcome")))).alias("done"))

    return lists.select("table_name", "row_id", "field", F.aggregate("list", begun, step).alias("x")).select("table_name", "row_id", "field", "x.*")


def restored(state: State, ids: DataFrame, now: int) -> tuple[State, DataFrame]:
    """The state after the discarded values of the conflicts ``ids(id)`` are put back,
    and id, outcome: RESTORED, ROW_GONE, VALUE_CHANGED_SINCE (the field is not what
    the conflict chose any more) or NOT_FOUND. What is restored is acknowledged."""
    asked = state.conflicts.join(ids.select("id").distinct(), "id", "left_semi")
    parts = []
    for t in TABLES:
        current = F.create_map(*(x for f in SYNCED[t] for x in (F.lit(f), json_text(F.col(f)))))
        rows = state.tables[t].select(F.col("id").alias("_id"), F.col("deleted_at").isNotNull().alias("_gone"), current.alias("_now"))
        mine = asked.where(F.col("table_name") == t).join(rows, F.col("row_id") == F.col("_id"), "left")
        gone = F.col("_id").isNull() | F.col("_gone")
        parts.append(mine.select("table_name", "row_id", "field", "id", "resolved_at", "chosen_value", "discarded_value", F.try_element_at("_now", "field").alias("now"), gone.alias("gone")))
    fields = cut(outcomes(reduce(DataFrame.unionByName, parts)))
    done = fields.select(F.explode("done").alias("x")).select("x.*")
    tables = dict(state.tables)
    for t in TABLES:
        # A row's fields are few, and each is there once.
        values = F.map_from_entries(F.collect_list(F.struct("field", "value")))
        mine = fields.where((F.col("table_name") == t) & (F.col("n") > 0)).groupBy(F.col("row_id").alias("_id")).agg(values.alias("_old"), F.sum("n").alias("_n"))
        rows = tables[t].join(mine, F.col("id") == F.col("_id"), "left")
        hit = F.col("_id").isNotNull()
        typed = lambda f: F.from_json(F.concat(F.lit('{"v":'), F.try_element_at("_old", F.lit(f)), F.lit("}")), f"v {TYPES.get(f, 'string')}")["v"]
        change = {f: F.when(hit & F.map_contains_key("_old", F.lit(f)), typed(f)).otherwise(F.col(f)) for f in SYNCED[t]}
        change |= {"updated_at": F.when(hit, F.lit(now).cast("bigint")).otherwise(F.col("updated_at")), "local_revision": F.col("local_revision") + F.coalesce("_n", F.lit(0))}
        change["pending_operation"] = F.when(hit, "UPSERT").otherwise(F.col("pending_operation"))
        rows = rows.withColumns(change).select(*state.tables[t].columns)
        if "content_hash" in rows.columns:
            rows = rows.withColumn("content_hash", identity.content_hash(F.col("account_id"), F.col("date"), F.col("amount_minor"), F.col("description")))
        tables[t] = rows
    back = done.where("outcome = 'RESTORED'").select(F.col("id").alias("_c")).distinct()
    seen = state.conflicts.join(back, F.col("id") == F.col("_c"), "left")
    conflicts = seen.withColumn("acknowledged_at", F.when(F.col("_c").isNotNull(), F.coalesce("acknowledged_at", F.lit(now).cast("bigint"))).otherwise(F.col("acknowledged_at"))).select(*state.conflicts.columns)
    missing = ids.select("id").distinct().join(state.conflicts.select("id"), "id", "left_anti").select("id", F.lit("NOT_FOUND").alias("outcome"))
    return replace(state, tables=tables, conflicts=conflicts), done.select("id", "outcome").unionByName(missing)
