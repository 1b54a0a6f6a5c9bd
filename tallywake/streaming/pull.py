"""Pulling as a stream: new batches of the log become the next version of a device's
four tables, shadow, conflicts, cursor and spend totals, published together. So whoever
reads a version finds rows and totals that agree."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import totals
from . import replication, sync
from .store import STORED, Store, numbered
from .versions import Versions

OTHERS = ("shadow", "conflicts", "cursor")


def frames(state: sync.State) -> dict:
    """Every table of a state with the key of its buckets: a row, its shadow and its
    conflicts lie in buckets of one number."""
    out = {t: (df, F.col("id")) for t, df in state.tables.items()}
    return out | {"shadow": (state.shadow, F.col("row_id")), "conflicts": (state.conflicts, F.col("row_id")), "cursor": (state.cursor, F.col("device_id"))}


def start(versions: Versions, state: sync.State) -> None:
    """Version 0: a device's tables as they are."""
    versions.write(0, frames(state) | {"totals": (totals.totals(state.tables["transactions"]), totals.key())})


def state_of(versions: Versions, version: int, touched: dict[str, list[int]] | None = None) -> sync.State:
    part = lambda t: versions.table(t, version, None if touched is None else touched[t])
    return sync.State({t: part(t) for t in sync.TABLES}, *(part(t) for t in OTHERS))


def step(versions: Versions, ops: DataFrame, device: str, now: int, version: int) -> dict[str, int]:
    """Writes ``version`` from the one before it and operations. Only the buckets of
    rows that the operations name are read and written; their numbers, at most as
    many as there are buckets, come to the driver. Deterministic, so that it may
    run twice. Returns the bytes written for each table."""
    ops = cut(ops)
    named = replication.readable(ops).select("table_name", versions.bucket(F.col("row_id")).alias("b")).distinct()
    touched = {t: [] for t in sync.TABLES}
    for r in named.collect():
        if r["table_name"] in touched:
            touched[r["table_name"]].append(r["b"])
    every = sorted({b for bs in touched.values() for b in bs})
    touched |= {"shadow": every, "conflicts": every, "cursor": list(range(versions.buckets))}
    state = state_of(versions, version - 1, touched)
    out = replace(sync.apply(state, ops, device, now), cursor=sync.advanced(state.cursor, ops))
    # Totals follow the rows before and after; only the buckets of those that change
    # are written.
    change = cut(totals.delta(state.tables["transactions"], out.tables["transactions"]))
    touched["totals"] = [r["b"] for r in change.select(versions.bucket(totals.key()).alias("b")).distinct().collect()]
    held = totals.applied(versions.table("totals", version - 1, touched["totals"]), change)
    return versions.write(version, frames(out) | {"totals": (held, totals.key())}, touched, version - 1)


def follow(store: Store, versions: Versions, checkpoint: str, device: str, now: int) -> int:
    """Applies every batch of the log that the checkpoint has not seen, and ends when
    there is none. Returns the newest version. Micro-batch ``k`` writes version
    ``k + 1``, whether it runs once or again. The device's own batches are passed over."""

    def fold(df: DataFrame, number: int) -> None:
        step(versions, replication.opened(numbered(df.where(F.col("device_id") != device)).select("device_id", "seq", "envelope"), store.key), device, now, number + 1)

    log = store.spark.readStream.schema(STORED).option("mode", "FAILFAST").json(f"{store.root}/ops")
    run = log.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    return versions.newest()
