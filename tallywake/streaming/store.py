"""Replication through files: an operation log, snapshots and claims in a shared folder.

The log has a folder for each batch, ``ops/device_id=.../seq=...``, so that what a
cursor has passed is pruned before any file is opened; a batch that is written again
takes its own folder's place. It is one line of JSON: a time and an envelope; a line
that is cut short is an error. Very many batches that are appended at once lie in
packs instead, as a folder for each costs more than what is in it: a folder for each
device and time, whose ``seq`` is negative and made of the batches that it holds, and
whose lines say their own number. All batches of a pack have one time, so that they
are old, folded and deleted together. A snapshot is a folder of its own, and it is there once
its manifest is. Manifests, reserved numbers and claims are empty files whose names
say all; each is created at once or not at all. Rows are read, folded and written by
Spark; only names of such small files, and a cursor's row for each device, are on the
driver. Any file system that Hadoop knows will do.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from . import replication

#: Files of a round at least, their age at least, the wait between claim and reading.
THRESHOLD, GRACE_MS, WAIT_S = 50, 3_600_000, 30
#: After so long without a snapshot another device may take over.
STALE_MS = 90 * 86_400_000
#: Batches that are deleted by a number of threads, and held by name, at once.
THREADS, AT_ONCE = 16, 4096
#: An append of more batches than this writes packs; batches to a file of a pack.
PACKED, PER_FILE = 1000, 1000
LOG = "created_at bigint, envelope binary, device_id string, seq bigint"
#: As it lies there; ``number`` is in packs only.
STORED = "created_at bigint, envelope binary, number bigint, device_id string, seq bigint"
HORIZON = "device_id string, horizon bigint"
FOLDED = "device_id string, seq bigint"


def numbered(stored: DataFrame) -> DataFrame:
    """Lines of ``STORED`` as batches, with ``pack`` where they lie in one."""
    pack = F.when(F.col("seq") < 0, F.col("seq")).alias("pack")
    return stored.select("created_at", "envelope", "device_id", F.coalesce("number", "seq").alias("seq"), pack)


@dataclass
class Store:
    """A shared folder, and the key of its envelopes."""

    spark: SparkSession
    root: str
    key: bytes

    # Small files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(f"{self.root}/{path}")
        return fs.exists(p)

    def remove(self, path: str) -> None:
        fs, p = self._fs(f"{self.root}/{path}")
        fs.delete(p, True)

    def names(self, folder: str) -> list[list[str]]:
        """What the names of a folder's files say, part by part."""
        fs, p = self._fs(f"{self.root}/{folder}")
        if not fs.exists(p):
            return []
        return sorted([unquote(x) for x in f.getPath().getName().split("~")] for f in fs.listStatus(p) if not f.getPath().getName().startswith("."))

    def put(self, folder: str, *parts: object) -> bool:
        """Creates a file whose name says ``parts``; False if it is there already."""
        fs, p = self._fs(f"{self.root}/{folder}/{self._name(*parts)}")
        return fs.createNewFile(p)

    def drop(self, folder: str, *parts: object) -> None:
        self.remove(f"{folder}/{self._name(*parts)}")

    @staticmethod
    def _name(*parts: object) -> str:
        return "~".join(quote(str(x), safe="") for x in parts)

    # The log

    def reserve(self, device: str) -> int:
        """The device's next number, taken for good before anything is written, so
        that a crash never uses one twice."""
        mine = [int(n) for d, n in self.names("seq") if d == device]
        n = max(mine, default=0) + 1
        while not self.put("seq", device, n):
            n += 1
        for old in mine:
            self.drop("seq", device, old)
        return n

    def append(self, ops: DataFrame, created_at: Column | int) -> None:
        """Seals every batch (device_id, seq) of ``ops`` into a folder of its own, or very
        many into packs. A task, a job or an append that runs again replaces what it wrote."""
        at = created_at if isinstance(created_at, Column) else F.lit(created_at)
        at = at.cast("bigint")
        rows = replication.sealed(ops, self.key).withColumn("created_at", at)
        mine = ops.select("device_id", "seq").distinct()
        many = mine.limit(PACKED + 1).count() > PACKED
        held = self.exists("ops") and (many or bool(self.names("packs")))
        written = self._write_packs(rows, mine.withColumn("created_at", at)) if many else self._write_folders(rows)
        if held:
            # Elsewhere they lie no more, once they are written here.
            self._drop_elsewhere(mine, written, folders=many)

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("device_id", "seq").json(f"{self.root}/ops")

    def _tasks(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _write_folders(self, rows: DataFrame) -> list[tuple[str, int]]:
        # Dealt out by a number of partitions: the work is folders and not bytes.
        self._write(rows.repartition(self._tasks(), "device_id", "seq").select("created_at", "envelope", "device_id", "seq"))
        return []

    def _write_packs(self, rows: DataFrame, batches: DataFrame) -> list[tuple[str, int]]:
        """Writes ``rows`` of ``batches(device_id, seq, created_at)`` as packs, and returns
        these. A row for each device and time comes to the driver."""
        by = batches.groupBy("device_id", "created_at").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("seq")).alias("x"))
        name = -F.shiftrightunsigned(F.xxhash64("device_id", "created_at", "n", "x"), 2) - 1
        packs = cut(by.select(F.col("device_id").alias("_d"), F.col("created_at").alias("_t"), name.alias("pack"), F.ceil(F.col("n") / PER_FILE).alias("files")))
        names = [(r["_d"], r["pack"]) for r in packs.select("_d", "pack").collect()]
        for x in names:
            self.put("packs", *x)
        at = rows.join(packs, F.col("device_id").eqNullSafe(F.col("_d")) & F.col("created_at").eqNullSafe(F.col("_t")))
        dealt = at.repartition(self._tasks(), "device_id", "pack", F.pmod(F.xxhash64("seq"), F.col("files")))
        self._write(dealt.select("created_at", "envelope", F.col("seq").alias("number"), "device_id", F.col("pack").alias("seq")))
        return names

    def _drop_elsewhere(self, batches: DataFrame, written: list[tuple[str, int]], folders: bool) -> None:
        """Takes batches out of all packs but ``written``, and of folders of their own."""
        new = self.spark.createDataFrame(written, "device_id string, pack bigint")
        log = self._log()
        if not folders:
            log = log.where("pack is not null")
        log = log.join(new, ["device_id", "pack"], "left_anti")
        again = cut(log.select("device_id", "seq", "pack").join(batches, ["device_id", "seq"], "left_semi"))
        for d, pack in [tuple(r) for r in again.where("pack is not null").select("device_id", "pack").distinct().collect()]:
            # What else is in the pack is packed again.
            rest = log.where((F.col("device_id") == d) & (F.col("pack") == pack)).join(batches, ["device_id", "seq"], "left_anti").select("created_at", "envelope", "device_id", "seq")
            rest = cut(rest)
            self._write_packs(rest, rest.select("device_id", "seq", "created_at"))
            self._remove_pack(d, pack)
        self._delete(again.where("pack is null"))

    def _remove_pack(self, device: str, pack: int) -> None:
        self.remove(f"ops/device_id={self._partition(device)}/seq={pack}")
        self.drop("packs", device, pack)

    def push(self, ops: DataFrame, device: str, now: int, seq: int | None = None) -> int | None:
        """Writes one batch of the device and returns its number; nothing, if there is
        nothing to send. A retry gives the number that it had."""
        ops = cut(ops)
        if ops.isEmpty():
            return None
        seq = self.reserve(device) if seq is None else seq
        self.append(ops.withColumns({"device_id": F.lit(device), "seq": F.lit(seq).cast("bigint")}), now)
        return seq

    def _log(self) -> DataFrame:
        """``numbered`` of all batches."""
        return numbered(self._stored())

    def _stored(self) -> DataFrame:
        if not self.exists("ops"):
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).option("mode", "FAILFAST").json(f"{self.root}/ops")

    def files(self) -> DataFrame:
        """created_at, envelope, device_id, seq of every batch."""
        return self._log().drop("pack")

    def after(self, cursor: DataFrame) -> DataFrame:
        """Operations of the batches that ``cursor(device_id, seq)`` has not reached.
        The cursor, a row for each device, becomes a literal of the filter, so that
        folders are pruned when the scan is planned; packs are read and not opened."""
        seen = {r["device_id"]: r["seq"] for r in cursor.collect()}
        new = F.col("seq") > 0
        if seen:
            at = F.create_map(*(F.lit(x) for pair in sorted(seen.items()) for x in pair))
            new = F.col("seq") > F.coalesce(F.try_element_at(at, F.col("device_id")), F.lit(0))
        return replication.opened(numbered(self._stored().where((F.col("seq") < 0) | new)).where(new), self.key)

    # Snapshots

    def write_snapshot(self, n: int, rows: DataFrame, horizon: DataFrame, folded: DataFrame) -> None:
        """The files of snapshot ``n``; nobody reads them before they are published.
        Each row is an envelope, so that no task holds more than its batch of rows."""
        sealed = rows.select(replication.seal(F.to_json(F.struct("table_name", "row_id", "remote_revision", "updated_at", "payload")), self.key).alias("envelope"))
        for name, df in (("rows", sealed), ("horizon", horizon.select("device_id", "horizon")), ("folded", folded.select("device_id", "seq"))):
            df.write.mode("overwrite").parquet(f"{self.root}/snapshots/{n}/{name}")

    def publish(self, n: int, now: int) -> bool:
        return self.put("manifests", n, now)

    def snapshots(self) -> list[tuple[int, int]]:
        """Number and time of what is published, newest last."""
        return sorted((int(n), int(at)) for n, at in self.names("manifests"))

    def _part(self, n: int | None, name: str, schema: str) -> DataFrame:
        if n is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/snapshots/{n}/{name}")

    def latest(self) -> int | None:
        return self.snapshots()[-1][0] if self.snapshots() else None

    def snapshot(self, n: int | None = None) -> DataFrame:
        """The rows of a published snapshot, of the newest by default; none, if there
        is none yet."""
        rows = self._part(self.latest() if n is None else n, "rows", "envelope binary")
        whole = F.from_json(replication.unseal(F.col("envelope"), self.key), replication.ROW)
        return rows.select(whole.alias("x")).select("x.*")

    def horizon(self) -> DataFrame:
        return self._part(self.latest(), "horizon", HORIZON)

    # The owner

    def claims(self) -> list[tuple[str, int]]:
        return sorted((d, int(at)) for at, d in self.names("claims"))

    def owner(self) -> str | None:
        return min((d for d, _ in self.claims()), default=None)

    def _resolved(self) -> str | None:
        """The owner; the claims of all others are deleted."""
        owner = self.owner()
        for d, at in self.claims():
            if d != owner:
                self.drop("claims", at, d)
        return owner

    def _claim(self, device: str, now: int, wait: float) -> bool:
        self.put("claims", now, device)
        time.sleep(wait)
        return self._resolved() == device

    def elect(self, device: str, now: int, wait: float = WAIT_S) -> bool:
        """Whether the device compacts. The first claims, waits and reads again; once
        there is an owner nothing is written."""
        return self._resolved() == device if self.claims() else self._claim(device, now, wait)

    def take_over(self, device: str, now: int, wait: float = WAIT_S) -> bool:
        for d, at in self.claims():
            self.drop("claims", at, d)
        return self._claim(device, now, wait)

    def is_stale(self, now: int) -> bool:
        frame = lambda rows, schema: self.spark.createDataFrame(rows, schema)
        one = stale(frame(self.claims(), "device_id string, claimed_at bigint"), frame(self.snapshots(), "n bigint, created_at bigint"), self.files().select("device_id", "seq"), now).first()
        return bool(one and one["stale"])

    # Compaction

    def compact(self, device: str, now: int, threshold: int = THRESHOLD, grace: int = GRACE_MS) -> int | None:
        """Folds the batches past the grace time onto the newest snapshot, publishes
        the next one, and then deletes exactly those batches. Returns its number.

        Nothing happens if the device does not own the log or too few batches are old
        enough; if it lost the log meanwhile, nothing is deleted. A snapshot lists what
        it folded: batches that a crash left undeleted are deleted by the next round
        and are not folded again, as an old operation would bring a row back that
        a deletion, folded and forgotten, has taken.
        """
        if self.owner() != device:
            return None
        before = self.latest()
        # Read once: some hundreds of rows to an envelope.
        old = cut(self._log().where(F.col("created_at") <= now - grace))
        done = self._part(before, "folded", FOLDED)
        left = old.select("device_id", "seq", "pack").join(done, ["device_id", "seq"], "left_semi")
        fresh = old.join(done, ["device_id", "seq"], "left_anti")
        new = fresh.select("device_id", "seq", "pack")
        n = None
        if new.count() >= threshold:
            ops = replication.opened(fresh, self.key)
            rows = self.snapshot(before).withColumns({"device_id": F.lit(""), "seq": F.lit(0).cast("bigint"), "version": F.lit(replication.FORMAT)}) if before is not None else None
            reached = self._part(before, "horizon", HORIZON).unionByName(new.select("device_id", F.col("seq").alias("horizon"))).groupBy("device_id").agg(F.max("horizon").alias("horizon"))
            # Also after what was written and never published.
            n = max([0, *(int(x[0]) for x in self.names("snapshots")), *(x[0] for x in self.snapshots())]) + 1
            # Also what an earlier crash left, as it may be left once more.
            self.write_snapshot(n, replication.compact(ops, rows), reached, new.unionByName(left))
            self.publish(n, now)
            if self.owner() != device:
                return n
            left = left.unionByName(new)
        self._delete(left.where("pack is null"))
        # A pack goes once all of it is folded: all there is of it is as old.
        whole = lambda df, c: df.where("pack is not null").groupBy("device_id", "pack").agg(F.count("*").alias(c))
        for r in whole(left, "n").join(whole(old, "m"), ["device_id", "pack"]).where("n = m").collect():
            self._remove_pack(r["device_id"], r["pack"])
        return n

    def _delete(self, batches: DataFrame) -> None:
        """Deletes the folders of batches (device_id, seq), several at a time, as each is a
        few calls that wait; no more than ``AT_ONCE`` of their names are held."""
        with ThreadPoolExecutor(THREADS) as pool:
            rows = batches.select("device_id", "seq").toLocalIterator()
            while some := [f"ops/device_id={self._partition(r['device_id'])}/seq={r['seq']}" for r in islice(rows, AT_ONCE)]:
                list(pool.map(self.remove, some))

    def _partition(self, device: str) -> str:
        """A device as Spark writes it into a folder's name."""
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(device)


def stale(claims: DataFrame, snapshots: DataFrame, files: DataFrame, now: int, by: list[str] | None = None) -> DataFrame:
    """Whether a claimed log has been left alone, for each account of ``by``: its
    newest snapshot is older than the horizon, or, without one, its newest claim is
    and there is a round's worth of batches."""
    by = by or []
    group = lambda df, x: df.groupBy(*by).agg(x)
    out = group(claims, F.max("claimed_at").alias("_claim"))
    for part in (group(snapshots, F.max("created_at").alias("_snapshot")), group(files, F.count("*").alias("_files"))):
        out = out.join(part, by, "left") if by else out.join(part, F.lit(True))  # one row on either side
    verdict = F.when(F.col("_snapshot").isNotNull(), now - F.col("_snapshot") > STALE_MS).otherwise((now - F.col("_claim") > STALE_MS) & (F.coalesce("_files", F.lit(0)) >= THRESHOLD))
    return out.select(*by, F.coalesce(verdict & F.col("_claim").isNotNull(), F.lit(False)).alias("stale"))


def elected(claims: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The owner among the claims ``(device_id, claimed_at)`` of an account."""
    return claims.groupBy(*(by or [])).agg(F.min("device_id").alias("owner"))


def taken_over(claims: DataFrame, contenders: DataFrame, by: list[str]) -> DataFrame:
    """The claims after devices have taken over: in their accounts all others' are
    gone, and of several contenders the smallest device's stays."""
    new = contenders.groupBy(*by).agg(F.min_by(F.struct("device_id", "claimed_at"), F.struct("device_id", "claimed_at")).alias("x")).select(*by, "x.*")
    return claims.join(new.select(*by), by, "left_anti").select(*by, "device_id", "claimed_at").unionByName(new)
