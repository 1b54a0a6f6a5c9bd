"""Replication: the operation log, snapshots, batches and their envelopes."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import dirty
from ..operators.merge import SYNCED

#: Batches of a newer format than this are skipped; their cursor still advances.
FORMAT = 1
PERIOD = "4 hours"
#: Tables in the order in which operations are applied, parents first.
STEPS = {"categories": 0, "transactions": 1, "budgets": 2, "category_rules": 3}
ITERATIONS = 210_000
VERSION = b"\x01"


def readable(ops: DataFrame) -> DataFrame:
    return ops.where(F.col("version") <= FORMAT)


def newest(ops: DataFrame) -> DataFrame:
    """The newest operation of each row. Of equal revisions the smallest device
    decides, whatever the order of the files."""
    known = ops.where(F.col("table_name").isin(*STEPS))
    rest = [c for c in ops.columns if c not in ("table_name", "row_id")]
    first = F.min_by(F.struct(*rest), F.struct(-F.col("remote_revision"), "device_id"))
    return known.groupBy("table_name", "row_id").agg(first.alias("x")).select("table_name", "row_id", "x.*")


def in_order(ops: DataFrame) -> DataFrame:
    step = F.create_map(*(F.lit(x) for pair in STEPS.items() for x in pair))
    return ops.withColumn("step", F.try_element_at(step, F.col("table_name")))


def horizon(ops: DataFrame) -> DataFrame:
    return ops.groupBy("device_id").agg(F.max("seq").alias("horizon"))


def compact(ops: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """The snapshot after folding operations onto it: newest rows, no tombstones.
    A tombstone is dropped last, so an older operation cannot bring a row back."""
    return newest(ops if snapshot is None else snapshot.unionByName(ops)).where("payload is not null")


def not_applied(ops: DataFrame, shadow: DataFrame) -> DataFrame:
    s = shadow.select("table_name", "row_id", F.col("remote_revision").alias("_seen"))
    return ops.join(s, ["table_name", "row_id"], "left").where("remote_revision > coalesce(_seen, 0)").drop("_seen")


def payload(fields: list[str]) -> Column:
    """A row as JSON; null values are kept as keys."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def from_payload(df: DataFrame, schema: str) -> DataFrame:
    return df.select("id", F.from_json("payload", schema).alias("x")).select("id", "x.*")


def patch(json: Column, key: str, value: Column) -> Column:
    """A JSON object with one field set to a JSON text; it keeps its place if it was
    there. All other values stay what they are: numbers, truths, nulls, objects."""
    old, new = F.from_json(json, "map<string,variant>"), F.parse_json(value)
    there = F.transform_values(old, lambda k, v: F.when(k == key, new).otherwise(v))
    return F.to_json(F.when(F.map_contains_key(old, F.lit(key)), there).otherwise(F.map_concat(old, F.create_map(F.lit(key), new))))


def batch(rows: DataFrame, shadow: DataFrame, table: str, device: str, seq: int) -> DataFrame:
    """The operations of one push: dirty rows, tombstones with a null payload."""
    return dirty(rows, shadow, table).select(
        F.lit(device).alias("device_id"), F.lit(seq).alias("seq"), F.lit(FORMAT).alias("version"), F.lit(table).alias("table_name"), F.col("id").alias("row_id"),
        F.col("local_revision").alias("remote_revision"), "updated_at", F.when(F.col("deleted_at").isNull(), payload(SYNCED[table])).alias("payload"),
    )


def derive_key(passphrase: str, salt: bytes) -> bytes:
    """A 256-bit key by PBKDF2 with HMAC-SHA256."""
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, ITERATIONS, 32)


def pairing_code(salt: bytes) -> str:
    return base64.b64encode(salt).decode()


def from_pairing_code(code: str) -> bytes | None:
    try:
        return base64.b64decode(code, validate=True)
    except ValueError:
        return None


def code_of(salt: Column) -> Column:
    """``pairing_code`` of a column."""
    return F.base64(salt)


def salt_of(code: Column) -> Column:
    """``from_pairing_code`` of a column."""
    return F.try_to_binary(code, F.lit("base64"))


def seal(text: Column, key: bytes) -> Column:
    """Version byte, nonce, AES-256-GCM."""
    return F.concat(F.lit(VERSION), F.aes_encrypt(text.cast("binary"), F.lit(key), F.lit("GCM")))


def unseal(envelope: Column, key: bytes) -> Column:
    return F.aes_decrypt(F.substring(envelope, 2, 1 << 30), F.lit(key), F.lit("GCM")).cast("string")


DEMO_KEY = hashlib.sha256(b"a key of the queries' own").digest()
#: What an envelope holds of an operation, and of a row of a snapshot.
ROW = "table_name string, row_id string, remote_revision bigint, updated_at bigint, payload string"
SEALED = f"version int, {ROW}"


def sealed(ops: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """One envelope for each batch (device and number). A batch is what one push
    sends, some hundreds of rows of a table at most."""
    fields = ["table_name", "row_id", "remote_revision", "updated_at", "payload", "version"]
    whole = F.to_json(F.sort_array(F.collect_list(F.struct(*fields))))
    return ops.groupBy("device_id", "seq").agg(whole.alias("_x")).select("device_id", "seq", seal(F.col("_x"), key).alias("envelope"))


def opened(envelopes: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """The operations of envelopes, whole."""
    rows = F.from_json(unseal(F.col("envelope"), key), f"array<struct<{SEALED}>>")
    return envelopes.select("device_id", "seq", F.explode(rows).alias("x")).select("device_id", "seq", "x.*")


def run_outcome(code: int) -> str:
    if code < 300:
        return "success"
    return "retryable" if code == 429 or code >= 500 else "terminal"


def outcome_of(code: Column) -> Column:
    """``run_outcome`` of a column."""
    return F.when(code < 300, "success").when((code == 429) | (code >= 500), "retryable").otherwise("terminal")


class NotConfigured(RuntimeError):
    """Raised by every call of a transport that is not set up."""


def disabled(*_) -> None:
    raise NotConfigured("transport is not configured")


def disabled_message() -> str:
    try:
        disabled()
    except NotConfigured as e:
        return str(e)
    return ""
