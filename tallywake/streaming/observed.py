"""Observed results: a stream that keeps the newest operation of each row as state and
emits a row only when what it shows has changed, with its images before and after.

State is Spark's, by row and checkpointed as changes, and the feed is a folder for each
micro-batch, so that what a batch writes follows the batch and not the snapshot. A
micro-batch that runs again writes its own folder again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import work_dir
from . import replication

KEY = ["table_name", "row_id"]
SHOWN = "table_name string, row_id string, remote_revision bigint, before string, payload string"
HELD = "remote_revision bigint, device_id string, payload string"


def newest_of(key, frames, state):
    """One row's part of a micro-batch: the newest of its operations and of what is
    held. Of equal revisions the smaller device decides."""
    held = state.get if state.exists else None
    best = held
    for pdf in frames:
        for revision, device, payload in zip(pdf["remote_revision"], pdf["device_id"], pdf["payload"]):
            one = (int(revision), device, None if pd.isna(payload) else payload)
            if best is None or one[0] > best[0] or (one[0] == best[0] and one[1] < best[1]):
                best = one
    if best is not None and best != held:
        state.update(best)
        before = held[2] if held else None
        if before != best[2]:  # else a newer revision that says the same
            yield pd.DataFrame({"table_name": [key[0]], "row_id": [key[1]], "remote_revision": [best[0]], "before": pd.Series([before], dtype=object), "payload": pd.Series([best[2]], dtype=object)})


def changes(ops: DataFrame) -> DataFrame:
    """A stream of operations as a stream of changes of what rows show."""
    known = replication.readable(ops).where(F.col("table_name").isin(*replication.STEPS)).select(*KEY, "remote_revision", "device_id", "payload")
    return known.groupBy(*KEY).applyInPandasWithState(newest_of, SHOWN, HELD, "update", "NoTimeout")


def follow(spark: SparkSession, log_dir: str, feed: str, checkpoint: str, schema, files: int | None = None) -> list[int]:
    """Writes the changes of every new file of a log to ``feed/<micro-batch>`` and ends
    when there is none; ``files`` is how many make a micro-batch. Returns the numbers of
    the micro-batches that ran."""
    ran: list[int] = []

    def put(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{feed}/{number}")
        ran.append(number)

    log = spark.readStream.schema(schema)
    log = (log.option("maxFilesPerTrigger", files) if files else log).parquet(log_dir)
    run = changes(log).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    return ran


def shown(spark: SparkSession, feed: str, numbers: list[int]) -> DataFrame:
    """What is live after micro-batches of a feed: the last change of each row."""
    if not numbers:
        return spark.createDataFrame([], SHOWN).drop("before")
    rows = spark.read.schema(f"{SHOWN}, batch bigint").parquet(*(f"{feed}/{n}" for n in numbers))
    last = F.max_by(F.struct("remote_revision", "payload"), "batch")
    return rows.groupBy(*KEY).agg(last.alias("x")).select(*KEY, "x.*").where("payload is not null")


def once(ops: DataFrame) -> DataFrame:
    """The log as a stream of some micro-batches: what is live after them."""
    spark = ops.sparkSession
    root = work_dir(spark, "observed")
    ops.write.parquet(f"{root}/log")
    return shown(spark, f"{root}/feed", follow(spark, f"{root}/log", f"{root}/feed", f"{root}/offsets", ops.schema))
