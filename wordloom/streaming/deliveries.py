"""Streams of deliveries: let each message through once, and track the receipts of operations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wordloom.functions.text import strip_space
from wordloom.operators.delivery import identifier, instant, plain_hash
from wordloom.session import scratch
from wordloom.streaming.windows import read_stream


def first_deliveries(spark: SparkSession, path: str) -> DataFrame:
    """``operation, hash, delivery_id``: of each message the delivery that the stream met first, as a table.

    The state is keyed by the whole identifier (quotient and remainder), so nothing is dropped by mistake; within one
    batch any delivery of a message may be the one. Rows without an operation id are left out.
    """
    folder = scratch(spark)
    rows = read_stream(spark, path).where("operation_id is not null")
    operation = F.lower(strip_space("operation_id"))
    digest = plain_hash(F.coalesce(F.col("receipt.payload_hash"), F.col("payload_hash")))
    key = identifier(operation, digest)
    keyed = rows.select(operation.alias("operation_text"), digest.alias("hash"), "delivery_id", *[c.alias(k) for k, c in key.items()])
    once = keyed.dropDuplicates(list(key)).select(F.col("operation_text").alias("operation"), "hash", "delivery_id")
    query = (
        once.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{folder}/out")


def kept_so_far(spark: SparkSession, path: str) -> DataFrame:
    """``delivery_id, deliveries``: of each message the delivery that stays among all that a run finds, as a table.

    The state is a row per message: its earliest readable delivery (then the smallest id) and their number. Each batch writes
    the messages it changed, and the last write of a message stands. Rows without an operation id are left out.
    """
    folder = scratch(spark)
    rows = read_stream(spark, path).where("operation_id is not null and delivery_id is not null")
    key = identifier(F.lower(strip_space("operation_id")), plain_hash(F.coalesce(F.col("receipt.payload_hash"), F.col("payload_hash"))))
    at = instant(F.col("queued_at"))
    keyed = rows.select(*[c.alias(k) for k, c in key.items()], F.struct(at.isNull().alias("late"), at.alias("at"), "delivery_id").alias("place"))
    first = keyed.groupBy(*key).agg(F.min("place").alias("first"), F.count("*").alias("deliveries"))
    table = first.select(*key, F.col("first.delivery_id").alias("delivery_id"), "deliveries")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = (
        table.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    written = spark.read.schema(table.withColumn("batch", F.lit(0)).schema).parquet(f"{folder}/out")
    last = written.groupBy(*key).agg(F.max(F.struct("batch", "delivery_id", "deliveries")).alias("l"))
    return last.select("l.delivery_id", "l.deliveries")


class ReceiptTracker(StatefulProcessor):
    """Per operation: the receipt's last (state, progress), when it was first seen, how many polls left it unchanged, and the next poll.

    A receipt is first seen when it is delivered, or now if that lies ahead. With ``timers`` a timer is set for the next
    poll and gives a row with ``due`` when it fires; it counts as no poll.
    """

    base, most = 60, 3600

    def __init__(self, timers: bool = False) -> None:
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "state string, progress bigint, polls int, first_seen timestamp, last_seen timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        before = self.seen.get() if self.seen.exists() else None
        state, progress, polls, first, last = before if before else (None, None, 0, None, None)
        known = before is not None
        batch = pd.concat(list(rows)).sort_values(["delivered_at", "delivery_id"])
        now = pd.Timestamp.now("UTC").tz_localize(None)
        for row in batch.itertuples():
            reached = None if pd.isna(row.progress) else int(row.progress)
            same = known and row.state == state and reached == progress
            polls = polls + 1 if same else 0
            at = min(pd.Timestamp(row.delivered_at), now)
            first, last = min(first or at, at), max(last or at, at)
            state, progress, known = row.state, reached, True
        first, last = (pd.Timestamp(t).to_pydatetime() for t in (first, last))
        self.seen.update((state, progress, polls, first, last))
        if self.timers:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int((self._next(last, polls) - pd.Timestamp(0)).total_seconds() * 1000))
        yield self._row(key, False)

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield self._row(key, True)

    def _next(self, last, polls: int) -> pd.Timestamp:
        return pd.Timestamp(last) + pd.Timedelta(seconds=self._wait(polls))

    def _wait(self, polls: int) -> int:
        return min(self.base * 2 ** min(polls - 1, 40), self.most) if polls else 0

    def _row(self, key, due: bool) -> pd.DataFrame:
        state, progress, polls, first, last = self.seen.get()
        return pd.DataFrame(
            {
                "operation": [key[0]], "state": [state], "progress": [progress], "polls": [polls], "wait_seconds": [self._wait(polls)],
                "first_seen": [pd.Timestamp(first)], "next_poll_at": [self._next(last, polls)], "due": [due],
            }
        )

    def close(self) -> None:
        pass


_TRACKED = "operation string, state string, progress bigint, polls int, wait_seconds bigint, first_seen timestamp, next_poll_at timestamp, due boolean"


def track_receipts(receipts: DataFrame, timers: bool = False) -> DataFrame:
    """The tracked row of each operation that a batch of ``receipts(operation, delivery_id, delivered_at, state, progress)`` names.

    ``receipts`` is a stream; its state store must be RocksDB. With ``timers`` a row with ``due`` tells that a poll is to be made.
    """
    return receipts.groupBy("operation").transformWithStateInPandas(
        statefulProcessor=ReceiptTracker(timers), outputStructType=_TRACKED, outputMode="Update", timeMode="ProcessingTime" if timers else "None"
    )


def tracked_receipts(spark: SparkSession, path: str) -> DataFrame:
    """track_receipts() over all deliveries that a run finds, as a table: the last row of each operation."""
    folder, setting = scratch(spark), "spark.sql.streaming.stateStore.providerClass"
    rows = read_stream(spark, path).where("operation_id is not null and receipt is not null").select(
        F.lower(strip_space("operation_id")).alias("operation"), "delivery_id", F.col("delivered_at").cast("timestamp").alias("delivered_at"),
        F.col("receipt.state").alias("state"), F.col("receipt.progress_seq").alias("progress"),
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        (
            track_receipts(rows).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
        )
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    written = spark.read.schema(f"{_TRACKED}, batch int").parquet(f"{folder}/out")
    return written.groupBy("operation").agg(F.max_by(F.struct(*[c for c in written.columns if c != "operation"]), "batch").alias("l")).select("operation", "l.*")
