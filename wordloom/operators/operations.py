"""Queued operations and their receipts: the latest per operation, progress, contracts and retry times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import bounded, strip_space
from wordloom.operators.delivery import instant, plain_hash


def backoff_seconds(polls: Column, base: int = 60, most: int = 3600) -> Column:
    """Seconds to wait after so many unchanged polls: doubling from ``base``, at most ``most``; 0 for none or null."""
    n = F.coalesce(polls, F.lit(0))
    return F.when(n <= 0, 0).otherwise(F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(n, F.lit(40)) - 1), F.lit(most)).cast("bigint"))


def duration_seconds(text: Column) -> Column:
    """Seconds of ``<positive integer><s|m|h|d>``; null for anything else."""
    unit = F.substring(text, -1, 1)
    number = F.regexp_extract(text, r"^([0-9]{1,12})[smhd]$", 1)
    scale = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return F.when((number != "") & (number.try_cast("bigint") > 0), number.try_cast("bigint") * scale)


def operation_key(operation_id: Column | str = "operation_id") -> Column:
    return F.lower(strip_space(operation_id))


def latest_states(deliveries: DataFrame) -> DataFrame:
    """``operation, state, deliveries``: the state of each operation at its last delivery (ties: the largest id)."""
    named = deliveries.where(F.col("operation_id").isNotNull()).select(operation_key().alias("operation"), "state", "delivered_at", "delivery_id")
    last = named.groupBy("operation").agg(F.max(F.struct("delivered_at", "delivery_id", "state")).alias("l"), F.count("*").alias("deliveries"))
    return last.select("operation", "l.state", "deliveries")


def receipt_mismatches(deliveries: DataFrame) -> DataFrame:
    """``delivery_id, fault``: deliveries whose receipt speaks of another operation, version, kind or payload.

    Without a receipt, and for values missing on either side, there is nothing to compare. The first fault is named.
    """
    ours, theirs = operation_key(), operation_key("receipt.operation_id")
    hashes = plain_hash(F.col("payload_hash")), plain_hash(F.col("receipt.payload_hash"))
    fault = (
        F.when(ours != theirs, "operation")
        .when(F.col("schema_version") != F.col("receipt.schema_version"), "version")
        .when(F.col("method") != F.col("receipt.kind"), "kind")
        .when(hashes[0] != hashes[1], "payload")
    )
    return deliveries.select("delivery_id", fault.alias("fault")).where("fault is not null")


def receipt_progress(deliveries: DataFrame) -> DataFrame:
    """``delivery_id, changed``: whether a receipt's (state, progress) differs from the operation's receipt before it.

    Receipts come in order of delivery; the first of an operation has changed. Rows without one are left out.
    """
    seen = deliveries.where(F.col("receipt").isNotNull() & F.col("operation_id").isNotNull()).select(
        operation_key().alias("operation"), "delivery_id", "delivered_at", F.struct("receipt.state", "receipt.progress_seq").alias("now")
    )
    before = F.lag("now").over(Window.partitionBy("operation").orderBy("delivered_at", "delivery_id"))
    return seen.select("delivery_id", (before.isNull() | ~before.eqNullSafe(F.col("now"))).alias("changed"))


def waiting_times(deliveries: DataFrame) -> DataFrame:
    """``project_id, operations, readable, longest_wait``: seconds from queueing to delivery, by project."""
    wait = F.unix_micros(F.col("delivered_at").cast("timestamp")) - F.unix_micros(instant(F.col("queued_at")))
    timed = deliveries.select("project_id", (wait / 1_000_000).alias("wait"))
    return timed.groupBy("project_id").agg(F.count("*").alias("operations"), F.count("wait").alias("readable"), F.round(F.max("wait"), 3).alias("longest_wait"))


def stale_since(changed: Column, accepted: Column, queued: Column) -> Column:
    """The instant since which an operation stands still: its last change, else its acceptance, else its queueing.

    A change that is there but can't be read falls back to the queueing, not to the acceptance.
    """
    return F.coalesce(instant(F.coalesce(changed, accepted)), instant(queued))


def stale_operations(deliveries: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """``delivery_id, stale_since`` of the deliveries that stood still for more than ``days`` before ``now``."""
    since = stale_since(F.col("receipt.updated_at"), F.col("receipt.created_at"), F.col("queued_at"))
    return deliveries.select("delivery_id", since.alias("stale_since"), now.alias("now")).where(
        F.col("stale_since") < F.col("now") - F.make_dt_interval(F.lit(days))
    ).select("delivery_id", "stale_since")


def next_polls(deliveries: DataFrame, now: Column) -> DataFrame:
    """``delivery_id, next_poll_at, deferred``: when each delivery is to be polled again, and whether that is still to come."""
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), backoff_seconds(F.col("unchanged_polls")).cast("decimal(18,6)"))
    at = F.col("delivered_at") + wait
    return deliveries.select("delivery_id", at.alias("next_poll_at"), now.alias("now")).select(
        "delivery_id", "next_poll_at", (F.col("next_poll_at") > F.col("now")).alias("deferred")
    )


def batch_summaries(deliveries: DataFrame) -> DataFrame:
    """A row per batch: deliveries, operations, those with a receipt, and how these ended."""
    state = F.col("receipt.state")
    return deliveries.groupBy("batch_id").agg(
        F.count("*").alias("deliveries"), F.count_distinct(operation_key()).alias("operations"), F.count("receipt").alias("receipts"),
        *[F.count_if(state == s).alias(s) for s in ("planned", "running", "done", "failed")],
        F.count_if(F.col("last_error").isNotNull()).alias("errors"), F.max("delivered_at").alias("last"),
    )


def normalized_operations(deliveries: DataFrame, state: str = "pending") -> tuple[DataFrame, DataFrame]:
    """Deliveries with tidy id, recomputed hash and a state, and the dead letters ``delivery_id, error``.

    The hash is that of the arguments as compact JSON with sorted keys. Arguments that are no JSON, and hashes (of the row,
    or else of the receipt) that differ from the recomputed one, are dead letters; a missing hash is filled in.
    """
    from wordloom.sources.pages import payload_hash

    told = plain_hash(F.coalesce(F.col("payload_hash"), F.col("receipt.payload_hash")))
    hashed = deliveries.withColumns({"__made": payload_hash("arguments"), "__told": told})
    error = (
        F.when(F.col("operation_id").isNull(), "no operation id").when(F.col("__made").isNull(), "the arguments are no JSON")
        .when(F.col("__told") != F.col("__made"), F.concat(F.lit("the payload hash is "), "__made", F.lit(", not "), "__told"))
    )
    marked = hashed.withColumn("__error", bounded(error))
    good = marked.where("__error IS NULL").withColumns(
        {"operation_id": operation_key(), "payload_hash": F.col("__made"), "state": F.coalesce("state", F.lit(state))}
    )
    dead = marked.where("__error IS NOT NULL").select("delivery_id", F.col("__error").alias("error"))
    return good.select(deliveries.columns), dead
