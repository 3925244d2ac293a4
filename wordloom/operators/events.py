"""The event log: lists, histories, routing into two stores, and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(events: DataFrame, when: str, key: str, limit: int = 20, **equal) -> DataFrame:
    """The newest events whose columns have the given values, newest first, ties by key."""
    for name, value in equal.items():
        events = events.where(F.col(name).eqNullSafe(F.lit(value)))
    return events.orderBy(F.desc(when), key).limit(limit)


def history(events: DataFrame, column: str, value, when: str, key: str) -> DataFrame:
    """The events of one entity from first to last; an array column must hold the value."""
    kind = dict(events.dtypes)[column]
    held = F.array_contains(column, value) if kind.startswith("array") else F.col(column) == F.lit(value)
    return events.where(held).orderBy(when, key)


def route(kind: Column, graph_kinds: tuple[str, ...]) -> Column:
    """The store an event belongs to: ``graph`` for the given kinds, else ``episodic``; null is episodic."""
    return F.when(kind.isin(*graph_kinds), "graph").otherwise("episodic")


def reshard(events: DataFrame, kind: str, graph_kinds: tuple[str, ...], path: str) -> None:
    """Write the events to one folder per store; a second run leaves the same files."""
    events.withColumn("target", route(F.col(kind), graph_kinds)).write.mode("overwrite").partitionBy("target").parquet(path)


def expire(events: DataFrame, when: str, now: Column, days: int = 90) -> DataFrame:
    """The events that are not older than ``days`` before ``now``; a null time is kept."""
    return events.where(F.col(when).isNull() | (F.col(when) > now - F.make_dt_interval(F.lit(days))))


def not_in(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The first row of each key that ``known`` doesn't have; null keys are left out."""
    return rows.where(F.col(key).isNotNull()).dropDuplicates([key]).join(known.select(key), key, "left_anti")


def event_rows(events: DataFrame, key: str, kind: str, when: str, kinds: dict[str, str], affects: Column, **context: str) -> DataFrame:
    """``id, kind, timestamp, affects`` and a column for each piece of context, as the event log keeps them.

    ``kinds`` names what is stored under another kind; ``affects`` are the ids that an event is about, nulls left out.
    """
    named = F.coalesce(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col(kind)], F.col(kind)) if kinds else F.col(kind)
    return events.select(
        F.col(key).cast("string").alias("id"), named.alias("kind"), F.col(when).alias("timestamp"), F.array_compact(affects).alias("affects"),
        *[F.lit(v).alias(n) for n, v in context.items()],
    )
