"""A stream of events written to two stores, and to a third place when that fails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordloom.operators.events import route


def route_events(events: DataFrame, kind: str, graph_kinds: tuple[str, ...], stores: dict[str, str], fallback: str, checkpoint: str) -> StreamingQuery:
    """Write each batch to the folder of its store (``graph`` and ``episodic``); a store that can't be written goes to the fallback.

    A batch is written under its number, so one that runs again after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("target", route(F.col(kind), graph_kinds)).persist()
        try:
            for store, folder in stores.items():
                rows = marked.where(F.col("target") == store).drop("target")
                try:
                    rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")
                except Exception:  # the event log must not lose rows because one store is away
                    rows.write.mode("overwrite").json(f"{fallback}/{store}/batch={number}")
        finally:
            marked.unpersist()

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
