"""Windowed counts over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.session import scratch


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file, with the schema they have now."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return stream.parquet(path)
    # a stream reads folders: the file's own, and of it nothing but the file
    return stream.option("pathGlobFilter", place.getName()).parquet(str(place.getParent().toString()))


def hourly_counts(spark: SparkSession, path: str, when: str, kind: str, value: str, late: str | None = None) -> DataFrame:
    """``hour, kind, events, value`` over all events that a run finds, as a table.

    The stream keeps one row per hour and kind; each batch writes the changed rows, and the last write of a row stands.
    Events count however late they come. With ``late`` hours are given up that long after the newest event, to bound the
    state, and events of such hours are dropped.
    """
    folder = scratch(spark)
    stamped = read_stream(spark, path).withColumn("__at", F.col(when).cast("timestamp"))
    stamped = stamped if late is None else stamped.withWatermark("__at", late)
    counted = stamped.groupBy(F.window("__at", "1 hour").alias("w"), F.col(kind)).agg(F.count("*").alias("events"), F.sum(value).alias("value"))
    rows = counted.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), kind, "events", "value")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = (
        rows.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    written = spark.read.schema(f"hour timestamp_ntz, {kind} string, events bigint, value double, batch int").parquet(f"{folder}/out")
    last = written.groupBy("hour", kind).agg(F.max(F.struct("batch", "events", "value")).alias("l"))
    return last.select("hour", kind, "l.events", "l.value")
