"""Folders that fill up: raw documents as a stream, handed on in batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordloom.functions.text import content_hash
from wordloom.sources.pages import media_type


def raw_documents(spark: SparkSession, folder: str, nested: bool = False) -> DataFrame:
    """``path, content, media_type, content_hash`` of each file that arrives; names ending in ``.tmp`` are not read yet.

    A file is read once: one that changes later under the same name isn't read again. Folders within are read if ``nested``.
    """
    texts = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", str(nested).lower()).load(folder)
    path = F.col("_metadata.file_path")
    rows = texts.select(path.alias("path"), F.col("value").alias("content")).where(~F.col("path").endswith(".tmp"))
    return rows.withColumns({"media_type": media_type("path"), "content_hash": content_hash("content")})


def drain(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], failed: str, every: str | None = None) -> StreamingQuery:
    """Hand each batch to ``handle``, equal contents once; a batch that fails is written to ``failed`` with its error.

    Without ``every`` it takes what is there and ends; else it runs on, with all that came since in one batch.
    """

    def batch(rows: DataFrame, number: int) -> None:
        once = rows.dropDuplicates(["content_hash"])
        try:
            handle(once, number)
        except Exception as error:  # the queue goes on; what failed is kept
            note = F.lit(f"{type(error).__name__}: {error}"[:500])
            once.withColumn("error", note).write.mode("overwrite").parquet(f"{failed}/batch={number}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(batch).start()
