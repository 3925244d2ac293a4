"""A wiki folder that changes: what was added, changed and removed, and a new generation where every page parses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordloom.operators.snapshots import reconcile
from wordloom.session import cut
from wordloom.sources import generations
from wordloom.sources.pages import read_pages


def changes(spark: SparkSession, folder: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages of the folder, and ``path, status`` against ``known(path, source_hash)``; removed ones are found too."""
    pages = cut(read_pages(spark, folder))
    return pages, reconcile(known, pages.select("path", "source_hash"), "path", "source_hash")


def watch_pages(spark: SparkSession, folder: str, root: str, scope: str, checkpoint: str, out: str, every: str | None = None) -> StreamingQuery:
    """Reconcile the folder with the scope's generation whenever files arrive, and write ``path, status`` of each batch to ``out``.

    What came since the last batch is one batch. A stream of files tells of new ones only, so each batch compares the whole
    folder, which finds changed and removed pages as well. A generation is published only if every page parses.
    Without ``every`` it takes what is there and ends.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    arrived = spark.readStream.schema(schema).format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)

    def batch(_: DataFrame, number: int) -> None:
        there = generations.exists(spark, root, scope)
        none = spark.createDataFrame([], "path string, source_hash string")
        pages, status = changes(spark, folder, generations.read_current(spark, root, scope, "path").select("path", "source_hash") if there else none)
        status.where("status <> 'same'").write.mode("overwrite").parquet(f"{out}/batch={number}")
        if pages.where(F.col("parse_error").isNotNull()).isEmpty():
            generations.commit(pages.drop("parse_error"), root, scope, "path")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return arrived.select("path").writeStream.option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(batch).start()
