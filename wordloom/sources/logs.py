"""JSON Lines logs and records with explicit schemas; bad lines are skipped or kept aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "id string, kind string, session_id string, project_root string, scope string, timestamp timestamp, payload string, affects array<string>"
LESSON = "lesson_id string, project_id string, source string, session_id string, recorded_at timestamp, text string, tags array<string>, marked boolean, shingles array<string>"
WORKFLOW = (
    "workflow_id string, project_id string, session_id string, recorded_at timestamp, team_id string, role_id string, "
    "summary string, artifacts array<string>, skill_uses array<struct<skill: string, corrections: array<string>>>, "
    "prompt_shingles array<string>, tool_shingles array<string>"
)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON Lines file or folder; lines that don't parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """``raw, digest``: the lines that are no JSON, as they are, with their SHA-256; blank lines are none."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.where(F.try_parse_json("value").isNull()).select(F.col("value").alias("raw"), F.sha2("value", 256).alias("digest"))


def append_lines(rows: DataFrame, path: str) -> None:
    """Append records as JSON Lines."""
    rows.write.mode("append").json(path)


def append_new(rows: DataFrame, path: str, schema: str, key: str) -> None:
    """Append the records whose key isn't in the log yet, the first of each key."""
    from wordloom.operators.events import not_in

    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    known = read_lines(spark, path, schema).select(key) if there else rows.select(key).limit(0)
    append_lines(not_in(rows, known, key), path)


def transcript_lines(spark: SparkSession, path: str) -> DataFrame:
    """``session_id, line_no, raw`` of transcript files: a file is a session named by its stem, lines keep their order."""
    files = spark.read.format("text").option("wholetext", "true").load(path).select(F.col("_metadata.file_name").alias("name"), "value")
    lines = files.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("session_id"), F.posexplode(F.split("value", "\n")).alias("line_no", "raw"))
    return lines.where("raw <> ''")


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a folder with one JSON file each, with the file's name."""
    return spark.read.schema(schema).option("multiLine", "true").json(path).select("*", F.col("_metadata.file_name").alias("file_name"))
