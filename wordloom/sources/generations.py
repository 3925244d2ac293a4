"""Immutable generations of a table, named by their content, and the pointer to the current one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators.snapshots import generation


def _digest(df: DataFrame):
    """A row's content: the columns' names and values as JSON, in order of name."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def commit(entries: DataFrame, root: str, scope: str, key: str = "id") -> str:
    """Write the entries as a generation of ``scope`` unless it is there, point to it, and return its name."""
    spark = entries.sparkSession
    rows = entries.withColumn("__scope", F.lit(scope))
    named = generation(rows, "__scope", key, _digest(entries)).head()
    name = named.generation if named else "0" * 64
    target = f"{root}/{scope}/generations/{name}"
    done, fs = _path(spark, f"{target}/_SUCCESS")
    if not fs.exists(done):
        entries.write.mode("overwrite").parquet(target)
    fresh, fs = _path(spark, f"{root}/{scope}/.current-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(name.encode()))
    out.close()
    current, _ = _path(spark, f"{root}/{scope}/current")
    # one rename that replaces what is there: a reader finds the old pointer or the new one, never none
    jvm = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
    options[0] = getattr(jvm, "Options$Rename").OVERWRITE
    jvm.FileContext.getFileContext(current.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(fresh), fs.makeQualified(current), options)
    return name


def publish(pages: DataFrame, root: str, scopes: list[str], error: str | None = None) -> DataFrame:
    """``scope, entries, failures, status, generation``: commit a generation of each of the scopes asked for.

    A scope without pages is ``missing``; one with a page that doesn't parse (``error`` isn't null) is ``refused`` and
    keeps the generation it had; the others are ``published``. An error if none is.
    """
    failed = F.count_if(F.col(error).isNotNull()) if error else F.lit(0)
    counts = {r.scope: r for r in pages.where(F.col("scope").isin(scopes)).groupBy("scope").agg(F.count("*").alias("n"), failed.alias("failed")).collect()}
    told = []
    for scope in scopes:
        have = counts.get(scope)
        fine = have is not None and not have.failed
        rows = pages.where(F.col("scope") == scope)
        name = commit(rows.drop(error) if error else rows, root, scope) if fine else None
        status = "missing" if have is None else "published" if fine else "refused"
        told.append((scope, have.n if have else 0, have.failed if have else 0, status, name))
    if not any(t[3] == "published" for t in told):
        raise ValueError("no scope could be published")
    return pages.sparkSession.createDataFrame(told, "scope string, entries bigint, failures bigint, status string, generation string")


def exists(spark: SparkSession, root: str, scope: str) -> bool:
    """Whether the scope has a current generation."""
    pointer, fs = _path(spark, f"{root}/{scope}/current")
    return fs.exists(pointer)


def current(spark: SparkSession, root: str, scope: str) -> str:
    """The name of the current generation; an error if there is none or the pointer is no SHA-256."""
    name = spark.read.text(f"{root}/{scope}/current").head()[0].strip()
    if len(name) != 64 or set(name) - set("0123456789abcdef"):
        raise ValueError(f"the pointer of {scope} names no generation")
    return name


def read(spark: SparkSession, root: str, scope: str, name: str) -> DataFrame:
    """A generation by name, without a check of its content."""
    return spark.read.parquet(f"{root}/{scope}/generations/{name}")


def read_current(spark: SparkSession, root: str, scope: str, key: str = "id") -> DataFrame:
    """The current generation, after its content was checked against its name."""
    name = current(spark, root, scope)
    entries = read(spark, root, scope, name)
    found = generation(entries.withColumn("__scope", F.lit(scope)), "__scope", key, _digest(entries)).head()
    if (found.generation if found else "0" * 64) != name:
        raise ValueError(f"generation {name} of {scope} was changed")
    return entries
