"""Snapshots: differences by content hash, merges, and generations named by their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of a generation's hash; a bucket's digests are joined in one row.
BUCKETS = 65_536


def reconcile(old: DataFrame, new: DataFrame, key: str, content_hash: str) -> DataFrame:
    """``key, status``: added, changed, removed or same, by comparing hashes. Keys must be unique; null keys are left out."""
    sides = [df.where(F.col(key).isNotNull()).select(key, F.col(content_hash).alias(n), F.lit(True).alias(f"in_{n}")) for df, n in ((old, "o"), (new, "n"))]
    both = sides[0].join(sides[1], key, "full_outer")
    status = F.when(F.col("in_o").isNull(), "added").when(F.col("in_n").isNull(), "removed")
    return both.select(key, status.when(~F.col("o").eqNullSafe(F.col("n")), "changed").otherwise("same").alias("status"))


def upsert(entries: DataFrame, incoming: DataFrame, now: Column | None = None) -> DataFrame:
    """``entries`` with ``incoming`` merged in by id: an id that exists is replaced, its revision raised by one.

    Of several incoming rows of one id the latest by ``updated_at`` stays. Both have the same columns; the result too.
    """
    columns = entries.columns
    latest = incoming.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("updated_at", "revision")).alias("r")).select("r.*")
    before = entries.select("id", F.col("revision").alias("old_revision"))
    merged = latest.join(before, "id", "left").select(
        *[
            F.coalesce(F.col("old_revision") + 1, F.lit(1)).cast("int").alias(c) if c == "revision"
            else F.coalesce(now, F.col(c)).alias(c) if c == "updated_at" and now is not None
            else F.col(c)
            for c in columns
        ]
    )
    return entries.join(latest.select("id"), "id", "left_anti").select(columns).union(merged)


def delete(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """``entries`` without the given ids; an id that isn't there is an error when the result is read."""
    missing = ids.select("id").distinct().join(entries, "id", "left_anti").agg(F.min("id").alias("missing"))
    checked = F.broadcast(missing)
    kept = entries.join(ids.select("id").distinct(), "id", "left_anti").join(checked)
    fine = F.when(F.col("missing").isNotNull(), F.raise_error(F.concat(F.lit("no entry "), F.col("missing")))).otherwise(True)
    return kept.where(fine.cast("boolean")).select(entries.columns)


def generation(entries: DataFrame, scope: str, key: str, digest: Column) -> DataFrame:
    """``scope, generation, entries``: a hash that names the content of each scope, whatever the order of its rows.

    Each row's SHA-256 is put into one of BUCKETS by its key; a bucket's digests are hashed in order of key, and the
    buckets' hashes in order of bucket, so no task gathers a whole scope. Null keys are left out; repeated rows count once.
    """
    rows = entries.where(F.col(key).isNotNull()).select(F.col(scope).alias("scope"), F.col(key).alias("k"), F.sha2(digest, 256).alias("d")).distinct()
    bucket = F.substring(F.sha2(F.col("k").cast("string"), 256), 1, 4)  # BUCKETS values
    parts = rows.groupBy("scope", bucket.alias("b")).agg(
        F.sort_array(F.collect_list(F.struct("k", "d"))).alias("l"), F.count("*").alias("n")
    )
    hashed = parts.select("scope", "b", "n", F.sha2(F.array_join(F.col("l.d"), ""), 256).alias("h"))
    whole = hashed.groupBy("scope").agg(F.sort_array(F.collect_list(F.struct("b", "h"))).alias("l"), F.sum("n").alias("entries"))
    name = F.sha2(F.concat(F.coalesce("scope", F.lit("")), F.lit("\n"), F.array_join(F.col("l.h"), "")), 256)
    return whole.select("scope", name.alias("generation"), "entries")
