"""Context retrieval: weighted term counts over scoped entries, one canonical copy each, best first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import cut_bytes, snippet

#: Weights of a term in title, description and content.
WEIGHTS = {"title": 4.0, "description": 2.0, "content": 1.0}


def query_terms(spark, query: str) -> list[str]:
    """Distinct lower-case terms of at least two bytes: runs of letters, digits, ``_`` and ``-``."""
    q = spark.createDataFrame([(query,)], "q string")
    raw = F.filter(F.split("q", r"[^\p{IsAlphabetic}\p{N}_-]"), lambda t: F.octet_length(t) >= 2)
    return sorted(q.select(F.array_distinct(F.transform(raw, F.lower))).head()[0])


def term_score(terms: list[str]) -> Column:
    """Weighted counts of non-overlapping occurrences of each term; 1 without terms."""
    if not terms:
        return F.lit(1.0)
    score = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        text = F.lower(F.coalesce(F.col(name), F.lit("")))
        for term in terms:
            count = (F.char_length(text) - F.char_length(F.replace(text, F.lit(term), F.lit("")))) / len(term)
            score = score + count * weight
    return score


def context(
    entries: DataFrame, query: str, scopes: dict[str, int], tags: tuple[str, ...] = (), limit: int = 8, candidates: int = 64
) -> DataFrame:
    """``scope, id, title, snippet, score`` of the entries that serve a query best.

    ``scopes`` gives the scopes to read, with priorities (lower first). Entries must carry all ``tags``. All are scored
    before any limit. Of entries with one id the one of the best (scope, score) stays, then of those that stand first
    for their id, one per equal title and content. Null texts are empty; null ids and other scopes are left out.
    """
    spark = entries.sparkSession
    terms = query_terms(spark, query)
    rank = F.coalesce(*[F.when(F.col("scope") == s, p) for s, p in scopes.items()])
    asked = F.size(F.array_except(F.array(*map(F.lit, tags)), F.coalesce("tags", F.array().cast("array<string>")))) == 0 if tags else F.lit(True)
    read = entries.where(F.col("scope").isin(*scopes) & F.col("id").isNotNull() & asked)
    texts = {c: F.coalesce(F.col(c), F.lit("")) for c in ("title", "content")}
    scored = read.select(
        "scope", "id", "title", "description", "content", rank.alias("priority"), term_score(terms).alias("score"),
        F.sha2(F.concat(texts["title"], F.lit("\0"), texts["content"]), 256).alias("hash"),
    )
    if query.strip():
        scored = scored.where("score > 0")
    first = ["priority", F.desc("score"), "id", "hash"]
    one = scored.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(*first))).where("n = 1")
    one = one.withColumn("n", F.row_number().over(Window.partitionBy("hash").orderBy(*first))).where("n = 1")
    best = one.orderBy(F.desc("score"), "priority", "id").limit(max(1, min(candidates, 512))).limit(max(1, min(limit, 32)))
    return best.select("scope", "id", "title", snippet("description", "content").alias("snippet"), "score")


def rendered(results: DataFrame, failed: int = 0) -> DataFrame:
    """``text``: the results of context() as one bounded block; they are at most 32 rows."""
    item = F.format_string("[%s:%s] %s\n%s\n", "scope", "id", F.coalesce("title", F.lit("")), "snippet")
    ranked = results.select(F.struct((-F.col("score")).alias("s"), "id", item.alias("item")).alias("r"))
    all_items = F.sort_array(F.collect_list("r"))
    status = F.when(F.lit(failed) > 0, F.format_string("[context-status] failed_scopes=%d candidates=%d\n", F.lit(failed), F.size(all_items))).otherwise("")
    block = F.concat(F.lit("--- context ---\n"), F.array_join(F.transform(all_items, lambda r: r["item"]), ""), status, F.lit("--- end of context ---\n"))
    return ranked.agg(F.when(F.count("*") > 0, block).otherwise("").alias("text"))


def entry_blocks(entries: DataFrame, body: int = 1200) -> DataFrame:
    """``id, block``: each entry as a model reads it: id, title, tags and the body's first ``body`` bytes."""
    text = cut_bytes(F.coalesce("content", F.lit("")), body)
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", ")
    block = F.concat(F.lit("## "), F.coalesce("title", F.lit("")), F.lit(" ["), "id", F.lit("]\ntags: "), tags, F.lit("\n\n"), text, F.lit("\n"))
    return entries.where(F.col("id").isNotNull()).select("id", block.alias("block"))
