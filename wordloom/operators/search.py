"""Full-text ranking: postings, document frequencies and TF-IDF scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions.text import index_tokens
from wordloom.session import cut

#: Query terms that a search may have; they are sent to every executor.
MOST_TERMS = 10_000


def postings(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf``: a term's share of the document's tokens. Documents without tokens have no rows.

    Repeated rows of one key are one longer document; a null key is left out.
    """
    tokens = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), index_tokens(text).alias("tokens"))
    counted = tokens.select("key", F.size("tokens").alias("n"), F.explode("tokens").alias("term"))
    counts = counted.groupBy("key", "term").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    return counts.select(F.col("key").alias(key), "term", (F.col("c") / F.col("n")).alias("tf"))


def document_frequencies(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``term, df, occurrences`` of each term of the index."""
    tokens = documents.where(F.col(key).isNotNull()).select(F.explode(index_tokens(text)).alias("term"), F.col(key).alias("key"))
    each = tokens.groupBy("term", "key").agg(F.count("*").alias("c"))
    return each.groupBy("term").agg(F.count("*").alias("df"), F.sum("c").alias("occurrences"))


def tfidf_search(documents: DataFrame, key: str, text: str, query: str, k: int = 5) -> DataFrame:
    """``key, score`` of the best ``k`` documents, by score and then key.

    The score sums tf * ln(N / (df + 1)) over the query's tokens, a repeated token as often as it stands there; N counts
    documents with a token. Scores may be zero or negative and still come out. A query without tokens finds nothing.

    Only the query's terms leave the scan: each document is reduced to its counts of them before any shuffle.
    """
    spark = documents.sparkSession
    asked = spark.createDataFrame([(query,)], "q string").select(index_tokens("q").alias("t")).head()[0]
    weight = {t: asked.count(t) for t in asked}
    if len(weight) > MOST_TERMS:
        raise ValueError(f"a query has at most {MOST_TERMS} terms")
    tokens = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), index_tokens(text).alias("tokens"))
    filled = tokens.where(F.size("tokens") > 0)
    total = filled.count()
    terms = F.array(*[F.lit(t) for t in weight]) if weight else F.array().cast("array<string>")
    hits = filled.select("key", F.size("tokens").alias("n"), F.filter("tokens", lambda t: F.array_contains(terms, t)).alias("hit"))
    counts = hits.where(F.size("hit") > 0).select("key", "n", F.explode("hit").alias("term"))
    tf = counts.groupBy("key", "term").agg((F.count("*") / F.first("n")).alias("tf"))
    df = tf.groupBy("term").agg(F.log(F.lit(float(total)) / (F.count("*") + 1)).alias("idf"))
    times = spark.createDataFrame(list(weight.items()), "term string, times int")
    idf = F.broadcast(df.join(F.broadcast(times), "term"))  # a row per query term
    scored = tf.join(idf, "term").groupBy("key").agg(F.sum(F.col("tf") * F.col("idf") * F.col("times")).alias("score"))
    best = scored.orderBy(F.desc("score"), "key").limit(k)
    return best.select(F.col("key").alias(key), F.round("score", 9).alias("score"))


#: Folders that the postings of a stored index are spread over by term.
BUCKETS = 64


def write_index(documents: DataFrame, key: str, text: str, path: str) -> None:
    """Store the postings of the documents, by bucket of the term and in order of term, and their number.

    A search reads the buckets of its terms, and within them the row groups that hold these.
    """
    tokens = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), index_tokens(text).alias("tokens"))
    filled = cut(tokens.where(F.size("tokens") > 0).select("key", F.size("tokens").alias("n"), F.explode("tokens").alias("term")).groupBy("key", "term").agg((F.count("*") / F.first("n")).alias("tf")))
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    rows = filled.withColumn("bucket", bucket).repartition("bucket", "term").sortWithinPartitions("bucket", "term")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    filled.agg(F.count_distinct("key").alias("documents")).write.mode("overwrite").parquet(f"{path}/size")


def search_index(spark: SparkSession, path: str, query: str, k: int = 5) -> DataFrame:
    """``key, score`` of the best ``k`` documents of a stored index, as tfidf_search() gives them; no text is read."""
    asked = spark.createDataFrame([(query,)], "q string").select(index_tokens("q").alias("t")).head()[0]
    weight = {t: asked.count(t) for t in asked}
    if len(weight) > MOST_TERMS:
        raise ValueError(f"a query has at most {MOST_TERMS} terms")
    total = spark.read.parquet(f"{path}/size").head().documents
    terms = spark.createDataFrame(list(weight.items()), "term string, times int")
    buckets = [r[0] for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
    rows = spark.read.parquet(f"{path}/postings")
    held = rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(list(weight))).select("key", "term", "tf")
    df = held.groupBy("term").agg(F.log(F.lit(float(total)) / (F.count("*") + 1)).alias("idf"))
    idf = F.broadcast(df.join(F.broadcast(terms), "term"))  # a row per query term
    scored = held.join(idf, "term").groupBy("key").agg(F.sum(F.col("tf") * F.col("idf") * F.col("times")).alias("score"))
    return scored.orderBy(F.desc("score"), "key").limit(k).select("key", F.round("score", 9).alias("score"))


#: Documents of a block that is scored at once, and queries of one.
ROWS, QUERIES = 4096, 256


def best_matches(documents: DataFrame, key: str, text: str, queries: DataFrame, k: int = 5, rows: int = ROWS, at_once: int = QUERIES) -> DataFrame:
    """``query, key, score, place``: the best ``k`` of all documents for each row of ``queries(query, text)``.

    Scores are those of tfidf_search(), ties go to the smaller key; a document may be found by its own text. Only
    documents that share a term with the query are found. Blocks of documents meet blocks of queries, by number, and each
    block keeps its best k of each query, so what common terms bring together never becomes rows.
    """
    spark = documents.sparkSession
    posted = cut(postings(documents.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text"))
    total = posted.select("key").distinct().count()
    frequent = posted.groupBy("term").agg(F.count("*").alias("df"))
    asked = queries.select("query", F.explode(index_tokens("text")).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    weighed = asked.join(frequent, "term").withColumn("weight", F.col("times") * F.log(F.lit(float(max(total, 1))) / (F.col("df") + 1)))
    n_queries = asked.select("query").distinct().count()
    if not n_queries or not total:
        kinds = {c: t for c, t in [*queries.dtypes, *posted.dtypes]}
        return spark.createDataFrame([], f"query {kinds['query']}, key {kinds['key']}, score double, place int")
    blocks = lambda c, n, size: F.pmod(F.xxhash64(c), F.lit(-(-n // size))).cast("int")
    needed = posted.join(asked.select("term").distinct(), "term", "left_semi")
    docs = needed.groupBy(blocks("key", total, rows).alias("block"), "key").agg(F.collect_list(F.struct("term", "tf")).alias("terms"))
    wanted = weighed.groupBy(blocks("query", n_queries, at_once).alias("of"), "query").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    doc_blocks = cut(docs.groupBy("block").agg(F.collect_list(F.struct("key", "terms")).alias("docs")))
    query_blocks = cut(wanted.groupBy("of").agg(F.collect_list(F.struct("query", "terms")).alias("queries")))
    every = doc_blocks.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(-(-n_queries // at_once) - 1))))
    met = every.join(query_blocks, "of")
    kinds = dict(queries.dtypes)["query"], dict(posted.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k_ in range(batch.num_rows):
                yield _best_of(batch.column(0)[k_].values, batch.column(1)[k_].values, k)

    found = met.select("docs", "queries").mapInArrow(run, f"query {kinds[0]}, key {kinds[1]}, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _best_of(docs: pa.StructArray, queries: pa.StructArray, k: int) -> pa.RecordBatch:
    """The best ``k`` of the documents of a block for each query of one; scores to nine places."""
    lists = docs.field("terms"), queries.field("terms")
    flat = [x.flatten() for x in lists]
    coded = pa.chunked_array([f.field("term") for f in flat]).dictionary_encode().combine_chunks()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    code = coded.indices.to_numpy()
    d_code, q_code = code[: len(flat[0])], code[len(flat[0]) :]
    weights = np.zeros((len(coded.dictionary), len(queries)))
    q_of = np.repeat(np.arange(len(queries)), np.diff(lists[1].offsets.to_numpy()))
    weights[q_code, q_of] = flat[1].field("weight").to_numpy()
    holds = np.zeros_like(weights, dtype=bool)
    holds[q_code, q_of] = True
    tf, ends = flat[0].field("tf").to_numpy(), lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py()
    names, out = docs.field("key"), []
    order = np.argsort(np.array(names.to_pylist(), dtype=object), kind="stable")
    scores = np.full((len(docs), len(queries)), -np.inf)
    for n in range(len(docs)):
        mine = slice(ends[n], ends[n + 1])
        score = np.round(tf[mine] @ weights[d_code[mine]], 9)
        scores[n] = np.where(holds[d_code[mine]].any(axis=0), score, -np.inf)
    scores = scores[order]
    for q in range(len(queries)):
        best = np.argsort(-scores[:, q], kind="stable")[:k]
        out += [(q, order[b], scores[b, q]) for b in best if scores[b, q] > -np.inf]
    q, d, s = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [queries.field("query").take(pa.array(q, pa.int64())), names.take(pa.array(d, pa.int64())), pa.array(s, pa.float64())], ["query", "key", "score"]
    )
