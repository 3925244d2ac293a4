"""Keywords of long texts and of turns, scored per window with decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import SPACE, lines

#: Words that are never keywords, in natural order.
KEYWORD_STOPWORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "day",
    "get", "has", "him", "his", "how", "man", "new", "now", "old", "see", "two", "way", "who", "boy", "did", "its",
    "let", "put", "say", "she", "too", "use", "that", "this", "with", "have", "from", "they", "will", "been", "when",
    "what", "your", "each", "which", "their", "time", "more", "very", "then", "than", "some", "would", "make", "into",
    "like", "over", "such", "also", "back", "after", "just", "where", "most", "know", "take", "year", "good", "much",
    "before", "right", "look", "think", "even", "through", "work", "long", "here", "well", "down", "were", "same",
    "about", "these", "should", "being", "used", "using", "returns", "return", "param", "params", "type", "types",
    "true", "false", "null", "none", "error", "result", "value", "values",
)

#: Texts of up to so many characters are their own query; windows of longer ones; decay; least score; most keywords.
LONG, SIZE, STEP, DECAY, LEAST, MOST = 2000, 1000, 600, 0.85, 0.15, 12


def window_tokens(text: Column) -> Column:
    """Letters, digits, ``_`` and ``-`` of each word that has at least three bytes of them and is no stop word."""
    tidy = F.transform(F.split(text, SPACE), lambda w: F.regexp_replace(w, r"[^\p{IsAlphabetic}\p{N}_-]", ""))
    return F.filter(tidy, lambda w: (F.octet_length(w) >= 3) & ~F.lower(w).isin(*KEYWORD_STOPWORDS))


def _scored(windows: DataFrame) -> DataFrame:
    """``key, at, token, score`` of ``windows(key, at, text)``: frequency in the window, more for long or code-like."""
    tokens = windows.select("key", "at", window_tokens(F.col("text")).alias("t"))
    each = tokens.select("key", "at", F.size("t").alias("n"), F.explode("t").alias("token"))
    counts = each.groupBy("key", "at", "token").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    token = F.col("token")
    length = F.when(F.octet_length(token) >= 6, 1.5).otherwise(1.0)
    code = F.when(token.rlike("[_-]") | (token.rlike("^[a-z].*[A-Z]") & (F.char_length(token) > 3)), 1.3).otherwise(1.0)
    return counts.select("key", "at", "token", (F.col("c") / F.col("n") * length * code).alias("score"))


def _best(scores: DataFrame, floor: float) -> DataFrame:
    """The best keywords of each key: at least a tenth of the best score, at most MOST, ties by token."""
    scores = scores.withColumn("score", F.round("score", 9))  # so that the order of summing doesn't break ties
    place = Window.partitionBy("key").orderBy(F.desc("score"), "token")
    top = F.max("score").over(Window.partitionBy("key"))
    kept = scores.withColumn("top", top).where(F.col("score") >= F.greatest(F.col("top") * 0.1, F.lit(floor)))
    return kept.withColumn("place", F.row_number().over(place)).where(F.col("place") <= MOST).drop("top")


def long_text_keywords(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, place, token, score`` of texts of more than LONG characters.

    Windows of SIZE characters start every STEP until one reaches the end. The first window of a token gives its score;
    in a later window with the token the old score shrinks by DECAY to the power of the window's index and the new one
    is added. Shorter texts and null keys have no rows; keys must be unique.
    """
    n = F.char_length(text)
    last = F.ceil((n - SIZE) / STEP).cast("int")
    long = texts.where(F.col(key).isNotNull() & (n > LONG)).select(F.col(key).alias("key"), F.col(text).alias("t"), F.explode(F.sequence(F.lit(0), last)).alias("at"))
    windows = long.select("key", "at", F.substring("t", F.col("at") * STEP + 1, F.lit(SIZE)).alias("text"))
    by_token = _scored(windows).groupBy("key", "token").agg(F.sort_array(F.collect_list(F.struct("at", "score"))).alias("s"))
    folded = F.aggregate("s", F.lit(0.0), lambda total, w: total * F.pow(F.lit(DECAY), w["at"]) + w["score"])
    best = _best(by_token.select("key", "token", folded.alias("score")), LEAST * 0.1)
    return best.select(F.col("key").alias(key), "place", "token", "score")


def turn_keywords(texts: DataFrame, key: str, text: str, turns: int) -> DataFrame:
    """``key, place, token, score`` over the last ``turns`` non-blank lines, each weighted by DECAY per line after it."""
    filled = F.filter(lines(text), lambda x: x.rlike(r"(?U)\S"))
    last = texts.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), filled.alias("all"))
    start = F.greatest(F.size("all") - turns + 1, F.lit(1))
    kept = last.where(F.size("all") > 0).select("key", F.posexplode(F.reverse(F.slice("all", start, turns))).alias("at", "text"))
    weighted = _scored(kept).groupBy("key", "token").agg(F.sum(F.col("score") * F.pow(F.lit(DECAY), "at")).alias("score"))
    return _best(weighted, 0.0).select(F.col("key").alias(key), "place", "token", "score")
