"""Copies hidden by formatting: one row per set of records whose canonical forms agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import lines, strip_space, words

#: Separators that no word holds.
PART, ITEM = "\x1e", "\x1f"


def canonical_form(content: Column, tags: Column) -> dict[str, Column]:
    """``body``: the words below the attribute block; ``form``: body, block and tags as one text.

    The block is what stands between a first line ``---`` and the next such line. Its lines become their words in
    order, as a sorted list without empty ones; the tags their words in order, as a sorted set without empty ones.
    """
    rows = lines(content)
    marks = F.transform(rows, strip_space)
    close = F.array_position(F.slice(marks, 2, F.greatest(F.size(marks) - 1, F.lit(1))), "---").cast("int")
    fenced = (F.element_at(marks, 1) == "---") & (F.size(rows) > 1) & (close > 0)
    body = F.when(fenced, F.slice(rows, close + 2, F.size(rows))).otherwise(rows)
    block = F.when(fenced, F.slice(rows, 2, F.greatest(close - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    tidy = lambda texts: F.filter(F.transform(texts, _joined), lambda x: x != "")
    text = _joined(F.array_join(body, "\n"))
    listed = F.array_join(F.array_sort(tidy(block)), ITEM)
    tagged = F.array_join(F.array_sort(F.array_distinct(tidy(F.array_compact(F.coalesce(tags, F.array()))))), ITEM)
    return {"body": text, "form": F.concat_ws(PART, text, listed, tagged)}


def _joined(text: Column) -> Column:
    return F.array_join(words(text), " ")


def layout_copies(records: DataFrame, key: str, content: str, tags: str) -> DataFrame:
    """``key, n_copies``: for each set of two or more copies the smallest key and the number of distinct keys.

    Records with a null key or without a word in the whole content are left out; null tags are like none. Repeated
    rows of one key are one record; should they differ, the one with the smallest hash stands for it. The canonical
    form is hashed to 128 bits and counted with a partial count before each shuffle, so a form with any number of
    copies costs a row per task. Two unequal forms with one hash would show as two lengths or two values of a second,
    independent hash: such groups are counted again by those.
    """
    form = canonical_form(F.col(content), F.col(tags))
    hashed = records.where(F.col(key).isNotNull() & F.col(content).rlike(r"[\p{L}\p{N}]")).select(
        F.col(key).alias("key"), form["form"].alias("form")
    )
    hashed = hashed.select(
        "key", F.unhex(F.md5("form")).alias("hash"), F.xxhash64("form").alias("second"), F.length("form").alias("length")
    )
    one = hashed.groupBy("key").agg(F.min(F.struct("hash", "second", "length")).alias("h"))
    # a hash met with two lengths or two second hashes is a collision: these two columns keep such forms apart
    counted = one.groupBy("h.hash", "h.second", "h.length").agg(F.min("key").alias("key"), F.count("*").alias("n_copies"))
    return counted.where("n_copies > 1").select(F.col("key").alias(key), "n_copies")
