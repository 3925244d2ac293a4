"""What models answer: fenced JSON, reports in batches, and what is done where an answer can't be used."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import body_links, bounded, slug, strip_space

REPORT = "array<struct<id: string, severity: string, issue: string, suggestion: string>>"
#: Severities in rising order; anything else is the first.
SEVERITIES = ("info", "warning", "error")


def strip_fences(text: Column | str) -> Column:
    """An answer without a code fence around it."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"^```[A-Za-z0-9_-]*[ \t]*\r?\n?", ""), r"\r?\n?```$", ""))


def parsed(text: Column | str, schema: str) -> Column:
    """The answer as a value of the schema; null, or a struct of nulls, where it is no JSON."""
    return F.from_json(strip_fences(text), schema)


def reports(answers: DataFrame, text: str) -> DataFrame:
    """``id, severity, issue, suggestion`` of each report in the answers; an answer that is no list has none."""
    each = answers.select(F.explode(parsed(text, REPORT)).alias("r")).select("r.*")
    known = F.lower(F.coalesce("severity", F.lit("")))
    return each.withColumn("severity", F.when(known.isin(*SEVERITIES), known).otherwise(SEVERITIES[0]))


def ask_in_batches(pages: DataFrame, model: Callable[[list[dict]], str], size: int = 50) -> DataFrame:
    """Reports of a model that sees up to ``size`` (1 to 100) pages ``(id, title, content)`` at a time.

    A batch whose call fails, or whose answer can't be read, gives one warning that says so and doesn't end the others.
    """
    size = max(1, min(size, 100))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                try:
                    answer = model(part.to_dict("records"))
                    json.loads(answer.strip().removeprefix("```json").removeprefix("```").removesuffix("```"))
                except Exception as error:
                    note = f"a batch of {len(part)} pages failed: {type(error).__name__}: {error}"[:500]
                    answer = json.dumps([{"id": None, "severity": "warning", "issue": note, "suggestion": "run again"}])
                yield pd.DataFrame({"answer": [answer]})

    return reports(pages.select("id", "title", "content").mapInPandas(run, "answer string"), "answer")


ENTRY = "title string, content string, tags array<string>, links array<string>, sources array<struct<id: string, resource: string>>, description string, type string"


def compiled(answers: DataFrame, key: str, text: str) -> DataFrame:
    """``key, id, title, content, tags, links, sources, description, entry_type, error`` of answers that compile a document.

    An answer is JSON, fenced or not. Links of the body come first, then those it names; of sources with one id the first
    stays; the type is Reference where none is told. An answer without title or content is an error, and so is no JSON.
    """
    made = answers.select(
        F.col(key).alias("key"), parsed(text, ENTRY).alias("e"), F.col(text).alias("raw"), F.try_parse_json(strip_fences(text)).isNotNull().alias("read")
    )
    e, none = (lambda c: F.col(f"e.{c}")), F.array().cast("array<string>")
    sources = F.coalesce(e("sources"), F.array().cast("array<struct<id: string, resource: string>>"))
    named = F.transform(sources, lambda x: x["id"])
    first = F.filter(sources, lambda x, i: x["id"].isNull() | (F.array_position(named, x["id"]) == i + 1))
    wrong = F.when(~F.col("read") | F.col("e").isNull(), "no JSON").when(F.coalesce(strip_space(e("title")), F.lit("")) == "", "no title").when(e("content").isNull(), "no content")
    return made.select(
        F.col("key").alias(key), slug(e("title")).alias("id"), e("title").alias("title"), e("content").alias("content"),
        F.coalesce(e("tags"), none).alias("tags"), F.array_distinct(F.concat(body_links(e("content")), F.coalesce(e("links"), none))).alias("links"),
        first.alias("sources"), e("description").alias("description"),
        F.coalesce(F.nullif(strip_space(e("type")), F.lit("")), F.lit("Reference")).alias("entry_type"),
        F.when(wrong.isNotNull(), F.concat(wrong, F.lit(": "), bounded(F.coalesce("raw", F.lit("")), 200))).alias("error"),
    )
