"""Lessons observed in messages and pages, as records with ids and fingerprints; footnote labels; log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators.events import not_in

#: Marks of lessons that were handled at once.
IMMEDIATE_MARKS = ("[GLOBAL]", "[USER]")
#: Types of pages that are lessons.
LESSON_TYPES = ("lesson", "gotcha")


def joined_id(*parts: Column | str, length: int = 32) -> Column:
    """The first hexadecimal digits of the SHA-256 of the parts, joined by NUL; a null part is empty."""
    columns = [F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")).cast("string") for p in parts]
    return F.substring(F.sha2(F.concat_ws("\0", *columns), 256), 1, length)


def message_lessons(messages: DataFrame) -> DataFrame:
    """``project_id, session_id, source, text, tags`` of ``messages(project_id, session_id, message)``, a row per lesson."""
    each = messages.select("project_id", "session_id", F.posexplode(T.lessons("message")).alias("n", "text"))
    source = F.concat(F.lit("session:"), F.coalesce("session_id", F.lit("")), F.lit("#"), F.col("n").cast("string"))
    return each.select("project_id", "session_id", source.alias("source"), "text", T.hashtags("text").alias("tags"))


def page_lessons(pages: DataFrame, project: Column, limit: int | None = 2000) -> DataFrame:
    """The same of pages whose type is a lesson's, in any case, cut to ``limit`` characters; None cuts nothing."""
    text = T.strip_space(F.coalesce("content", F.lit("")))
    typed = pages.where(F.lower("entry_type").isin(*LESSON_TYPES) & F.col("id").isNotNull())
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    return typed.select(
        project.alias("project_id"), F.lit(None).cast("string").alias("session_id"), F.concat(F.lit("kb:"), "id").alias("source"),
        (text if limit is None else F.substring(text, 1, limit)).alias("text"), tags.alias("tags"),
    )


def lesson_records(observations: DataFrame, now: Column) -> DataFrame:
    """Observations with ``lesson_id``, ``recorded_at``, ``marked`` and ``shingles``; of equal ids one row."""
    marked = F.lit(False)
    for mark in IMMEDIATE_MARKS:
        marked = marked | F.col("text").contains(mark)
    tokens = observations.withColumn("tokens", T.fingerprint_tokens("text"))
    made = tokens.select(
        joined_id("project_id", "source", "text").alias("lesson_id"), "project_id", "session_id", "source", now.alias("recorded_at"),
        "text", "tags", marked.alias("marked"), T.joined_shingles(F.col("tokens"), 3).alias("shingles"),
    )
    return made.dropDuplicates(["lesson_id"])


def new_records(records: DataFrame, known: DataFrame, key: str = "lesson_id") -> DataFrame:
    """The records whose key isn't known yet."""
    return not_in(records, known, key)


def source_labels(sources: Column) -> Column:
    """A label for each of a page's sources (``id, resource``), unique within the page whatever the case.

    An id that can be a label is kept where it stands first; where it stands again it gets the first free number behind it. All
    others are named by the slug of their resource (or ``source``), numbered too where that is taken. Null stays null.
    """
    usable = lambda x: x.isNotNull() & (x != "") & ~x.rlike(r"(?U)[\s\[\]^]")
    lower = F.transform(sources, lambda s: F.when(usable(s["id"]), F.lower(s["id"])))
    derived = lambda s: F.when(usable(T.slug(s["resource"])), T.slug(s["resource"])).otherwise("source")
    # in order of their claim: ids at their first place, repeated ids, then derived names
    claims = F.array_sort(
        F.transform(
            sources,
            lambda s, i: F.struct(
                F.when(~usable(s["id"]), 2).when(F.array_position(lower, F.lower(s["id"])) == i + 1, 0).otherwise(1).alias("turn"),
                i.alias("place"), F.when(usable(s["id"]), s["id"]).otherwise(derived(s)).alias("base"),
            ),
        )
    )

    def free(taken: Column, base: Column) -> Column:
        """Of base, base-2, base-3, ... the first that isn't taken; one of as many as are taken and one more is free."""
        named = F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda n: F.when(n == 1, base).otherwise(F.concat(base, F.lit("-"), n.cast("string"))))
        return F.get(F.filter(named, lambda c: ~F.array_contains(taken, F.lower(c))), 0)

    start = F.struct(F.array().cast("array<string>").alias("taken"), F.array().cast("array<struct<place: int, label: string>>").alias("told"))

    def claim(held: Column, c: Column) -> Column:
        label = free(held["taken"], c["base"])
        told = F.concat(held["told"], F.array(F.struct(c["place"].alias("place"), label.alias("label"))))
        return F.struct(F.concat(held["taken"], F.array(F.lower(label))).alias("taken"), told.alias("told"))

    return F.aggregate(claims, start, claim, lambda held: F.transform(F.array_sort(held["told"]), lambda t: t["label"]))


def with_source_labels(pages: DataFrame) -> DataFrame:
    """Pages whose ``sources`` all have an id, unique within the page; ids that can be footnote labels are kept."""
    named = pages.withColumn("__labels", source_labels(F.col("sources")))
    joined = F.transform(F.arrays_zip(F.col("sources").alias("s"), F.col("__labels").alias("l")), lambda x: F.struct(x["l"].alias("id"), x["s"]["resource"].alias("resource")))
    return named.withColumn("sources", joined).drop("__labels")


def log_lines(log: DataFrame) -> DataFrame:
    """``date, place, line`` of a change log's ``log(at, line)``: the newest day first, within a day the newest line first.

    Place 0 is the day's heading. The lines of one day are ordered within it.
    """
    dated = log.select(F.date_format("at", "yyyy-MM-dd").alias("date"), "at", "line").where("date is not null")
    within = Window.partitionBy("date").orderBy(F.desc("at"), "line")
    lines = dated.select("date", F.row_number().over(within).alias("place"), "line")
    heads = dated.select("date").distinct().select("date", F.lit(0).alias("place"), F.concat(F.lit("## "), "date").alias("line"))
    return heads.union(lines).orderBy(F.desc("date"), "place")
