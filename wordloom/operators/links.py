"""The link graph of pages: links, broken links, orphans, conformance reports and the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import body_links, lines, strip_space


def page_links(pages: DataFrame) -> DataFrame:
    """``id, target`` of each link of a page: the body's, then the declared ones; each target once a page."""
    declared = F.coalesce("links", F.array().cast("array<string>"))
    every = F.array_distinct(F.array_compact(F.concat(body_links("content"), declared)))
    return pages.where(F.col("id").isNotNull()).select("id", F.explode(every).alias("target")).distinct()


def broken_links(pages: DataFrame) -> DataFrame:
    """``id, target`` of the links whose target is no page."""
    known = pages.select(F.col("id").alias("target")).distinct()
    return page_links(pages).join(known, "target", "left_anti").select("id", "target")


def orphan_pages(pages: DataFrame) -> DataFrame:
    """``id`` of the pages that no page links to (a link to itself counts); none where there is one page at most."""
    ids = pages.where(F.col("id").isNotNull()).select("id").distinct()
    linked = page_links(pages).select(F.col("target").alias("id")).distinct()
    several = ids.limit(2).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(1).alias("one"))
    return ids.join(linked, "id", "left_anti").join(F.broadcast(several), F.lit(True)).select("id")


def _blank(c: str) -> Column:
    return ~F.coalesce(F.col(c), F.lit("")).rlike(r"(?U)\S")


def page_reports(pages: DataFrame, parse_error: str | None = None) -> DataFrame:
    """``id, severity, issue, target, fixable`` of each page that breaks a rule.

    A page that can't be parsed is an error and reports nothing else; no type is a fixable error, no description a
    warning, and so are a link to no page and a page that nothing links to.
    """
    good = pages.where(F.col(parse_error).isNull()) if parse_error else pages
    none = F.lit(None).cast("string")
    report = lambda df, level, issue, fixable=False, target=none: df.select(
        "id", F.lit(level).alias("severity"), F.lit(issue).alias("issue"), target.alias("target"), F.lit(fixable).alias("fixable")
    )
    one = good.where(F.col("id").isNotNull()).select("id", "entry_type", "description").distinct()
    issues = F.array_compact(
        F.array(
            F.when(_blank("entry_type"), F.struct(F.lit("error").alias("severity"), F.lit("no type").alias("issue"), F.lit(True).alias("fixable"))),
            F.when(_blank("description"), F.struct(F.lit("warning").alias("severity"), F.lit("no description").alias("issue"), F.lit(False).alias("fixable"))),
        )
    )
    plain = one.select("id", F.explode(issues).alias("i")).select("id", "i.severity", "i.issue", none.alias("target"), "i.fixable")
    found = plain.union(report(broken_links(good), "warning", "broken link", target=F.col("target")))
    found = found.union(report(orphan_pages(good), "warning", "orphan page"))
    if parse_error:
        found = found.union(report(pages.where(F.col(parse_error).isNotNull()), "error", "does not parse"))
    return found


def catalog_lines(pages: DataFrame) -> DataFrame:
    """``section, sort_key, line`` of the catalog: a line per page, by type (none: Uncategorized) and lower-case title."""
    title = F.coalesce("title", F.lit(""))
    about = F.when(_blank("description"), "").otherwise(F.concat(F.lit(" - "), strip_space("description")))
    line = F.concat(F.lit("* ["), title, F.lit("](/"), "id", F.lit(".md)"), about)
    section = F.coalesce("entry_type", F.lit("Uncategorized"))
    return pages.where(F.col("id").isNotNull()).select(section.alias("section"), F.lower(title).alias("sort_key"), line.alias("line")).distinct()


def carried_lines(existing: DataFrame, failed: DataFrame) -> DataFrame:
    """``section, sort_key, line``: the first line of an existing catalog for each page that failed to parse.

    ``existing(n, section, line)`` are its lines in order; ``failed(target)`` are paths without ``.md``.
    """
    parts = r"^\s*\* \[(.*?)\]\(/(.+?)\.md\)"
    entry = existing.select("n", "section", "line", F.regexp_extract("line", parts, 1).alias("title"), F.regexp_extract("line", parts, 2).alias("target"))
    kept = entry.where("target <> ''").join(failed.select("target").distinct(), "target", "left_semi")
    first = kept.groupBy("target").agg(F.min_by(F.struct("section", "title", "line"), "n").alias("r"))
    return first.select("r.section", F.lower("r.title").alias("sort_key"), "r.line")


def log_heading_reports(logs: DataFrame, text: str) -> DataFrame:
    """The given rows' ``heading`` for each ``## `` heading that isn't shaped like ``YYYY-MM-DD``."""
    heads = F.transform(F.filter(F.transform(lines(text), strip_space), lambda x: x.startswith("## ")), lambda x: strip_space(F.substring(x, F.lit(4), F.length(x))))
    return logs.select("*", F.explode(F.filter(heads, lambda h: ~h.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"))).alias("heading"))


def index_block_reports(pages: DataFrame, text: str, allowed: str = "version") -> DataFrame:
    """The rows whose text opens with a ``---`` block that holds a key other than those that begin with ``allowed``."""
    block = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)^\s*---(.*?)\n---", 1)
    return pages.where(F.exists(lines(block), lambda x: x.rlike(r"\S") & ~strip_space(x).startswith(allowed)))


def catalog_document(lines: DataFrame) -> DataFrame:
    """``section, place, line``: the catalog as its lines stand: a heading per section (place 0), then its lines by title.

    ``lines(section, sort_key, line)`` are those of catalog_lines(), carried_lines() or both. In order of section and place
    they are the document, which so may be written by many tasks.
    """
    every = lines.select("section", "sort_key", "line").distinct()
    place = F.row_number().over(Window.partitionBy("section").orderBy("sort_key", "line"))
    heads = every.select("section").distinct().select("section", F.lit(0).alias("place"), F.concat(F.lit("## "), "section").alias("line"))
    return heads.union(every.select("section", place.alias("place"), "line"))
