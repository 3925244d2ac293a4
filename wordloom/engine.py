"""A knowledge base as one object: ingest, search, context, focus, lint, get and the rest, over tables in a folder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import context as C
from wordloom.operators import answers, keywords, links, search, set_join, snapshots
from wordloom.operators.clusters import leader_clusters
from wordloom.session import cut
from wordloom.sources import generations

ENTRY = (
    "id string, title string, content string, tags array<string>, links array<string>, "
    "sources array<struct<id: string, resource: string>>, created_at timestamp, updated_at timestamp, revision int, "
    "entry_type string, description string, generated_by string, scope string, extra map<string, string>, content_hash string"
)

#: A model: gets a batch of raw documents (``path, content, related``) and gives ``title, content, tags, description, entry_type``.
Model = Callable[[pd.DataFrame], pd.DataFrame]

#: Share of its words from which a text is a near copy of an entry.
NEAR_COPY = 0.85

_COMPILED = "title string, content string, tags array<string>, description string, entry_type string"


def plain_model(batch: pd.DataFrame) -> pd.DataFrame:
    """The model used without another: the first line is the title, the first sentence the description."""
    lines = batch["content"].fillna("").str.strip().str.split("\n")
    first = lines.str[0].str.lstrip("# ").str.strip()
    return pd.DataFrame(
        {
            "title": first.where(first != "", "Untitled").str.slice(0, 80),
            "content": batch["content"].fillna(""),
            "tags": [[] for _ in range(len(batch))],
            "description": first.str.split(". ", regex=False).str[0].str.slice(0, 160),
            "entry_type": "Reference",
        }
    )


#: What focus() says where nothing was found.
NOTHING = "Nothing was found about: {}"


@dataclass(frozen=True)
class Tool:
    """An operation for callers that dispatch on names: its arguments as a JSON schema, and what runs it."""

    name: str
    description: str
    schema: dict
    run: Callable[..., DataFrame | str]


class KnowledgeBase:
    """Entries of one scope below ``folder``; every change is a new generation, and readers see whole generations only."""

    def __init__(self, spark: SparkSession, folder: str, scope: str = "project", model: Model = plain_model) -> None:
        self.spark, self.folder, self.scope, self.model = spark, folder, scope, model
        self._checked: str | None = None
        if not generations.exists(spark, folder, scope):
            generations.commit(spark.createDataFrame([], ENTRY), folder, scope)

    def entries(self) -> DataFrame:
        """The entries of the current generation; the content of each generation is checked when this object first reads it.

        A generation never changes, so what was checked once, or written by this object, is only read.
        """
        name = generations.current(self.spark, self.folder, self.scope)
        if name == self._checked:
            return generations.read(self.spark, self.folder, self.scope, name)
        found = generations.read_current(self.spark, self.folder, self.scope)
        self._checked = name
        return found

    def _commit(self, entries: DataFrame) -> str:
        # written once before it replaces what it was read from
        self._checked = generations.commit(cut(entries), self.folder, self.scope)
        return self._checked

    def readiness(self) -> DataFrame:
        """One row: the scope, its generation, its entries and those that don't stand up to the rules."""
        faults = links.page_reports(self.entries()).where("severity = 'error'").select("id").distinct().agg(F.count("*").alias("faults"))
        name = generations.current(self.spark, self.folder, self.scope)
        counts = self.entries().agg(F.count("*").alias("entries")).join(F.broadcast(faults))  # a row each
        return counts.select(F.lit(self.scope).alias("scope"), F.lit(name).alias("generation"), "entries", "faults")

    def list(self, limit: int | None = None) -> DataFrame:
        """``id, title, entry_type, updated_at`` in order of id; all, or the first ``limit``."""
        rows = self.entries().select("id", "title", "entry_type", "updated_at").orderBy("id")
        return rows if limit is None else rows.limit(limit)

    def related(self, raw: DataFrame, k: int = 5, head: int | None = 500) -> DataFrame:
        """``path, related``: up to ``k`` ids of the entries best by TF-IDF for the terms of each raw document's first ``head`` bytes.

        With None its whole text counts. All terms count, so a term that very many entries hold costs a row for each of them and
        each document with it; search.best_matches() is the way for many documents.
        """
        text = F.coalesce("content", F.lit(""))
        heads = raw.select("path", F.explode(F.array_distinct(T.index_tokens(text if head is None else T.cut_bytes(text, head)))).alias("term"))
        posted = search.postings(self.entries(), "id", "content")
        total = self.entries().count()
        frequent = posted.groupBy("term").agg(F.count("*").alias("df"))
        weighed = frequent.select("term", F.log(F.lit(float(max(total, 1))) / (F.col("df") + 1)).alias("idf"))
        scores = heads.join(weighed, "term").join(posted, "term").groupBy("path", "id").agg(F.sum(F.col("tf") * F.col("idf")).alias("s"))
        n = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("s"), "id"))
        best = scores.withColumn("n", n).where(F.col("n") <= k)
        return best.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("related"))

    def compile(self, raw: DataFrame, tags: tuple[str, ...] = (), entry_type: str | None = None) -> DataFrame:
        """The entries that raw documents ``(path, content)`` become: the model's, with the caller's tags first.

        The content hash is the raw document's, for a model may word its content anew each time.
        """
        model = self.model

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                made = model(batch.drop(columns="raw_hash")).reset_index(drop=True)
                yield pd.concat([batch[["path", "raw_hash"]].reset_index(drop=True), made], axis=1)

        asked = raw.join(self.related(raw), "path", "left").select("path", "content", "related", T.content_hash("content").alias("raw_hash"))
        made = asked.mapInPandas(run, f"path string, raw_hash string, {_COMPILED}")
        listed = F.concat(F.array(*map(F.lit, tags)).cast("array<string>"), F.coalesce("tags", F.array().cast("array<string>")))
        tidy = F.array_distinct(F.filter(F.transform(listed, lambda t: T.strip_space(t)), lambda t: t != ""))
        now = F.current_timestamp()
        return made.select(
            T.slug("title").alias("id"), "title", "content", tidy.alias("tags"), T.body_links("content").alias("links"),
            F.array(F.struct(F.lit(None).cast("string").alias("id"), F.col("path").alias("resource"))).alias("sources"),
            now.alias("created_at"), now.alias("updated_at"), F.lit(1).alias("revision"),
            F.coalesce(F.nullif(F.trim(F.lit(entry_type)), F.lit("")), "entry_type").alias("entry_type"), "description",
            F.lit("model").alias("generated_by"), F.lit(self.scope).alias("scope"),
            F.create_map().cast("map<string,string>").alias("extra"), F.col("raw_hash").alias("content_hash"),
        )

    def ingest(self, raw: DataFrame, **how: Any) -> str:
        """Compile raw documents and merge them in; raw content that an entry was made of already changes nothing.

        A raw document whose words agree to NEAR_COPY with an entry's takes over the id of the most similar one (of
        equally similar ones the last id). So do those that agree with an earlier one of ``raw``, by path, that has none
        to take over; of these the last stays.
        """
        columns = [f.strip().split()[0] for f in _fields()]
        made = cut(self.compile(raw, **how)).withColumn("path", F.col("sources")[0]["resource"])
        one = made.groupBy("content_hash").agg(F.min_by(F.struct(*made.columns), F.struct("path", "id")).alias("r")).select("r.*")
        fresh = cut(one.join(self.entries().select("content_hash").distinct(), "content_hash", "left_anti"))
        texts = raw.select(T.content_hash("content").alias("content_hash"), "content").dropDuplicates(["content_hash"])
        known = self._known(texts.join(fresh.select("content_hash", "path", F.col("id").alias("own")), "content_hash"))
        named = fresh.join(known, "content_hash", "left").withColumn("id", F.coalesce("known", "id"))
        place = Window.partitionBy("known").orderBy(F.desc("path"), "content_hash")
        new = named.withColumn("n", F.row_number().over(place)).where("known IS NULL OR n = 1").select(columns)
        return self._commit(snapshots.upsert(self.entries().select(columns), new, F.current_timestamp()))

    def _known(self, texts: DataFrame) -> DataFrame:
        """``content_hash, known``: the id to take over, of ``texts(content_hash, content, path, own)`` that are near copies."""
        texts = cut(texts)
        old = self.entries().select(F.concat(F.lit("o"), "id").alias("key"), "content")
        both = texts.select(F.concat(F.lit("n"), "content_hash").alias("key"), "content").union(old)
        classes, members = set_join.set_classes(both, "key", T.normal_words("content"))
        members = cut(members)
        pairs = cut(set_join.similar_sets(classes, NEAR_COPY))
        ways = pairs.select("a", "b", "similarity").union(pairs.select("b", "a", "similarity"))
        ways = ways.union(classes.select("node", F.col("node").alias("b"), F.lit(1.0)))
        ids = members.where("key LIKE 'o%'").groupBy("node").agg(F.max("key").alias("key"))  # one of equal sets will do
        docs = members.where("key LIKE 'n%'").select(F.col("node").alias("a"), F.expr("substring(key, 2)").alias("content_hash"))
        met = docs.join(ways, "a").join(ids.withColumnRenamed("node", "b"), "b")
        best = cut(met.groupBy("content_hash").agg(F.expr("substring(max_by(key, struct(similarity, key)), 2)").alias("known")))
        rest = cut(docs.join(best, "content_hash", "left_anti"))
        side = lambda n, end: rest.select(F.col("a").alias(n), F.col("content_hash").alias(end))
        near = ways.join(side("a", "x"), "a").join(side("b", "y"), "b").where("x < y")
        nodes = cut(texts.join(rest, "content_hash", "left_semi").select(F.col("content_hash").alias("node"), F.col("path").alias("place")))
        led = leader_clusters(nodes, cut(near.select(F.col("x").alias("a"), F.col("y").alias("b"), "similarity")))
        own = texts.select(F.col("content_hash").alias("anchor"), F.col("own").alias("known"))
        grouped = led.withColumn("n", F.count("*").over(Window.partitionBy("anchor"))).where("n > 1")
        return best.union(grouped.join(own, "anchor").select(F.col("node").alias("content_hash"), "known"))

    def delete(self, *ids: str) -> str:
        return self._commit(snapshots.delete(self.entries(), self.spark.createDataFrame([(i,) for i in ids], "id string")))

    def get(self, entry_id: str) -> DataFrame:
        """The entry; an error if there is none."""
        found = self.entries().where(F.col("id") == entry_id)
        if found.isEmpty():
            raise KeyError(entry_id)
        return found

    def search(self, query: str, k: int = 5) -> DataFrame:
        """``id, title, score`` of the best entries."""
        rows = self.entries()
        text = F.concat_ws(" ", "title", F.array_join("tags", " "), "content")
        best = search.tfidf_search(rows.select("id", text.alias("text")), "id", "text", query, k)
        return best.join(rows.select("id", "title"), "id").select("id", "title", "score").orderBy(F.desc("score"), "id")

    def context(self, query: str, limit: int = 8, tags: tuple[str, ...] = ()) -> DataFrame:
        return C.context(self.entries(), query, {self.scope: 0}, tags, limit)

    def focus_query(self, topic: str) -> str:
        """The topic, or its keywords where it is long."""
        if len(topic) <= keywords.LONG:
            return topic
        row = keywords.long_text_keywords(self.spark.createDataFrame([(1, topic)], "k int, t string"), "k", "t").orderBy("place").collect()
        return " ".join(r.token for r in row) or topic

    def focus(self, topic: str, k: int = 10, model: Callable[[str, str], str] | None = None) -> DataFrame:
        """``text``: the entries that serve a topic best, in one block, or what a model makes of them.

        The entries are the best ``k`` by TF-IDF for the topic or its keywords. ``model(topic, block)`` gives the text; it isn't
        asked where nothing is found, and the text then says so.
        """
        query = self.focus_query(topic)
        if model is None:
            return C.rendered(self.context(query, k))
        best = self.search(query, k)
        blocks = C.entry_blocks(self.entries().join(F.broadcast(best.select("id", "score")), "id"))  # k rows
        ranked = blocks.join(best.select("id", "score"), "id").orderBy(F.desc("score"), "id").collect()
        text = model(topic, "\n".join(r.block for r in ranked)) if ranked else NOTHING.format(topic)
        return self.spark.createDataFrame([(text,)], "text string")

    def lint(self, model: Callable[[list[dict]], str] | None = None) -> DataFrame:
        """``id, severity, issue, target, fixable`` by the rules, and what a model finds in batches of pages if one is given."""
        found = links.page_reports(self.entries())
        if model is None:
            return found
        told = answers.ask_in_batches(self.entries(), model)
        return found.union(told.select("id", "severity", "issue", F.col("suggestion").alias("target"), F.lit(False).alias("fixable")))

    def fix_types(self) -> str:
        """Give entries without a type the type Reference."""
        typed = F.when(F.coalesce("entry_type", F.lit("")).rlike(r"(?U)\S"), F.col("entry_type")).otherwise("Reference")
        return self._commit(self.entries().withColumn("entry_type", typed))

    def catalog(self) -> DataFrame:
        return links.catalog_lines(self.entries())

    def stats(self) -> DataFrame:
        return self.entries().agg(F.count("*").alias("entries"), F.sum(F.size("tags")).alias("tags"), F.sum(F.size("links")).alias("links"))

    def catalog_document(self, carried: DataFrame | None = None) -> DataFrame:
        """The catalog as a document, with the lines carried over for pages that don't parse (see links.carried_lines())."""
        lines = links.catalog_lines(self.entries())
        return links.catalog_document(lines if carried is None else lines.union(carried.select(lines.columns)))

    def tools(self) -> dict[str, Callable[..., DataFrame | str]]:
        """The operations by name, for callers that dispatch on names."""
        return {t.name: t.run for t in self.described_tools()}

    def described_tools(self) -> list[Tool]:
        """The operations with what a caller must know of each."""
        text = {"type": "string"}
        wanted = lambda **fields: {"type": "object", "properties": fields, "required": [n for n, f in fields.items() if f == text]}
        number = {"type": "integer", "minimum": 1}
        return [
            Tool("ingest", "Compile a text into an entry and merge it in.", wanted(content=text), self._ingest_text),
            Tool("lint", "Report entries that break a rule.", wanted(), self.lint),
            Tool("focus", "Tell what serves a topic best.", wanted(topic=text, k=number), self.focus),
            Tool("search", "Rank entries by full text.", wanted(query=text, k=number), self.search),
            Tool("get", "Give one entry by its id.", wanted(entry_id=text), self.get),
        ]

    def call(self, name: str, arguments: dict) -> DataFrame | str:
        """Run a tool by name; arguments that its schema doesn't know, or that it misses, are an error."""
        tool = next((t for t in self.described_tools() if t.name == name), None)
        if tool is None:
            raise KeyError(name)
        known, needed = set(tool.schema["properties"]), set(tool.schema["required"])
        if set(arguments) - known or needed - set(arguments):
            raise ValueError(f"{name} takes {sorted(known)} and needs {sorted(needed)}")
        return tool.run(**arguments)

    def _ingest_text(self, content: str, source: str = "text") -> str:
        name = f"{source}-{hashlib.sha256(content.encode()).hexdigest()[:8]}"
        return self.ingest(self.spark.createDataFrame([(name, content)], "path string, content string"))


def _fields() -> list[str]:
    """Column definitions of ENTRY, commas within types kept."""
    out, depth = [""], 0
    for c in ENTRY:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
