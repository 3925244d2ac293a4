"""Queries that write what the tables hold, as pages, logs, transcripts, generations and indexes, and read it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import observations, search, snapshots, transcripts
from wordloom.operators.events import reshard
from wordloom.plans import dialect as D
from wordloom.plans.documents import _TFIDF, QUERY
from wordloom.plans.pages import _cut_to
from wordloom.plans.registry import Registry
from wordloom.session import cut, read_table, scratch
from wordloom.sources import generations, logs, pages
from wordloom.streaming import inbox
from wordloom.streaming import pages as changing
from wordloom.streaming.routes import route_events

registry = Registry()


def _wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page once."""
    rows = read_table(spark, sf_dir, "wiki_entries").where("id is not null")
    return rows.drop("extra").distinct().withColumn("extra", F.create_map().cast("map<string,string>"))


_ONE = "one AS (SELECT DISTINCT id, title, content, tags, links, sources, created_at, updated_at, revision, entry_type, description, generated_by, scope FROM wiki_entries WHERE id IS NOT NULL)"


def _micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def _page_columns(read: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "|")
    return read.select(
        "path", "id", "title", "content", joined("tags").alias("tags"), joined("links").alias("links"), joined("sources.resource").alias("sources"),
        "revision", "entry_type", "description", _micros("created_at").alias("created"), _micros("updated_at").alias("updated"), "parse_error",
    )


_JOINED = "coalesce(array_to_string(list_filter({0}, lambda x: x IS NOT NULL), '|'), '')"
_PAGES = f"""WITH {_ONE} SELECT id || '.md' AS path, id, coalesce(title, id) AS title, ltrim(replace(coalesce(content, ''), chr(13) || chr(10), chr(10)), chr(10)) AS content,
  {_JOINED.format("tags")} AS tags, {_JOINED.format("links")} AS links, {_JOINED.format("[x.resource for x in sources]")} AS sources, revision, entry_type, description,
  epoch_us(created_at) AS created, epoch_us(updated_at) AS updated, NULL::VARCHAR AS parse_error FROM one"""


@registry.query("page_round_trip", _PAGES)
def page_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as Markdown with a YAML block, and parsed again."""
    return _page_columns(pages.parse_pages(pages.render_pages(_wiki(spark, sf_dir))))


def _files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for each page."""
    folder = scratch(spark)
    pages.write_pages(pages.render_pages(_wiki(spark, sf_dir)), folder).write.format("noop").mode("overwrite").save()
    return folder


@registry.query("page_files", _PAGES)
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by way of a folder of files."""
    return _page_columns(pages.read_pages(spark, _files(spark, sf_dir)))


@registry.query("stream_raw_pages", f"WITH {_ONE} SELECT id || '.md' AS path, 'markdown' AS media_type FROM one")
def stream_raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of such a folder, handed on by a stream."""
    folder, out = _files(spark, sf_dir), scratch(spark)
    rows = inbox.raw_documents(spark, folder, True)
    take = lambda batch, number: batch.select("path", "media_type").write.mode("overwrite").parquet(f"{out}/batch={number}")
    inbox.drain(rows, scratch(spark), take, scratch(spark)).awaitTermination()
    found = spark.read.schema("path string, media_type string, batch int").parquet(out)
    base = folder.removeprefix("file://")
    return found.select(F.expr(f"substring(path, instr(path, '{base}/') + {len(base) + 1})").alias("path"), "media_type")


@registry.query(
    "stream_wiki_changes",
    f"""WITH {_ONE} SELECT id || '.md' AS path, CASE WHEN created_at < '2025-05-01' THEN 'changed' ELSE 'added' END AS status FROM one
UNION ALL SELECT 'gone/' || id || '.md', 'removed' FROM one WHERE revision > 2""",
)
def stream_wiki_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream over the folder finds against a generation of older pages, some of which are gone."""
    root, out, rows = scratch(spark), scratch(spark), _wiki(spark, sf_dir)
    old = rows.where(F.col("created_at") < F.lit("2025-05-01").cast("timestamp_ntz")).select("id", F.lit("older").alias("source_hash"))
    gone = rows.where("revision > 2").select(F.concat(F.lit("gone/"), "id"), F.lit("older"))
    generations.commit(old.union(gone).select(F.concat("id", F.lit(".md")).alias("path"), "source_hash"), root, "wiki", "path")
    changing.watch_pages(spark, _files(spark, sf_dir), root, "wiki", scratch(spark), out).awaitTermination()
    return spark.read.schema("path string, status string").parquet(f"{out}/batch=0")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of JSON per event; one in 97 is torn."""
    rows = read_table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.col("props").alias("payload"), F.array(F.concat(F.lit("user:"), F.col("user_id").cast("string"))).alias("affects"),
    )
    torn = F.concat(F.lit('{"id":"'), "id", F.lit('","kind":"'), "kind")
    return rows.select(F.when(F.col("id").cast("bigint") % 97 == 0, torn).otherwise(F.to_json(F.struct(*rows.columns))).alias("value"))


@registry.query(
    "event_log",
    "SELECT event_id::VARCHAR AS id, event_type AS kind, epoch_us(ts) AS at, props AS payload, 'user:' || user_id AS affects FROM events WHERE event_id % 97 <> 0",
)
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON Lines log of the events, read with its schema; torn lines are skipped."""
    path = scratch(spark)
    _lines(spark, sf_dir).write.text(path)
    return logs.read_lines(spark, path, logs.EVENT).select("id", "kind", _micros("timestamp").alias("at"), "payload", F.array_join("affects", "|").alias("affects"))


@registry.query(
    "torn_lines",
    """WITH t AS (SELECT '{"id":"' || event_id || '","kind":"' || event_type AS raw FROM events WHERE event_id % 97 = 0) SELECT raw, sha256(raw) AS digest FROM t""",
)
def torn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The torn lines of the same log, kept aside."""
    path = scratch(spark)
    _lines(spark, sf_dir).write.text(path)
    return logs.bad_lines(spark, path)


@registry.query("appended_log", "SELECT event_id::VARCHAR AS id, min(event_type) AS kind, 1::BIGINT AS lines FROM events GROUP BY event_id")
def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that a third of the events stand in, and then all of them come twice."""
    path, schema = scratch(spark), "id string, kind string"
    rows = read_table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"))
    logs.append_lines(rows.where(F.col("id").cast("bigint") % 3 == 0), path)
    logs.append_new(rows.union(rows), path, schema, "id")
    return logs.read_lines(spark, path, schema).groupBy("id").agg(F.min("kind").alias("kind"), F.count("*").alias("lines"))


_ROUTES = "SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'graph' ELSE 'episodic' END AS target, count(*) AS events, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1"


def _routed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("target").agg(F.count("*").alias("events"), F.sum("event_id").alias("ids"))


@registry.query("resharded_events", _ROUTES)
def resharded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in a folder per store."""
    path = scratch(spark)
    reshard(read_table(spark, sf_dir, "events"), "event_type", ("purchase", "signup"), path)
    return _routed(spark.read.parquet(path))


@registry.query("stream_routed_events", _ROUTES)
def stream_routed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream into two stores."""
    from wordloom.streaming.windows import read_stream

    stores = {n: scratch(spark) for n in ("graph", "episodic")}
    source = read_stream(spark, f"{sf_dir}/events.parquet")
    route_events(source, "event_type", ("purchase", "signup"), stores, scratch(spark), scratch(spark)).awaitTermination()
    schema = source.schema
    held = [spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f).withColumn("target", F.lit(n)) for n, f in stores.items()]
    return _routed(held[0].union(held[1]))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = [F.coalesce(F.size(c), F.lit(-1)).cast("string") for c in ("prompts", "tool_sequence")]
    key = F.concat_ws("@", "session_id", F.coalesce(_micros("captured_at"), F.lit(0)).cast("string"), *sizes)
    rows = read_table(spark, sf_dir, "transcript_digests").where("session_id is not null")
    return rows.select(key.alias("session_id"), "prompts", "tool_sequence").distinct()


def _transcripts(rows: DataFrame) -> DataFrame:
    """Lines of transcripts: what was said, and a line of JSON for each tool used."""
    said = rows.select("session_id", F.posexplode("prompts").alias("n", "p"))
    user = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(F.lit("user").alias("role"), F.col("p").alias("content")).alias("message")))
    used = rows.select("session_id", F.posexplode("tool_sequence").alias("n", "t"))
    rest = F.expr("substring(t, instr(t, ':') + 1)")
    name = F.when(F.col("t").startswith("Bash:"), "Bash").when(F.col("t").startswith("Skill:"), "Skill").otherwise(F.col("t"))
    given = F.struct(F.when(name == "Skill", rest).alias("skill"), F.when(name == "Bash", rest).alias("command"))
    block = F.struct(F.lit("tool_use").alias("type"), name.alias("name"), given.alias("input"))
    line = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.lit("assistant").alias("role"), F.array(block).alias("content")).alias("message")))
    return said.select("session_id", "n", user.alias("raw")).union(used.select("session_id", F.col("n") + 1_000_000, line)).toDF("session_id", "line_no", "raw")


_TOOL = f"""CASE WHEN starts_with(x, 'Bash:') THEN CASE WHEN {D.trim("substring(x, 6)")} = '' THEN 'Bash' ELSE 'Bash:' || substring(regexp_split_to_array({D.trim("substring(x, 6)")}, '{D.WS}+')[1], 1, 40) END
  WHEN starts_with(x, 'Skill:') THEN CASE WHEN {D.trim("substring(x, 7)")} = '' THEN 'Skill' ELSE 'Skill:' || {D.trim("string_split(substring(x, 7), ':')[-1]")} END ELSE x END"""
_DIGESTS = f"""WITH s AS (SELECT DISTINCT session_id || '@' || coalesce(epoch_us(captured_at), 0) || '@' || coalesce(len(prompts), -1) || '@' || coalesce(len(tool_sequence), -1) AS session_id, prompts, tool_sequence FROM transcript_digests WHERE session_id IS NOT NULL),
d AS (SELECT session_id, [substring({D.trim("x")}, 1, 1000) for x in list_filter(coalesce(prompts, []), lambda y: y IS NOT NULL AND {D.trim("y")} <> '' AND NOT starts_with({D.trim("y")}, '<'))] AS p,
  [{_TOOL} for x in list_filter(coalesce(tool_sequence, []), lambda y: y IS NOT NULL)] AS t FROM s)
SELECT session_id, array_to_string(p[:200], chr(10)) AS prompts, array_to_string(t[:2000], ' > ') AS tools,
  array_to_string([substring(x, 7) for x in list_filter(t, lambda y: starts_with(y, 'Skill:'))][:50], '|') AS skills FROM d WHERE len(p) > 0 OR len(t) > 0"""


@registry.query("session_digests", _DIGESTS)
def session_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of transcripts made of what the table's sessions said and used."""
    found = transcripts.digests(cut(_transcripts(_sessions(spark, sf_dir))))
    return found.select(
        "session_id", F.array_join("prompts", "\n").alias("prompts"), F.array_join("tool_sequence", " > ").alias("tools"),
        F.array_join("skill_uses.skill", "|").alias("skills"),
    )


@registry.query("final_messages", "SELECT project_id AS session_id, arg_max(text, doc_id) AS message FROM documents WHERE project_id IS NOT NULL AND text IS NOT NULL GROUP BY project_id")
def final_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last message of each project's documents, as lines of an assistant."""
    rows = read_table(spark, sf_dir, "documents").where("project_id is not null")
    said = F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"))
    lines = rows.select(F.col("project_id").alias("session_id"), F.col("doc_id").alias("line_no"), F.to_json(F.struct(F.lit("assistant").alias("type"), said.alias("message"))).alias("raw"))
    return transcripts.final_messages(lines)


@registry.query("indexed_search", _TFIDF)
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tfidf_search by way of a stored index."""
    path = scratch(spark)
    search.write_index(read_table(spark, sf_dir, "documents"), "doc_id", "text", path)
    return search.search_index(spark, path, QUERY, 50).select(F.col("key").alias("doc_id"), "score")


@registry.query(
    "best_matches",
    f"""WITH d AS (SELECT doc_id, {D.index_tokens("text")} AS t FROM documents),
tf AS (SELECT doc_id, term, count(*) AS c, count(*) / any_value(l) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM d) GROUP BY doc_id, term),
idf AS (SELECT term, ln((SELECT count(*) FROM d WHERE len(t) > 0) / (count(*) + 1)) AS idf FROM tf GROUP BY term),
s AS (SELECT q.doc_id AS query, tf.doc_id AS doc_id, round(sum(q.c * tf.tf * idf), 9) AS score FROM tf q JOIN tf USING (term) JOIN idf USING (term) WHERE q.doc_id % 20 = 0 GROUP BY ALL)
SELECT query, doc_id, round(score, 7) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id)::INTEGER AS place FROM s QUALIFY place <= 5""",
)
def best_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five of all documents for every document whose id is divisible by 20."""
    rows = read_table(spark, sf_dir, "documents")
    asked = rows.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), "text")
    found = search.best_matches(rows, "doc_id", "text", asked, 5)
    return found.select("query", F.col("key").alias("doc_id"), F.round("score", 7).alias("score"), "place")


def _old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _wiki(spark, sf_dir).drop("extra")
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return rows.where(F.col("created_at") < day("2025-05-01")), rows.where(F.col("updated_at") >= day("2025-04-01"))


@registry.query(
    "upserted_pages",
    f"""WITH {_ONE}, old AS (SELECT * FROM one WHERE created_at < '2025-05-01'), new AS (SELECT * FROM one WHERE updated_at >= '2025-04-01')
SELECT n.id, n.title, coalesce(o.revision + 1, 1)::INTEGER AS revision FROM new n LEFT JOIN old o ON o.id = n.id
UNION ALL SELECT id, title, revision FROM old WHERE id NOT IN (SELECT id FROM new)""",
)
def upserted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older pages with changed ones merged in."""
    old, new = _old_and_new(spark, sf_dir)
    return snapshots.upsert(old, new).select("id", "title", "revision")


@registry.query("remaining_pages", f"WITH {_ONE} SELECT id, title FROM one WHERE NOT (revision > 2)")
def remaining_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without those that are deleted by id."""
    rows = _wiki(spark, sf_dir)
    return snapshots.delete(rows, rows.where("revision > 2").select("id")).select("id", "title")


@registry.query(
    "published_scopes",
    f"""WITH {_ONE}, p AS (SELECT split_part(scope, ':', 1) AS scope, {D.trim("coalesce(content, '')")} = '' AS bad FROM one),
c AS (SELECT scope, count(*) AS entries, count(*) FILTER (bad AND scope = 'team') AS failures FROM p GROUP BY scope),
a AS (SELECT unnest(['project', 'shared', 'team', 'nowhere']) AS scope)
SELECT a.scope, coalesce(entries, 0) AS entries, coalesce(failures, 0) AS failures, CASE WHEN c.scope IS NULL THEN 'missing' WHEN failures > 0 THEN 'refused' ELSE 'published' END AS status,
  CASE WHEN c.scope IS NOT NULL AND failures = 0 THEN entries ELSE 0 END AS read FROM a LEFT JOIN c ON c.scope = a.scope""",
)
def published_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations of several scopes at once, and how many entries each reads back; pages without content don't parse in one of them."""
    root = scratch(spark)
    rows = _wiki(spark, sf_dir).drop("extra").withColumn("scope", F.substring_index("scope", ":", 1))
    bad = F.when((F.col("scope") == "team") & ~F.coalesce("content", F.lit("")).rlike(r"(?U)\S"), "no content")
    told = cut(generations.publish(rows.withColumn("parse_error", bad), root, ["project", "shared", "team", "nowhere"], "parse_error"))
    counts = None
    for scope in ("project", "shared", "team"):
        if generations.exists(spark, root, scope):
            one = generations.read_current(spark, root, scope).agg(F.count("*").alias("read")).select(F.lit(scope).alias("scope"), "read")
            counts = one if counts is None else counts.union(one)
    return told.join(counts, "scope", "left").select("scope", "entries", "failures", "status", F.coalesce("read", F.lit(0)).alias("read"))


_LESSONS = r"""m AS (SELECT doc_id, project_id, list_filter([{clean} for x in list_filter(l, lambda y: regexp_matches(y, '{starts}'))], lambda z: z <> '') AS m, whole
  FROM (SELECT doc_id, project_id, {whole} AS whole, [{line} for x in regexp_split_to_array(text, '\r\n|\r|\n')] AS l FROM documents WHERE source = 'lesson' AND text IS NOT NULL)),
r AS (SELECT doc_id, project_id, CASE WHEN len(m) > 0 THEN m WHEN whole <> '' THEN [whole] ELSE [] END AS r FROM m),
e AS (SELECT doc_id, project_id, unnest(range(0, len(r))) AS n, substring(unnest(r), 1, 2000) AS text FROM r)"""
_STARTS = r"(?i)^(?:lesson:|gotcha:|pattern:|learned:)"
_LESSONS = (
    _LESSONS.replace("{clean}", D.trim(f"regexp_replace(x, '{_STARTS}', '')")).replace("{starts}", _STARTS)
    .replace("{whole}", D.trim("text")).replace("{line}", D.trim("regexp_replace(" + D.trim("x") + ", '^[-* ]+', '')"))
)


@registry.query(
    "lesson_records",
    f"""WITH {_LESSONS}, s AS (SELECT project_id, doc_id::VARCHAR AS session_id, 'session:' || doc_id || '#' || n AS source, text, {D.fingerprint_tokens("text")} AS t FROM e)
SELECT substring(sha256(coalesce(project_id, '') || chr(0) || source || chr(0) || text), 1, 32) AS lesson_id, project_id, source, text,
  contains(text, '[GLOBAL]') OR contains(text, '[USER]') AS marked, len(list_distinct(CASE WHEN len(t) < 3 THEN [array_to_string(t, ' ')] ELSE [t[i] || ' ' || t[i+1] || ' ' || t[i+2] for i in range(1, len(t) - 1)] END))::INTEGER AS shingles FROM s""",
)
def lesson_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the lessons that lesson documents hold."""
    rows = read_table(spark, sf_dir, "documents").where("source = 'lesson' and text is not null")
    said = rows.select("project_id", F.col("doc_id").cast("string").alias("session_id"), F.col("text").alias("message"))
    made = observations.lesson_records(observations.message_lessons(said), F.current_timestamp())
    return made.select("lesson_id", "project_id", "source", "text", "marked", F.size("shingles").alias("shingles"))


@registry.query(
    "page_lessons",
    f"WITH {_ONE} SELECT scope AS project_id, 'kb:' || id AS source, substring({D.trim('content')}, 1, 2000) AS text FROM one WHERE lower(entry_type) IN ('lesson', 'gotcha')".replace(D.trim("content"), D.trim("coalesce(content, '')")),
)
def page_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lessons among the pages."""
    return observations.page_lessons(_wiki(spark, sf_dir), F.col("scope")).select("project_id", "source", "text")


@registry.query(
    "change_log",
    f"""WITH {_ONE}, l AS (SELECT DISTINCT strftime(updated_at, '%Y-%m-%d') AS date, updated_at, '* **Update**: ' || id AS line FROM one WHERE updated_at IS NOT NULL)
SELECT date, row_number() OVER (PARTITION BY date ORDER BY updated_at DESC, line)::INTEGER AS place, line FROM l UNION ALL SELECT DISTINCT date, 0, '## ' || date FROM l""",
)
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of changes that the pages' dates tell."""
    log = _wiki(spark, sf_dir).select(F.col("updated_at").alias("at"), F.concat(F.lit("* **Update**: "), "id").alias("line")).distinct()
    return observations.log_lines(log)


@registry.query(
    "entry_blocks",
    f"""WITH {_ONE}, s AS (SELECT id, title, tags, coalesce(content, '') AS s FROM one)
SELECT id, '## ' || coalesce(title, '') || ' [' || id || ']' || chr(10) || 'tags: ' || coalesce(array_to_string(list_filter(tags, lambda x: x IS NOT NULL), ', '), '') || chr(10) || chr(10) || {_cut_to(1200)} || chr(10) AS block FROM s""",
)
def entry_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a model reads them."""
    from wordloom.operators.context import entry_blocks

    return entry_blocks(_wiki(spark, sf_dir))
