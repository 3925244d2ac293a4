"""Queries over wiki pages: context, links, reports, catalog, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import answers, links, observations, snapshots
from wordloom.operators import context as C
from wordloom.plans import dialect as D
from wordloom.plans.registry import Registry
from wordloom.session import read_table

registry = Registry()

QUERY = "shadow batcher retries"
SCOPES = {"project": 0, "shared": 1, "team": 2}


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "wiki_entries")


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the kind of their scope in place of its name."""
    return _pages(spark, sf_dir).withColumn("scope", F.substring_index("scope", ":", 1))


def _counts(text: str, weight: int) -> str:
    low = f"lower(coalesce({text}, ''))"
    return " + ".join(f"{weight} * (length({low}) - length(replace({low}, '{w}', ''))) / {len(w)}" for w in QUERY.split())


_SNIPPET = f"array_to_string(list_filter(regexp_split_to_array(CASE WHEN {D.trim("coalesce(description, '')")} <> '' THEN description ELSE coalesce(content, '') END, '{D.WS}+'), lambda w: w <> ''), ' ')"


def _cut_to(limit: int) -> str:
    """Bytes of ``s`` without a character cut in two: the longest prefix of whole characters."""
    return f"substring(s, 1, len(list_filter(range(1, least(length(s), {limit}) + 1), lambda i: octet_length(encode(substring(s, 1, i))) <= {limit})))"


_CUT = _cut_to(360)

_CONTEXT = f"""WITH e AS (SELECT split_part(scope, ':', 1) AS scope, id, title, description, content,
  {_counts("title", 4)} + {_counts("description", 2)} + {_counts("content", 1)} AS score,
  sha256(coalesce(title, '') || chr(0) || coalesce(content, '')) AS hash FROM wiki_entries WHERE id IS NOT NULL),
s AS (SELECT *, CASE scope WHEN 'project' THEN 0 WHEN 'shared' THEN 1 ELSE 2 END AS priority FROM e WHERE scope IN ('project', 'shared', 'team') AND score > 0),
i AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY priority, score DESC, id, hash) = 1),
h AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY hash ORDER BY priority, score DESC, id, hash) = 1),
b AS (SELECT scope, id, title, {_SNIPPET} AS s, score::DOUBLE AS score FROM h ORDER BY score DESC, priority, id LIMIT 32)
SELECT scope, id, title, {_CUT} AS snippet, score FROM b"""


@registry.query("context", _CONTEXT)
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.context(_scoped(spark, sf_dir), QUERY, SCOPES, limit=32, candidates=512)


@registry.query(
    "snippets",
    f"""WITH s AS (SELECT DISTINCT id, revision, {_SNIPPET} AS s FROM wiki_entries) SELECT id, revision, {_CUT} AS snippet FROM s""",
)
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("id", "revision", T.snippet("description", "content").alias("snippet")).distinct()


@registry.query(
    "slugs",
    f"""WITH s AS (SELECT DISTINCT id, title FROM wiki_entries WHERE title IS NOT NULL),
t AS (SELECT id, array_to_string(list_filter(regexp_split_to_array(lower(title), '[^{D.ALNUM}]'), lambda x: x <> ''), '-') AS slug FROM s)
SELECT id, CASE WHEN slug IN ({D.quoted(T.DEVICE_NAMES)}) THEN slug || '_' ELSE slug END AS slug,
  NOT (starts_with(id, '/') OR regexp_matches(id, '[\\\\:]') OR len(list_filter(string_split(id, '/'), lambda x: x = '' OR regexp_matches(x, '[. ]$')
       OR lower(split_part(x, '.', 1)) IN ({D.quoted(T.DEVICE_NAMES)}))) > 0) AS safe FROM t""",
)
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).where("title is not null").select("id", "title").distinct()
    return rows.select("id", T.slug("title").alias("slug"), T.is_safe_path("id").alias("safe"))


_LINKS = r"""links_of AS (SELECT DISTINCT id, target FROM (SELECT id, unnest(list_concat(
  regexp_extract_all(regexp_replace(coalesce(content, ''), '`[^`\n]*`', '', 'g'), '\[[^\[\]]*\]\(/+([^\s()<>]+)\.md\)', 1), coalesce(links, []))) AS target
  FROM wiki_entries WHERE id IS NOT NULL) WHERE target IS NOT NULL)"""


@registry.query("page_links", f"WITH {_LINKS} SELECT * FROM links_of")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.page_links(_pages(spark, sf_dir))


_BROKEN = "SELECT id, target FROM links_of l WHERE NOT EXISTS (SELECT 1 FROM wiki_entries w WHERE w.id = l.target)"
_ORPHANS = """SELECT DISTINCT id FROM wiki_entries w WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM links_of l WHERE l.target = w.id)
  AND (SELECT count(DISTINCT id) FROM wiki_entries) > 1"""


@registry.query("broken_links", f"WITH {_LINKS} {_BROKEN}")
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.broken_links(_pages(spark, sf_dir))


@registry.query("orphan_pages", f"WITH {_LINKS} {_ORPHANS}")
def orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.orphan_pages(_pages(spark, sf_dir))


@registry.query(
    "page_reports",
    f"""WITH {_LINKS}, p AS (SELECT DISTINCT id, entry_type, description FROM wiki_entries WHERE id IS NOT NULL)
SELECT id, 'error' AS severity, 'no type' AS issue, NULL AS target, true AS fixable FROM p WHERE {D.trim("coalesce(entry_type, '')")} = ''
UNION ALL SELECT id, 'warning', 'no description', NULL, false FROM p WHERE {D.trim("coalesce(description, '')")} = ''
UNION ALL SELECT id, 'warning', 'broken link', target, false FROM ({_BROKEN})
UNION ALL SELECT id, 'warning', 'orphan page', NULL, false FROM ({_ORPHANS})""",
)
def page_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.page_reports(_pages(spark, sf_dir))


@registry.query(
    "catalog",
    f"""SELECT DISTINCT coalesce(entry_type, 'Uncategorized') AS section, lower(coalesce(title, '')) AS sort_key,
  '* [' || coalesce(title, '') || '](/' || id || '.md)' || CASE WHEN {D.trim("coalesce(description, '')")} = '' THEN '' ELSE ' - ' || {D.trim("description")} END AS line
FROM wiki_entries WHERE id IS NOT NULL""",
)
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.catalog_lines(_pages(spark, sf_dir))


@registry.query(
    "page_stats",
    """SELECT count(*) AS entries, sum(len(tags))::BIGINT AS tags, sum(len(links))::BIGINT AS links, max(revision) AS revision
FROM (SELECT DISTINCT id, tags, links, revision FROM wiki_entries)""",
)
def page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _pages(spark, sf_dir).select("id", "tags", "links", "revision").distinct()
    return one.agg(F.count("*").alias("entries"), F.sum(F.size("tags")).alias("tags"), F.sum(F.size("links")).alias("links"), F.max("revision").alias("revision"))


_OLD, _NEW = "2025-05-01", "2025-05-15"


@registry.query(
    "reconciled",
    f"""WITH h AS (SELECT DISTINCT id, created_at, updated_at, sha256(coalesce(title, '')) AS t, sha256(coalesce(content, '')) AS c FROM wiki_entries WHERE id IS NOT NULL),
o AS (SELECT id, t || CASE WHEN updated_at < '{_OLD}' THEN c ELSE '' END AS h FROM h WHERE created_at < '{_OLD}'),
n AS (SELECT id, t || c AS h FROM h WHERE updated_at >= '2025-03-15' OR created_at >= '{_NEW}')
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'changed' ELSE 'same' END AS status
FROM o FULL JOIN n ON o.id = n.id""",
)
def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two states of the wiki: pages of before a day, whose later text wasn't known, and recent ones."""
    hashed = [F.sha2(F.coalesce(c, F.lit("")), 256).alias(n) for c, n in (("title", "t"), ("content", "c"))]
    rows = _pages(spark, sf_dir).where("id is not null").select("id", "created_at", "updated_at", *hashed).distinct()
    known = F.when(F.col("updated_at") < F.lit(_OLD).cast("timestamp_ntz"), F.col("c")).otherwise("")
    old = rows.where(F.col("created_at") < F.lit(_OLD).cast("timestamp_ntz")).select("id", F.concat("t", known).alias("h"))
    recent = (F.col("updated_at") >= F.lit("2025-03-15").cast("timestamp_ntz")) | (F.col("created_at") >= F.lit(_NEW).cast("timestamp_ntz"))
    return snapshots.reconcile(old, rows.where(recent).select("id", F.concat("t", "c").alias("h")), "id", "h")


@registry.query(
    "generations",
    """WITH r AS (SELECT DISTINCT scope, id, sha256(coalesce(title, '') || chr(10) || coalesce(content, '')) AS d FROM wiki_entries WHERE id IS NOT NULL),
b AS (SELECT scope, substring(sha256(id), 1, 4) AS b, sha256(string_agg(d, '' ORDER BY id, d)) AS h, count(*) AS n FROM r GROUP BY ALL)
SELECT scope, sha256(coalesce(scope, '') || chr(10) || string_agg(h, '' ORDER BY b)) AS generation, sum(n)::BIGINT AS entries FROM b GROUP BY scope""",
)
def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    return snapshots.generation(_pages(spark, sf_dir), "scope", "id", digest)


@registry.query(
    "rendered_context",
    f"""WITH c AS ({_CONTEXT}) SELECT '--- context ---' || chr(10) || string_agg('[' || scope || ':' || id || '] ' || coalesce(title, '') || chr(10) || snippet || chr(10), '' ORDER BY score DESC, id)
  || '--- end of context ---' || chr(10) AS text FROM c""",
)
def rendered_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rendered(context(spark, sf_dir))


@registry.query(
    "title_overlap",
    f"""WITH w AS (SELECT DISTINCT id, list_distinct({D.normal_words("title")}) AS a, list_distinct({D.normal_words("description")}) AS b FROM wiki_entries WHERE id IS NOT NULL)
SELECT id, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 9) END::DOUBLE AS overlap FROM w""",
)
def title_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far title and description of each page have the same words; without any they do."""
    rows = _pages(spark, sf_dir).where("id is not null").select("id", "title", "description").distinct()
    return rows.select("id", F.round(T.overlap_ratio(T.normal_words("title"), T.normal_words("description"), 1.0), 9).alias("overlap"))


_TAG = "cache"


@registry.query("tagged_context", _CONTEXT.replace("FROM wiki_entries WHERE id IS NOT NULL", f"FROM wiki_entries WHERE id IS NOT NULL AND list_contains(tags, '{_TAG}')", 1))
def tagged_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context from the pages with a tag only."""
    return C.context(_scoped(spark, sf_dir), QUERY, SCOPES, (_TAG,), limit=32, candidates=512)


_LINE = f"""'* [' || coalesce(title, '') || '](/' || id || '.md)' || CASE WHEN {D.trim("coalesce(description, '')")} = '' THEN '' ELSE ' - ' || {D.trim("description")} END"""


@registry.query(
    "catalog_document",
    f"""WITH l AS (SELECT DISTINCT coalesce(entry_type, 'Uncategorized') AS section, lower(coalesce(title, '')) AS sort_key, {_LINE} AS line FROM wiki_entries WHERE id IS NOT NULL)
SELECT section, row_number() OVER (PARTITION BY section ORDER BY sort_key, line)::INTEGER AS place, line FROM l UNION ALL SELECT DISTINCT section, 0, '## ' || section FROM l""",
)
def catalog_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole catalog, headings and lines by place."""
    return links.catalog_document(links.catalog_lines(_pages(spark, sf_dir)))


@registry.query(
    "carried_lines",
    f"""WITH l AS (SELECT DISTINCT id, title, coalesce(entry_type, 'Uncategorized') AS section, {_LINE} AS line FROM wiki_entries
  WHERE id IS NOT NULL AND {D.trim("coalesce(content, '')")} = '' AND regexp_matches({_LINE}, '^\\* \\[[^\\]\\n]*\\]\\(/[^)\\n]+\\.md\\)'))
SELECT section, lower(coalesce(title, '')) AS sort_key, line FROM l""",
)
def carried_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's lines of pages that have lost their content."""
    rows = _pages(spark, sf_dir).where("id is not null").select("id", "title", "content", "entry_type", "description").distinct()
    lines = links.catalog_lines(rows).withColumn("n", F.xxhash64("section", "line"))
    plain = lines.where(F.col("line").rlike(r"^\* \[[^\]\n]*\]\(/[^)\n]+\.md\)"))
    lost = rows.where(~F.coalesce("content", F.lit("")).rlike(r"(?U)\S")).select(F.col("id").alias("target"))
    return links.carried_lines(plain, lost)


@registry.query(
    "heading_reports",
    rf"""WITH l AS (SELECT id, [{D.trim("x")} for x in regexp_split_to_array(content, '\r\n|\r|\n')] AS l FROM (SELECT DISTINCT id, content FROM wiki_entries WHERE content IS NOT NULL)),
h AS (SELECT id, unnest([{D.trim("substring(x, 4)")} for x in list_filter(l, lambda y: starts_with(y, '## '))]) AS heading FROM l)
SELECT id, heading FROM h WHERE NOT regexp_full_match(heading, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')""",
)
def heading_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of the second level that are no dates, as a change log must not have."""
    rows = _pages(spark, sf_dir).where("content is not null").select("id", "content").distinct()
    return links.log_heading_reports(rows, "content").select("id", "heading")


@registry.query(
    "block_reports",
    r"""WITH b AS (SELECT id, regexp_extract(coalesce(content, ''), '(?s)^\s*---(.*?)\n---', 1) AS b FROM (SELECT DISTINCT id, content FROM wiki_entries))
SELECT id FROM b WHERE len(list_filter(regexp_split_to_array(b, '\r\n|\r|\n'), lambda x: regexp_matches(x, '\S') AND NOT starts_with(regexp_replace(x, '^\s+|\s+$', '', 'g'), 'owner'))) > 0""",
)
def block_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose block holds a key other than the owner."""
    return links.index_block_reports(_pages(spark, sf_dir).select("id", "content").distinct(), "content", "owner").select("id")


@registry.query(
    "compiled_answers",
    f"""WITH o AS (SELECT DISTINCT id, title, content, tags, sources, description, entry_type FROM wiki_entries WHERE id IS NOT NULL)
SELECT id AS source, title, content, coalesce(array_to_string(tags, '|'), '') AS tags, CASE WHEN {D.trim("coalesce(entry_type, '')")} = '' THEN 'Reference' ELSE {D.trim("entry_type")} END AS entry_type,
  (coalesce(len(list_distinct([s.id for s in sources])), 0) + 2 * coalesce(len(list_filter(sources, lambda s: s.id IS NULL)), 0))::INTEGER AS sources,
  CASE WHEN {D.trim("coalesce(title, '')")} = '' THEN 'no title' WHEN content IS NULL THEN 'no content' END AS error FROM o""",
)
def compiled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages given as a model's fenced JSON, each with its sources twice, and read as entries."""
    rows = _pages(spark, sf_dir).where("id is not null").select("id", "title", "content", "tags", "sources", "description", F.col("entry_type").alias("type")).distinct()
    twice = F.concat(F.coalesce("sources", F.array().cast("array<struct<id: string, resource: string>>")), F.coalesce("sources", F.array().cast("array<struct<id: string, resource: string>>")))
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct("title", "content", "tags", twice.alias("sources"), "description", "type")), F.lit("\n```"))
    made = answers.compiled(rows.select(F.col("id").alias("source"), answer.alias("answer")), "source", "answer")
    return made.select("source", "title", "content", F.array_join("tags", "|").alias("tags"), "entry_type", F.size("sources").alias("sources"), F.substring_index("error", ":", 1).alias("error"))


@registry.query(
    "source_labels",
    f"""WITH p AS (SELECT DISTINCT id, sources FROM wiki_entries WHERE id IS NOT NULL AND len(sources) > 0),
e AS (SELECT id, unnest(range(1, len(sources) + 1)) AS n, unnest(sources) AS s FROM p),
u AS (SELECT id, n, s.resource AS resource, CASE WHEN s.id <> '' AND NOT regexp_matches(s.id, '[\\s\\[\\]^]') THEN s.id END AS own,
  array_to_string(list_filter(regexp_split_to_array(lower(s.resource), '[^{D.ALNUM}]'), lambda x: x <> ''), '-') AS slug FROM e),
t AS (SELECT id, n, coalesce(own, CASE WHEN slug = '' THEN 'source' WHEN slug IN ({D.quoted(T.DEVICE_NAMES)}) THEN slug || '_' ELSE slug END) AS base, own IS NULL AS made FROM u),
r AS (SELECT id, n, base, row_number() OVER (PARTITION BY id, lower(base) ORDER BY made, n) AS k FROM t)
SELECT id, string_agg(CASE WHEN k = 1 THEN base ELSE base || '-' || k END, '|' ORDER BY n) AS labels FROM r GROUP BY id""",
)
def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of each page's sources."""
    rows = _pages(spark, sf_dir).where("id is not null and size(sources) > 0").select("id", "sources").distinct()
    return observations.with_source_labels(rows).select("id", F.array_join("sources.id", "|").alias("labels"))
