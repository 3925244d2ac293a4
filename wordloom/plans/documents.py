"""Queries over documents: ranking, copies, keywords, lessons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import keywords, search, set_join, workflows
from wordloom.operators.observations import IMMEDIATE_MARKS
from wordloom.plans import dialect as D
from wordloom.plans.registry import Registry
from wordloom.session import cut, read_table

registry = Registry()

QUERY = "stale lease retry snapshot lease Worker"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


_TFIDF = f"""
WITH d AS (SELECT doc_id, {D.index_tokens("text")} AS t FROM documents),
q AS (SELECT unnest({D.index_tokens(f"'{QUERY}'")}) AS term),
n AS (SELECT count(*) AS n FROM d WHERE len(t) > 0),
tf AS (SELECT doc_id, term, count(*) / any_value(l) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM d) GROUP BY ALL),
idf AS (SELECT term, ln(any_value(n) / (count(*) + 1)) AS idf FROM tf, n GROUP BY term)
SELECT doc_id, round(sum(tf * idf), 9) AS score FROM q JOIN tf USING (term) JOIN idf USING (term)
GROUP BY doc_id ORDER BY sum(tf * idf) DESC, doc_id LIMIT 50
"""


@registry.query("tfidf_search", _TFIDF)
def tfidf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.tfidf_search(_documents(spark, sf_dir), "doc_id", "text", QUERY, 50)


@registry.query(
    "term_frequencies",
    f"""WITH d AS (SELECT doc_id, {D.index_tokens("text")} AS t FROM documents),
e AS (SELECT doc_id, unnest(t) AS term FROM d)
SELECT term, count(DISTINCT doc_id) AS df, count(*)::BIGINT AS occurrences FROM e GROUP BY term""",
)
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.document_frequencies(_documents(spark, sf_dir), "doc_id", "text")


@registry.query(
    "postings",
    f"""WITH d AS (SELECT doc_id, {D.index_tokens("text")} AS t FROM documents),
e AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d)
SELECT doc_id, term, round(count(*) / any_value(n), 9) AS tf FROM e GROUP BY doc_id, term""",
)
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.postings(_documents(spark, sf_dir), "doc_id", "text")
    return found.select("doc_id", "term", F.round("tf", 9).alias("tf"))


@registry.query(
    "exact_copies",
    f"""SELECT sha256(array_to_string({D.normal_words("text")}, ' ')) AS hash, min(doc_id) AS first_id, count(*) AS n
FROM documents WHERE len({D.normal_words("text")}) > 0 GROUP BY 1 HAVING count(*) > 1""",
)
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that agree but for white space and case."""
    rows = _documents(spark, sf_dir).where(F.col("text").rlike(r"(?U)\S")).select("doc_id", T.content_hash("text").alias("hash"))
    return rows.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


_SETS = """, c AS (SELECT min(doc_id) AS node, s FROM (SELECT doc_id, list_sort(list_distinct(w)) AS s FROM w) WHERE len(s) > 0 GROUP BY s),
p AS (SELECT a.node AS a, b.node AS b, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) AS n
      FROM c a JOIN c b ON a.node < b.node AND len(a.s) >= {t} * len(b.s) AND len(b.s) >= {t} * len(a.s))
SELECT a, b, round(i / (n - i), 9) AS similarity FROM p WHERE i / (n - i) >= {t}"""


@registry.query("near_copies", f"WITH w AS (SELECT doc_id, {D.normal_words('text')} AS w FROM documents)" + _SETS.format(t=0.85))
def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents whose word sets agree to 0.85, between representatives of equal sets."""
    classes, _ = set_join.set_classes(_documents(spark, sf_dir), "doc_id", T.normal_words("text"))
    pairs = set_join.similar_sets(classes, 0.85)
    return pairs.select("a", "b", F.round("similarity", 9).alias("similarity"))


_CLASS = """, s AS (SELECT doc_id, list_sort(list_distinct(w)) AS s FROM w)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class_id FROM s WHERE len(s) > 0"""


@registry.query("copy_classes", f"WITH w AS (SELECT doc_id, {D.normal_words('text')} AS w FROM documents)" + _CLASS)
def copy_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The representative of each document's class of equal word sets (see near_copies)."""
    _, members = set_join.set_classes(_documents(spark, sf_dir), "doc_id", T.normal_words("text"))
    return members.select(F.col("key").alias("doc_id"), F.col("node").alias("class_id"))


_GRAM_RUNS = f"""WITH t AS (SELECT doc_id, {D.fingerprint_tokens("text")} AS t FROM documents WHERE @ROWS AND text IS NOT NULL),
w AS (SELECT doc_id, CASE WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
      ELSE [t[i] || ' ' || t[i+1] || ' ' || t[i+2] for i in range(1, len(t) - 1)] END AS w FROM t)"""
_GRAMS = _GRAM_RUNS.replace("@ROWS", "source = 'lesson'")


def _lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where("source = 'lesson'")


@registry.query("similar_lessons", _GRAMS + _SETS.format(t=0.6))
def similar_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of lessons whose runs of three words agree to 0.6, between representatives of equal ones."""
    pairs, _ = workflows.similar_lessons(_lessons(spark, sf_dir), "doc_id", "text")
    return pairs.select("a", "b", F.round("similarity", 9).alias("similarity"))


_FIRSTS = """b AS (SELECT w.doc_id, list_sort(list_distinct(w)) AS s, d.captured_at FROM w JOIN documents d USING (doc_id)),
c AS (SELECT s, first(doc_id ORDER BY captured_at NULLS FIRST, doc_id) AS node, first(captured_at ORDER BY captured_at NULLS FIRST, doc_id) AS since FROM b WHERE len(s) > 0 GROUP BY s)"""
_NEAR = """SELECT a, b FROM (SELECT x.node AS a, y.node AS b, len(list_intersect(x.s, y.s)) AS i, len(x.s) + len(y.s) AS n FROM c x JOIN c y ON x.node < y.node) WHERE i / (n - i) >= 0.6"""


def _clusters(grams: str, reasoned: bool) -> str:
    """Clusters of the lessons of ``grams`` (CTEs that begin with WITH) and their facts."""
    tags = "list_distinct(list_filter(string_split(g.tags, ' '), lambda x: x <> ''))"
    names = lambda of: "len(list_filter(t, lambda x: x IN (" + D.quoted(of) + "))) > 0"
    return f"""{grams.replace("WITH ", "WITH RECURSIVE ", 1)}, {_FIRSTS}, {D.led("SELECT node, since FROM c", _NEAR)},
tt AS ({_TAGS}), pt AS ({_PORTABLE}),
m AS (SELECT b.doc_id, led.anchor, d.project_id, pt.names_tool, pt.has_path, {tags} AS t FROM b JOIN c USING (s) JOIN led ON led.node = c.node
  JOIN documents d ON d.doc_id = b.doc_id JOIN tt g ON g.doc_id = b.doc_id JOIN pt ON pt.doc_id = b.doc_id),
f AS (SELECT anchor, count(*) AS lessons, count(DISTINCT project_id) AS projects, bool_or({names(workflows.GLOBAL_TAGS)}) AS g, bool_or({names(workflows.USER_TAGS)}) AS u,
  bool_or(names_tool AND doc_id = anchor) AS tool, bool_or(has_path) AS local, list_sort(list_distinct(flatten(list(t)))) AS t FROM m GROUP BY anchor)
SELECT anchor, lessons, projects, reasons, CASE WHEN u AND NOT g THEN 'user' ELSE 'global' END AS scope,
  array_to_string(list_filter(t, lambda x: x NOT IN ({D.quoted((*workflows.GLOBAL_TAGS, *workflows.USER_TAGS))})), ' ') AS tags
FROM (SELECT *, array_to_string(list_filter([CASE WHEN projects >= 2 THEN 'recurrence' END, CASE WHEN g THEN 'tagged-global' END,
  CASE WHEN tool AND NOT local THEN 'portable-tooling' END], lambda x: x IS NOT NULL), ',') AS reasons FROM f) {"WHERE reasons <> ''" if reasoned else ""}"""


def _facts(rows: DataFrame, reasoned: bool) -> DataFrame:
    rows = rows.withColumn("tags", T.hashtags("text"))
    led = cut(workflows.lesson_clusters(rows, "doc_id", "text", "project_id", "captured_at"))
    facts = workflows.cluster_facts(led, rows, "doc_id", "text", "project_id", "tags", reasoned)
    return facts.withColumns({"reasons": F.array_join("reasons", ","), "tags": F.array_join("tags", " ")})


def _keyword_tokens(text: str) -> str:
    return f"""list_filter([regexp_replace(x, '[^{D.ALNUM}_-]', '', 'g') for x in regexp_split_to_array({text}, '{D.WS}+')],
  lambda x: octet_length(encode(x)) >= 3 AND lower(x) NOT IN ({D.quoted(keywords.KEYWORD_STOPWORDS)}))"""


_KEYWORD_SCORES = r"""
e AS (SELECT doc_id, win, len(t) AS n, unnest(t) AS token FROM k),
s AS (SELECT doc_id, win, token, count(*) / any_value(n)
        * CASE WHEN octet_length(encode(token)) >= 6 THEN 1.5 ELSE 1.0 END
        * CASE WHEN regexp_matches(token, '[_-]') OR (regexp_matches(token, '^[a-z].*[A-Z]') AND length(token) > 3) THEN 1.3 ELSE 1.0 END AS score
      FROM e GROUP BY doc_id, win, token)"""
_KEYWORD_BEST = """
g AS (SELECT doc_id, token, round(score, 9) AS score FROM f),
b AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM g),
r AS (SELECT doc_id, token, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, token) AS place
      FROM b WHERE score >= greatest(top * 0.1, {floor}))
SELECT doc_id, place::INTEGER AS place, token, score FROM r WHERE place <= 12"""

_LONG = f"""WITH w AS (SELECT doc_id, text, unnest(range(0, 1 + ceil((length(text) - 1000) / 600)::BIGINT)) AS win FROM documents WHERE length(text) > 2000),
k AS (SELECT doc_id, win, {_keyword_tokens("substring(text, win * 600 + 1, 1000)")} AS t FROM w),{_KEYWORD_SCORES},
l AS (SELECT doc_id, token, list(struct_pack(w := win::DOUBLE, s := score) ORDER BY win) AS l FROM s GROUP BY doc_id, token),
f AS (SELECT doc_id, token, list_reduce(l, lambda x, y: struct_pack(w := y.w, s := x.s * pow(0.85, y.w) + y.s)).s AS score FROM l),
{_KEYWORD_BEST.format(floor=0.015)}"""


@registry.query("long_text_keywords", _LONG)
def long_text_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.long_text_keywords(_documents(spark, sf_dir), "doc_id", "text")


_TURNS = f"""WITH a AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda x: regexp_matches(x, '[^\\s\\x{{0b}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]')) AS a
  FROM documents WHERE source = 'session'),
w AS (SELECT doc_id, unnest(range(0, least(5, len(a)))) AS win, a FROM a),
k AS (SELECT doc_id, win, {_keyword_tokens("a[len(a) - win]")} AS t FROM w),{_KEYWORD_SCORES},
f AS (SELECT doc_id, token, sum(score * pow(0.85, win)) AS score FROM s GROUP BY doc_id, token),
{_KEYWORD_BEST.format(floor=0.0)}"""


@registry.query("turn_keywords", _TURNS)
def turn_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.turn_keywords(_documents(spark, sf_dir).where("source = 'session'"), "doc_id", "text", 5)


_STARTS = r"(?i)^(?:lesson:|gotcha:|pattern:|learned:)"
_EXTRACT = rf"""WITH l AS (SELECT doc_id, {D.trim("text")} AS whole,
  [{D.trim("regexp_replace(" + D.trim("x") + ", '^[-* ]+', '')")} for x in regexp_split_to_array(text, '\r\n|\r|\n')] AS l FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, whole, list_filter([{D.trim("regexp_replace(x, '" + _STARTS + "', '')")} for x in list_filter(l, lambda y: regexp_matches(y, '{_STARTS}'))], lambda z: z <> '') AS m FROM l),
r AS (SELECT doc_id, CASE WHEN len(m) > 0 THEN m WHEN whole <> '' THEN [whole] ELSE [] END AS r FROM m)
SELECT doc_id, unnest(range(0, len(r)))::INTEGER AS place, substring(unnest(r), 1, 2000) AS lesson FROM r"""


@registry.query("lessons", _EXTRACT)
def lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).where("text is not null")
    return rows.select("doc_id", F.posexplode(T.lessons("text")).alias("place", "lesson"))


_TAGGED = rf"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{D.WS}+'), lambda x: starts_with(x, '#')) AS w,
  {D.trim("regexp_split_to_array(text, '\\r\\n|\\r|\\n')[1]")} AS line FROM documents WHERE text IS NOT NULL),
t AS (SELECT *, list_sort(list_distinct([lower(y) for y in list_filter([regexp_replace(substring(x, 2), '[^{D.ALNUM}:]+$', '') for x in w],
  lambda z: regexp_full_match(z, '[A-Za-z0-9:-]+'))])) AS tags FROM w)"""
_TAGS = f"{_TAGGED} SELECT doc_id, array_to_string(tags, ' ') AS tags FROM t"


@registry.query(
    "tags_and_titles",
    f"""{_TAGGED}
SELECT doc_id, array_to_string(tags, ' ') AS tags,
  CASE WHEN line = '' THEN 'Promoted lesson' WHEN length(line) > 80 THEN substring(line, 1, 80) || '…' ELSE line END AS title FROM t""",
)
def tags_and_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).where("text is not null")
    return rows.select("doc_id", F.array_join(T.hashtags("text"), " ").alias("tags"), T.first_line_title("text").alias("title"))


@registry.query(
    "document_sizes",
    """SELECT source, count(*) AS documents, count(text) AS filled, sum(length(text))::BIGINT AS characters,
  sum(octet_length(encode(text)))::BIGINT AS bytes, count(DISTINCT project_id) AS projects FROM documents GROUP BY source""",
)
def document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("documents"), F.count("text").alias("filled"), F.sum(F.char_length("text")).alias("characters"),
        F.sum(F.octet_length("text")).alias("bytes"), F.count_distinct("project_id").alias("projects"),
    )


_VERSIONED = r"^@*[A-Za-z0-9._/-]+@[\^~=v]*[0-9][^@]*$"
_BARE = r"""regexp_replace(string_split(regexp_replace(w, '^[`''"()\[\]{},;]+|[`''"()\[\]{},;]+$', '', 'g'), ':')[1], '\.+$', '')"""
_PORTABLE = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, [{D.trim("x")} for x in list_slice(string_split(t, '`'), 2, len(string_split(t, '`')), 2)] AS spans, regexp_split_to_array(t, '{D.WS}+') AS w FROM d),
p AS (SELECT *, [{_BARE} for w in w] AS bare FROM w)
SELECT doc_id, len(list_filter(spans, lambda s: lower(regexp_split_to_array(s, '{D.WS}+')[1]) IN ({D.quoted(T.KNOWN_TOOLS)})
    OR regexp_matches(regexp_split_to_array(s, '{D.WS}+')[1], '{_VERSIONED}') OR regexp_matches(s, '^[A-Za-z0-9_-]+{D.WS}*={D.WS}*"*[\^~=<>]*[0-9]'))) > 0
  OR len(list_filter(w, lambda x: regexp_matches(regexp_replace(x, '^[`''"(),;]+|[`''"(),;]+$', '', 'g'), '{_VERSIONED}'))) > 0 AS names_tool,
  len(list_filter(bare, lambda b: contains(b, '/') AND NOT contains(b, '://') AND NOT regexp_matches(b, '^[/~$@]') AND (regexp_matches(b, '^\.\.?/')
    OR (len(list_filter(string_split(b, '/'), lambda y: y <> '')) >= 2 AND (list_filter(string_split(b, '/'), lambda y: y <> '')[1] IN ({D.quoted(T.REPOSITORY_FOLDERS)})
      OR regexp_matches(list_filter(string_split(b, '/'), lambda y: y <> '')[-1], '.\.[^.]+$')))))) > 0 AS has_path FROM p"""


@registry.query("portable_tools", _PORTABLE)
def portable_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document names a tool or version, and a path of a repository."""
    rows = _documents(spark, sf_dir)
    return rows.select("doc_id", T.names_tool("text").alias("names_tool"), T.has_repository_path("text").alias("has_path"))


@registry.query("lesson_clusters", _clusters(_GRAMS, False))
def lesson_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What recurs across projects: clusters of lessons with their counts and reasons."""
    return _facts(_lessons(spark, sf_dir), False)


@registry.query("promoted_lessons", _clusters(_GRAM_RUNS.replace("@ROWS", "source IN ('lesson', 'skill', 'glossary') AND NOT contains(coalesce(text, ''), '[GLOBAL]') AND NOT contains(coalesce(text, ''), '[USER]')"), True))
def promoted_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of short texts that have a reason to be promoted; those marked as handled are left out."""
    rows = _documents(spark, sf_dir).where("source in ('lesson', 'skill', 'glossary')")
    return _facts(workflows.unmarked(rows, "text", IMMEDIATE_MARKS), True)


def _page_sets(words: str) -> str:
    return f"WITH w AS (SELECT DISTINCT id AS doc_id, {words} AS w FROM wiki_entries WHERE id IS NOT NULL)"


_RUNS = f"""(SELECT CASE WHEN len(t) < 3 THEN [array_to_string(t, ' ')] ELSE [t[i] || ' ' || t[i+1] || ' ' || t[i+2] for i in range(1, len(t) - 1)] END FROM (SELECT {D.fingerprint_tokens("content")} AS t))"""
_NEAR_PAGES = _page_sets(D.normal_words("content")) + _SETS.format(t=0.85)


def _page_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = read_table(spark, sf_dir, "wiki_entries").where("id is not null").select("id", "content").distinct()
    return set_join.set_classes(pages, "id", T.normal_words("content"))


@registry.query("near_pages", _NEAR_PAGES)
def near_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of pages whose word sets agree to 0.85, between representatives of equal sets."""
    pairs = set_join.similar_sets(_page_classes(spark, sf_dir)[0], 0.85)
    return pairs.select("a", "b", F.round("similarity", 9).alias("similarity"))


@registry.query(
    "nearest_pages",
    f"""WITH pairs AS ({_NEAR_PAGES}), ways AS (SELECT a, b, similarity FROM pairs UNION ALL SELECT b, a, similarity FROM pairs)
SELECT a AS id, arg_max(b, (similarity, b)) AS nearest, max(similarity) AS similarity FROM ways GROUP BY a""",
)
def nearest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page with a near copy the most similar one; ties go to the last id."""
    found = set_join.nearest(set_join.similar_sets(_page_classes(spark, sf_dir)[0], 0.85))
    return found.select(F.col("node").alias("id"), "nearest", F.round("similarity", 9).alias("similarity"))


@registry.query("similar_page_runs", _page_sets(_RUNS) + _SETS.format(t=0.6))
def similar_page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of pages whose runs of three words agree to 0.6, as lessons are compared."""
    pages = read_table(spark, sf_dir, "wiki_entries").where("id is not null").select("id", F.coalesce("content", F.lit("")).alias("content")).distinct()
    pairs, _ = workflows.similar_lessons(pages, "id", "content")
    return pairs.select("a", "b", F.round("similarity", 9).alias("similarity"))
