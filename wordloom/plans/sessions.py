"""Queries over workflows, transcripts and the memory queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import health, operations, workflows
from wordloom.plans import dialect as D
from wordloom.plans.registry import Registry
from wordloom.session import read_table

registry = Registry()


_SIMILAR = """w AS (SELECT workflow_id AS id, list_distinct(list_filter(any_value(prompt_shingles), lambda x: x IS NOT NULL)) AS p,
  list_distinct(list_filter(any_value(tool_shingles), lambda x: x IS NOT NULL)) AS t FROM workflows WHERE workflow_id IS NOT NULL GROUP BY 1),
s AS (SELECT * FROM w WHERE len(p) > 0 AND len(t) > 0),
c AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.p, b.p)) AS ip, len(a.p) + len(b.p) AS np, len(list_intersect(a.t, b.t)) AS it, len(a.t) + len(b.t) AS nt
  FROM s a JOIN s b ON a.id < b.id),
r AS (SELECT a, b, (ip / (np - ip) + it / (nt - it)) / 2 AS s FROM c)"""


@registry.query("similar_workflows", f"WITH {_SIMILAR} SELECT a, b, round(s, 9) AS similarity FROM r WHERE s >= 0.5")
def similar_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, _ = workflows.similar_workflows(read_table(spark, sf_dir, "workflows"))
    return pairs.select("a", "b", F.round("similarity", 9).alias("similarity"))


_ONE = "SELECT DISTINCT ON (workflow_id) workflow_id, project_id, recorded_at, skill_uses FROM workflows WHERE workflow_id IN (SELECT id FROM s) ORDER BY workflow_id"
_RECURS = f"""{_SIMILAR}, one AS ({_ONE}), {D.led("SELECT workflow_id AS node, recorded_at AS since FROM one", "SELECT a, b FROM r WHERE s >= 0.5")},
g AS (SELECT led.anchor, one.project_id, list_distinct(list_filter([u.skill for u in one.skill_uses], lambda x: x IS NOT NULL)) AS skills FROM led JOIN one ON one.workflow_id = led.node),
f AS (SELECT anchor, count(*) AS sessions, count(DISTINCT project_id) AS projects FROM g GROUP BY anchor),
u AS (SELECT anchor, skill, count(*) AS n FROM (SELECT anchor, unnest(skills) AS skill FROM g) GROUP BY ALL),
recurring AS (SELECT anchor, sessions, projects FROM f WHERE (sessions >= 3 OR projects >= 2)
  AND NOT EXISTS (SELECT 1 FROM u WHERE u.anchor = f.anchor AND 2 * u.n >= f.sessions))"""


@registry.query("recurring_workflows", f"WITH RECURSIVE {_RECURS} SELECT * FROM recurring")
def recurring_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflows.recurring_workflows(read_table(spark, sf_dir, "workflows"))


_CORRECTED = """ow AS (SELECT DISTINCT workflow_id, team_id, role_id, skill_uses FROM workflows WHERE workflow_id IS NOT NULL),
uw AS (SELECT workflow_id, team_id, role_id, unnest(skill_uses) AS u FROM ow),
pw AS (SELECT workflow_id, team_id, role_id, u.skill AS skill, sum(coalesce(len(u.corrections), 0)) AS n FROM uw WHERE u.skill IS NOT NULL GROUP BY ALL),
corrected AS (SELECT skill, team_id, role_id, count(*) AS sessions, sum(n)::BIGINT AS corrections FROM pw WHERE n >= 2 GROUP BY skill, team_id, role_id)"""


@registry.query(
    "proposals",
    f"""WITH RECURSIVE {_RECURS}, {_CORRECTED} SELECT 'workflow' AS kind, anchor AS name, sessions FROM recurring
UNION ALL SELECT 'skill', skill, sum(sessions)::BIGINT FROM corrected GROUP BY skill""",
)
def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the two detectors propose together."""
    return workflows.proposals(read_table(spark, sf_dir, "workflows"))


@registry.query("corrected_skills", f"WITH {_CORRECTED} SELECT * FROM corrected")
def corrected_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflows.corrected_skills(read_table(spark, sf_dir, "workflows"))


@registry.query(
    "tool_runs",
    """WITH t AS (SELECT session_id, list_filter(tool_sequence, lambda x: x IS NOT NULL) AS t FROM transcript_digests WHERE session_id IS NOT NULL),
g AS (SELECT DISTINCT session_id, substring(sha256(unnest([t[i] || ' ' || t[i+1] || ' ' || t[i+2] for i in range(1, len(t) - 1)])), 1, 16) AS shingle FROM t WHERE len(t) >= 3)
SELECT shingle, count(*) AS sessions FROM g GROUP BY shingle""",
)
def tool_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many sessions each run of three tools stands."""
    rows = read_table(spark, sf_dir, "transcript_digests").where("session_id is not null")
    steps = rows.select("session_id", F.array_compact("tool_sequence").alias("t"))
    each = steps.select("session_id", F.explode(T.joined_shingles(F.col("t"), 3, short=False)).alias("shingle"))
    return each.distinct().groupBy("shingle").agg(F.count("*").alias("sessions"))


_CORRECTS = "(?:^(?:no,|no\\.|no |nope|stop|wait,))|" + "|".join(p.replace("'", "''") for p in T.CORRECTION_PHRASES)


@registry.query(
    "prompt_kinds",
    f"""WITH p AS (SELECT session_id, unnest(prompts) AS p FROM transcript_digests WHERE session_id IS NOT NULL)
SELECT session_id, count(p) AS prompts, count(*) FILTER (regexp_matches(lower({D.trim("coalesce(p, '')")}), '{_CORRECTS}')) AS corrections FROM p GROUP BY session_id""",
)
def prompt_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of each session and how many of them correct something."""
    rows = read_table(spark, sf_dir, "transcript_digests").where("session_id is not null").select("session_id", F.explode("prompts").alias("p"))
    return rows.groupBy("session_id").agg(F.count("p").alias("prompts"), F.count_if(T.is_correction("p")).alias("corrections"))


@registry.query(
    "artifact_paths",
    """WITH a AS (SELECT DISTINCT session_id, unnest(artifacts) AS path FROM transcript_digests WHERE session_id IS NOT NULL)
SELECT path, regexp_matches('/' || path, '/docs/|/reports/|\\.md$') AS documentation, count(*) AS sessions FROM a WHERE path IS NOT NULL GROUP BY path""",
)
def artifact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "transcript_digests").where("session_id is not null").select("session_id", F.explode("artifacts").alias("path"))
    each = rows.where("path is not null").distinct().groupBy("path").agg(F.count("*").alias("sessions"))
    return each.select("path", T.is_documentation_path("path").alias("documentation"), "sessions")


_KEY = f"lower({D.trim('operation_id')})"
_HASH = "regexp_replace(lower({}), '^sha256:', '')"


@registry.query(
    "latest_states",
    f"""WITH d AS (SELECT {_KEY} AS operation, state, delivered_at, delivery_id FROM memory_operations WHERE operation_id IS NOT NULL)
SELECT operation, arg_max(state, (delivered_at, delivery_id)) AS state, count(*) AS deliveries FROM d GROUP BY operation""",
)
def latest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.latest_states(read_table(spark, sf_dir, "memory_operations"))


@registry.query(
    "state_counts",
    "SELECT project_id, state, count(*) AS operations, sum(unchanged_polls)::BIGINT AS polls FROM memory_operations GROUP BY project_id, state",
)
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "memory_operations")
    return rows.groupBy("project_id", "state").agg(F.count("*").alias("operations"), F.sum("unchanged_polls").alias("polls"))


@registry.query(
    "receipt_mismatches",
    f"""SELECT * FROM (SELECT delivery_id, CASE WHEN {_KEY} <> lower({D.trim("receipt.operation_id")}) THEN 'operation'
  WHEN schema_version <> receipt.schema_version THEN 'version' WHEN method <> receipt.kind THEN 'kind'
  WHEN {_HASH.format(D.trim("payload_hash"))} <> {_HASH.format(D.trim("receipt.payload_hash"))} THEN 'payload' END AS fault FROM memory_operations) WHERE fault IS NOT NULL""",
)
def receipt_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.receipt_mismatches(read_table(spark, sf_dir, "memory_operations"))


@registry.query(
    "receipt_progress",
    f"""WITH s AS (SELECT {_KEY} AS operation, delivery_id, delivered_at, (receipt.state, receipt.progress_seq) AS seen FROM memory_operations
  WHERE receipt IS NOT NULL AND operation_id IS NOT NULL),
l AS (SELECT delivery_id, seen, lag(seen) OVER w AS before, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY operation ORDER BY delivered_at, delivery_id))
SELECT delivery_id, n = 1 OR before IS DISTINCT FROM seen AS changed FROM l""",
)
def receipt_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.receipt_progress(read_table(spark, sf_dir, "memory_operations"))


@registry.query(
    "poll_backoff",
    """SELECT delivery_id, CASE WHEN coalesce(unchanged_polls, 0) <= 0 THEN 0 ELSE least(60 * pow(2, least(unchanged_polls, 40) - 1), 3600) END::BIGINT AS seconds
FROM memory_operations""",
)
def poll_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "memory_operations")
    return rows.select("delivery_id", operations.backoff_seconds(F.col("unchanged_polls")).cast("bigint").alias("seconds"))


@registry.query(
    "waiting_times",
    r"""WITH w AS (SELECT project_id, epoch_us(delivered_at) - epoch_us(CASE WHEN regexp_full_match(trim(queued_at), '\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})')
  THEN try_cast(trim(queued_at) AS TIMESTAMPTZ) END) AS w FROM memory_operations)
SELECT project_id, count(*) AS operations, count(w) AS readable, round(max(w) / 1000000, 3) AS longest_wait FROM w GROUP BY project_id""",
)
def waiting_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.waiting_times(read_table(spark, sf_dir, "memory_operations"))


@registry.query(
    "dependencies",
    f"""WITH d AS (SELECT DISTINCT {_KEY} AS operation, unnest(dependencies) AS needs FROM memory_operations WHERE operation_id IS NOT NULL),
k AS (SELECT DISTINCT {_KEY} AS operation FROM memory_operations)
SELECT d.operation, lower({D.trim("d.needs")}) AS needs, k.operation IS NOT NULL AS known FROM (SELECT DISTINCT * FROM d WHERE needs IS NOT NULL) d LEFT JOIN k ON k.operation = lower({D.trim("d.needs")})""",
)
def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each operation waits for, and whether that was ever delivered."""
    rows = read_table(spark, sf_dir, "memory_operations").where("operation_id is not null")
    needs = rows.select(operations.operation_key().alias("operation"), F.explode("dependencies").alias("raw")).where("raw is not null").distinct()
    known = rows.select(operations.operation_key().alias("needs")).distinct().withColumn("known", F.lit(True))
    keyed = needs.select("operation", operations.operation_key("raw").alias("needs"))
    return keyed.join(known, "needs", "left").select("operation", "needs", F.coalesce("known", F.lit(False)).alias("known"))


_RFC = r"\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})"


def _instant(text: str) -> str:
    return f"(CASE WHEN regexp_full_match(trim({text}), '{_RFC}') THEN try_cast(trim({text}) AS TIMESTAMPTZ) END)"


@registry.query(
    "stale_operations",
    f"""WITH s AS (SELECT delivery_id, coalesce({_instant("coalesce(receipt.updated_at, receipt.created_at)")}, {_instant("queued_at")}) AS since FROM memory_operations),
n AS (SELECT max(delivered_at) AS now FROM memory_operations)
SELECT delivery_id, epoch_us(since) AS stale_since FROM s, n WHERE epoch_us(since) < epoch_us(now) - 7 * 86400000000""",
)
def stale_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries that stood still for a week before the last one."""
    rows = read_table(spark, sf_dir, "memory_operations")
    now = F.broadcast(rows.agg(F.max("delivered_at").cast("timestamp").alias("now")))  # one row
    found = operations.stale_operations(rows.join(now), F.col("now"), 7)
    return found.select("delivery_id", F.unix_micros("stale_since").alias("stale_since"))


@registry.query(
    "next_polls",
    """WITH w AS (SELECT delivery_id, delivered_at, CASE WHEN coalesce(unchanged_polls, 0) <= 0 THEN 0 ELSE least(60 * pow(2, least(unchanged_polls, 40) - 1), 3600) END::BIGINT AS s FROM memory_operations)
SELECT delivery_id, epoch_us(delivered_at) + s * 1000000 AS next_poll, epoch_us(delivered_at) + s * 1000000 > epoch_us(TIMESTAMP '2025-06-01') AS deferred FROM w""",
)
def next_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each operation is to be polled again, and whether a day in June comes before that."""
    found = operations.next_polls(read_table(spark, sf_dir, "memory_operations"), F.lit("2025-06-01").cast("timestamp_ntz"))
    return found.select("delivery_id", F.unix_micros(F.col("next_poll_at").cast("timestamp")).alias("next_poll"), "deferred")


@registry.query(
    "batch_summaries",
    f"""SELECT batch_id, count(*) AS deliveries, count(DISTINCT {_KEY}) AS operations, count(receipt) AS receipts, count(*) FILTER (receipt.state = 'planned') AS planned,
  count(*) FILTER (receipt.state = 'running') AS running, count(*) FILTER (receipt.state = 'done') AS done, count(*) FILTER (receipt.state = 'failed') AS failed,
  count(last_error) AS errors, max(delivered_at) AS last FROM memory_operations GROUP BY batch_id""",
)
def batch_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.batch_summaries(read_table(spark, sf_dir, "memory_operations"))


_TOLD = _HASH.format(D.trim("coalesce(payload_hash, receipt.payload_hash)"))
_SORTED = """'{' || array_to_string([to_json(k)::VARCHAR || ':' || json_extract(arguments, '$.' || k)::VARCHAR for k in list_sort(json_keys(arguments))], ',') || '}'"""
_NORMAL = f"""n AS (SELECT delivery_id, {_KEY} AS operation_id, state, sha256({_SORTED}) AS made, {_TOLD} AS told FROM memory_operations)"""


@registry.query(
    "normalized_operations",
    f"WITH {_NORMAL} SELECT delivery_id, operation_id, made AS payload_hash, coalesce(state, 'pending') AS state FROM n WHERE operation_id IS NOT NULL AND (told IS NULL OR told = made)",
)
def normalized_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries with tidy ids and hashes recomputed from their arguments."""
    good, _ = operations.normalized_operations(read_table(spark, sf_dir, "memory_operations"))
    return good.select("delivery_id", "operation_id", "payload_hash", "state")


@registry.query(
    "dead_letters",
    f"""WITH {_NORMAL} SELECT delivery_id, CASE WHEN operation_id IS NULL THEN 'no operation id' ELSE 'the payload hash is ' || made || ', not ' || told END AS error
FROM n WHERE operation_id IS NULL OR (told IS NOT NULL AND told <> made)""",
)
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries without an id or with another payload than their hash tells."""
    return operations.normalized_operations(read_table(spark, sf_dir, "memory_operations"))[1]


_CHECKS = (
    ("operation ids", "memory_operations", "operation_id IS NULL", "last_error IS NOT NULL"), ("receipts", "memory_operations", "receipt.state = 'lost'", "receipt IS NULL"),
    ("document texts", "documents", "n_chars < 0", "text IS NULL"), ("page types", "wiki_entries", "id IS NULL", "entry_type IS NULL"),
    ("sessions", "transcript_digests", "session_id IS NULL", "tool_sequence IS NULL"), ("workflows", "workflows", "workflow_id IS NULL", "prompt_shingles IS NULL"),
)
_CHECK = """SELECT '{0}' AS name, CASE WHEN f > 0 THEN 'FAIL' WHEN w > 0 THEN 'WARN' ELSE 'PASS' END AS status, f || ' failed, ' || w || ' warned' AS detail
FROM (SELECT count(*) FILTER ({2}) AS f, count(*) FILTER ({3}) AS w FROM {1})"""
_ALL_CHECKS = " UNION ALL ".join(_CHECK.format(*c) for c in _CHECKS)


@registry.query("health", _ALL_CHECKS)
def table_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check of each table."""
    return health.together(*[health.check(read_table(spark, sf_dir, t), n, F.expr(f), F.expr(w)) for n, t, f, w in _CHECKS])


@registry.query("health_summary", f"SELECT count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'WARN') AS warned, count(*) FILTER (status = 'FAIL') AS failed FROM ({_ALL_CHECKS})")
def health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.summary(table_health(spark, sf_dir))


@registry.query(
    "durations",
    """WITH d AS (SELECT delivery_id, unchanged_polls || (['s', 'm', 'h', 'd', 'y', ''])[delivery_id % 6 + 1] AS d FROM memory_operations)
SELECT delivery_id, d AS text, CASE WHEN regexp_full_match(d, '[0-9]{1,12}[smhd]') AND substring(d, 1, length(d) - 1)::BIGINT > 0
  THEN substring(d, 1, length(d) - 1)::BIGINT * CASE d[-1] WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 ELSE 86400 END END AS seconds FROM d""",
)
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of durations, made of a count and a unit."""
    unit = F.element_at(F.array(*map(F.lit, ("s", "m", "h", "d", "y", ""))), (F.col("delivery_id") % 6 + 1).cast("int"))
    rows = read_table(spark, sf_dir, "memory_operations").select("delivery_id", F.concat(F.col("unchanged_polls").cast("string"), unit).alias("text"))
    return rows.select("delivery_id", "text", operations.duration_seconds(F.col("text")).alias("seconds"))


@registry.query(
    "cluster_evidence",
    f"""WITH RECURSIVE {_SIMILAR}, one AS ({_ONE}), {D.led("SELECT workflow_id AS node, recorded_at AS since FROM one", "SELECT a, b FROM r WHERE s >= 0.5")}
SELECT led.anchor, string_agg(led.node || ':' || (round(coalesce(r.s, 1), 3) * 1000)::BIGINT, '|' ORDER BY led.node) AS evidence
FROM led LEFT JOIN r ON r.a = least(led.node, led.anchor) AND r.b = greatest(led.node, led.anchor) GROUP BY led.anchor""",
)
def cluster_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workflows of each cluster, with their similarity to its anchor in thousandths."""
    led = workflows.workflow_clusters(read_table(spark, sf_dir, "workflows"))
    found = workflows.cluster_evidence(led, "workflow_id")
    item = lambda e: F.concat(e["key"], F.lit(":"), F.round(e["similarity"] * 1000).cast("bigint").cast("string"))
    return found.select("anchor", F.array_join(F.transform("evidence", item), "|").alias("evidence"))


_NEXT = "lead(receipt) OVER (PARTITION BY batch_id ORDER BY delivery_id)"


@registry.query(
    "foreign_receipts",
    f"""WITH f AS (SELECT delivery_id, operation_id, schema_version, method, payload_hash, {_NEXT} AS receipt FROM memory_operations)
SELECT * FROM (SELECT delivery_id, CASE WHEN {_KEY} <> lower({D.trim("receipt.operation_id")}) THEN 'operation'
  WHEN schema_version <> receipt.schema_version THEN 'version' WHEN method <> receipt.kind THEN 'kind'
  WHEN {_HASH.format(D.trim("payload_hash"))} <> {_HASH.format(D.trim("receipt.payload_hash"))} THEN 'payload' END AS fault FROM f) WHERE fault IS NOT NULL""",
)
def foreign_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """receipt_mismatches() where every delivery holds the receipt of the next one of its batch."""
    after = F.lead("receipt").over(Window.partitionBy("batch_id").orderBy("delivery_id"))
    return operations.receipt_mismatches(read_table(spark, sf_dir, "memory_operations").withColumn("receipt", after))


@registry.query(
    "projects_receipts",
    f"""WITH f AS (SELECT delivery_id, {_KEY} AS op, arg_min(method, delivery_id) OVER (PARTITION BY project_id) AS method, receipt FROM memory_operations)
SELECT delivery_id, 'kind' AS fault FROM f WHERE method <> receipt.kind""",
)
def projects_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where every delivery has the method of its project's first one: receipts of another kind."""
    rows = read_table(spark, sf_dir, "memory_operations")
    first = rows.groupBy("project_id").agg(F.min_by("method", "delivery_id").alias("m"))
    return operations.receipt_mismatches(rows.alias("r").join(first, rows["project_id"].eqNullSafe(first["project_id"])).select("r.*", "m").withColumn("method", F.col("m")))
