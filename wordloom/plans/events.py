"""Queries over the event log, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import events as E
from wordloom.plans.delivery import _KEPT
from wordloom.plans.registry import Registry
from wordloom.session import read_table
from wordloom.streaming import deliveries, windows

registry = Registry()

GRAPH = ("purchase", "signup")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


@registry.query(
    "newest_events",
    "SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 20",
)
def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.newest(_events(spark, sf_dir), "ts", "event_id", 20, event_type="error").select("event_id", "ts", "user_id", "event_type", "value")


@registry.query("event_history", "SELECT event_id, ts, event_type, value FROM events WHERE user_id = 7 ORDER BY ts, event_id")
def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.history(_events(spark, sf_dir), "user_id", 7, "ts", "event_id").select("event_id", "ts", "event_type", "value")


@registry.query(
    "event_routes",
    """SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'graph' ELSE 'episodic' END AS target, event_type, count(*) AS events,
  count(DISTINCT user_id) AS users, round(sum(value), 4) AS value FROM events GROUP BY ALL""",
)
def event_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("target", E.route(F.col("event_type"), GRAPH))
    return rows.groupBy("target", "event_type").agg(
        F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("value")
    )


@registry.query(
    "unexpired_events",
    """SELECT user_id, count(*) AS events, max(ts) AS last FROM events, (SELECT max(ts) AS now FROM events)
WHERE ts > now - INTERVAL 90 DAY AND event_type NOT IN ('purchase', 'signup') GROUP BY user_id""",
)
def unexpired_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the episodic store of the 90 days before the last event, by user."""
    rows = _events(spark, sf_dir)
    now = F.broadcast(rows.agg(F.max("ts").alias("now")))  # one row
    kept = E.expire(rows.join(now), "ts", F.col("now"), 90).where(E.route(F.col("event_type"), GRAPH) == "episodic")
    return kept.groupBy("user_id").agg(F.count("*").alias("events"), F.max("ts").alias("last"))


@registry.query(
    "event_properties",
    "SELECT (props::JSON ->> 'k')::BIGINT AS k, count(*) AS events, round(avg(value), 6) AS mean FROM events GROUP BY 1",
)
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"), "value")
    return rows.groupBy("k").agg(F.count("*").alias("events"), F.round(F.avg("value"), 6).alias("mean"))


@registry.query(
    "stream_event_windows",
    """SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL""",
)
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per hour and type, kept up to date by a stream over the log."""
    found = windows.hourly_counts(spark, f"{sf_dir}/events.parquet", "ts", "event_type", "value")
    return found.select("hour", "event_type", "events", F.round("value", 4).alias("value"))


@registry.query(
    "stream_first_deliveries",
    r"""SELECT DISTINCT lower(regexp_replace(operation_id, '^\s+|\s+$', '', 'g')) AS operation,
  regexp_replace(lower(regexp_replace(coalesce(receipt.payload_hash, payload_hash), '^\s+|\s+$', '', 'g')), '^sha256:', '') AS hash
FROM memory_operations WHERE operation_id IS NOT NULL""",
)
def stream_first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages that a stream over the deliveries lets through, each once."""
    return deliveries.first_deliveries(spark, f"{sf_dir}/memory_operations.parquet").select("operation", "hash")


@registry.query(
    "event_rows",
    """SELECT event_id::VARCHAR AS id, CASE event_type WHEN 'purchase' THEN 'order_placed' WHEN 'signup' THEN 'user_joined' ELSE event_type END AS kind, epoch_us(ts) AS at,
  array_to_string(list_filter(['user:' || user_id, 'item:' || (props::JSON ->> 'k')], lambda x: x IS NOT NULL), '|') AS affects, 'shop' AS scope FROM events""",
)
def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the log keeps them: renamed kinds, the ids they are about, and where they come from."""
    item = F.concat(F.lit("item:"), F.try_variant_get(F.try_parse_json("props"), "$.k", "string"))
    about = F.array(F.concat(F.lit("user:"), F.col("user_id").cast("string")), item)
    rows = E.event_rows(_events(spark, sf_dir), "event_id", "event_type", "ts", {"purchase": "order_placed", "signup": "user_joined"}, about, scope="shop")
    return rows.select("id", "kind", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"), F.array_join("affects", "|").alias("affects"), "scope")


@registry.query("stream_kept_deliveries", _KEPT)
def stream_kept_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivery of each message that stays, kept up to date by a stream over the deliveries."""
    return deliveries.kept_so_far(spark, f"{sf_dir}/memory_operations.parquet")


_RECEIPTS = """s AS (SELECT lower(regexp_replace(operation_id, '^\\s+|\\s+$', '', 'g')) AS operation, receipt.state AS state, receipt.progress_seq AS progress, delivered_at, delivery_id
  FROM memory_operations WHERE operation_id IS NOT NULL AND receipt IS NOT NULL),
l AS (SELECT *, row_number() OVER w AS n, CASE WHEN lag(state) OVER w IS NOT DISTINCT FROM state AND lag(progress) OVER w IS NOT DISTINCT FROM progress AND row_number() OVER w > 1 THEN 0 ELSE row_number() OVER w END AS fresh
  FROM s WINDOW w AS (PARTITION BY operation ORDER BY delivered_at, delivery_id)),
p AS (SELECT operation, arg_max(state, n) AS state, arg_max(progress, n) AS progress, max(n) - max(fresh) AS polls, min(delivered_at) AS first, max(delivered_at) AS last FROM l GROUP BY operation)"""


@registry.query(
    "stream_receipts",
    f"""WITH {_RECEIPTS}, w AS (SELECT *, CASE WHEN polls > 0 THEN least(60 * pow(2, least(polls - 1, 40)), 3600) ELSE 0 END::BIGINT AS wait FROM p)
SELECT operation, state, progress, polls::INTEGER AS polls, epoch_us(first) AS first, epoch_us(last) + wait * 1000000 AS next_poll FROM w""",
)
def stream_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream over the deliveries knows of each operation's receipt in the end."""
    found = deliveries.tracked_receipts(spark, f"{sf_dir}/memory_operations.parquet")
    return found.select("operation", "state", "progress", "polls", F.unix_micros("first_seen").alias("first"), F.unix_micros("next_poll_at").alias("next_poll"))
