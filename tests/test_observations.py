"""Lessons, labels, logs, answers, health checks and routes."""

import datetime
import json

from pyspark.sql import functions as F

from wordloom.operators import answers, health
from wordloom.operators.observations import lesson_records, log_lines, message_lessons, new_records, page_lessons, with_source_labels
from wordloom.streaming.routes import route_events


def test_lessons(spark):
    said = spark.createDataFrame([("p", "s1", "- Lesson: pin #Tools\nGotcha: [GLOBAL] stop"), ("p", "s2", " "), ("p", None, None)], "project_id string, session_id string, message string")
    pages = spark.createDataFrame([("a", "Lesson", " text ", ["X"]), ("b", "Runbook", "t", []), ("c", "GOTCHA", None, None), (None, "lesson", "t", [])], "id string, entry_type string, content string, tags array<string>")
    seen = message_lessons(said).union(page_lessons(pages, F.lit("p")))
    rows = {r.source: r for r in lesson_records(seen.union(seen), F.lit("2025-01-01").cast("timestamp")).collect()}
    assert {k: (r.text, r.tags, r.marked) for k, r in rows.items()} == {
        "session:s1#0": ("pin #Tools", ["tools"], False), "session:s1#1": ("[GLOBAL] stop", [], True), "kb:a": ("text", ["x"], False), "kb:c": ("", [], False),
    }
    assert all(len(r.lesson_id) == 32 and len(r.shingles) == 1 for r in rows.values())
    known = spark.createDataFrame([(rows["kb:a"].lesson_id,)], "lesson_id string")
    assert new_records(lesson_records(seen, F.current_timestamp()), known).count() == 3


def test_labels(spark):
    schema = "k int, sources array<struct<id: string, resource: string>>"
    rows = [(1, [(i, "r") for i in ("x", "x", "x-2", None, "a b", "X")]), (2, [(None, ""), ("", "doc")])]
    got = {r.k: [x.id for x in r.sources] for r in with_source_labels(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ["x", "x-3", "x-2", "r", "r-2", "X-4"], 2: ["source", "doc"]}
    df = spark.createDataFrame([(1, [("x", "a"), ("x", "b"), (None, "My Doc")]), (2, []), (3, None)], "k int, sources array<struct<id: string, resource: string>>")
    got = {r.k: r.sources and [tuple(x) for x in r.sources] for r in with_source_labels(df).collect()}
    assert got == {1: [("x", "a"), ("x-2", "b"), ("my-doc", "My Doc")], 2: [], 3: None}


def test_log(spark):
    at = lambda d, h: datetime.datetime(2025, 1, d, h)
    df = spark.createDataFrame([(at(1, 3), "a"), (at(2, 1), "b"), (at(1, 5), "c"), (None, "d")], "at timestamp, line string")
    assert [r.line for r in log_lines(df).collect()] == ["## 2025-01-02", "b", "## 2025-01-01", "c", "a"]


def test_answers(spark):
    good = json.dumps([{"id": "a", "severity": "ERROR", "issue": "x"}, {"severity": "loud", "issue": "y"}])
    df = spark.createDataFrame([(f"```json\n{good}\n```",), ("nonsense",), (None,)], "t string")
    assert [(r.id, r.severity, r.issue) for r in answers.reports(df, "t").collect()] == [("a", "error", "x"), (None, "info", "y")]
    pages = spark.createDataFrame([(str(k), "t", "c") for k in range(5)], "id string, title string, content string").coalesce(1)

    def model(batch):
        if any(p["id"] == "2" for p in batch):
            raise RuntimeError("away")
        return json.dumps([{"id": p["id"], "severity": "info", "issue": "seen"} for p in batch])

    rows = answers.ask_in_batches(pages, model, 2).collect()
    assert sorted(str(r.id) for r in rows) == ["0", "1", "4", "None"] and any("away" in r.issue for r in rows)


def test_health(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    checks = health.together(health.check(df, "a", F.col("x") > 9), health.check(df, "b", F.col("x") > 4), health.check(df.limit(0), "c", F.lit(True)), health.check(df, "d", F.col("x") > 9, F.col("x").isNull()))
    assert {r.name: r.status for r in checks.collect()} == {"a": "PASS", "b": "FAIL", "c": "PASS", "d": "WARN"}
    assert tuple(health.summary(checks).head()) == (2, 1, 1)


def test_routes(spark, tmp_path):
    schema = "id string, kind string"
    spark.createDataFrame([("1", "compiled"), ("2", "focused"), ("3", None)], schema).write.parquet(str(tmp_path / "in"))
    blocked = tmp_path / "blocked"
    blocked.write_text("no folder")
    stores = {"graph": str(tmp_path / "graph"), "episodic": str(blocked)}
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    route_events(stream, "kind", ("compiled",), stores, str(tmp_path / "fall"), str(tmp_path / "state")).awaitTermination()
    assert [r.id for r in spark.read.parquet(stores["graph"]).collect()] == ["1"]
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "fall/episodic")).collect()) == ["2", "3"]
