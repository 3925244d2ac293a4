"""Pages, logs, generations, transcripts and streams over small folders."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from wordloom.operators import snapshots, transcripts
from wordloom.operators.links import carried_lines, index_block_reports, log_heading_reports
from wordloom.sources import generations, logs
from wordloom.sources.pages import canonical_json_hash, media_type, parse_pages, read_pages, render_pages
from wordloom.streaming.deliveries import track_receipts
from wordloom.streaming.inbox import drain, raw_documents

PAGE = """---
type: Runbook
title: Start up
tags: [a, yes, 2024-01-01]
sources: [notes.txt, {id: s1, resource: book}, 12]
generated: {by: me, at: "2025-01-02T00:00:00Z"}
created_at: 2025-01-01T00:00:00+01:00
colour: {deep: 1}
---

Body [x](/other.md)
"""


def parsed(spark, *texts):
    df = spark.createDataFrame([(f"p{k}.md", t) for k, t in enumerate(texts)], "path string, text string")
    return [r.asDict() for r in parse_pages(df).orderBy("path").collect()]


def test_page(spark):
    one, twin = parsed(spark, PAGE, PAGE.replace("\n", "\r\n"))
    assert one["parse_error"] is None and one["id"] == "p0" and one["title"] == "Start up" and one["revision"] == 1
    assert one["tags"] == ["a", "yes", "2024-01-01"] and [tuple(s) for s in one["sources"]] == [(None, "notes.txt"), ("s1", "book"), (None, "12")]
    assert str(one["updated_at"]) == "2025-01-02 00:00:00" and str(one["created_at"]) == "2024-12-31 23:00:00"
    assert one["extra"] == {"colour": '{"deep": 1}'} and one["content"] == "Body [x](/other.md)\n" and one["generated_by"] == "me"
    assert twin["content"] == one["content"] and twin["content_hash"] == one["content_hash"]


@pytest.mark.parametrize(
    "text, error",
    [
        ("plain", "fence"), ("---\na: 1\n", "fence"), ("---\ntags: {a: 1}\n---\n", "tags"), ("---\nid: a:b\n---\n", "safe path"),
        ("---\ncreated_at: yesterday\n---\n", "created"), ("---\ntitle: a: b\n---\n", "Error"), (None, "fence"), ("---\nsources: [[1]]\n---\n", "source"),
    ],
)
def test_bad_pages(spark, text, error):
    assert error in parsed(spark, text)[0]["parse_error"]


def test_provenance_is_lenient(spark):
    for made in ("text", "true", "[1]", "{at: x}"):
        row = parsed(spark, f"---\ngenerated: {made}\ntimestamp: 2025-03-01T00:00:00Z\n---\nx")[0]
        assert row["parse_error"] is None and row["generated_by"] is None and str(row["updated_at"]) == "2025-03-01 00:00:00"


def test_read_and_render(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/one.md").write_text(PAGE)
    (tmp_path / "index.md").write_text("# Index")
    (tmp_path / "notes.txt").write_text("x")
    pages = read_pages(spark, str(tmp_path))
    rows = pages.collect()
    assert [r.id for r in rows] == ["deep/one"]
    again = parse_pages(render_pages(pages)).collect()[0]
    same = ("id", "title", "content", "tags", "links", "sources", "created_at", "updated_at", "revision", "entry_type", "extra", "content_hash")
    assert all(again[c] == rows[0][c] for c in same)


def test_media_types(spark):
    df = spark.createDataFrame([("A.MD",), ("b.json",), ("c",)], "p string")
    assert [r[0] for r in df.select(media_type("p")).collect()] == ["markdown", "json", "text"]


def test_canonical_hash():
    assert canonical_json_hash('{"b": 1, "a": [1,2]}') == canonical_json_hash('{"a":[1, 2],"b":1}') != canonical_json_hash("{}")
    assert canonical_json_hash("{") is None and canonical_json_hash(None) is None


def test_logs(spark, tmp_path):
    path = str(tmp_path / "log")
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.json").write_text('{"id":"1","kind":"x"}\n{"id":\n{"id":"2","affects":["p"]}\n')
    assert sorted(r.id for r in logs.read_lines(spark, path, logs.EVENT).collect()) == ["1", "2"]
    assert [r.raw for r in logs.bad_lines(spark, path).collect()] == ['{"id":']
    new = logs.read_lines(spark, path, logs.EVENT).limit(0)
    more = spark.createDataFrame([("2", "y"), ("3", "y"), ("3", "y"), (None, "y")], "id string, kind string")
    logs.append_new(more.unionByName(new.select("id", "kind")), path, logs.EVENT, "id")
    logs.append_new(more, path, logs.EVENT, "id")
    assert sorted(r.id for r in logs.read_lines(spark, path, logs.EVENT).collect()) == ["1", "2", "3"]


def test_generations(spark, tmp_path):
    root = str(tmp_path / "kb")
    rows = [("b", "2", None), ("a", "1", ["x"])]
    df = spark.createDataFrame(rows, "id string, content string, tags array<string>")
    name = generations.commit(df, root, "project")
    assert generations.commit(df.orderBy("id").repartition(3), root, "project") == name
    other = generations.commit(df.where("id = 'a'"), root, "project")
    assert other != name and generations.read_current(spark, root, "project").count() == 1
    assert generations.commit(df, root, "project") == name and generations.read_current(spark, root, "project").count() == 2
    df.withColumn("content", F.lit("z")).write.mode("overwrite").parquet(f"{root}/project/generations/{name}")
    with pytest.raises(ValueError, match="was changed"):
        generations.read_current(spark, root, "project")
    with pytest.raises(Exception):  # noqa: B017
        generations.read_current(spark, root, "none")


def test_reconcile_and_merge(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "id string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), (None, "1"), ("c", None)], "id string, h string")
    got = {r.id: r.status for r in snapshots.reconcile(old, new, "id", "h").collect()}
    assert got == {"a": "same", "b": "changed", "c": "same", "d": "added"}
    schema = "id string, content string, revision int, updated_at timestamp"
    day = [datetime.datetime(2025, 1, k) for k in range(1, 4)]
    have = spark.createDataFrame([("a", "x", 4, day[0])], schema)
    come = spark.createDataFrame([("a", "y", 1, day[1]), ("a", "z", 1, day[2]), ("b", "w", 7, day[0])], schema)
    assert sorted((r.id, r.content, r.revision) for r in snapshots.upsert(have, come).collect()) == [("a", "z", 5), ("b", "w", 1)]
    ids = spark.createDataFrame([("a",)], "id string")
    assert snapshots.delete(have, ids).count() == 0
    with pytest.raises(Exception, match="no entry"):
        snapshots.delete(have, ids.union(spark.createDataFrame([("q",)], "id string"))).union(have).collect()


def line(role, content, **more):
    return json.dumps({"type": role, "message": {"role": role, "content": content}} | more)


def test_transcripts(spark):
    use = lambda name, **i: {"type": "tool_use", "name": name, "input": i}
    rows = [
        line("user", "please start"), "torn {", line("assistant", [use("Bash", command="git status -s"), use("Write", file_path="docs/a.md"), use("Edit", file_path="b.rs")]),
        line("assistant", [use("Skill", skill="kit:plan"), {"type": "text", "text": "done"}]), line("user", "no, redo it"), line("user", "meta wrong", isMeta=True),
        line("user", [{"type": "tool_result", "content": "wrong"}]), line("user", [{"type": "text", "text": "fine"}, {"type": "text", "text": "instead of x"}]),
        line("user", "<system-reminder>wrong"), line("user", "<command-name>/review</command-name>"), line("user", "<command-name>/clear</command-name>"),
        *[line("user", f"ok {k}") for k in range(6)], line("user", "stop"), line("assistant", "the end"), line("assistant", []),
    ]
    df = spark.createDataFrame([("s", k, r) for k, r in enumerate(rows)] + [("t", 0, "{}")], "session_id string, line_no int, raw string")
    (got,) = transcripts.digests(df).collect()
    assert got.prompts[:3] == ["please start", "no, redo it", "fine\ninstead of x"] and len(got.prompts) == 10
    assert got.commands == ["git status -s"] and got.artifacts == ["docs/a.md"]
    assert got.tool_sequence == ["Bash:git", "Write", "Edit", "Skill:plan"]
    assert [(u.skill, u.corrections) for u in got.skill_uses] == [("plan", ["no, redo it", "fine\ninstead of x"]), ("review", [])]
    assert {r.session_id: r.message for r in transcripts.final_messages(df).collect()} == {"s": "the end"}
    assert transcripts.digests(df.limit(0)).count() == 0


def test_transcript_files(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text(line("user", "a") + "\n\n" + line("user", "b") + "\n")
    rows = logs.transcript_lines(spark, str(tmp_path)).collect()
    assert [(r.session_id, r.line_no) for r in rows] == [("one", 0), ("one", 2)]


def test_catalog_and_logs(spark):
    old = spark.createDataFrame([(1, "A", "* [X](/x.md) - one"), (2, "B", "* [X2](/x.md)"), (3, "B", "* [Y](/y.md)")], "n int, section string, line string")
    kept = carried_lines(old, spark.createDataFrame([("x",), ("z",)], "target string")).collect()
    assert [tuple(r) for r in kept] == [("A", "x", "* [X](/x.md) - one")]
    log = spark.createDataFrame([("## 2025-99-01\n## May 1\nx\n ##  2025-01-01",)], "t string")
    assert [r.heading for r in log_heading_reports(log, "t").collect()] == ["May 1"]
    index = spark.createDataFrame([("---\nversion: 1\n---\nx",), ("---\ntitle: x\n---\n",), ("x",), (None,)], "t string")
    assert index_block_reports(index, "t").count() == 1


def test_inbox(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    for name, text in (("a.md", "one  two"), ("b.txt", "One two"), ("c.tmp", "part"), ("d.json", "{}")):
        (box / name).write_text(text)
    seen = []

    def handle(batch, _):
        seen.extend(r.content for r in batch.collect())
        if len(seen) > 2:
            raise RuntimeError("full")

    drain(raw_documents(spark, str(box)), str(tmp_path / "state"), handle, str(tmp_path / "failed")).awaitTermination()
    assert len(seen) == 2
    (box / "e.md").write_text("later")
    drain(raw_documents(spark, str(box)), str(tmp_path / "state"), handle, str(tmp_path / "failed")).awaitTermination()
    assert seen[2:] == ["later"] and spark.read.parquet(str(tmp_path / "failed")).head().error == "RuntimeError: full"


def test_receipts(spark, tmp_path):
    schema = "operation string, delivery_id bigint, delivered_at timestamp, state string, progress bigint"
    at = datetime.datetime(2025, 1, 1)
    rows = [("a", 1, at, "running", 1), ("a", 2, at, "running", 1), ("a", 3, at, "running", 1), ("b", 4, at, "done", 2)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = track_receipts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        write = lambda batch, n: batch.write.mode("append").parquet(out)
        stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    run()
    got = {r.operation: (r.state, r.progress, r.polls, r.wait_seconds) for r in spark.read.parquet(out).collect()}
    assert got == {"a": ("running", 1, 2, 120), "b": ("done", 2, 0, 0)}
    spark.createDataFrame([("a", 5, at, "running", 1), ("b", 6, at, "done", 3)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    rows = {(r.operation, r.progress, r.polls) for r in spark.read.parquet(out).collect()}
    assert {("a", 1, 3), ("b", 3, 0)} <= rows
