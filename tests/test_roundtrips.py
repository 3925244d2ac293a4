"""Stored indexes, ranked search of many queries, folders of pages, answers and operations on small tables."""

import collections
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from wordloom.operators import answers, operations, search, workflows
from wordloom.sources import generations, pages
from wordloom.streaming.pages import changes, watch_pages

DOCS = "k bigint, text string, term string, tf int, key int, query int"


def documents(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1, 2, 3) for k, t in enumerate(texts)], DOCS)


def words(text):
    return [w for w in (text or "").split() if len(w) > 2]


def brute(texts, asked, k):
    held = [collections.Counter(words(t)) for t in texts]
    total = sum(bool(h) for h in held)
    df = collections.Counter(w for h in held for w in h)
    out = {}
    for q in asked:
        scores = {}
        for d, h in enumerate(held):
            if both := [w for w in held[q] if w in h]:
                scores[d] = round(sum(held[q][w] * h[w] / sum(h.values()) * math.log(total / (df[w] + 1)) for w in both), 9)
        out[q] = [d for d, _ in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return {q: d for q, d in out.items() if d}


def test_best_matches(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", f"own{k % 9}", "omega"]) for _ in range(rng.randint(0, 12))) for k in range(60)] + [None, "", "zeta", "alpha beta", "alpha beta"]
    docs = documents(spark, texts)
    asked = docs.where("k % 5 = 0 or k > 59").select(F.col("k").alias("query"), "text")
    for size in ({}, {"rows": 7, "at_once": 3}):
        rows = search.best_matches(docs, "k", "text", asked, 4, **size).orderBy("query", "place").collect()
        got = {}
        for r in rows:
            got.setdefault(r.query, []).append(r.key)
        assert got == brute(texts, [k for k in range(len(texts)) if k % 5 == 0 or k > 59], 4)
    assert search.best_matches(docs, "k", "text", asked.limit(0)).count() == 0
    assert search.best_matches(docs.limit(0), "k", "text", asked).count() == 0


def test_stored_index(spark, tmp_path):
    docs = documents(spark, ["alpha beta beta", "beta gamma", None, "", "alpha delta epsilon", "The and"])
    search.write_index(docs, "k", "text", str(tmp_path / "i"))
    for query in ("alpha", "beta gamma beta", "unheard", "", "the"):
        want = [tuple(r) for r in search.tfidf_search(docs, "k", "text", query).collect()]
        assert [tuple(r) for r in search.search_index(spark, str(tmp_path / "i"), query).collect()] == want
    # only the buckets of the query's terms are read
    plan = search.search_index(spark, str(tmp_path / "i"), "alpha")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan and "text" not in plan.split("== Physical Plan ==")[1]


def test_write_pages_stays_in_its_folder(spark, tmp_path):
    files = spark.createDataFrame([("a/b.md", "x"), ("c.md", None)], "path string, text string")
    assert {tuple(r) for r in pages.write_pages(files, str(tmp_path / "p")).collect()} == {("a/b.md", 1), ("c.md", 0)}
    assert sorted(os.listdir(tmp_path / "p")) == ["a", "c.md"] and (tmp_path / "p/a/b.md").read_text() == "x"
    with pytest.raises(Exception, match="leaves the folder"):
        pages.write_pages(spark.createDataFrame([("../x.md", "x")], "path string, text string"), str(tmp_path / "p")).collect()


def test_wiki_changes(spark, tmp_path):
    wiki, root, out, state = (str(tmp_path / n) for n in ("wiki", "root", "out", "state"))
    os.makedirs(wiki)

    def put(name, text):
        (tmp_path / "wiki" / name).write_text(text)

    page = "---\ntitle: {0}\n---\n\n{0}"
    put("a.md", page.format("one"))
    put("b.md", page.format("two"))
    put("index.md", "no page")
    run = lambda: watch_pages(spark, wiki, root, "s", state, out).awaitTermination()
    found = lambda n: {r.path: r.status for r in spark.read.parquet(f"{out}/batch={n}").collect()}
    run()
    assert found(0) == {"a.md": "added", "b.md": "added"}
    first = generations.current(spark, root, "s")
    put("a.md", page.format("changed"))
    os.remove(tmp_path / "wiki/b.md")
    put("c.md", page.format("three"))
    run()
    assert found(1) == {"a.md": "changed", "b.md": "removed", "c.md": "added"} and generations.current(spark, root, "s") != first
    second = generations.current(spark, root, "s")
    put("d.md", "no block")
    run()
    assert found(2) == {"d.md": "added"} and generations.current(spark, root, "s") == second  # it doesn't parse
    known = spark.createDataFrame([], "path string, source_hash string")
    assert changes(spark, wiki, known)[1].count() == 3


def test_compiled_answers(spark):
    rows = [
        (1, '```json\n{"title": "A b", "content": "see [x](/p/q.md)", "links": ["r", "p/q"], "sources": [{"id": "1", "resource": "u"}, {"id": "1", "resource": "v"}, {"resource": "w"}]}\n```'),
        (2, '{"title": " ", "content": "x"}'), (3, '{"title": "x"}'), (4, "no json"), (5, None), (6, '{"title": "x", "content": "", "type": " Gotcha "}'),
    ]
    got = {r.k: r for r in answers.compiled(spark.createDataFrame(rows, "k int, raw string"), "k", "raw").collect()}
    assert (got[1].id, got[1].links, [s.resource for s in got[1].sources], got[1].entry_type, got[1].error) == ("a-b", ["p/q", "r"], ["u", "w"], "Reference", None)
    assert [got[k].error.split(":")[0] for k in (2, 3, 4, 5)] == ["no title", "no content", "no JSON", "no JSON"]
    assert (got[6].entry_type, got[6].error) == ("Gotcha", None)


def test_operations(spark):
    import datetime

    from wordloom.sources.pages import canonical_json_hash

    h = canonical_json_hash('{"b": 1, "a": [2]}')
    at = datetime.datetime(2025, 1, 10)
    kind = "delivery_id bigint, operation_id string, arguments string, payload_hash string, state string, queued_at string, delivered_at timestamp, unchanged_polls int, receipt struct<payload_hash: string, created_at: string, updated_at: string>"
    rows = [
        (1, " OP ", '{"b": 1, "a": [2]}', None, None, "2025-01-01T00:00:00Z", at, 3, None), (2, "x", '{"a":[2],"b":1}', "sha256:" + h.upper(), "done", None, at, None, (None, None, "bad")),
        (3, "x", "{}", h, "done", "2025-01-09T00:00:00Z", at, 0, (None, "2025-01-01T00:00:00Z", None)), (4, None, "{}", None, "done", None, at, 50, None), (5, "y", "no", None, "done", None, at, 1, None),
    ]
    df = spark.createDataFrame(rows, kind)
    good, dead = operations.normalized_operations(df)
    assert {r.delivery_id: (r.operation_id, r.payload_hash, r.state) for r in good.collect()} == {1: ("op", h, "pending"), 2: ("x", h, "done")}
    assert {r.delivery_id: r.error[:16] for r in dead.collect()} == {3: "the payload hash", 4: "no operation id", 5: "the arguments ar"}
    stale = operations.stale_operations(df, F.lit(at).cast("timestamp"), 7)
    assert {r.delivery_id for r in stale.collect()} == {1, 3}  # 2: its change can't be read, and it has no queueing
    polls = {r.delivery_id: (r.next_poll_at - at).total_seconds() for r in operations.next_polls(df, F.lit(at)).collect()}
    assert polls == {1: 240, 2: 0, 3: 0, 4: 3600, 5: 60}
    assert operations.next_polls(df, F.lit(at)).where("deferred").count() == 3


def test_facts_scopes_and_evidence(spark):
    led = spark.createDataFrame([(1, 1, 1.0), (2, 1, 0.71234), (3, 3, 1.0), (4, 4, 1.0)], "k int, anchor int, similarity double")
    rows = [(1, "a [USER] b", "p", ["user", "Ops"]), (2, "b", "q", None), (3, "c", "p", ["SCOPE:global", "user"]), (4, "d", "p", [None, "x"])]
    df = spark.createDataFrame(rows, "k int, text string, project string, tags array<string>")
    got = {r.anchor: r for r in workflows.cluster_facts(led, df, "k", "text", "project", "tags").collect()}
    assert (got[1].scope, got[1].tags, got[1].reasons) == ("user", ["Ops"], ["recurrence"])
    assert (got[3].scope, got[3].tags, got[3].reasons, got[4].reasons) == ("global", [], ["tagged-global"], [])
    assert workflows.cluster_facts(led, df, "k", "text", "project", "tags", reasoned=True).count() == 2
    assert workflows.unmarked(df, "text", ("[USER]",)).count() == 3
    evidence = {r.anchor: [tuple(e) for e in r.evidence] for r in workflows.cluster_evidence(led, "k").collect()}
    assert evidence[1] == [(1, 1.0), (2, 0.712)]
    assert [len(r.evidence) for r in workflows.cluster_evidence(led, "k", 1).where("anchor = 1").collect()] == [1]
    same = spark.sql("SELECT array(named_struct('key', 1), named_struct('key', 2)) a, array(named_struct('key', 2), named_struct('key', 1), named_struct('key', 1)) b")
    assert same.select(workflows.same_evidence(F.col("a"), F.col("b"))).head()[0]
