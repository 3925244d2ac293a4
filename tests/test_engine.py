"""The knowledge base from end to end."""

import random
import time

import pytest

from wordloom.engine import KnowledgeBase, plain_model
from wordloom.operators import keywords, set_join, workflows
from wordloom.operators.context import context


def test_knowledge_base(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    raw = [("a.md", "# Retry queue\nThe retry queue drains slowly. See [b](/lease-table.md)."), ("b.md", "Lease table\nLeases expire hourly."), ("c.md", "lease  TABLE\nleases expire hourly.")]
    kb.ingest(spark.createDataFrame(raw, "path string, content string"), tags=(" ops ", "ops", ""))
    rows = {r.id: r for r in kb.entries().collect()}
    assert len(rows) == 2 and "retry-queue" in rows and rows["retry-queue"].tags == ["ops"] and rows["retry-queue"].links == ["lease-table"]
    before = kb.entries().count()
    kb.ingest(spark.createDataFrame(raw[:1], "path string, content string"))
    assert kb.entries().count() == before and kb.get("retry-queue").head().revision == 1
    kb.tools()["ingest"]("Retry queue\nnow it drains fast", "note")
    assert kb.get("retry-queue").head().revision == 2
    assert kb.search("drains", 1).head().id == "retry-queue"
    assert "retry-queue" in kb.focus("retry").head().text and kb.focus("nothing-here").head().text == ""
    assert kb.lint().where("issue = 'orphan page'").count() >= 1 and kb.catalog().count() == 2 and kb.stats().head().entries == 2
    kb.fix_types()
    kb.delete("retry-queue")
    with pytest.raises(KeyError):
        kb.get("retry-queue")
    again = KnowledgeBase(spark, str(tmp_path / "kb"))
    assert again.entries().count() == 1
    assert len(kb.focus_query("word_one " * 400)) < 20 and kb.focus_query("short") == "short"


def test_ingest_knows_copies(spark, tmp_path):
    """Copies are known by the raw text, whatever title and words the model makes of it, and near copies take over the id."""
    def model(batch):
        made = plain_model(batch)
        made["title"] = [f"Title {abs(hash(c))}" for c in batch["content"]]
        made["description"] = str(time.time())
        return made

    ask = lambda *rows: spark.createDataFrame(rows, "path string, content string")
    words = " ".join(f"w{k}" for k in range(40))
    kb = KnowledgeBase(spark, str(tmp_path / "kb"), model=model)
    kb.ingest(ask(("a", words), ("b", words + " more"), ("c", "something else")))
    first = {r.content: r for r in kb.entries().collect()}
    assert set(first) == {words + " more", "something else"}  # a and b are near copies, the last stays
    kb.ingest(ask(("d", words + " other"), ("e", "Something  ELSE")))
    second = {r.content: r for r in kb.entries().collect()}
    assert set(second) == {words + " other", "something else"}
    assert second[words + " other"].id == first[words + " more"].id and second[words + " other"].revision == 2
    kb.model = lambda batch: model(batch).assign(content="worded anew")
    kb.ingest(ask(("f", "third text")))
    kb.model = lambda batch: model(batch).assign(content="in yet other words", title="New")
    kb.ingest(ask(("g", "third text")))
    assert kb.entries().count() == 3 and kb.entries().where("id = 'new'").isEmpty()


def test_related_counts_common_terms(spark, tmp_path):
    """Terms that more than a tenth of the entries hold rank too."""
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    held = {f"e{k:02}": f"own{k} filler" + (" lease" * (k + 1) if k < 15 else "") for k in range(60)}
    entries = spark.createDataFrame([(k, v) for k, v in held.items()], "id string, content string")
    kb.entries = lambda: entries
    found = kb.related(spark.createDataFrame([("p", "lease")], "path string, content string"), 3).head()
    assert found and found.related == ["e14", "e13", "e12"]


ENTRY = "scope string, id string, title string, description string, content string, tags array<string>"


def test_context(spark):
    rows = [("project", f"f{k:03}", "filler", None, "nothing", []) for k in range(60)] + [("shared", "zz", "Lease", None, "lease lease", ["t"]), ("project", "zz2", None, "", "a lease", None)]
    df = spark.createDataFrame(rows, ENTRY)
    got = [(r.id, r.score) for r in context(df, "Lease x", {"project": 0, "shared": 1}).collect()]
    assert got == [("zz", 6.0), ("zz2", 1.0)]
    assert [r.id for r in context(df, "lease", {"project": 0, "shared": 1}, ("t",)).collect()] == ["zz"]
    assert context(df, " ", {"project": 0, "shared": 1}, limit=99).count() == 3  # equal texts are one
    assert context(df.limit(0), "lease", {"project": 0}).count() == 0


def test_context_first_wins(spark):
    """Against the sequential rule: an id is taken once it is met, then a content."""
    rng = random.Random(1)
    rows = [(rng.choice(["p", "s"]), f"i{rng.randint(0, 12)}", f"w{rng.randint(0, 4)} w", None, f"w{rng.randint(0, 4)}", []) for _ in range(80)]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    want, ids, texts = [], set(), set()
    score = lambda r: 4 * r[2].count("w") + r[4].count("w")
    for r in sorted(rows, key=lambda r: (r[0], -score(r), r[1])):
        new = r[1] not in ids
        ids.add(r[1])
        if new and (r[2], r[4]) not in texts:
            texts.add((r[2], r[4]))
            want.append((r[0], r[1]))
    got = context(spark.createDataFrame(rows, ENTRY), " ", {"p": 0, "s": 1}, limit=32).collect()
    assert sorted((r.scope, r.id) for r in got) == sorted(want)


def test_similar_sets(spark):
    rng = random.Random(6)
    rows = [(k, [f"v{int(rng.paretovariate(0.6)) % 90}" for _ in range(rng.randint(0, 25))]) for k in range(150)]
    rows += [(200 + k, [*rows[k][1][1:], "new"]) for k in range(60)]
    df = spark.createDataFrame(rows, "k bigint, v array<string>")
    for t in (0.5, 0.85):
        classes, members = set_join.set_classes(df, "k", df.v)
        node = {r.key: r.node for r in members.collect()}
        sets = {k: frozenset(v) for k, v in rows if v}
        want = {
            (a, b) for a in set(node.values()) for b in set(node.values())
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t
        }
        assert {(r.a, r.b) for r in set_join.similar_sets(classes, t).collect()} == want
        assert all(node[k] == min(j for j in sets if sets[j] == sets[k]) for k in sets)


def test_lessons_recur(spark):
    import datetime

    day = datetime.datetime(2025, 1, 1)
    text = "always pin the lockfile before you run `cargo build` on the shared machine"
    rows = [(1, text, "p1", day), (2, text + " today", "p2", day), (3, "something else entirely is said here", "p1", day), (4, None, "p1", day), (5, text.upper(), "p3", day)]
    df = spark.createDataFrame(rows, "k bigint, text string, project string, at timestamp")
    led = workflows.lesson_clusters(df, "k", "text", "project", "at")
    assert {r.k: r.anchor for r in led.collect()} == {1: 1, 2: 1, 3: 3, 5: 1}
    facts = {r.anchor: (r.lessons, r.projects, r.reasons) for r in workflows.cluster_facts(led, df, "k", "text", "project").collect()}
    assert facts == {1: (3, 3, ["recurrence", "portable-tooling"]), 3: (1, 1, [])}


def test_recurring_workflows(spark):
    import datetime

    day = datetime.datetime(2025, 1, 1)
    use = lambda s: [(s, [])] if s else []
    schema = "workflow_id string, project_id string, recorded_at timestamp, prompt_shingles array<string>, tool_shingles array<string>, skill_uses array<struct<skill: string, corrections: array<string>>>"
    rows = [(f"a{k}", f"p{k}", day, ["1", "2", str(k)], ["x", "y"], use(None)) for k in range(3)]
    rows += [(f"b{k}", "p", day, ["7", "8"], ["z"], use("plan")) for k in range(3)] + [("c", "p", day, None, ["z"], use(None)), ("a0", "p0", day, ["1", "2", "0"], ["x", "y"], use(None))]
    got = workflows.recurring_workflows(spark.createDataFrame(rows, schema)).collect()
    assert [tuple(r) for r in got] == [("a0", 3, 3)]


def test_keywords(spark):
    def fold(text):
        scores, k, start = {}, 0, 0
        while True:
            words = [w for w in text[start : start + 1000].split() if len(w) >= 3]
            for w in sorted(set(words)):
                s = words.count(w) / len(words) * (1.5 if len(w) >= 6 else 1.0) * (1.3 if "_" in w else 1.0)
                scores[w] = s if k == 0 else scores.get(w, 0.0) * 0.85**k + s
            if start + 1000 >= len(text):
                break
            start, k = start + 600, k + 1
        top = max(scores.values())
        best = sorted(((round(s, 9), w) for w, s in scores.items() if s >= max(0.1 * top, 0.015)), key=lambda x: (-x[0], x[1]))[:12]
        return [w for _, w in best]

    rng = random.Random(2)
    texts = {k: " ".join(rng.choice(["alpha", "beta_x", "gamma", "longword", "tau", "ok"]) for _ in range(600 + 100 * k)) for k in range(3)}
    df = spark.createDataFrame([*texts.items(), (9, "short"), (10, None)], "k int, t string")
    got = {}
    for r in keywords.long_text_keywords(df, "k", "t").orderBy("k", "place").collect():
        got.setdefault(r.k, []).append(r.token)
    assert got == {k: fold(t) for k, t in texts.items()}


def test_tools_readiness_and_models(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    assert kb.readiness().head().entries == 0
    kb.call("ingest", {"content": "Retry queue\nthe retry queue drains slowly"})
    kb.call("ingest", {"content": "Lease table\nleases expire hourly"})
    assert {t.name for t in kb.described_tools()} == {"ingest", "lint", "focus", "search", "get"}
    assert kb.call("get", {"entry_id": "retry-queue"}).head().title == "Retry queue"
    for name, arguments in (("get", {}), ("get", {"entry_id": "x", "more": 1})):
        with pytest.raises(ValueError):
            kb.call(name, arguments)
    with pytest.raises(KeyError):
        kb.call("drop", {})
    ready = kb.readiness().head()
    assert (ready.scope, ready.entries, ready.faults, len(ready.generation)) == ("project", 2, 0, 64)
    assert [r.id for r in kb.list().collect()] == ["lease-table", "retry-queue"] and kb.list(1).count() == 1
    asked = []
    model = lambda topic, block: asked.append(block) or f"about {topic}"
    assert kb.focus("drains", model=model).head().text == "about drains" and "retry-queue" in asked[0] and "lease" not in asked[0]
    assert kb.focus("unheard", model=model).head().text == "Nothing was found about: unheard" and len(asked) == 1
    judge = lambda pages: '[{"id": "retry-queue", "severity": "error", "issue": "vague", "suggestion": "say more"}]'
    assert kb.lint(judge).where("issue = 'vague' and target = 'say more'").count() >= 1
    lines = [r.line for r in kb.catalog_document().orderBy("section", "place").collect()]
    assert lines[0] == "## Reference" and len(lines) == 3


def test_pointer_is_replaced_at_once(spark, tmp_path):
    """A second commit renames over the pointer; what was checked once isn't checked again, what was changed is found."""
    from wordloom.sources import generations

    rows = lambda n: spark.createDataFrame([(f"i{k}", k) for k in range(n)], "id string, v int")
    root = str(tmp_path / "g")
    names = [generations.commit(rows(n), root, "s") for n in (2, 3, 2)]
    assert names[0] == names[2] and generations.current(spark, root, "s") == names[0] and generations.read_current(spark, root, "s").count() == 2
    told = generations.publish(rows(2).selectExpr("id", "v", "'s' AS scope", "CASE WHEN id = 'i1' THEN 'bad' END AS error").union(rows(1).selectExpr("id", "v", "'t'", "null")), root, ["s", "t", "u"], "error")
    assert {r.scope: r.status for r in told.collect()} == {"s": "refused", "t": "published", "u": "missing"}
    with pytest.raises(ValueError):
        generations.publish(rows(2).selectExpr("id", "v", "'s' AS scope"), root, ["nowhere"])
