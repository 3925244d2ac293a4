"""Mixing on small tables: targets, caps, and what cannot be met."""

import math
import os
import random

import pytest

from wordloom.llm import mixing
from wordloom.llm.mixing import calibration, document_rates, mix, mix_shares, mixed_copies, read_targets, shares as shares_of
from wordloom.llm.tokens import VOCABULARY

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")

DOCS = "doc_id bigint, text string, source string, tokens int, p string, rate string, most int, label int"
TARGETS = "source string, target_weight double, max_repeats int"


def documents(spark, counts, seed=1):
    rng = random.Random(seed)
    rows, k = [], 0
    for source, n in counts.items():
        for _ in range(n):
            word = source or rng.choice(["a", "b"])
            rows.append((k, " ".join(rng.choice([f"{word}{rng.randint(0, 9)}", "and", "or"]) for _ in range(rng.randint(20, 60))), source, 1, "x", "y", 2, 3))
            k += 1
    return spark.createDataFrame(rows, DOCS)


def shares(spark, docs, targets):
    return {r.source: r for r in mix_shares(docs, spark.createDataFrame(targets, TARGETS), "doc_id", "text", "source").collect()}


def test_targets_are_met(spark):
    docs = documents(spark, {"a": 300, "b": 60, "c": 40, None: 30})
    got = shares(spark, docs, [("a", 0.5, 1), ("b", 0.3, 3), ("none", 0.2, 2)])
    assert got["none"].reached_share == 0
    assert abs(got["a"].reached_share - 0.5 / 0.8) < 0.02 and abs(got["b"].reached_share - 0.3 / 0.8) < 0.02
    assert got["a"].most_copies <= 1 and got["b"].most_copies <= 3


def test_caps_hold_when_the_total_is_too_large(spark):
    docs = documents(spark, {"a": 100, "b": 10})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGETS)
    rows = mix(docs, targets, "doc_id", "text", "source", total=1e9).collect()
    assert {r.copies for r in rows if r.source == "a"} == {1} and {r.copies for r in rows if r.source == "b"} == {2}


def test_edges(spark):
    docs = documents(spark, {"a": 30, "b": 5})
    empty = spark.createDataFrame([(900, None, "a", 1, "", "", 1, 1), (901, "", "a", 1, "", "", 1, 1), (None, "x y", "a", 1, "", "", 1, 1)], DOCS)
    targets = [("a", 1.0, 1), ("a", 1.0, 1), (None, 0.5, 1), ("z", None, 1), ("y", 0.0, 1)]
    rows = mix(docs.union(empty), spark.createDataFrame(targets, TARGETS), "doc_id", "text", "source").collect()
    assert sorted(r.doc_id for r in rows) == list(range(30)) and {r.copies for r in rows} == {1}
    assert mix(docs, spark.createDataFrame([], TARGETS), "doc_id", "text", "source").count() == 0
    assert shares(spark, docs, []) == {}
    assert mix(docs.limit(0), spark.createDataFrame(targets, TARGETS), "doc_id", "text", "source").count() == 0
    assert {r.reached_share for r in shares(spark, docs.limit(0), targets).values()} == {0.0}


def test_read_targets(spark):
    goal = read_targets(spark.createDataFrame([("b", 1.0, None), ("a", 3.0, 2), ("b", 1.0, None)], TARGETS))
    assert (goal.names, goal.weights, goal.caps) == (["a", "b"], [0.75, 0.25], [2, 1])


def test_two_classes_after_an_observation(spark):
    """The session holds an observation, and the classifier has two classes: the model must still reach the tasks."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    docs = documents(spark, {"a": 60, "b": 60, None: 20}, seed=4)
    got = shares(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)])
    assert abs(got["a"].reached_share - 0.5) < 0.03


def test_listed_sources_stay_among_many(spark, monkeypatch):
    """More sources than can be classes: the listed ones are classes all the same, the others are one."""
    monkeypatch.setattr(mixing, "MOST_SOURCES", 4)
    names = [f"{c}source" for c in "abcdefghijkl"]
    docs = documents(spark, {n: 12 for n in names})
    listed = [names[1], names[6], names[11]]
    asked = spark.createDataFrame([(1000 + k, " ".join(f"{n}{i}" for i in range(10)), None, 1, "x", "y", 2, 3) for k, n in enumerate(listed)], DOCS)
    found = {r.doc_id: r.p for r in mixing.posteriors(docs.union(asked), "doc_id", "text", "source", listed).collect()}
    assert [found[1000 + k].index(max(found[1000 + k])) for k in range(3)] == [0, 1, 2] and all(min(p) > 0 for p in found.values())


def texts(rng, source, n=40, own=0.25):
    """Words of which a part are the source's own."""
    return " ".join(f"{source}{rng.randint(0, 9)}" if rng.random() < own else rng.choice(["and", "or", "of", "the", "so"]) for _ in range(n))


def test_many_sources_meet_their_targets(spark):
    """1,500 sources, three of them listed: none is lost, all others are one class."""
    rng = random.Random(6)
    sources = [f"s{k}x" for k in range(1500)] + ["a"] * 300 + ["b"] * 200 + ["c"] * 100 + [None] * 60
    rows = [(k, texts(rng, s or rng.choice("ab")), s, 1, "x", "y", 2, 3) for k, s in enumerate(sources)]
    got = shares(spark, spark.createDataFrame(rows, DOCS), [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)])
    assert {n: round(r.reached_share, 1) for n, r in got.items()} == {"a": 0.5, "b": 0.3, "c": 0.2}
    assert all(abs(r.reached_share - r.target_share) < 0.02 and abs(r.missed_share) < 1e-3 and r.settled for r in got.values())


def test_posteriors_steer_the_mix(spark):
    """Half of the documents hide their source. The true shares meet the targets, and hidden ones are used as their true source is."""
    rng = random.Random(7)
    true = ["a"] * 500 + ["b"] * 300 + ["c"] * 200
    rows = [(k, texts(rng, s), None if rng.random() < 0.5 else s, 1, "x", "y", 2, 3) for k, s in enumerate(true)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = [("a", 0.3, 1), ("b", 0.5, 1), ("c", 0.2, 1)]
    used = mix(docs, spark.createDataFrame(targets, TARGETS), "doc_id", "text", "source", total=20_000.0).collect()

    size = {n: sum(r.copies * r.tokens for r in used if true[r.doc_id] == n) for n in "abc"}
    assert all(abs(size[n] / sum(size.values()) - w) < 0.03 for n, w, _ in targets)
    hidden = {n: [r.copies for r in used if r.source is None and true[r.doc_id] == n] for n in "abc"}
    rate = {n: sum(c) / len(c) for n, c in hidden.items()}
    assert rate["b"] > 2 * rate["a"] and min(map(len, hidden.values())) > 60


def test_soft_membership_of_named_documents(spark):
    """With half the weight on posteriors the labels alone no longer decide, and the fit still meets the targets."""
    rng = random.Random(8)
    rows = [(k, texts(rng, s), s, 1, "x", "y", 2, 3) for k, s in enumerate(["a"] * 200 + ["b"] * 100)]
    got = {r.source: r for r in mix_shares(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS), "doc_id", "text", "source", label_weight=0.5).collect()}
    assert all(abs(r.reached_share - 0.5) < 0.03 for r in got.values())


def test_steps_that_do_not_settle_are_told(spark):
    docs = documents(spark, {"a": 100, "b": 50, None: 60})
    asked = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    one = {r.source: r for r in mix_shares(docs, asked, "doc_id", "text", "source", steps=1).collect()}
    assert not any(r.settled for r in one.values()) and max(abs(r.missed_share) for r in one.values()) > 1e-3
    lost = mix_shares(docs, asked, "doc_id", "text", "source", total=1e7).collect()
    assert all(r.missed_share < -0.1 for r in lost)  # the caps leave no way to it


def test_shares_of_a_written_mix(spark, tmp_path):
    """The shares by source, against SQL over the written mix."""
    import duckdb

    docs = documents(spark, {"a": 300, "b": 60, "c": 40, None: 30})
    rates, fit = document_rates(docs, spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3)], TARGETS), "doc_id", "text", "source")
    used = mixed_copies(rates, "doc_id")
    used.write.parquet(str(tmp_path / "mix"))
    sql = f"SELECT source, sum(copies * tokens) / (SELECT sum(copies * tokens) FROM m), count(*) FILTER (copies > 0), max(copies) FROM m WHERE source IS NOT NULL GROUP BY 1"
    want = {r[0]: r[1:] for r in duckdb.sql(f"WITH m AS (SELECT * FROM '{tmp_path}/mix/*.parquet') {sql}").fetchall()}
    got = {r.source: (r.labelled_share, r.documents_used, r.most_copies) for r in shares_of(spark.read.parquet(str(tmp_path / "mix")), fit).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[n][0], want[n][0], rel_tol=1e-9) and got[n][1:] == want[n][1:] for n in got)


def test_calibration(spark):
    """Posteriors of documents that weren't fitted on add up to the sources' numbers, however unequal these are."""
    rng = random.Random(9)
    sources = ["a"] * 1500 + ["b"] * 300 + ["c"] * 150 + ["rest"] * 400 + [None] * 80
    rows = [(k, texts(rng, s or "a", 20, 0.06), s, 1, "x", "y", 2, 3) for k, s in enumerate(sources)]
    docs, asked = spark.createDataFrame(rows, DOCS), spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 1), ("c", 0.1, 1), ("none", 0.1, 1)], TARGETS)
    got = {r.source: r for r in calibration(docs, asked, "doc_id", "text", "source", sample=100).collect()}
    for n in "abc":
        assert abs(got[n].expected - got[n].documents) < 0.05 * got[n].documents + 2 * got[n].documents**0.5
    assert got["none"].documents == 0 and got["none"].expected < 1e-6 and got["a"].right > 0.8 * got["a"].documents
    assert calibration(docs.limit(0), asked, "doc_id", "text", "source").count() == 0
