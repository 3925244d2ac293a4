"""Page spam: measures on small texts, and held-out accuracy on labelled pages."""

import os

import numpy as np
import pytest

from wordloom.llm.stuffing import NAMES, Forest, fit, function_words, measured, measures, stuffed_pages

LARGE = "/root/testdata/sf0.1"
SCHEMA = "doc_id bigint, text string, label int, measures string, features string"


def test_measures():
    prose = "The store keeps what the worker has sent. It is read again when the queue is empty, and nobody waits for it. "
    functions = frozenset("the what has it is when and for by".split())
    rows = measures(["", "x", "buy shoes now " * 50, prose * 3, "\n".join(f"[a{k}](http://x/{k})" for k in range(40)), "a" * 100_000, "\n\n"], functions)
    got = {n: rows[:, k] for k, n in enumerate(NAMES)}
    assert np.isfinite(rows).all() and rows.shape == (7, len(NAMES))
    assert got["lag_3"][2] > 0.9 > got["lag_3"][3] and got["gap_8"][2] > 0.9
    assert got["function"][3] > 0.3 > got["function"][2] and got["links"][4] == 0.5 and got["link_even"][4] < 0.01 and got["lag_2"][4] > 0.45
    assert got["prose"][3] > 0.5 > got["prose"][2] and got["stuffed"][2] == 1 and got["stuffed"][3] == 0
    assert measures([], functions).shape == (0, len(NAMES)) and not any(n.startswith(("mark_", "upper", "spaces")) for n in NAMES)


def test_function_words(spark):
    """Words that many documents of a language hold, as evenly as chance would have it; keywords aren't among them."""
    rows = [(f"the number {k} of item{k} is kept", "en") for k in range(60)] + [("shoes " * 60 + "the", "en-GB")] * 20
    rows += [(f"der Wert {k} von Teil{k} ist da", "DE") for k in range(40)] + [("x" * k, "zz") for k in range(5)] + [(None, "en"), ("", "de"), ("y", None)]
    docs = spark.createDataFrame([(*r, 1, "a", "b") for r in rows], "text string, lang string, df int, term string, n string")
    found = {(r.language, r.term) for r in function_words(docs, "text", "lang").collect()}
    assert {t for g, t in found if g == "en"} == {"the", "number", "of", "is", "kept"}
    assert {t for g, t in found if g == "de"} == {"der", "wert", "von", "ist", "da"}
    assert {r.term for r in function_words(docs, "text").collect()} >= {"the"} and function_words(docs.limit(0), "text", "lang").count() == 0


def test_forest_as_arrays(spark, tmp_path):
    from pyspark.ml.classification import RandomForestClassificationModel
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(1)
    table = rng.random((200, len(NAMES)))
    rows = [(k, int(t[0] + t[1] > 1), [float(x) for x in t]) for k, t in enumerate(table)]
    df = spark.createDataFrame(rows, "k int, label int, measures array<double>")
    model = fit(df, "label", trees=12, depth=5)
    forest = Forest(model, str(tmp_path / "forest"), spark)
    model = RandomForestClassificationModel.load(str(tmp_path / "forest"))
    scored = model.transform(df.select("k", array_to_vector("measures").alias("features"))).orderBy("k")
    want = [r[0] for r in scored.select(vector_to_array("probability")[1]).collect()]
    assert np.allclose(forest.score(table), want)


def test_edges(spark):
    docs = spark.createDataFrame(
        [(k, t, 7, "x", "y") for k, t in enumerate([None, "", " ", *["best cheap shoes " * 40] * 6, *["It is what we have read in the store, and so on it goes. " * 6] * 6])], SCHEMA
    )
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 1), (9, 0), (10, 0), (11, None), (None, 1), (99, 0)], "doc_id bigint, label int")
    assert sorted(r[0] for r in stuffed_pages(docs, labels, "doc_id", "text", "label").collect()) == [3, 4, 5, 6, 7, 8]
    assert stuffed_pages(docs, labels.where("label = 1"), "doc_id", "text", "label").count() == 0
    assert stuffed_pages(docs, labels.limit(0), "doc_id", "text", "label").count() == 0
    assert stuffed_pages(docs.limit(0), labels, "doc_id", "text", "label").count() == 0


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="no test tables here")
def test_held_out_accuracy(spark):
    """Labels that the forest hasn't seen."""
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{LARGE}/{n}.parquet") for n in ("documents", "page_labels"))
    labels = labels.where("is_spam is not null").select("doc_id", "is_spam").distinct()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    truth = {r.doc_id: r.is_spam for r in labels.where(part).collect()}
    held = docs.join(labels.where(part).select("doc_id"), "doc_id")
    found = {r[0] for r in stuffed_pages(held.union(docs.join(labels.where(~part).select("doc_id"), "doc_id")), labels.where(~part), "doc_id", "text", "is_spam", "lang").collect()}
    hits = sum(truth[k] for k in truth if k in found)
    assert hits >= 0.95 * sum(truth.values()) and hits >= 0.95 * len(found & truth.keys())


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="no test tables here")
def test_held_out_language(spark, tmp_path):
    """A language of which the forest has seen no page."""
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{LARGE}/{n}.parquet") for n in ("documents", "page_labels"))
    functions = frozenset(r.term for r in function_words(docs, "text", "lang").collect())
    labels = labels.where("is_spam is not null").groupBy("doc_id").agg(F.max("is_spam").alias("label"))
    rows = measured(docs.join(labels, "doc_id"), ["label", "lang"], "text", functions).cache()
    for language in ("de", "ru"):
        there = F.coalesce(F.lower("lang"), F.lit("")).startswith(language)
        forest = Forest(fit(rows.where(~there), "label"), str(tmp_path / language), spark)
        held = rows.where(there).collect()
        found, truth = forest.score(np.array([r.measures for r in held])) >= 0.5, np.array([r.label == 1 for r in held])
        assert (found & truth).sum() >= 0.95 * max(found.sum(), truth.sum()) > 0
    rows.unpersist()


@pytest.mark.parametrize("period", [7, 9, 11, 13, 23])
def test_every_period_has_a_lag(period):
    """A phrase that is repeated agrees with itself at the lag of its length."""
    row = dict(zip(NAMES, measures([" ".join([" ".join(f"w{k}" for k in range(period))] * 20)], frozenset())[0]))
    assert row["lag_most"] > 0.9
