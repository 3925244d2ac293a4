"""Frequent subsequences against plain enumeration."""

import itertools
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from wordloom.llm import sequences
from wordloom.llm.sequences import frequent_sequences

SCHEMA = "session_id string, steps array<string>, entity int, weight int, pattern string, place int"


def found(spark, rows, share=Fraction(1, 10), longest=5):
    df = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA)
    return {r.pattern: r.support for r in frequent_sequences(df, "session_id", F.col("steps"), share, longest).collect()}


def brute(rows, share=Fraction(1, 10), longest=5):
    holders, entities = {}, set()
    for e, steps in rows:
        if e is None:
            continue
        entities.add(e)
        clean = [s for s in (steps or []) if s is not None and s.strip()]
        for n in range(2, longest + 1):
            for p in set(itertools.combinations(clean, n)):
                holders.setdefault(p, set()).add(e)
    return {" > ".join(p): len(h) for p, h in holders.items() if len(h) >= share * len(entities)}


def random_rows(seed, n=120, letters="abcdef"):
    rng = random.Random(seed)
    rows = [(f"s{rng.randint(0, n)}", [rng.choice(letters) for _ in range(rng.randint(0, 9))]) for _ in range(n)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_patterns(spark, seed):
    rows = random_rows(seed)
    assert found(spark, rows) == brute(rows)


def test_many_blocks_and_passes(spark, monkeypatch):
    monkeypatch.setattr(sequences, "BLOCK", 15)
    monkeypatch.setattr(sequences, "PASS", 50)
    rows = random_rows(3, 200)
    assert found(spark, rows, Fraction(1, 7), 4) == brute(rows, Fraction(1, 7), 4)


def test_one_entity_holds_a_third(spark):
    rows = random_rows(4, 80) + [("hot", list(p)) for p in itertools.product("xyz", repeat=3)]
    assert found(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [
        ("a", ["x", None, "y", " ", ""]), ("a", ["x", None, "y", " ", ""]), ("a", ["y", "x"]), (None, ["x", "y"]), ("b", None), ("c", []),
        ("d", ["x", "x", "x"]), ("e", [None]), ("f", ["y", "x"]),
    ]
    assert found(spark, rows, Fraction(1, 6)) == brute(rows, Fraction(1, 6)) == {"x > y": 1, "y > x": 2, "x > x": 1, "x > x > x": 1}
    assert found(spark, []) == {}
    assert found(spark, [("a", None)]) == {}
    assert found(spark, [("a", ["q"] * 3000)], longest=3) == {"q > q": 1, "q > q > q": 1}


def test_many_items_at_a_low_share(spark):
    """10,000 items at a share of 0.001: memory grows with the steps, not with steps times items."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    rows = [(f"s{k}", [f"i{min(9999, int(rng.paretovariate(0.35))) if rng.random() < 0.5 else rng.randint(1, 9999)}" for _ in range(rng.randint(2, 14))]) for k in range(6000)]
    assert len({x for _, r in rows for x in r}) > 5000
    assert found(spark, rows, Fraction(1, 1000), 2) == brute(rows, Fraction(1, 1000), 2)
    steps = pa.array([r for _, r in rows])
    items = pa.array([f"i{k}" for k in range(1, 10_000)])
    tracemalloc.start()
    diagram = sequences.Diagram(steps, items)
    mined = diagram.mine(np.ones(len(rows), np.int64), 30, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert mined and peak < 100e6  # a table of nodes by items would take a gigabyte


def test_bound_leaves_out_what_cannot_reach_the_support(spark):
    """Patterns of one block alone are no candidates where the other blocks can't add enough."""
    rows = [(f"s{k}", ["a", "b", f"c{k % 3}"]) for k in range(90)] + [(f"t{k}", ["x", "y", f"z{k}"]) for k in range(9)]
    df = spark.createDataFrame(rows, "entity string, steps array<string>").repartition(1)
    patterns, n = sequences._candidates(df, Fraction(1, 10), 3, 10)
    kept = {tuple(r[0]) for r in patterns.collect()}
    assert ("x", "y") not in kept and ("a", "b", "c0") in kept and len(kept) == n
