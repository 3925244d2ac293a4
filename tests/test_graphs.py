"""Components and leader clusters against plain Python."""

import random

from wordloom.operators.clusters import leader_clusters
from wordloom.operators.components import connected_components


def union_find(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in up}


def components(spark, edges):
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    return {r.node: r.component for r in connected_components(df).collect()}


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(30)] + [(rng.randint(100, 180), rng.randint(100, 180)) for _ in range(60)]
    edges += [(500, 500), (7, 6), (6, 7)] + [(1000, 1000 + k) for k in range(1, 200)]
    assert components(spark, edges) == union_find(edges)


def test_components_empty_and_null(spark):
    assert components(spark, []) == {}
    assert components(spark, [(None, 1), (2, None)]) == {}
    assert components(spark, [(3, 3)]) == {3: 3}


def leaders(spark, nodes, pairs, **how):
    df = spark.createDataFrame(nodes, "node bigint, place int")
    links = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "a bigint, b bigint, similarity double")
    return {r.node: r.anchor for r in leader_clusters(df, links, **how).collect()}


def in_order(nodes, pairs):
    anchors, want = [], {}
    for k, _ in sorted(nodes, key=lambda n: (n[1] is not None, n[1] or 0, n[0])):
        near = next((a for a in anchors if (min(a, k), max(a, k)) in pairs), None)
        want[k] = k if near is None else near
        if near is None:
            anchors.append(k)
    return want


def test_leaders(spark):
    rng = random.Random(4)
    nodes = [(k, rng.choice([None, 1, 2, 3])) for k in range(60)]
    pairs = {(a, b): rng.random() for a, b in {tuple(sorted(rng.sample(range(60), 2))) for _ in range(50)}}
    want = in_order(nodes, pairs)
    assert leaders(spark, nodes, pairs) == want
    assert leaders(spark, nodes, pairs, bound=0) == want  # rounds alone
    assert leaders(spark, nodes, pairs, bound=4) == want  # some components in tasks, others in rounds
    assert leaders(spark, nodes, {}) == {k: k for k, _ in nodes}


def test_long_chain(spark, monkeypatch):
    """A chain of 1,000 records, each like the one before: few tables are written."""
    from wordloom.operators import clusters, components

    written = []
    for module in (clusters, components):
        monkeypatch.setattr(module, "cut", lambda df, made=module.cut: (written.append(1), made(df))[1])
    nodes = [(k, k) for k in range(1000)]
    pairs = {(k, k + 1): 0.9 for k in range(999)}
    assert leaders(spark, nodes, pairs) == in_order(nodes, pairs)
    assert len(written) < 20
    written.clear()
    pairs = {(k, k + 1): 0.9 for k in range(999) if k % 50 != 49}
    assert leaders(spark, nodes, pairs, bound=100) == in_order(nodes, pairs)  # by components
    assert len(written) < 20
