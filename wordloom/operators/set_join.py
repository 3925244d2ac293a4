"""Exact similarity join of sets by prefix filter.

Two sets with a Jaccard similarity of at least t share one of the first n - ceil(t n) + 1 values of each, values being
ordered from rare to common; the smaller of the two needs only its first n - ceil(2 t / (1 + t) n) + 1. Only these prefixes
are joined, and a pair must be able to reach t by its sizes and by what is left of both sets from the shared value on. So
common values hardly pair up the records that hold them; the candidates are then compared on the whole sets. Equal sets
are one class throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.session import cut


def set_classes(records: DataFrame, key: str, items: Column) -> tuple[DataFrame, DataFrame]:
    """Equal sets as one class: ``classes(node, items)`` and ``members(key, node)``.

    Values are held as 64-bit hashes. Null values and repeats don't count; null keys and empty sets are left out. The
    class's node is the smallest key; repeated rows of one key are one record, whose first set by hash stands.
    """
    listed = records.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.array_distinct(F.array_compact(items)).alias("raw"))
    held = listed.select("key", F.array_sort(F.transform("raw", lambda x: F.xxhash64(x))).alias("items"))
    held = held.select("*", F.xxhash64("items").alias("k1"), F.xxhash64(F.lit(1), "items").alias("k2"))
    one = held.groupBy("key").agg(F.min(F.struct("k1", "k2")).alias("k"))
    sets = held.groupBy("k1", "k2").agg(F.any_value("items").alias("items")).where("size(items) > 0")
    placed = one.select("key", "k.k1", "k.k2")
    names = placed.groupBy("k1", "k2").agg(F.min("key").alias("node"))
    classes = cut(sets.join(names, ["k1", "k2"]).select("node", "items", "k1", "k2"))
    members = placed.join(classes.select("k1", "k2", "node"), ["k1", "k2"]).select("key", "node")
    return classes.select("node", "items"), members


def similar_sets(classes: DataFrame, threshold: float) -> DataFrame:
    """``a, b, similarity`` with a < b: all pairs of ``classes(node, items)`` that are at least so similar."""
    values = classes.select("node", F.explode("items").alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("n"))
    shared = common.where("n > 1")
    ranked = values.join(shared, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("v"))
    sized = ranked.join(classes.select("node", F.size("items").alias("size")), "node")
    # values that stand in one set only come first in its order and join nothing: they just use up the prefix
    prefix = lambda t: (F.size("v") - F.ceil(F.lit(t) * F.col("size") - 1e-9) + 1).cast("int")
    sized = sized.withColumns({"larger": prefix(threshold), "smaller": prefix(2 * threshold / (1 + threshold)), "held": F.size("v")})
    heads = sized.where("larger > 0").select("node", "size", "smaller", "held", F.posexplode(F.slice("v", 1, F.col("larger"))).alias("at", "h"))
    heads = cut(heads.select("node", "size", F.col("h.value").alias("value"), (F.col("at") < F.col("smaller")).alias("small"), (F.col("held") - F.col("at")).alias("left")))
    side = lambda rows, n: rows.select("value", F.col("node").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("size", "left")])
    fits = (F.col("size_x") <= F.col("size_y")) & (F.col("size_x") >= F.lit(threshold) * F.col("size_y") - 1e-9)
    reach = F.least("left_x", "left_y") >= F.lit(threshold / (1 + threshold)) * (F.col("size_x") + F.col("size_y")) - 1e-9
    met = side(heads.where("small"), "x").join(side(heads, "y"), "value").where((F.col("x") != F.col("y")) & fits & reach)
    met = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    sides = [classes.select(F.col("node").alias(n), F.col("items").alias(f"items_{n}")) for n in ("a", "b")]
    both = met.join(sides[0], "a").join(sides[1], "b")
    common = F.size(F.array_intersect("items_a", "items_b"))
    ratio = common / (F.size("items_a") + F.size("items_b") - common)
    return both.select("a", "b", ratio.alias("similarity")).where(F.col("similarity") >= threshold)


def nearest(pairs: DataFrame) -> DataFrame:
    """``node, nearest, similarity``: the most similar partner of each node of ``pairs(a, b, similarity)``; ties go to the last."""
    ways = pairs.select("a", "b", "similarity").union(pairs.select("b", "a", "similarity"))
    best = ways.groupBy(F.col("a").alias("node")).agg(F.max(F.struct("similarity", "b")).alias("m"))
    return best.select("node", F.col("m.b").alias("nearest"), "m.similarity")
