"""All similar pairs between records that hold two sets each.

Minwise hashes of both sets are mixed in each band. With a mean similarity of at least t, one of the two sets has at
least t, so bands of (2 minima of the first, 1 of the second) and of (1, 2) meet such a pair with probability at least
0.2 each where t = 0.6; 40 bands of each kind miss a pair that lies exactly on the threshold with 1.4e-4 at the most
unfavourable split, and far less beyond. Buckets that many records crowd, for they hold little but common values, are
left to an exact join on the rarest values of one set and, where many share these, of the other set too. Every candidate
is then checked on the whole sets, in integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.minhash import CROWD, Bands, bucket_rows, may_agree, overlap, rare_heads, rare_rows, shared_buckets
from wordloom.session import cut


def set_classes(records: DataFrame, key: str, first: str, second: str) -> tuple[DataFrame, DataFrame]:
    """Records with equal sets as one class: ``classes(node, first, second)`` and ``members(node, key)``.

    Null and repeated values do not count; records with a null key or an empty or null set are left out. Repeated rows
    of one key are one record. Sets are held as 64-bit hashes of their values, in ascending order.
    """
    filled = [F.exists(c, lambda x: x.isNotNull()) for c in (first, second)]
    held = records.where(F.col(key).isNotNull() & filled[0] & filled[1]).select(
        F.col(key).alias("key"),
        *[
            F.array_sort(F.transform(F.array_distinct(F.array_compact(c)), lambda x: F.xxhash64(x))).alias(n)
            for n, c in (("first", first), ("second", second))
        ],
    )
    held = held.select(
        "*",
        F.xxhash64(F.size("first"), "first", "second").alias("k1"),
        F.xxhash64(F.lit(1), F.size("first"), "first", "second").alias("k2"),
    )
    classes = held.groupBy("k1", "k2").agg(F.any_value("first").alias("first"), F.any_value("second").alias("second"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    members = held.select("k1", "k2", "key").distinct().join(classes.select("k1", "k2", "node"), ["k1", "k2"])
    return classes.select("node", "first", "second"), members.select("node", "key")


def similar_classes(classes: DataFrame, share: tuple[int, int] = (3, 5), bands: int = 40) -> DataFrame:
    """``a, b`` with a < b: the classes whose mean Jaccard similarity is at least ``share`` (a fraction)."""
    met = candidates(classes, share, bands)
    side = lambda end: classes.select(*[F.col(c).alias(n) for c, n in zip(classes.columns, (end, f"{end}1", f"{end}2"))])
    both = met.join(side("a"), "a").join(side("b"), "b")
    (common1, all1), (common2, all2) = overlap("a1", "b1"), overlap("a2", "b2")
    close = (common1 * all2 + common2 * all1) * share[1] >= all1 * all2 * (2 * share[0])
    return both.where(close).select("a", "b")


def candidates(classes: DataFrame, share: tuple[int, int] = (3, 5), bands: int = 40) -> DataFrame:
    """``a, b`` with a < b: the pairs of ``classes(node, first, second)`` whose whole sets are to be compared."""
    families = [Bands((("first", 2), ("second", 1)), bands), Bands((("first", 1), ("second", 2)), bands)]
    shared = shared_buckets(bucket_rows(classes, "node", families), "node")
    met = _met(shared.where(F.col("crowd") <= CROWD))
    crowd = shared.where(F.col("crowd") > CROWD).select("node").distinct()
    if not crowd.isEmpty():
        crowded = cut(classes.join(crowd, "node", "left_semi"))
        # a similar pair reaches the share in one of its sets
        met = met.union(_rare_pairs(crowded, "first", "second", share)).union(_rare_pairs(crowded, "second", "first", share))
    return met.distinct()


def _rare_pairs(records: DataFrame, name: str, other: str, share: tuple[int, int]) -> DataFrame:
    """``a, b`` with a < b: no pair is missing that has the mean ``share`` and reaches it in the set ``name``.

    Such a pair has one of the rarest values of ``name`` in common, and agrees to at least 2 share - 1 in the other set.
    So where many records hold a rare value, they meet only if they also share one of the rarest values of the other
    set, as counted among them.
    """
    rows = rare_rows(records, "node", name, share[0] / share[1])
    sized = rows.groupBy("bucket").agg(F.count("*").alias("crowd")).where("crowd > 1")
    rows = cut(rows.join(sized, "bucket"))
    least = (2 * share[0] - share[1]) / share[1]
    if least <= 0:  # any other set will do
        return _met(rows)
    many = rows.where(F.col("crowd") > CROWD).select("bucket", "node")
    values = many.join(records.select("node", F.size(other).alias("size"), F.col(other).alias("items")), "node")
    heads = cut(rare_heads(values.select("bucket", "node", "size", F.explode("items").alias("value")), ["bucket"], least))
    side = lambda rows, n: rows.select("bucket", "value", F.col("node").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("size", "after")])
    both = side(heads.where("small"), "x").join(side(heads, "y"), ["bucket", "value"]).where("x <> y").where(may_agree(least))
    found = both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return _met(rows.where(F.col("crowd") <= CROWD)).union(found)


def _met(rows: DataFrame) -> DataFrame:
    """``a, b`` with a < b of each bucket."""
    left, right = (rows.select("bucket", F.col("node").alias(n)) for n in ("a", "b"))
    return left.join(right, "bucket").where("a < b").select("a", "b")


def similar_pairs(records: DataFrame, key: str, first: str, second: str, share: tuple[int, int] = (3, 5)) -> DataFrame:
    """``key_a, key_b`` with key_a < key_b: every pair of different keys whose sets are similar enough.

    The comparison works on classes of equal sets; only the result lists the pairs between and within classes, which
    it must name one by one: blocks of a class meet blocks of another, so no task lists the pairs of a whole class.
    Ties on the threshold are pairs. An empty table gives no pairs. similar_members() tells the same without naming pairs.
    """
    classes, members = set_classes(records, key, first, second)
    placed = blocks(cut(members))
    between = cut(similar_classes(classes, share))
    parts = placed.groupBy("node").agg(F.max("parts").alias("parts"))
    many = lambda end, n: parts.select(F.col("node").alias(end), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(n))
    side = lambda end, n, k: placed.select(F.col("node").alias(end), F.col("block").alias(n), F.col("key").alias(k))
    met = between.join(many("a", "p"), "a").join(many("b", "q"), "b")
    across = met.join(side("a", "p", "x"), ["a", "p"]).join(side("b", "q", "y"), ["b", "q"]).select("x", "y")
    within = twins(placed)
    return across.union(within).select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


#: Members of a block.
MEMBERS = 2_000


def blocks(members: DataFrame, size: int = MEMBERS) -> DataFrame:
    """``members(node, key)`` with ``alike``, the number of members of the node, and its block of ``parts`` of about ``size``."""
    sizes = members.groupBy("node").agg(F.count("*").alias("alike"))
    counted = members.join(sizes, "node").withColumn("parts", F.ceil(F.col("alike") / size).cast("int"))
    return counted.withColumn("block", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))


def twins(placed: DataFrame) -> DataFrame:
    """``x, y``: the pairs within a node of ``placed``, which comes from blocks(): each block meets itself and all later ones."""
    copies = placed.where("alike > 1")
    x = copies.select("node", F.col("block").alias("p"), F.explode(F.sequence("block", F.col("parts") - 1)).alias("q"), F.col("key").alias("x"))
    y = copies.select("node", F.explode(F.sequence(F.lit(0), "block")).alias("p"), F.col("block").alias("q"), F.col("key").alias("y"))
    return x.join(y, ["node", "p", "q"]).where("p < q OR x < y").select("x", "y")


def similar_members(records: DataFrame, key: str, first: str, second: str, share: tuple[int, int] = (3, 5)) -> DataFrame:
    """``key, class_id, links``: each key, the smallest key with equal sets, and how many other keys are similar to it.

    The same comparison as similar_pairs(), in as many rows as there are keys with two filled sets.
    """
    classes, members = set_classes(records, key, first, second)
    members, between = cut(members), cut(similar_classes(classes, share))
    alike = members.groupBy("node").agg(F.min("key").alias("class_id"), F.count("*").alias("n"))
    ways = between.select("a", "b").union(between.select("b", "a"))
    linked = ways.join(alike.select(F.col("node").alias("b"), "n"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("other"))
    told = alike.join(linked, "node", "left").select("node", "class_id", (F.coalesce("other", F.lit(0)) + F.col("n") - 1).alias("links"))
    return members.join(told, "node").select(F.col("key").alias(key), "class_id", "links")
