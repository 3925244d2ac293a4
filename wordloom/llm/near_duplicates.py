"""Records that differ by small edits, grouped over links of high set similarity.

64 bands of 4 minima meet a pair of similarity 0.6 with probability 0.99986 and, groups being linked in many ways, lose
a member less often still. In each bucket all members are first compared with its head; what is linked to the same
smallest record by then belongs together, and only other members are compared with each other. So a bucket full of copies costs
one comparison a member, and no pair that could still join two groups is skipped. Where a bucket still holds many
parts or large ones, since very many pages share a passage, its members meet by an exact join on their rarest shingles
instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import words
from wordloom.llm.minhash import CROWD, agreeing, may_agree, overlap, rare_heads, shared_buckets, with_bands, with_runs
from wordloom.operators.components import connected_components
from wordloom.session import cut, spread

#: Bands and minima of each. Their lowest bytes are the signature; at similarity s a share s + (1 - s) / 256 of it agrees.
BANDS, ROWS = 64, 4
SIGNATURE = BANDS * ROWS


def text_classes(records: DataFrame, key: str, title: str, content: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Records with equal shingles as one class: ``classes(node, grams, signature, buckets)`` and ``members(node, key)``.

    Shingles are runs of ``size`` words of title, line feed and content, as 64-bit hashes. Records with a null key,
    without a word in the content, or too short for a shingle are left out. Repeated rows of one key are one record;
    should their texts differ, the one with the smallest hash stands for it.
    """
    whole = F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\n"), F.coalesce(F.col(content), F.lit("")))
    texts = spread(records.where(F.col(key).isNotNull() & F.col(content).rlike(r"[\p{L}\p{N}]")).select(F.col(key).alias("key"), whole.alias("text")))
    worded = texts.select("key", words(F.col("text")).alias("words"))
    # the words stand in a projection of their own: inside the lambda they would be found again for each
    hashes = worded.select("key", F.transform("words", lambda w: F.xxhash64(w)).alias("grams"))
    # written, since both classes and members are made of them: a text's shingles are taken once
    held = cut(with_runs(hashes, "grams", size).select("*", F.xxhash64("grams").alias("k1"), F.xxhash64(F.lit(1), "grams").alias("k2")))
    classes = held.groupBy("k1", "k2").agg(F.any_value("grams").alias("grams")).where("size(grams) > 0")
    classes = cut(with_bands(classes.withColumn("node", F.monotonically_increasing_id()), "grams", BANDS, ROWS))
    one = held.groupBy("key").agg(F.min(F.struct("k1", "k2")).alias("k"))
    members = one.select("key", "k.k1", "k.k2").join(classes.select("k1", "k2", "node"), ["k1", "k2"])
    return classes.select("node", "grams", "signature", "buckets"), members.select("node", "key")


def linked(pairs: DataFrame, classes: DataFrame, share: float) -> DataFrame:
    """The pairs ``a, b`` of nodes that are similar enough: first by signature, then by the whole sets."""
    least = SIGNATURE * (share - 5.5 * (share * (1 - share) / SIGNATURE) ** 0.5)
    side = lambda end, what: classes.select(F.col("node").alias(end), F.col(what).alias(f"{end}_{what}"))
    signed = pairs.join(side("a", "signature"), "a").join(side("b", "signature"), "b")
    likely = agreeing(signed, "a_signature", "b_signature", int(least))
    common, either = overlap("a_grams", "b_grams")
    return likely.join(side("a", "grams"), "a").join(side("b", "grams"), "b").where(_ratio(common, either) >= share).select("a", "b")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def class_components(classes: DataFrame, share: float = 0.6) -> DataFrame:
    """``node, component`` of every class that is linked to another one."""
    shared = shared_buckets(classes.select(F.explode("buckets").alias("bucket"), "node"), "node")
    star = shared.where("head < node").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    first = cut(linked(star, classes, share))
    placed = shared.join(_labels(first), "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("part"))
    sizes = placed.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    parts = sizes.groupBy("bucket").agg(
        F.count("*").alias("parts"), F.sum("n").alias("members"), F.sum(F.col("n").cast("double") * F.col("n")).alias("inner")
    ).where("parts > 1")
    # pairs of different parts, of which a member may be in CROWD on average
    pairs = (F.col("members").cast("double") * F.col("members") - F.col("inner")) / 2
    crowded = (F.col("parts") > CROWD) | (pairs > CROWD * F.col("members"))
    open_rows = cut(placed.join(parts.select("bucket", crowded.alias("crowded")), "bucket"))
    rest = _across(open_rows.where("not crowded").select("bucket", "node", "part"))
    crowd = open_rows.where("crowded").select("node", "part").distinct()
    if not crowd.isEmpty():
        rest = rest.union(_rare_across(classes.join(crowd, "node"), share))
    rest = rest.distinct()
    second = linked(rest, classes, share)
    return connected_components(first.union(second))


def _labels(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that a node is linked to, and what that one is linked to in turn.

    Nodes of one label are of one component, whose other labels are found later. It takes no rounds and brings nearly all
    members of a group together that all look like its smallest one.
    """
    near = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("near"))
    far = near.select(F.col("node").alias("near"), F.col("near").alias("far"))
    return near.join(far, "near", "left").select("node", F.coalesce("far", "near").alias("label"))


def _across(placed: DataFrame) -> DataFrame:
    """``a, b``: the pairs of ``placed(bucket, node, part)`` that share a bucket but are of different parts."""
    parts = placed.select("bucket", "part").distinct()
    two = parts.withColumnRenamed("part", "p").join(parts.withColumnRenamed("part", "q"), "bucket").where("p < q")
    x, y = (placed.select("bucket", F.col("part").alias(p), F.col("node").alias(n)) for p, n in (("p", "x"), ("q", "y")))
    pairs = two.join(x, ["bucket", "p"]).join(y, ["bucket", "q"])
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _rare_across(placed: DataFrame, share: float) -> DataFrame:
    """``a, b``: pairs of ``placed(node, grams, part)`` of different parts, all among them that agree to ``share``.

    They meet on their rarest shingles if their sizes and the places of these allow it, so large parts that only
    share a passage don't meet, for its shingles are common in both.
    """
    values = placed.select("node", F.size("grams").alias("size"), F.explode("grams").alias("value"))
    heads = cut(rare_heads(values, [], share).join(placed.select("node", "part"), "node"))
    some = heads.groupBy("value", "part").agg(F.max("small").alias("small"))
    smaller = some.where("small").select("value", F.col("part").alias("p"))
    two = smaller.join(some.select("value", F.col("part").alias("q")), "value").where("p <> q")
    side = lambda rows, p, n: rows.select("value", F.col("part").alias(p), F.col("node").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("size", "after")])
    both = two.join(side(heads.where("small"), "p", "x"), ["value", "p"]).join(side(heads, "q", "y"), ["value", "q"])
    return both.where(may_agree(share)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_duplicate_groups(
    records: DataFrame, key: str, title: str, content: str, size: int = 5, share: float = 0.8
) -> DataFrame:
    """``key, group_id``: a row for each record with a link; the group is named by its smallest key.

    Two records are linked if the Jaccard similarity of their shingles is at least ``share`` (ties are links; equal
    texts are links too). Null titles are like empty ones; an empty table gives no rows; other columns are not read.
    """
    classes, members = text_classes(records, key, title, content, size)
    members = cut(members)
    parts = class_components(classes, share)
    placed = members.join(parts, "node", "left").select(
        "key", F.coalesce("component", "node").alias("part")
    )
    groups = placed.groupBy("part").agg(F.min("key").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return placed.join(groups, "part").select(F.col("key").alias(key), "group_id")
