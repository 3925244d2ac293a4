"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wordloom.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for each end of an edge; the component is its smallest node.

    Repeated edges, both directions and loops are allowed; a node with only loops is its own component, rows with a
    null end are left out, and no edges give no rows. Each round is two aggregations and joins on the edges, written
    to the shared folder; the number of rounds grows with the logarithm of the longest path. A node with very many
    edges is safe: its minimum is combined before the shuffle, and the join that hands it back has one row a node on one
    side, so a crowded partition of the other may be split. The joins are never broadcasts, whose data no bound would hold.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    loops = ends.where("u = v").select("u").distinct()
    links, before = _written(ends.where("u > v").distinct())
    while before[0]:
        links, after = _written(_small_star(_large_star(links)))
        if after == before:
            break
        before = after
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    heads = links.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return found.union(heads).union(alone).groupBy("node").agg(F.min("component").alias("component"))


def _large_star(links: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest node of its neighbourhood."""
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = links.select(F.inline(ways))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v")  # repeats go with those of the small star


def _small_star(links: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()


def _written(links: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The edges, written, with their number and an order-free checksum, which are counted as they are written."""
    seen = Observation()
    marks = F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("sum")
    written = cut(links.select("u", "v").observe(seen, *marks))
    return written, (int(seen.get["n"]), int(seen.get["sum"]))
