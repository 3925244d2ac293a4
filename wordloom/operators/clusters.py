"""Leader clusters over a similarity graph, as if records came one by one in order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators.components import connected_components
from wordloom.session import cut

#: Pairs of a component that one task goes through in order.
BOUND = 200_000


def leader_clusters(nodes: DataFrame, pairs: DataFrame, bound: int = BOUND) -> DataFrame:
    """``node, anchor, similarity`` for each row of ``nodes(node, place)``; ``pairs(a, b, similarity)`` are undirected.

    Taken in order of (place, node), a record joins the first cluster whose anchor it is similar to, else it opens one
    (similarity 1). Nodes must be unique; a null place comes first; pairs with unknown nodes are left out.

    What a record does depends on its own connected component only. Components of up to ``bound`` pairs are gone through
    in order inside tasks, many to a task; a chain of any such length costs no rounds. Larger ones take rounds, each of
    which decides every record without an undecided earlier neighbour; all that remains of the graph then are pairs of
    undecided records, written to the shared folder.
    """
    order = lambda end: nodes.select(F.col("node").alias(end), F.struct("place", "node").alias(f"at_{end}"))
    placed = pairs.join(order("a"), "a").join(order("b"), "b").where("a <> b")
    first = F.col("at_a") < F.col("at_b")
    links = cut(
        placed.select(
            F.when(first, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("hi"),
            F.least("at_a", "at_b").alias("at"), F.greatest("at_a", "at_b").alias("to"), "similarity",
        ).dropDuplicates(["lo", "hi"])
    )
    ids = nodes.select("node")
    n_links = links.count()
    if not n_links:
        return ids.select("node", F.col("node").alias("anchor"), F.lit(1.0).alias("similarity"))
    if n_links <= bound:  # no component is larger
        member = cut(_in_tasks(links.withColumn("component", F.lit(0))))
    else:
        parts = cut(connected_components(links, "lo", "hi"))
        sized = links.join(parts.select(F.col("node").alias("lo"), "component"), "lo")
        large = sized.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > bound).select("component")
        small = _in_tasks(sized.join(large, "component", "left_anti"))
        member = cut(small).union(_in_rounds(sized.join(large, "component", "left_semi").select("lo", "hi")))
    held = links.join(member.withColumnRenamed("node", "hi"), "hi").join(member.withColumnRenamed("node", "lo"), "lo", "left_anti")
    best = held.groupBy("hi").agg(F.min(F.struct("at", "lo", "similarity")).alias("m"))
    found = best.select(F.col("hi").alias("node"), F.col("m.lo").alias("anchor"), "m.similarity")
    return ids.join(found, "node", "left").select(
        "node", F.coalesce("anchor", "node").alias("anchor"), F.coalesce("similarity", F.lit(1.0)).alias("similarity")
    )


def _in_tasks(links: DataFrame) -> DataFrame:
    """``node``: the records that join an earlier one, of ``links(component, lo, hi, at, to)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # rows come by component: all but the last one are whole
            last = pc.not_equal(batch.column(0), batch.column(0)[-1])
            whole = pc.sum(last).as_py() or 0
            if whole or (held and held[-1].column(0)[-1] != batch.column(0)[0]):
                yield from _joined([*held, batch.slice(0, whole)])
                held = []
            held.append(batch.slice(whole))
        yield from _joined(held)

    kind = links.schema["lo"].dataType.simpleString()
    rows = links.select("component", "lo", "hi", "at", "to").repartition("component").sortWithinPartitions("component")
    return rows.mapInArrow(run, f"node {kind}")


def _joined(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the records of whole components, those that join one before them."""
    table = pa.Table.from_batches(batches) if batches else None
    if table is None or not table.num_rows:
        return
    lo, hi, at, to = (table.column(c).to_pylist() for c in ("lo", "hi", "at", "to"))
    place = {n: _key(p) for n, p in [*zip(lo, at), *zip(hi, to)]}
    before: dict = {}
    for x, y in zip(lo, hi):
        before.setdefault(y, []).append(x)
    members: set = set()
    for node in sorted(before, key=place.__getitem__):
        if any(x not in members for x in before[node]):
            members.add(node)
    yield pa.RecordBatch.from_arrays([pa.array(list(members), table.schema.field("lo").type)], ["node"])


def _key(value: object) -> tuple:
    """A value that sorts like Spark's: null first, structs field by field."""
    if isinstance(value, dict):
        return (1, tuple(_key(v) for v in value.values()))
    return (0, ()) if value is None else (1, value)


def _in_rounds(open_links: DataFrame) -> DataFrame:
    """The same of ``links(lo, hi)`` by rounds over the whole graph; the first undecided record is decided in each, so it ends."""
    found = open_links.select(F.col("hi").alias("node")).limit(0)
    open_links = cut(open_links)
    while not open_links.isEmpty():
        followers = open_links.select(F.col("hi").alias("node")).distinct()
        anchors = open_links.select(F.col("lo").alias("node")).distinct().join(followers, "node", "left_anti")
        joined = cut(open_links.join(anchors.withColumnRenamed("node", "lo"), "lo").select(F.col("hi").alias("node")).distinct())
        found = found.union(joined)
        gone = cut(anchors.union(joined))
        open_links = cut(
            open_links.join(gone.withColumnRenamed("node", "lo"), "lo", "left_anti")
            .join(gone.withColumnRenamed("node", "hi"), "hi", "left_anti").select("lo", "hi")
        )
    return found
