"""Frequent subsequences: ordered patterns that many entities share, with any gaps between the steps.

The database becomes a sequence decision diagram: rows are chains of steps, equal suffixes are one node, and a row's
count is a weight on its first node. The diagram conditional on a prefix is a set of weighted nodes, those that stand
right after the prefix; pushing it along one more item follows each node to just after the item's next occurrence, and
nodes that coincide there merge their weights. Conditional diagrams that were met before are looked up.

Spark runs this in two passes. The first counts equal sequences (that is the diagrams' weight) and mines each block of
them at a share of rows so low that no pattern of the required support can miss it in every block; this gives a
superset. What blocks counted, and how much the others can hold at most, bounds each pattern's rows from above; patterns
whose bound is too low are gone before the second pass, which counts the rest exactly: a bit for each pattern a row
holds, united by entity (so an entity counts once however many rows it has), then added up. Candidates stay a written
table; PASS of them at a time are sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wordloom.session import cut, scratch

#: Rows of a block, at least, and rows that a pattern must hold in one for it to be a candidate: low shares take larger
#: blocks, of up to MOST_ROWS. A diagram's memory grows with its steps alone.
BLOCK, LOCAL, MOST_ROWS = 8_000, 40, 100_000
#: Patterns counted in one pass; more are counted in several passes.
PASS = 4096
#: Steps that a diagram looks at in one go.
REACH = 1 << 22
#: Patterns are joined with this.
ARROW = " > "


class Diagram:
    """The shared suffix graph of some rows. A node is a suffix, held as the place of its first step in one of the rows
    that end so; ``behind`` is the node behind each step."""

    def __init__(self, rows: pa.ListArray, items: pa.Array) -> None:
        codes = pa.compute.index_in(rows.flatten(), items)
        owner = pa.compute.list_parent_indices(rows)
        known = pa.compute.is_valid(codes)
        step = codes.filter(known).to_numpy(zero_copy_only=False).astype(np.int64)
        row = owner.filter(known).to_numpy(zero_copy_only=False).astype(np.int64)
        length = np.bincount(row, minlength=len(rows))
        ends = np.cumsum(length)
        node = np.zeros(len(rows), dtype=np.int64)  # 0: nothing follows
        behind, begins, stops, base = np.zeros(len(step), np.int64), [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 1
        for k in range(1, int(length.max(initial=0)) + 1):  # suffixes of k steps from suffixes of k - 1
            live = np.flatnonzero(length >= k)
            at = ends[live] - k
            behind[at] = node[live]
            made, first, place = np.unique(node[live] * len(items) + step[at], return_index=True, return_inverse=True)
            begins.append(at[first])
            stops.append(ends[live][first])
            node[live] = base + place
            base += len(made)
        self.step, self.behind, self.first, self.items = step, behind, node, len(items)
        self.begin, self.stop = np.concatenate(begins), np.concatenate(stops)
        # the place of the same item before each step, in its row
        order = np.argsort(row * len(items) + step, kind="stable")
        same = (row[order][1:] == row[order][:-1]) & (step[order][1:] == step[order][:-1])
        self.before = np.full(len(step), -1)
        self.before[order[1:][same]] = order[:-1][same]

    def reach(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the nodes, an item that occurs in it, and the node behind the item's first occurrence there."""
        size = self.stop[nodes] - self.begin[nodes]
        ends = np.cumsum(size)
        parts, at = [], 0
        while at < len(nodes):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + REACH, side="right")))
            which = np.repeat(np.arange(at, to), size[at:to])
            begin = self.begin[nodes[which]]
            place = begin + np.arange(len(which)) - np.repeat(ends[at:to] - size[at:to] - (ends[at - 1] if at else 0), size[at:to])
            first = self.before[place] < begin
            parts.append((which[first], self.step[place[first]], self.behind[place[first]]))
            at = to
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (none, none, none)

    def mine(self, weights: np.ndarray, least: int, longest: int) -> dict[tuple[int, ...], int]:
        """Patterns of 2 to ``longest`` steps held by rows of a weight of at least ``least`` together, and that weight."""
        known: dict[tuple[bytes, bytes, int], dict[tuple[int, ...], int]] = {}

        def push(nodes: np.ndarray, weights: np.ndarray, steps: int) -> dict[tuple[int, ...], int]:
            key = (nodes.tobytes(), weights.tobytes(), steps)
            if key not in known:
                which, item, to = self.reach(nodes)
                held = np.bincount(item, weights=weights[which], minlength=self.items)
                often = np.flatnonzero(held >= least)
                found = {(int(i),): int(held[i]) for i in often}
                if steps > 1:
                    for i, place in _by_item(item, often):
                        at, merged = np.unique(to[place], return_inverse=True)
                        weight = np.bincount(merged, weights=weights[which[place]]).astype(np.int64)
                        found.update(((i, *rest), w) for rest, w in push(at, weight, steps - 1).items())
                known[key] = found
            return known[key]

        start, place = np.unique(self.first, return_inverse=True)
        weight = np.bincount(place, weights=weights).astype(np.int64)
        return {p: w for p, w in push(start, weight, longest).items() if len(p) > 1}

    def holders(self, patterns: list[tuple[int, ...]]) -> Iterator[tuple[int, np.ndarray]]:
        """For each pattern that any row holds: its place in the list and the rows that hold it."""
        tree: dict = {}
        for place, pattern in enumerate(patterns):
            at = tree
            for item in pattern:
                at = at.setdefault(item, {})
            at[None] = place
        stack = [(tree, np.arange(len(self.first)), self.first)]
        while stack:
            at, rows, nodes = stack.pop()
            if None in at:
                yield at[None], rows
            wanted = np.array(sorted(i for i in at if i is not None), np.int64)
            if not len(wanted):
                continue
            some, inverse = np.unique(nodes, return_inverse=True)
            which, item, to = self.reach(some)
            for i, place in _by_item(item, wanted):
                behind = np.full(len(some), -1)
                behind[which[place]] = to[place]
                next_nodes = behind[inverse]
                held = next_nodes >= 0
                stack.append((at[i], rows[held], next_nodes[held]))


def _by_item(item: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each wanted item that is there, with its places."""
    place = np.flatnonzero(np.isin(item, wanted))
    place = place[np.argsort(item[place], kind="stable")]
    found, at = np.unique(item[place], return_index=True)
    for i, part in zip(found.tolist(), np.split(place, at[1:])):
        yield i, part


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows in blocks of ``size`` to 2 * ``size`` rows, or in one where there are fewer."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            if n >= size and n + batch.num_rows - at >= 2 * size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
            held.append(part := batch.slice(at, size))
            n += part.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _steps(table: pa.Table) -> pa.ListArray:
    return table.column("steps").chunk(0)


def _candidates(rows: DataFrame, share: Fraction, longest: int, least: int) -> tuple[DataFrame, int]:
    """``pattern ARRAY<STRING>``: what at least ``share`` of the rows of some block hold and ``least`` rows may hold, and how many."""
    size = min(MOST_ROWS, max(BLOCK, -(-LOCAL * share.denominator // share.numerator)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, size):
            steps, weights = _steps(table), table.column("weight").chunk(0).to_numpy()
            least = max(1, -(-share.numerator * int(weights.sum()) // share.denominator))
            row = pa.compute.list_parent_indices(steps)
            pairs = pa.table({"row": row, "item": steps.flatten()}).group_by(["row", "item"]).aggregate([])
            pairs = pairs.append_column("weight", pa.array(weights[pairs["row"].to_numpy()]))
            held = pairs.group_by("item").aggregate([("weight", "sum")])
            items = held.filter(pa.compute.greater_equal(held["weight_sum"], least))["item"].combine_chunks()
            names = items.to_pylist()
            found = Diagram(steps, items).mine(weights, least, longest) if names else {}
            # no pattern stands for the block: what a pattern that isn't found there holds at most
            listed = [[], *([names[i] for i in p] for p in found)]
            columns = [pa.array(listed, pa.list_(pa.string())), pa.array([0, *found.values()], pa.int64()), pa.array([least - 1] * len(listed), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["pattern", "held", "bound"])

    seen = Observation()
    weighted = cut(rows.groupBy("steps").agg(F.count("*").alias("weight")).observe(seen, F.count(F.lit(1)).alias("n")))
    blocks = weighted.coalesce(max(1, int(seen.get["n"]) // size)).mapInArrow(run, "pattern array<string>, held bigint, bound bigint")
    summed = cut(blocks.groupBy("pattern").agg(F.sum("held").alias("held"), F.sum("bound").alias("bound")))
    elsewhere = summed.where("size(pattern) = 0").head()
    may = F.col("held") + F.lit(elsewhere.bound if elsewhere else 0) - F.col("bound") >= least
    kept = Observation()
    patterns = cut(summed.where((F.size("pattern") > 0) & may).select("pattern").observe(kept, F.count(F.lit(1)).alias("n")))
    return patterns, int(kept.get["n"])


def _supports(rows: DataFrame, patterns: list[list[str]]) -> DataFrame:
    """``place, support`` of each pattern: the number of distinct entities with a row that holds it."""
    items = pa.array(sorted({x for p in patterns for x in p}))
    code = {x: k for k, x in enumerate(items.to_pylist())}
    coded = [tuple(code[x] for x in p) for p in patterns]
    words = -(-len(patterns) // 64)
    names = [f"w{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, BLOCK):
            bits = np.zeros((table.num_rows, words), dtype=np.uint64)
            for place, held in Diagram(_steps(table), items).holders(coded):
                bits[held, place // 64] |= np.uint64(1 << (place % 64))
            some = bits.any(axis=1)
            kept = table.column("entity").chunk(0).filter(pa.array(some))
            columns = [pa.array(np.ascontiguousarray(bits[some, k]).view(np.int64)) for k in range(words)]
            yield pa.RecordBatch.from_arrays([kept, *columns], ["entity", *names])

    entity = rows.schema["entity"].dataType.simpleString()
    marked = rows.mapInArrow(run, f"entity {entity}, " + ", ".join(f"{n} bigint" for n in names))
    united = marked.groupBy("entity").agg(*[F.bit_or(n).alias(n) for n in names])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(64 * words, dtype=np.int64)
        for batch in batches:
            for k in range(words):
                word = np.ascontiguousarray(batch.column(k).to_numpy()).view(np.uint8)
                sums[64 * k : 64 * (k + 1)] += np.unpackbits(word.reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        place = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(sums[place])], ["place", "support"])

    summed = united.select(*names).mapInArrow(total, "place bigint, support bigint")
    return summed.groupBy("place").agg(F.sum("support").alias("support"))


def frequent_sequences(
    sequences: DataFrame, entity: str, steps: Column, share: Fraction = Fraction(1, 10), longest: int = 5
) -> DataFrame:
    """``pattern, support``: ordered patterns of 2 to ``longest`` steps, joined by `` > ``, with their support.

    An entity holds a pattern if the steps occur in this order, with any gaps, in one of its rows; steps may repeat.
    Patterns held by at least ``share`` of all distinct entities come out (ties too). Null and blank steps are
    skipped; rows with a null entity are left out; entities without steps still count in the total. Repeated rows
    change nothing. An empty table gives no patterns.
    """
    named = sequences.where(F.col(entity).isNotNull())
    clean = F.filter(F.coalesce(steps, F.array().cast("array<string>")), lambda s: s.rlike(r"(?U)[^\s\x1c-\x1f]"))
    rows = named.select(F.col(entity).alias("entity"), clean.alias("steps")).where("size(steps) > 1")
    entities = named.agg(F.count_distinct(F.col(entity))).head()[0]
    spark = sequences.sparkSession
    least = -(-share.numerator * entities // share.denominator)
    n_rows = rows.count()
    if not n_rows:
        return spark.createDataFrame([], "pattern string, support bigint")
    # a pattern of that support lies in at least `least` rows, so in some block it has at least this share of the rows
    lower = Fraction(min(least, n_rows), n_rows)
    candidates, n = _candidates(rows, lower, longest, least)
    parts, folder = -(-n // PASS), scratch(spark)
    for k in range(parts):
        part = candidates.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == k).collect() if parts > 1 else candidates.collect()
        for at in range(0, len(part), PASS):
            block = [list(p) for p in sorted(tuple(r[0]) for r in part[at : at + PASS])]
            listed = spark.createDataFrame([(k, ARROW.join(p)) for k, p in enumerate(block)], "place bigint, pattern string")
            counted = _supports(rows, block).where(F.col("support") >= least).join(F.broadcast(listed), "place").select("pattern", "support")
            if parts == 1:
                return counted
            counted.write.mode("append").parquet(folder)
    return spark.read.schema("pattern string, support bigint").parquet(folder) if parts else spark.createDataFrame([], "pattern string, support bigint")
