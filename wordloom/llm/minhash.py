"""Minwise hash signatures in bands: bucket rows, candidate pairs, and checks of signatures and sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.session import cut

#: Seed of the universal hash functions.
SEED = 20_240_229
#: Values hashed at a time, so that the work stays in the processor's cache.
CHUNK = 1 << 16
#: Records of a bucket that are compared with each other as they are; members of larger ones go by rare_rows().
CROWD = 64


@dataclass(frozen=True)
class Bands:
    """``count`` bands, each of so many minima of each named set: pairs that agree in all of a band's minima meet.

    Two records whose sets have the Jaccard similarities j1, j2, ... meet in a band with probability
    j1**r1 * j2**r2 * ..., so in no band at all with (1 - that) ** count.
    """

    rows: tuple[tuple[str, int], ...]
    count: int


def _functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-shift hash functions: odd factors and offsets of 64 bits."""
    rng = np.random.default_rng(seed)
    full = np.iinfo(np.uint64).max
    factors = rng.integers(0, full, n, dtype=np.uint64, endpoint=True) | np.uint64(1)
    return factors, rng.integers(0, full, n, dtype=np.uint64, endpoint=True)


def _minima(values: np.ndarray, starts: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The minima of each set under each function: functions x sets. No set may be empty."""
    out = np.empty((len(factors), len(starts)), dtype=np.uint64)
    for k, (f, o) in enumerate(zip(factors, offsets)):
        out[k] = np.minimum.reduceat(values * f + o, starts)
    return out >> np.uint64(32)


def _chunks(column: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about CHUNK values each."""
    ends = column.offsets.to_numpy().astype(np.int64)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(ends, ends[at] + CHUNK, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to
        at = to


def _sets(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    ends = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).view(np.uint64), ends[:-1] - ends[0]


def bucket_rows(records: DataFrame, key: str, families: list[Bands]) -> DataFrame:
    """``bucket BIGINT, key``: one row per record and band. The named sets are ``array<bigint>`` without nulls.

    Records where a named set is null or empty are left out: nothing is similar to an empty set.
    """
    names = sorted({name for f in families for name, _ in f.rows})
    need = {n: sum(r * f.count for f in families for name, r in f.rows if name == n) for n in names}
    drawn = {n: _functions(need[n], SEED + k) for k, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, columns = batch.column(0), [batch.column(1 + k) for k in range(len(names))]
            for at, to in _chunks(columns[0]):
                minima = {n: _minima(*_sets(c.slice(at, to - at)), *drawn[n]) for n, c in zip(names, columns)}
                used = dict.fromkeys(names, 0)
                rows = []
                for f in families:
                    for _ in range(f.count):
                        band = np.concatenate([minima[name][used[name] : used[name] + r] for name, r in f.rows])
                        used = {name: used[name] + dict(f.rows).get(name, 0) for name in used}
                        rows.append(_mixed(band, len(rows) + 1).view(np.int64))
                out = pa.array(np.stack(rows, axis=1).ravel())
                which = pa.array(np.repeat(np.arange(at, to), len(rows)))
                yield pa.RecordBatch.from_arrays([out, keys.take(which)], ["bucket", key])

    full = records.where(" and ".join(f"size({n}) > 0" for n in names)).select(key, *names)
    return full.mapInArrow(run, f"bucket bigint, {key} {dict(full.dtypes)[key]}")


def shared_buckets(rows: DataFrame, key: str) -> DataFrame:
    """``bucket, key, head, crowd`` of the buckets with several records: the smallest key of each and their number.

    Buckets are counted with a partial count before the shuffle, and the rows join a row per bucket, so a bucket that
    holds a third of all records may be split over many tasks. The many buckets with one record are gone; the rest is
    written.
    """
    sized = rows.groupBy("bucket").agg(F.min(key).alias("head"), F.count("*").alias("crowd")).where("crowd > 1")
    return cut(rows.join(sized, "bucket"))


def rare_rows(records: DataFrame, key: str, items: str, share: float) -> DataFrame:
    """``bucket BIGINT, key``: each record under the rarest values of its set, as many as a similarity of ``share`` needs.

    Two sets of n values or less that agree to ``share`` have one of each other's n - ceil(share n) + 1 rarest values in
    common. So records that crowd a bucket because of values that very many hold meet only where they share rare ones,
    and no pair that is similar enough is missed.
    """
    values = records.select(key, F.explode(items).alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    ranked = values.join(common, "value").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("v"))
    sized = ranked.join(records.select(key, F.size(items).alias("size")), key)
    # values of a single record come first in its order and meet nothing
    most = F.col("size") - F.ceil(F.lit(share) * F.col("size") - 1e-9) + 1 - (F.col("size") - F.size("v"))
    return sized.where(most > 0).select(F.explode(F.slice("v", 1, most.cast("int"))).alias("r"), key).select(F.col("r.value").alias("bucket"), key)


def rare_heads(values: DataFrame, by: list[str], share: float) -> DataFrame:
    """``*by, value, node, size, after, small``: the rarest values of each set of ``values(*by, node, size, value)``.

    Sets are compared within ``by`` only, and values are counted there. Two sets that agree to ``share`` have one of the
    smaller's n - ceil(2 share / (1 + share) n) + 1 rarest values, which are ``small``, in common with the larger's
    n - ceil(share n) + 1. ``after`` counts the values from this one on that other sets hold too; see may_agree().
    """
    common = values.groupBy(*by, "value").agg(F.count("*").alias("n")).where("n > 1")
    ranked = values.join(common, [*by, "value"]).groupBy(*by, "node", "size").agg(
        F.sort_array(F.collect_list(F.struct("n", "value"))).alias("v")
    )
    # values of a single record come first in its order and meet nothing
    most = lambda t: (F.size("v") - F.ceil(F.lit(t) * F.col("size") - 1e-9) + 1).cast("int")
    ranked = ranked.withColumns({"larger": most(share), "smaller": most(2 * share / (1 + share)), "held": F.size("v")})
    heads = ranked.where("larger > 0").select(
        *by, "node", "size", "smaller", "held", F.posexplode(F.slice("v", 1, F.col("larger"))).alias("at", "h")
    )
    after, small = F.col("held") - F.col("at"), F.col("at") < F.col("smaller")
    return heads.select(*by, F.col("h.value").alias("value"), "node", "size", after.alias("after"), small.alias("small"))


def may_agree(share: float) -> Column:
    """Whether ``x`` (the smaller) and ``y``, which meet on a value of rare_heads(), can agree to ``share`` if it is their first."""
    fits = (F.col("size_x") <= F.col("size_y")) & (F.col("size_x") >= F.lit(share) * F.col("size_y") - 1e-9)
    needed = F.lit(share / (1 + share)) * (F.col("size_x") + F.col("size_y")) - 1e-9
    return fits & (F.least("after_x", "after_y") >= needed)


def with_runs(records: DataFrame, name: str, size: int) -> DataFrame:
    """The list ``name`` of 64-bit hashes becomes the set of hashes of each run of ``size`` of them, in order.

    A shorter list becomes an empty set. The list has no nulls; other columns stay.
    """
    names = records.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(name)
            column = batch.column(place)
            values, starts = _sets(column)
            length = np.diff(column.offsets.to_numpy())
            owner = np.repeat(np.arange(len(column)), length)
            n = max(0, len(values) - size + 1)
            mixed = np.zeros(n, np.uint64)
            for k in range(size):
                mixed = (mixed ^ values[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            inside = owner[:n] == owner[size - 1 :][:n]
            mixed, of = mixed[inside], owner[:n][inside]
            order = np.lexsort((mixed, of))
            mixed, of = mixed[order], of[order]
            new = np.ones(len(mixed), bool)
            new[1:] = (mixed[1:] != mixed[:-1]) | (of[1:] != of[:-1])
            ends = np.concatenate(([0], np.cumsum(np.bincount(of[new], minlength=len(column)))))
            made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(mixed[new].view(np.int64)))
            yield pa.RecordBatch.from_arrays([made if k == place else batch.column(k) for k in range(len(names))], names)

    schema = ", ".join(f"`{c}` {t}" for c, t in records.dtypes)
    return records.mapInArrow(run, schema)


def _mixed(rows: np.ndarray, band: int) -> np.ndarray:
    """One number of the minima of a band: minima x sets."""
    mixed = np.full(rows.shape[1], band, dtype=np.uint64)
    for m in rows:
        mixed = (mixed ^ m) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    return mixed


def with_bands(records: DataFrame, name: str, count: int, rows: int) -> DataFrame:
    """Add ``signature``, the lowest byte of each of count * rows minima of the set ``name``, and ``buckets``, one of each band.

    Both are taken of the same minima: that two records agree in one band says little about the others. They are null for
    an empty set.
    """
    factors, offsets = _functions(count * rows, SEED - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(name))
            full = np.flatnonzero(np.diff(column.offsets.to_numpy()) > 0)
            kept = column.take(pa.array(full))
            bytes_, buckets = np.zeros((len(full), count * rows), np.uint8), np.zeros((len(full), count), np.int64)
            for at, to in _chunks(kept) if len(full) else ():
                minima = _minima(*_sets(kept.slice(at, to - at)), factors, offsets)
                bytes_[at:to] = minima.astype(np.uint8).T
                for k in range(count):
                    buckets[at:to, k] = _mixed(minima[k * rows : (k + 1) * rows], k + 1).view(np.int64)
            place = np.full(len(column), -1)
            place[full] = np.arange(len(full))
            place = pa.array(place, mask=place < 0)
            signature = pa.Array.from_buffers(pa.binary(count * rows), len(full), [None, pa.py_buffer(bytes_)]).cast(pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(full) + 1) * count, count, dtype=np.int32)), pa.array(buckets.ravel()))
            columns = [*batch.columns, signature.take(place), lists.take(place)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "signature", "buckets"])

    schema = ", ".join(f"`{c}` {t}" for c, t in records.dtypes)
    return records.mapInArrow(run, f"{schema}, signature binary, buckets array<bigint>")


def agreeing(pairs: DataFrame, left: str, right: str, least: int) -> DataFrame:
    """The pairs whose two binary signatures agree in at least ``least`` bytes, without the signatures."""
    rest = [c for c in pairs.columns if c not in (left, right)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint8)
                for c in (left, right)
            )
            same = (a.reshape(batch.num_rows, -1) == b.reshape(batch.num_rows, -1)).sum(axis=1)
            yield batch.select(rest).filter(pa.array(same >= least))

    return pairs.mapInArrow(run, pairs.select(rest).schema)


def overlap(left: str, right: str) -> tuple[Column, Column]:
    """Sizes of intersection and union of two sets held as arrays without repeats."""
    common = F.size(F.array_intersect(left, right)).cast("bigint")
    return common, F.size(left) + F.size(right) - common
