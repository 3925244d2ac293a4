"""One delivery of each message stays."""

import random

from wordloom.operators.delivery import identifier, kept_deliveries, plain_hash, surplus_deliveries

SCHEMA = "delivery_id bigint, operation_id string, payload_hash string, queued_at string, receipt struct<payload_hash: string>, quotient int"
H = ["%064x" % (k * 7919) for k in range(40)]


def table(spark, rows):
    return spark.createDataFrame([(d, o, h, q, None if r is None else (r,), 1) for d, o, h, q, r in rows], SCHEMA)


def surplus(spark, rows):
    return sorted(r[0] for r in surplus_deliveries(table(spark, rows)).collect())


def test_earliest_readable_instant_stays(spark):
    rows = [
        (1, "op-1", H[1], "n/a", None),
        (2, " OP-1\n", H[1].upper(), "2025-01-01T05:00:00+05:00", None),
        (3, "op-1", None, "2025-01-01T00:00:01Z", "sha256:" + H[1]),
        (4, "op-1", H[2], None, None),
        (5, "op-2", H[1], "", None),
    ]
    assert surplus(spark, rows) == [1, 3]


def test_ties_nulls_and_repeats(spark):
    rows = [
        (7, "a", H[3], "2025-01-01T00:00:00Z", None),
        (6, "a", H[3], "2025-01-01T00:00:00+00:00", None),
        (6, "a", H[3], "2025-01-01T00:00:00+00:00", None),
        (None, "a", H[3], "2024-01-01T00:00:00Z", None),
        (8, None, H[3], "2024-01-01T00:00:00Z", None),
        (9, "", "short", None, None),
        (10, "", " SHORT ", "2025-02-30T00:00:00Z", None),
        (11, "", None, None, None),
        (12, "", None, None, None),
    ]
    assert surplus(spark, rows) == [7, 10, 12]


def test_receipt_hash_comes_first(spark):
    rows = [(1, "a", H[1], None, H[2]), (2, "a", H[1], None, None), (3, "a", H[2], None, None)]
    assert surplus(spark, rows) == [3]


def test_empty(spark):
    assert surplus(spark, []) == []


def test_identifier_keeps_everything(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    hashes = ["%064x" % rng.getrandbits(256) for _ in range(500)]
    pairs = [(f"op-{k % 7}", h) for k, h in enumerate(hashes)] + [("op-1", h) for h in hashes]
    df = spark.createDataFrame(pairs, "o string, h string").distinct()
    keyed = df.select(*[c.alias(k) for k, c in identifier(F.col("o"), plain_hash(F.col("h"))).items()])
    assert keyed.distinct().count() == df.count()
    # one operation's messages spread over the shards
    assert keyed.where("operation = 'op-1'").select("quotient").distinct().count() > 490


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [
        (k, rng.choice(["x", "X ", "y", "hot", "hot"]), rng.choice(H[:3]), rng.choice([None, "bad", f"2025-01-0{rng.randint(1, 9)}T00:00:00Z"]), None)
        for k in range(400)
    ]
    best = {}
    for d, o, h, q, _ in rows:
        rank = (q in (None, "bad"), "" if q in (None, "bad") else q, d)
        key = (o.strip().lower(), h)
        best[key] = min(best.get(key, rank), rank)
    stay = {v[2] for v in best.values()}
    assert surplus(spark, rows) == sorted(r[0] for r in rows if r[0] not in stay)
    assert kept_deliveries(table(spark, rows)).count() == len(best)


def test_receipts_without_progress():
    """A receipt with a null progress is one like others: it counts as unchanged after another null."""
    import pandas as pd

    from wordloom.streaming.deliveries import ReceiptTracker

    class State:
        kept = None
        exists = lambda self: self.kept is not None
        get = lambda self: self.kept

        def update(self, value):
            self.kept = value

    tracker = ReceiptTracker()
    tracker.seen = State()
    rows = pd.DataFrame({"delivered_at": [1, 2, 3], "delivery_id": ["a", "b", "c"], "state": ["open"] * 3, "progress": [None, None, 4.0]})
    found = [next(tracker.handleInputRows(("o",), iter([part]), None)).iloc[0] for part in (rows[:2], rows[2:])]
    assert (found[0].polls, found[0].progress, found[1].polls, found[1].progress) == (1, None, 0, 4)


def test_blocks_and_shards_without_spark(monkeypatch):
    """Many small blocks: winners meet again in their shards, the losers of a block are passed on."""
    import numpy as np
    import pyarrow as pa

    from wordloom.operators import delivery

    monkeypatch.setattr(delivery, "BLOCK", 16)
    rng = random.Random(9)
    messages = [(rng.choice(["hot", "x" * 47, "y" * 48, "z" * 200, "", "ü"]), rng.choice([H[0], H[1], "short", "f" * 64, "F" * 64, None])) for _ in range(30)]
    rows = [(*rng.choice(messages), rng.choice([rng.randint(0, 9), (1 << 63) - 1]), k) for k in range(600)]
    part = lambda n, kinds, rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], n)
    batches = [part(["operation", "hash", "at", "id"], [pa.string(), pa.string(), pa.int64(), pa.int64()], rows[k : k + 7]) for k in range(0, 600, 7)]
    met = pa.Table.from_batches(delivery._met_first(iter(batches))).sort_by("shard")
    out = pa.Table.from_batches(delivery._met_again(iter(met.to_batches(max_chunksize=5)))).to_pylist()
    best, count = {}, {}
    for o, h, at, d in rows:
        best[o, h] = min(best.get((o, h), (at, d)), (at, d))
        count[o, h] = count.get((o, h), 0) + 1
    stay = {best[m][1]: count[m] for m in best}
    assert {r["id"]: r["deliveries"] for r in out if r["deliveries"] is not None} == stay
    assert sorted(r["id"] for r in out if r["deliveries"] is None) == sorted({r[3] for r in rows} - stay.keys())
    words = np.arange(40, dtype=np.uint64).reshape(20, 2)
    assert len(np.unique(delivery.permuted(words), axis=0)) == 20


def test_one_pass_and_spread(spark):
    """One scan, no sort-based aggregate; one operation's messages spread over the shards."""
    rows = [(k, "hot", "%064x" % k, None, None) for k in range(2000)]
    plan = surplus_deliveries(table(spark, rows))._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan and plan.split("== Physical Plan ==")[1].count("Scan ") <= 1
    from pyspark.sql import functions as F

    from wordloom.operators import delivery

    named = table(spark, rows).select(F.col("operation_id").alias("operation"), F.col("payload_hash").alias("hash"), F.lit(0).cast("bigint").alias("at"), F.col("delivery_id").alias("id"))
    assert named.mapInArrow(delivery._met_first, delivery._SETTLED).select("shard").distinct().count() > 1900
