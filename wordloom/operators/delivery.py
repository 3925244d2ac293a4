"""Messages delivered more than once: keep exactly one delivery of each.

A message is an operation and a payload hash. Both together are an identifier of fixed width: the operation, padded, with
its length, and the 256 bits of the hash. (What doesn't fit has a wider identifier, and a table for each width.) An
identifier is permuted, so nothing is lost and equal leading bits say nothing about the message: these are its quotient,
which names a shard, and all that is left is the remainder, which is stored whole. A shard's table is open-addressed and
compares complete remainders, so no two messages are ever taken for each other, unlike in a filter that keeps
fingerprints.

It is done in one pass over the deliveries. Each block of rows is put into a table where it is read: what loses to
another delivery of its message there is surplus for good, and only a block's winners meet again, in the table of their
shard. So a message that was delivered very often costs a row per block, and one operation's messages spread over all
shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import strip_space

#: Bits of the permuted identifier that name the shard.
QUOTIENT_BITS = 20
#: Bytes of an operation that fit the fixed width of 10 words.
OPERATION_BYTES = 47
#: Rows put into a table at a time; a shard with more of them is held whole.
BLOCK = 100_000

#: An RFC 3339 date-time.
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def instant(text: Column) -> Column:
    """The instant of an RFC 3339 text as a timestamp; null where it is missing or unreadable."""
    tidy = F.upper(strip_space(text))
    return F.when(tidy.rlike(RFC3339), tidy.try_cast("timestamp"))


def plain_hash(text: Column) -> Column:
    """A payload hash without surrounding white space, case and a leading ``sha256:``."""
    return F.regexp_replace(F.lower(strip_space(text)), r"^sha256:", "")


def identifier(operation: Column, payload_hash: Column) -> dict[str, Column]:
    """Quotient and remainder of a message as columns; together they hold the whole identifier.

    A hash that isn't 64 hex digits stays in the remainder as the text it is; null is a value of its own.
    """
    fixed = payload_hash.rlike(r"^[0-9a-f]{64}$")
    word = [F.when(fixed, _word(F.substring(payload_hash, 1 + 16 * k, 16))) for k in range(4)]
    text = F.when(~fixed, payload_hash)
    rest = [operation, *word[1:], text]
    permuted = F.coalesce(word[0], F.lit(0).cast("bigint")).bitwiseXOR(F.xxhash64(*rest))
    return {
        "quotient": F.shiftrightunsigned(permuted, 64 - QUOTIENT_BITS).cast("int"),
        "remainder": permuted.bitwiseAND(F.lit((1 << (64 - QUOTIENT_BITS)) - 1)),
        **{f"hash_{k}": w for k, w in enumerate(word[1:], 1)},
        "hash_text": text,
        "operation": operation,
    }


def _word(hex16: Column) -> Column:
    """16 hex digits as a signed 64-bit word."""
    high, low = (F.conv(F.substring(hex16, at, 8), 16, 10).cast("bigint") for at in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def _fixed(operations: pa.StringArray, hashes: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that fit the fixed width, and their identifiers: rows x 10 words."""
    sizes = np.diff(_ends(operations)), np.diff(_ends(hashes))
    rows = np.flatnonzero((sizes[0] <= OPERATION_BYTES) & (sizes[1] == 64) & hashes.is_valid().to_numpy(zero_copy_only=False))
    digits = np.full(256, 255, np.uint8)
    digits[np.frombuffer(b"0123456789abcdef", np.uint8)] = np.arange(16)
    text = digits[_bytes(hashes.take(pa.array(rows)))].reshape(-1, 64)
    good = (text < 16).all(axis=1)
    rows, text = rows[good], text[good]
    out = np.zeros((len(rows), 80), np.uint8)
    held = operations.take(pa.array(rows))
    size = np.diff(_ends(held))
    out[:, 0] = size
    starts = np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(rows)), size), 1 + np.arange(size.sum()) - starts] = _bytes(held)
    out[:, 48:] = text[:, ::2] << 4 | text[:, 1::2]
    return rows, out.view(np.uint64)


def _ends(column: pa.StringArray | pa.BinaryArray) -> np.ndarray:
    """Where each value begins in the column's bytes, and where the last ends."""
    if not len(column):
        return np.zeros(1, np.int32)
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]


def _bytes(column: pa.StringArray | pa.BinaryArray) -> np.ndarray:
    ends = _ends(column)
    whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return whole[ends[0] : ends[-1]]


def _wide(operation: str, payload_hash: str | None) -> bytes:
    """The identifier of a message that doesn't fit the fixed width: 96 bytes or more, in steps of 16."""
    name, text = operation.encode(), (payload_hash or "").encode()
    raw = bytes([255, payload_hash is None]) + len(name).to_bytes(4, "big") + len(text).to_bytes(4, "big") + name + text
    return raw.ljust(max(96, -(-len(raw) // 16) * 16), b"\0")


def permuted(words: np.ndarray) -> np.ndarray:
    """Identifiers (rows x words) with the first word mixed with all others; nothing is lost, for each step can be undone."""
    out = words.copy()
    mixed = np.zeros(len(words), np.uint64)
    for k in range(1, words.shape[1]):
        mixed = (mixed ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    first = out[:, 0] ^ mixed
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        first = (first ^ (first >> np.uint64(33))) * np.uint64(factor)
    out[:, 0] = first ^ (first >> np.uint64(33))
    return out


def identifiers(operations: pa.StringArray, hashes: pa.StringArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each width, the rows and their permuted identifiers."""
    rows, words = _fixed(operations, hashes)
    if len(rows):
        yield rows, permuted(words)
    left = np.setdiff1d(np.arange(len(operations)), rows)
    wide: dict[int, list[tuple[int, bytes]]] = {}
    for k in left.tolist():
        raw = _wide(operations[k].as_py(), hashes[k].as_py())
        wide.setdefault(len(raw), []).append((k, raw))
    for size, held in wide.items():
        words = np.frombuffer(b"".join(raw for _, raw in held), np.uint64).reshape(-1, size // 8)
        yield np.array([k for k, _ in held]), permuted(words)


def insert(words: np.ndarray) -> np.ndarray:
    """Put identifiers (rows x words) into an open-addressed table: for each row the first one that holds its slot.

    A slot is looked for from the remainder's bits on; rows share it only if their complete words agree.
    """
    size = 1 << max(4, (2 * len(words)).bit_length())
    mask = np.uint64(size - 1)
    owner = np.full(size, -1, np.int64)
    slot = words[:, 0] & mask
    found = np.empty(len(words), np.int64)
    rows = np.arange(len(words))
    while len(rows):
        at = slot[rows]
        free = rows[owner[at] < 0]
        owner[slot[free][::-1]] = free[::-1]  # of several rows the first gets it
        holder = owner[at]
        same = (words[holder] == words[rows]).all(axis=1)
        found[rows[same]] = holder[same]
        rows = rows[~same]
        slot[rows] = (slot[rows] + np.uint64(1)) & mask
    return found


def _settle(words: np.ndarray, at: np.ndarray, ids: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with these identifiers, those that stay of their message, how many deliveries each has, and those that don't.

    A repeated row of the delivery that stays is neither.
    """
    group = insert(words)
    order = np.lexsort((ids, at, group))
    first = np.ones(len(order), bool)
    first[1:] = group[order][1:] != group[order][:-1]
    best = order[first]
    winner = np.repeat(best, np.diff(np.append(np.flatnonzero(first), len(order))))
    lost = order[ids[order] != ids[winner]]
    return best, np.bincount(group, weights=times, minlength=len(group))[group[best]].astype(np.int64), lost


_SETTLED = "shard int, identifier binary, at bigint, id bigint, deliveries bigint"


def _rows(shard: np.ndarray, words: np.ndarray | None, at: np.ndarray, ids: np.ndarray, times: np.ndarray | None) -> pa.RecordBatch:
    none = lambda t: pa.nulls(len(ids), t)
    raw = none(pa.binary())
    if words is not None:
        width = words.shape[1] * 8
        raw = pa.Array.from_buffers(pa.binary(width), len(words), [None, pa.py_buffer(np.ascontiguousarray(words))]).cast(pa.binary())
    columns = [pa.array(shard.astype(np.int32)), raw, pa.array(at), pa.array(ids), none(pa.int64()) if times is None else pa.array(times)]
    return pa.RecordBatch.from_arrays(columns, ["shard", "identifier", "at", "id", "deliveries"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _met_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``operation, hash, at, id`` in blocks: what wins within its block, with its identifier, and what loses, without."""
    for table in _gathered(batches):
        operations, hashes, at, ids = (c.combine_chunks() for c in table.columns)
        at, ids = at.to_numpy(), ids.to_numpy()
        for rows, words in identifiers(operations, hashes):
            best, times, lost = _settle(words, at[rows], ids[rows], np.ones(len(rows)))
            shard = words[best, 0] >> np.uint64(64 - QUOTIENT_BITS)
            yield _rows(shard, words[best], at[rows][best], ids[rows][best], times)
            if len(lost):  # they are only passed on, by a shard of their own
                yield _rows(ids[rows][lost] & ((1 << QUOTIENT_BITS) - 1), None, at[rows][lost], ids[rows][lost], None)


def _met_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same of rows in order of shard, now for good. No more than BLOCK rows and the shard at their end are held."""
    held: pa.Table | None = None
    for table in _gathered(batches):
        lost = table.filter(table["identifier"].is_null())
        yield from lost.to_batches()
        table = table.filter(table["identifier"].is_valid())
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows:
            shard = held["shard"].to_numpy()
            whole = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
            yield from _settled_shards(held.slice(0, whole))
            held = held.slice(whole)
    if held is not None:
        yield from _settled_shards(held)


def _settled_shards(table: pa.Table) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    shard, at, ids, times = (table[c].to_numpy() for c in ("shard", "at", "id", "deliveries"))
    raw = table["identifier"].combine_chunks()
    size = np.diff(_ends(raw))
    for width in np.unique(size).tolist():
        rows = np.flatnonzero(size == width)
        words = _bytes(raw.take(pa.array(rows))).view(np.uint64).reshape(-1, width // 8)
        best, total, lost = _settle(words, at[rows], ids[rows], times[rows])
        yield _rows(shard[rows][best], words[best], at[rows][best], ids[rows][best], total)
        if len(lost):
            yield _rows(shard[rows][lost], None, at[rows][lost], ids[rows][lost], None)


def settled_deliveries(deliveries: DataFrame) -> DataFrame:
    """``delivery_id, at, deliveries``: each delivery of a message; ``deliveries`` is their number where it stays, else null.

    ``deliveries`` has ``operation_id``, ``payload_hash``, ``receipt.payload_hash``, ``queued_at`` and an integer
    ``delivery_id``; further columns are not read. The earliest readable ``queued_at`` wins, then the smallest
    ``delivery_id``. Rows without an operation or a delivery id name no message and are left out; an empty operation id
    is an id, and a missing hash one of its own. A repeated row of the delivery that stays is not there again, one of
    another may be. An empty table gives an empty result.
    """
    at = F.coalesce(F.unix_micros(instant(F.col("queued_at"))), F.lit((1 << 63) - 1))
    named = deliveries.where(F.col("operation_id").isNotNull() & F.col("delivery_id").isNotNull()).select(
        F.lower(strip_space("operation_id")).alias("operation"),
        plain_hash(F.coalesce(F.col("receipt.payload_hash"), F.col("payload_hash"))).alias("hash"),
        at.alias("at"), F.col("delivery_id").cast("bigint").alias("id"),
    )
    blocks = named.mapInArrow(_met_first, _SETTLED)
    shards = blocks.repartition("shard").sortWithinPartitions("shard").mapInArrow(_met_again, _SETTLED)
    readable = F.when(F.col("at") < (1 << 63) - 1, F.timestamp_micros("at"))
    kind = deliveries.schema["delivery_id"].dataType
    return shards.select(F.col("id").cast(kind).alias("delivery_id"), readable.alias("at"), "deliveries")


def kept_deliveries(deliveries: DataFrame) -> DataFrame:
    """``delivery_id, at, deliveries``: one row per message, the delivery that stays (see settled_deliveries)."""
    return settled_deliveries(deliveries).where("deliveries is not null")


def surplus_deliveries(deliveries: DataFrame) -> DataFrame:
    """``delivery_id`` of every delivery but the one that stays of its message (see settled_deliveries), each once."""
    return settled_deliveries(deliveries).where("deliveries is null").select("delivery_id").distinct()
