"""Encoding a corpus with a public byte-level vocabulary, each distinct word once, and decoding it.

Texts are split into pre-tokens block by block. Within a block the occurrences of one word are combined before any
shuffle: what travels is each block's distinct words with their places, not each occurrence. Globally distinct words are
encoded once each, the ids are joined back to the places, and each block puts its texts together again by position. A
word that every text holds is a row per block, and these rows may be split over many tasks: nothing is gathered by word.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.session import cut, spread

#: Where the vocabulary files of public tokenizers lie on every machine; described in README.md there.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters of text in a block, about; a single longer text is a block of its own.
BLOCK = 4_000_000


@lru_cache(maxsize=2)
def _ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY):
    """The encoder of a rank file, without special tokens."""
    import tiktoken

    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=_ranks(vocabulary), special_tokens={})


def _pieces(texts: DataFrame) -> DataFrame:
    """``block, keys, lengths, codes, words``: one row per block of (key, text) rows.

    ``codes`` are the pre-tokens of all the block's texts in order, as places in ``words``; ``lengths`` says how many
    belong to each text.
    """
    import regex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(PATTERN).findall
        made = 0
        base = TaskContext.get().partitionId() << 32
        kind = None

        def block(keys: list[pa.Array], lengths: list[int], words: list[str]) -> pa.RecordBatch:
            nonlocal made
            coded = pa.array(words, pa.string()).dictionary_encode()
            made += 1
            row = [[base + made], [pa.concat_arrays(keys)], [pa.array(lengths, pa.int32())], [coded.indices], [coded.dictionary]]
            types = [pa.int64(), pa.list_(kind), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
            arrays = [pa.array(row[0], types[0])]
            for value, t in zip(row[1:], types[1:]):
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(value[0])], pa.int32()), value[0], type=t))
            return pa.RecordBatch.from_arrays(arrays, ["block", "keys", "lengths", "codes", "words"])

        keys, lengths, words, size = [], [], [], 0
        for batch in batches:
            kind, at = batch.column(0).type, 0
            for n, text in enumerate(batch.column(1).to_pylist()):
                found = find(text) if text else []
                words += found
                lengths.append(len(found))
                size += len(text) if text else 0
                if size >= BLOCK:
                    keys.append(batch.column(0).slice(at, n + 1 - at))
                    yield block(keys, lengths, words)
                    at, keys, lengths, words, size = n + 1, [], [], [], 0
            if at < batch.num_rows:
                keys.append(batch.column(0).slice(at))
        if lengths:
            yield block(keys, lengths, words)

    kind = texts.schema["key"].dataType.simpleString()
    return spread(texts).mapInArrow(
        run, f"block bigint, keys array<{kind}>, lengths array<int>, codes array<int>, words array<string>"
    )


def _encoded(words: DataFrame, vocabulary: str) -> DataFrame:
    """``word, ids`` of each distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            ids = pa.array([encode(w) for w in batch.column(0).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["word", "ids"])

    return words.select("word").distinct().mapInArrow(run, "word string, ids array<int>")


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``values``, one after the other, and where each begins and the last ends."""
    size = sizes[which]
    ends = np.concatenate(([0], np.cumsum(size)))
    index = np.arange(ends[-1]) + np.repeat(starts[which] - ends[:-1], size)
    return values[index], ends


def _assemble(pieces: pa.Table, ids: pa.Table) -> pa.Table:
    """The texts of one block from its pieces and its words' ids."""
    row = {c: pieces.column(c).combine_chunks().values for c in ("keys", "lengths", "codes")}
    order = np.argsort(ids.column("place").to_numpy())
    lists = ids.column("ids").combine_chunks()
    starts = lists.offsets.to_numpy()[:-1].astype(np.int64)[order]
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)[order]
    codes = row["codes"].to_numpy()
    if len(codes):
        flat, ends = _gather(lists.values.to_numpy(), starts, sizes, codes)
    else:
        flat, ends = np.empty(0, np.int32), np.zeros(1, np.int64)
    last = np.concatenate(([0], np.cumsum(row["lengths"].to_numpy())))
    out = pa.ListArray.from_arrays(pa.array(ends[last].astype(np.int32)), pa.array(flat, pa.int32()))
    return pa.table({"key": row["keys"], "ids": out})


def encode_corpus(texts: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, ids``: a row for each row of ``texts`` with the ids of the whole text, no special tokens among them.

    Null and empty texts have an empty list; strings that look like special tokens are ordinary text. Repeated rows and
    null keys keep their rows. An empty table gives no rows; other columns are not read.
    """
    pieces = cut(_pieces(texts.select(F.col(key).alias("key"), F.col(text).alias("text"))))
    places = pieces.select("block", F.posexplode("words").alias("place", "word"))
    found = places.join(_encoded(places, vocabulary), "word").select(F.col("block").alias("of"), "place", "ids")
    kind = texts.schema[key].dataType.simpleString()
    whole = (
        pieces.select("block", "keys", "lengths", "codes")
        .groupBy("block")
        .cogroup(found.groupBy("of"))
        .applyInArrow(_assemble, f"key {kind}, ids array<int>")
    )
    return whole.select(F.col("key").alias(key), "ids")


def token_bytes(spark: SparkSession, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id, bytes``: the bytes of each token as hexadecimal text; as many rows as the vocabulary has."""
    return spark.createDataFrame([(rank, token.hex()) for token, rank in _ranks(vocabulary).items()], "id int, bytes string")


def decode_corpus(encoded: DataFrame, key: str, ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, text`` of each row of lists of ids; null and empty lists are the empty text, null ids are skipped.

    Keys must be unique. An id that the vocabulary doesn't have is an error. The token table is as small as the
    vocabulary, so it is sent to every executor.
    """
    table = F.broadcast(token_bytes(encoded.sparkSession, vocabulary))
    each = encoded.select(F.col(key).alias("key"), F.posexplode(ids).alias("at", "id")).where("id is not null")
    named = each.join(table, "id", "left").select(
        "key",
        F.struct("at", F.coalesce("bytes", F.raise_error(F.concat(F.lit("no token "), F.col("id").cast("string"))))).alias("t"),
    )
    joined = named.groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("t"))
    texts = joined.select("key", F.decode(F.unhex(F.array_join(F.col("t.col2"), "")), "UTF-8").alias("text"))
    return encoded.select(F.col(key).alias("key")).join(texts, "key", "left").select(
        F.col("key").alias(key), F.coalesce("text", F.lit("")).alias("text")
    )


def token_counts(texts: DataFrame, columns: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The given columns and ``tokens``: the number of ids of the text, 0 for null, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            kept = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64())], [*columns, "tokens"])

    kept = texts.select(*columns, F.col(text).alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[:-1])
    return kept.mapInArrow(run, f"{schema}, tokens bigint")
