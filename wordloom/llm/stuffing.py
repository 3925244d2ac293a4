"""Keyword-stuffed and link-list pages: measures of each text, a forest fitted on labelled pages, and the pages it finds.

Stuffing repeats terms at short and even gaps, so the gaps between a term's recurrences and the agreement of the term
sequence with itself some terms later (its positional autocorrelation) stand out; lists of nouns, tags and products have
many different terms and no function words. Both are measured in windows of terms as well as over the whole text, since
a page counts by what makes up most of it. A link is one term of the sequence, so a list of links is a term that recurs
at short and even gaps. No character, no punctuation and no word is looked for by name.

The function words themselves are found in the corpus: those that a large part of a language's documents hold, and as
evenly as chance would spread them. The forest only sets the thresholds of the measures. They are taken block-wise with
numpy inside the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.session import cut, scratch, spread

#: Terms of a window, and how many terms back a recurrence counts as near.
WINDOW, NEAR = 20, 48
#: Lags of the autocorrelation.
LAGS = tuple(range(1, 25))
#: A function word is held by this share of a language's documents, in at most 2 ** UNEVEN times fewer than by chance.
HELD, UNEVEN = 0.25, 1.0
#: Languages of fewer documents are taken together.
FEW = 30

#: The term that stands for a link.
LINK = "\x01"
_CJK = "぀-ヿ㐀-鿿"
#: Terms, ends of sentences and ends of lines.
_UNIT = re.compile(rf"{LINK}|[{_CJK}]|[^\W_{_CJK}]+|[.!?。！？]+(?=[\s\"')\]]|$)|\n")
_URL = re.compile(r"https?://[^\s<>\"')\]]+|www\.[^\s<>\"')\]]+|(?<=\]\()[^)\s]*(?=\))")

NAMES = (
    ["log_terms", "distinct", "top_term", "top_five", "near", "gap_8", "gap_even", "gap_log", "function", "function_few"]
    + ["function_none", "near_most", "stuffed", "listed", "prose", "prose_terms", "ended", "digits", "once"]
    + ["links", "link_gap", "link_even", "link_windows"]
    + [f"lag_{k}" for k in LAGS]
    + ["lag_most", "lag_sum"]
)


def _units(text: str) -> list[str]:
    return _UNIT.findall(_URL.sub(f" {LINK} ", text).lower())


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values between the bounds."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def measures(texts: list[str], function_words: frozenset[str]) -> np.ndarray:
    """One row of NAMES per text; an empty text has zeros."""
    n = len(texts)
    out = dict.fromkeys(NAMES, np.zeros(n))
    units: list[str] = []
    counts = np.empty(n, dtype=np.int64)
    for k, text in enumerate(texts):
        found = _units(text)
        units += found
        counts[k] = len(found)
    coded = pa.array(units, pa.string()).dictionary_encode()
    words = coded.dictionary.to_pylist()
    if not words:
        return np.zeros((n, len(NAMES)))
    code = coded.indices.to_numpy()
    is_end = np.array([w[0] in ".!?。！？" for w in words])
    is_stop = is_end | np.array([w == "\n" for w in words])
    is_function = np.array([w in function_words for w in words])
    is_number = np.array([w[0].isdigit() for w in words])
    is_link = np.array([w == LINK for w in words])
    owner = np.repeat(np.arange(n), counts)
    stop = is_stop[code]

    # sentences: what ends in a full stop has five terms and function words
    term = ~stop
    segment = np.cumsum(np.concatenate(([0], stop[:-1])))
    _, segment = np.unique(segment + owner, return_inverse=True)  # a text's end ends a segment too
    function = is_function[code] & term
    per = np.bincount(segment, weights=term)
    fun = np.bincount(segment, weights=function)
    end = np.bincount(segment, weights=is_end[code]) > 0
    prose = (per >= 5) & (fun >= np.maximum(1, 0.12 * per))
    out["prose"] = _by(owner, (term & (prose & end)[segment]).astype(float), n)
    out["prose_terms"] = _by(owner, (term & prose[segment]).astype(float), n)
    out["ended"] = _by(owner, is_end[code].astype(float), n)

    # from here on, terms only
    code, owner, function = code[term], owner[term], function[term]
    terms = np.bincount(owner, minlength=n)
    bounds = np.concatenate(([0], np.cumsum(terms)))
    many = np.maximum(1, terms)
    for name in ("prose", "prose_terms", "ended"):
        out[name] = out[name] / many
    out["log_terms"] = np.log1p(terms)
    out["function"] = _sums(function, bounds) / many
    out["digits"] = _sums(is_number[code], bounds) / many

    # how often a term stands in a text, and the gaps between its recurrences
    key = owner * len(words) + code
    group, held = np.unique(key, return_counts=True)
    whose = group // len(words)
    ranked = np.lexsort((-held, whose))
    place = np.arange(len(group)) - np.searchsorted(whose[ranked], whose[ranked])
    out["distinct"] = np.bincount(whose, minlength=n) / many
    out["top_term"] = _by(whose[ranked], held[ranked] * (place < 1), n) / many
    out["top_five"] = _by(whose[ranked], held[ranked] * (place < 5), n) / many
    out["once"] = _by(whose, (held == 1).astype(float), n) / many
    at = np.arange(len(code)) - bounds[owner]
    order = np.argsort(key, kind="stable")
    never = 1 << 30
    gap = np.full(len(code), never)
    same = key[order][1:] == key[order][:-1]
    gap[order[1:][same]] = (at[order][1:] - at[order][:-1])[same]
    again, near, link = gap < never, gap <= NEAR, is_link[code]
    out["near"] = _sums(near, bounds) / many
    out["gap_8"] = _sums(gap <= 8, bounds) / many
    out["gap_log"], out["gap_even"] = _spread(gap, again, bounds)
    out["links"] = _sums(link, bounds) / many
    out["link_gap"], out["link_even"] = _spread(gap, again & link, bounds)

    # windows of terms that lie within one text
    if len(code) >= WINDOW:
        inside = owner[WINDOW - 1 :] == owner[: len(owner) - WINDOW + 1]
        slide = lambda x: np.convolve(x.astype(float), np.ones(WINDOW), "valid")
        few, close, soon, linked = slide(function), slide(near), slide(gap < WINDOW), slide(link)
        start = owner[: len(inside)]
        windows = np.maximum(1, np.bincount(start, weights=inside, minlength=n))
        for name, met in (
            ("function_few", few <= 2.5), ("function_none", few <= 0.5), ("near_most", close >= WINDOW * 0.5),
            ("stuffed", (few <= 2.5) & (close >= WINDOW * 0.4)), ("listed", (few <= 1.5) & (soon <= WINDOW * 0.2)),
            ("link_windows", linked >= WINDOW * 0.15),
        ):
            out[name] = np.bincount(start, weights=inside & met, minlength=n) / windows
    lagged = []
    for k in LAGS:
        agree = (code[k:] == code[:-k]) & (owner[k:] == owner[:-k])
        lagged.append(np.bincount(owner[:-k] if k < len(owner) else owner[:0], weights=agree, minlength=n) / many)
        out[f"lag_{k}"] = lagged[-1]
    out["lag_most"], out["lag_sum"] = np.max(lagged, axis=0), np.sum(lagged, axis=0)
    return np.stack([out[name] for name in NAMES], axis=1)


def _spread(gap: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the logarithm of each text's gaps that count: even gaps deviate little."""
    log_gap = np.where(counts, np.log1p(np.minimum(gap, 1 << 20)), 0.0)
    times = np.maximum(1, _sums(counts, bounds))
    mean = _sums(log_gap, bounds) / times
    return mean, np.sqrt(np.maximum(0, _sums(log_gap**2, bounds) / times - mean**2))


def _by(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


def term_counts(documents: DataFrame, text: str, group: Column) -> DataFrame:
    """``language, term, df, cf``: documents with a term and its occurrences, in each group of documents.

    They are added up in each batch before any shuffle. The term "" counts the documents themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 10_000):
                batch = whole.slice(at, 10_000)
                named = batch.column(0).dictionary_encode()
                languages, language = named.dictionary, named.indices.to_numpy()
                found = [_units(t) for t in batch.column(1).to_pylist()]
                coded = pa.array([w for f in found for w in f], pa.string()).dictionary_encode()
                size = len(coded.dictionary) or 1
                owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
                each, times = np.unique(owner * size + coded.indices.to_numpy(), return_counts=True)
                key, place = np.unique(language[each // size] * np.int64(size) + each % size, return_inverse=True)
                df, cf = np.bincount(place, minlength=len(key)), np.bincount(place, weights=times, minlength=len(key)).astype(np.int64)
                docs = np.bincount(language, minlength=len(languages))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([languages.take(pa.array(key // size)), languages]),
                        pa.concat_arrays([coded.dictionary.take(pa.array(key % size)), pa.array([""] * len(languages), pa.string())]),
                        pa.array(np.concatenate([df, docs])), pa.array(np.concatenate([cf, docs])),
                    ],
                    ["language", "term", "df", "cf"],
                )

    kept = spread(documents.where(F.col(text) != "").select(group.alias("language"), F.col(text).alias("text")))
    counts = kept.mapInArrow(run, "language string, term string, df bigint, cf bigint")
    return counts.groupBy("language", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def function_words(documents: DataFrame, text: str, lang: str | None = None, held: float = HELD, uneven: float = UNEVEN, few: int = FEW) -> DataFrame:
    """``language, term``: the words that at least ``held`` of a language's documents hold, spread as by chance.

    A term with as many occurrences would by chance be in N (1 - exp(-occurrences / N)) of N documents; keywords are in far
    fewer, function words aren't. Languages are the first two letters of ``lang``; other values, and languages of less
    than ``few`` documents, are one group. Documents hold d different terms on average, so a language has at
    most d / ``held`` such words, however large the corpus is.
    """
    tag = F.regexp_extract(F.lower(F.coalesce(F.col(lang), F.lit(""))), r"^([a-z]{2})(?:[-_].*)?$", 1) if lang else F.lit("")
    counts = cut(term_counts(documents, text, tag))
    sizes = counts.where("term = ''").select("language", F.col("df").alias("n"))
    group = sizes.select("language", F.when(F.col("n") >= few, F.col("language")).otherwise("").alias("group"), "n")
    group = F.broadcast(group)  # at most 26 * 26 + 1 rows
    total = group.groupBy("group").agg(F.sum("n").alias("n"))
    terms = counts.where(F.col("term").rlike(r"\p{L}")).join(group.select("language", "group"), "language")
    summed = terms.groupBy("group", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).join(F.broadcast(total), "group")
    chance = F.col("n") * (1 - F.exp(-F.col("cf") / F.col("n")))
    even = chance <= F.col("df") * 2.0**uneven
    return summed.where((F.col("df") >= held * F.col("n")) & even).select(F.col("group").alias("language"), "term")


def measured(texts: DataFrame, columns: list[str], text: str, functions: frozenset[str]) -> DataFrame:
    """The given columns and ``measures ARRAY<DOUBLE>`` of each text; null is like empty."""

    def rows(batch: pa.RecordBatch, table: np.ndarray) -> pa.RecordBatch:
        lists = pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*batch.columns, lists], [*columns, "measures"])

    kept, schema = _with_text(texts, columns, text)
    return kept.mapInArrow(_by_measures(rows, functions), f"{schema}, measures array<double>")


def _with_text(texts: DataFrame, columns: list[str], text: str) -> tuple[DataFrame, str]:
    kept = texts.select(*columns, F.col(text).alias("__text"))
    return kept, ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[:-1])


def _by_measures(use: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], functions: frozenset[str]) -> Callable:
    """A map over batches whose last column is the text: ``use`` gets the other columns and the measures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                table = measures([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()], functions)
                yield use(batch.select(range(batch.num_columns - 1)), table)

    return run


def fit(labelled: DataFrame, label: str, trees: int = 80, depth: int = 9) -> RandomForestClassificationModel:
    """A forest on rows of ``measures`` and a label of 0 or 1."""
    rows = labelled.select(array_to_vector("measures").alias("features"), F.col(label).cast("double").alias("label"))
    return RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=5, featureSubsetStrategy="sqrt", maxBins=48, minInstancesPerNode=1
    ).fit(rows.coalesce(2))


class Forest:
    """A fitted forest as arrays, so that a text is judged where its measures are taken: node by tree, children, shares.

    The fitted model itself can't always be sent to tasks: its training summary holds the session.
    """

    def __init__(self, model: RandomForestClassificationModel, folder: str, spark: SparkSession) -> None:
        model.write().overwrite().save(folder)
        # as many rows as the forest has nodes: at most trees * 2 ** (depth + 1)
        nodes = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
        first, count = {}, 0
        for n in nodes:
            first.setdefault(n.treeID, count)
            count += 1
        base = np.array([first[n.treeID] for n in nodes])
        self.roots = np.array(sorted(first.values()))
        self.left, self.right = (base + [max(0, n[c]) for n in nodes] for c in ("leftChild", "rightChild"))
        self.inner = np.array([n.leftChild >= 0 for n in nodes])
        self.measure = np.array([max(0, n.split.featureIndex) for n in nodes])
        self.limit = np.array([n.split.leftCategoriesOrThreshold[0] if n.leftChild >= 0 else 0.0 for n in nodes])
        self.share = np.array([n.impurityStats[1] / (sum(n.impurityStats) or 1.0) for n in nodes])

    def score(self, table: np.ndarray) -> np.ndarray:
        """The mean share of the label 1 in the leaves that each row of measures falls into."""
        row = np.arange(len(table))[:, None]
        at = np.tile(self.roots, (len(table), 1))
        while (inner := self.inner[at]).any():
            to = np.where(table[row, self.measure[at]] <= self.limit[at], self.left[at], self.right[at])
            at = np.where(inner, to, at)
        return self.share[at].mean(axis=1)


def stuffed_pages(
    documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, lang: str | None = None,
    most_labels: int = 20_000, least: float = 0.5,
) -> DataFrame:
    """``key``: documents of which stuffed keywords, link lists or tags make up most.

    ``labels`` has (key, label) rows; null labels are left out and repeated ones count once. The forest is fitted on at
    most ``most_labels`` labelled documents, those with the smallest hash of their key; function words are counted over
    all documents, by ``lang`` where it is given, and every document is measured whole. Null and empty texts are never
    found. Without labels of both kinds nothing is found.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("label"))
    marks = marks.orderBy(F.xxhash64(key), key).limit(most_labels)
    # as many as function_words() says, whatever the size of the corpus
    functions = frozenset(r.term for r in function_words(documents, text, lang).select("term").distinct().collect())
    # the labelled documents are few by their bound, so they are sent to the scan instead of shuffling the texts
    sample = documents.select(key, text).join(F.broadcast(marks), key)
    train = measured(sample, [key, "label"], text, functions).select("measures", "label").cache()
    spark = documents.sparkSession
    try:
        if train.select("label").distinct().count() < 2:
            return documents.select(key).limit(0)
        forest = Forest(fit(train, "label"), scratch(spark), spark)
    finally:
        train.unpersist()

    def found(batch: pa.RecordBatch, table: np.ndarray) -> pa.RecordBatch:
        return batch.filter(pa.array(forest.score(table) >= least))

    kept, schema = _with_text(documents.where(F.col(text) != ""), [key], text)
    return spread(kept).mapInArrow(_by_measures(found, functions), schema)
