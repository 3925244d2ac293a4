"""Mixing sources to target weights, sizes counted in tokens of a public tokenizer.

Every document belongs to the domains (the sources with a target) with some probability. A classifier is fitted on a
bounded sample of the documents that name their source, each weighed by how many it stands for. It is fitted twice, on
one half of the documents and on the other, so each half has posteriors of a model that hasn't seen it; the intercepts
are then moved until these posteriors add up to the sources' numbers of documents, over the whole table. One that names no source belongs to the domains by its posteriors; one that
names its source does so by ``label_weight`` (all of it by default, for the shares are counted by named sources), and by
its posteriors for the rest. A rate per document,
between 0 and the most often it may be used, says how often it is expected in the mix; the rates make the expected
tokens of each domain meet the targets in the least squares, by projected gradient steps:

    rate <- clip(rate - sum_k posterior_k * (tokens_k - target_k) / available_k, 0, most)

This is a gradient step in the metric of the documents' tokens with the errors scaled by each domain's available tokens.
In it no curvature exceeds 1 (Jensen), so the step needs no search, and where each document has one domain it is exact.
Steps are taken with Nesterov's momentum, from a point a little beyond the last rate.
Documents with equal posteriors and caps have equal rates throughout, so they are one row with their summed tokens: the
steps run over that table, and each sends one number per domain to the driver.

The texts are read once: the pass that counts tokens also notes which ones a text holds, and all else works on that.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.tokens import VOCABULARY, encoder
from wordloom.session import cut, spread

#: Labelled documents per source that the classifier is fitted on, in expectation.
SAMPLE = 500
#: Features of the classifier: tokens, by the remainder of their ids.
FEATURES = 1 << 12
#: Gradient steps at most, and the change of a domain's share at which they end.
STEPS, STILL = 60, 1e-6
#: A document is large if so many like it would be more than its source's share.
LARGE = 200
#: Sources that may be listed.
MOST_SOURCES = 1000
#: Documents of a cell in which rates are rounded, about.
CELL = 20_000


@dataclass(frozen=True)
class Targets:
    """The domains in order, their weights (summing to 1) and caps."""

    names: list[str]
    weights: list[float]
    caps: list[int]


def read_targets(targets: DataFrame) -> Targets:
    """Targets from ``source, target_weight, max_repeats`` rows.

    Rows without a source or a positive weight are left out and repeated ones count once (the smallest stands); a
    missing cap is 1. The table has a row per source, at most MOST_SOURCES.
    """
    rows = (
        targets.where("source is not null and target_weight > 0")
        .groupBy("source")
        .agg(F.min(F.struct("target_weight", F.coalesce("max_repeats", F.lit(1)).alias("cap"))).alias("t"))
        .select("source", "t.*").orderBy("source").limit(MOST_SOURCES + 1).collect()
    )
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources are listed")
    total = sum(r.target_weight for r in rows) or 1.0
    return Targets([r.source for r in rows], [r.target_weight / total for r in rows], [max(0, r.cap) for r in rows])


def _numbers(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]) if values else F.array().cast("array<double>")


@dataclass(frozen=True)
class Fit:
    """What a mix was fitted to: the targets, the tokens wanted and expected of each domain, and whether the steps came to rest."""

    goal: Targets
    wanted: list[float]
    expected: list[float]
    settled: bool


@dataclass(frozen=True)
class Classifier:
    """Weights of each feature and class, and intercepts, of the model of each half of the documents.

    Classes are the listed sources in order and, as the last one, all others; one that a half lacks can't be.
    """

    weights: list[np.ndarray]
    intercepts: list[np.ndarray]
    moved: np.ndarray

    def logarithms(self, half: int, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Logarithms of the posteriors of texts x classes, for texts whose features begin at ``starts``."""
        logits = np.add.reduceat(self.weights[half][flat].astype(np.float64), starts) + self.intercepts[half]
        return logits - logits.max(axis=1, keepdims=True) + self.moved


def token_features(texts: DataFrame, columns: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The given columns, ``tokens`` (0 for null) and ``features``: which tokens the text holds, by remainder, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            ids = [encode(t) if t else [] for t in batch.column(batch.num_columns - 1).to_pylist()]
            size = np.array([len(i) for i in ids], np.int64)
            owner = np.repeat(np.arange(len(ids)), size)
            flat = np.fromiter((x for i in ids for x in i), np.int64, int(size.sum())) % FEATURES
            held = np.unique(owner * FEATURES + flat)
            ends = np.concatenate(([0], np.cumsum(np.bincount(held // FEATURES, minlength=len(ids)))))
            features = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((held % FEATURES).astype(np.int16)))
            kept = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(size), features], [*columns, "tokens", "features"])

    kept = spread(texts.select(*columns, F.col(text).alias("__text")))
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[:-1])
    return kept.mapInArrow(run, f"{schema}, tokens bigint, features array<smallint>")


def classify(sized: DataFrame, key: str, source: str, listed: list[str], sample: int = SAMPLE) -> Classifier | None:
    """Two multinomial logistic regressions, each on about ``sample`` documents of each listed source, chosen by the hash of their key.

    ``sized`` comes from token_features(). All sources that aren't listed are one class. A sampled document weighs as
    many as its class has for each one sampled. None if not both halves have documents of two classes.
    """
    kind = F.coalesce(
        _lookup({n: F.lit(k) for k, n in enumerate(listed)}, F.col(source)), F.when(F.col(source).isNotNull(), len(listed))
    ).cast("int")
    named = sized.where(F.col(source).isNotNull() & (F.col("tokens") > 0)).withColumns({"kind": kind, "half": _half(key)})
    counts = {(r.half, r.kind): r["count"] for r in named.groupBy("half", "kind").count().collect()}  # 2 rows a class
    have = [{k: n for (h, k), n in counts.items() if h == half} for half in (0, 1)]
    if min(map(len, have)) < 2:
        return None
    with ThreadPoolExecutor(2) as both:  # each fit is a row of small jobs
        models = list(both.map(lambda half: _fit(named.where(F.col("half") == half), have[half], key, len(listed) + 1, sample), (0, 1)))
    model = Classifier([w for w, _ in models], [i for _, i in models], np.zeros(len(listed) + 1))
    true = np.array([sum(n for (_, k), n in counts.items() if k == c) for c in range(len(listed) + 1)], float)
    return Classifier(model.weights, model.intercepts, _moved(with_logarithms(named, model, key, source), true))


def _half(key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("half"), key), F.lit(2)).cast("int")


def _fit(named: DataFrame, have: dict[int, int], key: str, classes: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and intercepts of a model on a sample of each class; a class without documents can't be."""
    order = sorted(have)
    share = {k: min(1.0, sample / have[k]) for k in order}
    of = lambda values: F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("kind")]
    chosen = F.pmod(F.xxhash64(key), F.lit(1_000_000)) < of(share) * 1_000_000
    rows = named.where(chosen).select(
        F.transform("features", lambda x: x.cast("string")).alias("held"), "kind", of({k: 1 / share[k] for k in order}).alias("weight")
    )
    vectors = CountVectorizerModel.from_vocabulary([str(k) for k in range(FEATURES)], "held", "vector")
    train = vectors.transform(rows).select("vector", "kind", "weight").coalesce(4).cache()
    try:
        there = sorted(r[0] for r in train.select("kind").distinct().collect())  # a class may be missed by chance
        if len(there) > 1:
            label = F.create_map(*[x for n, k in enumerate(there) for x in (F.lit(k), F.lit(float(n)))])[F.col("kind")]
            fitted = LogisticRegression(
                featuresCol="vector", weightCol="weight", family="multinomial", maxIter=20, regParam=0.02, standardization=False
            ).fit(train.withColumn("label", label))
    finally:
        train.unpersist()
    weights, intercepts = np.zeros((FEATURES, classes), np.float32), np.full(classes, -1e4)
    intercepts[there] = 0.0
    if len(there) > 1:
        # the arrays alone are sent to tasks: the model's training summary may hold the session
        weights[:, there], intercepts[there] = fitted.coefficientMatrix.toArray().T, fitted.interceptVector.toArray()
    return weights, intercepts


def _moved(logarithms: DataFrame, true: np.ndarray, rounds: int = 25, near: float = 0.005) -> np.ndarray:
    """What to add to each class's logits for the posteriors of ``logarithms(p)`` to add up to the true numbers."""
    held = cut(logarithms.select("p"))
    moved = np.zeros(len(true))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(true))
        for batch in batches:
            lists = batch.column(0)
            total += _shares(lists.flatten().to_numpy().reshape(-1, len(true)) + moved).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(true))), pa.array(total)], ["class", "total"])

    for _ in range(rounds):
        rows = held.mapInArrow(run, "class bigint, total double").groupBy("class").agg(F.sum("total").alias("total")).collect()
        sums = np.zeros(len(true))
        sums[[r["class"] for r in rows]] = [r.total for r in rows]
        some = (true > 0) & (sums > 0)
        if not some.any() or np.abs(np.log(true[some] / sums[some])).max() <= near:
            break
        moved = moved + np.where(some, np.log(np.where(some, true, 1) / np.where(some, sums, 1)), 0.0)
    return moved


def _shares(logits: np.ndarray) -> np.ndarray:
    share = np.exp(logits - logits.max(axis=1, keepdims=True))
    return share / share.sum(axis=1, keepdims=True)


def with_logarithms(sized: DataFrame, model: Classifier, key: str, source: str, exact: bool = False) -> DataFrame:
    """Add ``p`` in place of ``features``: logarithms (with a constant) of the posteriors of each class, or the posteriors.

    Documents that name a source are judged by the model of the other half, others by the mean of both. They need a token.
    """
    columns = [c for c in sized.columns if c not in ("features", "half")]
    sent, n = sized.sparkSession.sparkContext.broadcast(model), len(model.moved)
    by = F.when(F.col(source).isNotNull(), 1 - _half(key)).otherwise(2).cast("int").alias("__by")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                judge, held = batch.column(len(columns)).to_numpy(), batch.column(len(columns) + 1)
                p = np.zeros((batch.num_rows, n))
                for half in (0, 1):
                    rows = np.flatnonzero((judge == half) | (judge == 2))
                    if len(rows):
                        part = held.take(pa.array(rows))
                        found = m.logarithms(half, part.flatten().to_numpy(), part.offsets.to_numpy()[:-1] - part.offsets[0].as_py())
                        p[rows] += _shares(found) if exact else found
                p[judge == 2] /= 2
                lists = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), n).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(columns))], lists], [*columns, "p"])

    schema = ", ".join(f"`{c}` {t}" for c, t in sized.dtypes if c in columns)
    return sized.select(*columns, by, "features").mapInArrow(run, f"{schema}, p array<double>")


def with_posteriors(sized: DataFrame, model: Classifier, key: str, source: str) -> DataFrame:
    """Add ``p`` in place of ``features``: the posterior of each listed source, in order; they add up to less than 1."""
    found = with_logarithms(sized, model, key, source, exact=True)
    return found.withColumn("p", F.slice("p", 1, len(model.moved) - 1))


def posteriors(documents: DataFrame, key: str, text: str, source: str, listed: list[str], sample: int = SAMPLE) -> DataFrame | None:
    """``key, p`` of the documents without a source: the probability of each listed source, in order; see classify()."""
    sized = cut(token_features(documents, [key, source], text).where("tokens > 0"))
    model = classify(sized, key, source, listed, sample)
    return None if model is None else with_posteriors(sized.where(F.col(source).isNull()), model, key, source).select(key, "p")


def calibration(
    documents: DataFrame, targets: DataFrame, key: str, text: str, source: str, sample: int = SAMPLE, fold: int = 4, vocabulary: str = VOCABULARY
) -> DataFrame:
    """``source, documents, expected, right, unnamed``: how well posteriors tell the listed sources, on documents not fitted on.

    A ``fold``-th of the documents, by the hash of their key, is held out. ``documents`` of them name the source,
    ``expected`` is the sum of their posteriors, ``right`` how many that name it have it as the most probable listed one;
    ``unnamed`` is the sum over all documents without a source. Without two sources there are no rows.
    """
    goal = read_targets(targets)
    empty = "source string, documents bigint, expected double, right bigint, unnamed double"
    sized = cut(token_features(documents.where(F.col(key).isNotNull()), [key, source], text, vocabulary).where("tokens > 0"))
    held = F.pmod(F.xxhash64(F.lit("held out"), key), F.lit(fold)) == 0
    model = classify(sized.where(~held), key, source, goal.names, sample) if goal.names else None
    if model is None:
        return documents.sparkSession.createDataFrame([], empty)
    scored = with_posteriors(sized.where(held | F.col(source).isNull()), model, key, source)
    best = F.array_position("p", F.array_max("p")) - 1
    named = F.col(source).isNotNull()
    aggs = []
    for k, n in enumerate(goal.names):
        own = F.coalesce(F.col(source) == n, F.lit(False))
        aggs += [
            F.count_if(own).alias(f"n{k}"), F.sum(F.when(named, F.col("p")[k])).alias(f"e{k}"),
            F.count_if(own & (best == k)).alias(f"r{k}"), F.sum(F.when(~named, F.col("p")[k])).alias(f"u{k}"),
        ]
    rows = [
        F.struct(
            F.lit(n).alias("source"), F.col(f"n{k}").alias("documents"), F.coalesce(f"e{k}", F.lit(0.0)).alias("expected"),
            F.col(f"r{k}").alias("right"), F.coalesce(f"u{k}", F.lit(0.0)).alias("unnamed"),
        )
        for k, n in enumerate(goal.names)
    ]
    return scored.agg(*aggs).select(F.inline(F.array(*rows)))


def document_rates(
    documents: DataFrame, targets: DataFrame, key: str, text: str, source: str,
    total: float | None = None, vocabulary: str = VOCABULARY, label_weight: float = 1.0, sample: int = SAMPLE,
    steps: int = STEPS, large: int = LARGE,
) -> tuple[DataFrame, Fit]:
    """``key, source, tokens, p, most, rate`` of each document that may be in the mix, and what it was fitted to.

    Left out are documents of sources without a target, texts without tokens and null keys. A document without a source
    may be used as often as one of the most restricted source. ``total`` is the size of the mix in tokens; by default
    the largest at which every source with documents can meet its target. A document that names its source belongs to
    it by ``label_weight``. Where the gradient ``steps`` don't come to rest, the fit says so.
    """
    goal = read_targets(targets)
    spark = documents.sparkSession
    if not goal.names:
        kind = documents.schema[key].dataType.simpleString()
        schema = f"`{key}` {kind}, source string, tokens bigint, p array<double>, most int, rate double"
        return spark.createDataFrame([], schema), Fit(goal, [], [], True)
    sized = cut(token_features(documents.where(F.col(key).isNotNull()), [key, source], text, vocabulary).where("tokens > 0"))
    caps = dict(zip(goal.names, goal.caps))
    one_hot = _lookup({n: _numbers([float(m == n) for m in goal.names]) for n in goal.names}, F.col(source))
    most = F.coalesce(_lookup({n: F.lit(c) for n, c in caps.items()}, F.col(source)), F.lit(min(caps.values()))).cast("int")
    model = classify(sized, key, source, goal.names, sample)
    named, unnamed = sized.where(F.col(source).isin(goal.names)), sized.where(F.col(source).isNull())
    made = lambda rows, p: rows.select(key, F.col(source).alias("source"), "tokens", p.alias("p"), most.alias("most"))
    rows = made(named, one_hot)
    if model is not None:
        if label_weight < 1:
            blend = F.zip_with(one_hot, "p", lambda x, y: x * label_weight + y * (1 - label_weight))
            rows = made(with_posteriors(named, model, key, source), blend)
        rows = rows.union(made(with_posteriors(unnamed, model, key, source), F.col("p")))
    rows = cut(rows)
    groups = cut(_grouped(rows))
    held = _per_domain(groups.where("source is not null"), F.col("tokens"), len(goal.names))
    reach = [caps[n] * h / w for n, h, w in zip(goal.names, held, goal.weights)]
    had = sum(w for w, r in zip(goal.weights, reach) if r > 0)
    size = total if total is not None else min([r * had for r in reach if r > 0], default=0.0)
    wanted = [w / had * size if r > 0 else 0.0 for w, r in zip(goal.weights, reach)] if had else [0.0] * len(reach)
    first = _with_rates(rows, _descend(groups, wanted, steps)[0], len(wanted))
    # a document that is a large part of its source can't be used in part: such ones are made whole first, and the
    # others' rates are fitted to what is left
    share = F.coalesce(_lookup(dict(zip(goal.names, map(F.lit, wanted))), F.col("source")), F.lit(size))
    is_large = F.col("tokens") * large > share
    whole = cut(mixed_copies(first.where(is_large), key).withColumn("rate", F.col("copies").cast("double")).drop("copies"))
    rest = rows.where(~is_large)
    done = _per_domain(whole, F.col("rate") * F.col("tokens"), len(wanted))
    rest_groups = cut(_grouped(rest))
    history, reached, settled = _descend(rest_groups, [max(0.0, t - y) for t, y in zip(wanted, done)], steps)
    fit = Fit(goal, wanted, [x + y for x, y in zip(done, reached)], settled)
    return whole.union(_with_rates(rest, history, len(wanted))), fit


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("p", "most", "source").agg(F.sum("tokens").cast("double").alias("tokens"))


def _rates(p: np.ndarray, most: np.ndarray, history: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
    """The rates after the steps with the given scaled errors and momenta, from rates of 0, and the point the next step starts at."""
    rate = point = np.zeros(len(most))
    for errors, momentum in history:
        to = np.clip(point - p @ errors, 0.0, most)
        point = to + momentum * (to - rate)
        rate = to
    return rate, point


def _members(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    p, most = (batch.column(batch.schema.get_field_index(c)) for c in ("p", "most"))
    return p.flatten().to_numpy(zero_copy_only=False).reshape(-1, n), most.to_numpy(zero_copy_only=False).astype(float)


def _reached(groups: DataFrame, history: list[tuple[np.ndarray, float]], n: int) -> np.ndarray:
    """Expected tokens of each domain at the rates and at the next step's start: 2 rows. A row per task is sent to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, n))
        for batch in batches:
            p, most = _members(batch, n)
            total += np.stack(_rates(p, most, history)) * batch.column(2).to_numpy() @ p
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["total"])

    rows = groups.select("p", "most", "tokens").mapInArrow(run, "total array<double>").collect()
    return np.sum([r.total for r in rows], axis=0).reshape(2, n) if rows else np.zeros((2, n))


def _descend(groups: DataFrame, wanted: list[float], steps: int) -> tuple[list[tuple[np.ndarray, float]], list[float], bool]:
    """The scaled errors and momentum of each gradient step towards the wanted tokens of each domain, where they led, and whether to rest."""
    available = np.array(_per_domain(groups, F.col("tokens"), len(wanted)))
    target = np.array(wanted, float)
    history: list[tuple[np.ndarray, float]] = []
    before = point = np.zeros(len(wanted))
    pace = 1.0
    for _ in range(steps):
        after = (1 + (1 + 4 * pace**2) ** 0.5) / 2
        errors = np.where(available > 0, (point - target) / np.where(available > 0, available, 1), 0.0)
        history.append((errors, (pace - 1) / after))
        pace = after
        reached, point = _reached(groups, history, len(wanted))
        if np.abs(reached - before).max(initial=0.0) <= STILL * max(target.sum(), 1.0):
            return history, reached.tolist(), True
        before = reached
    return history, before.tolist(), False


def _with_rates(rows: DataFrame, history: list[tuple[np.ndarray, float]], n: int) -> DataFrame:
    """Add ``rate``, after the given steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate, _ = _rates(*_members(batch, n), history)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], [*batch.schema.names, "rate"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, rate double")


def _lookup(values: dict[str, Column], of: Column) -> Column:
    found = F.lit(None)
    for name, value in values.items():
        found = F.when(of == name, value).otherwise(found)
    return found


def _per_domain(groups: DataFrame, tokens: Column, n: int) -> list[float]:
    row = groups.agg(*[F.sum(tokens * F.col("p")[k]).alias(f"y{k}") for k in range(n)]).head()
    return [float(v or 0.0) for v in row]


def mixed_copies(rates: DataFrame, key: str) -> DataFrame:
    """Add ``copies``: whole numbers that follow the rates, never more than ``most``.

    Documents stand in order of source and size; each gets the steps of the rounded running sum of the rates that fall
    on it, so a source's tokens differ from the expected ones by about a document. The running sum is taken in cells
    (size class and hash) of about CELL documents at most first, and then within each cell: no window holds a whole source.
    """
    rates = cut(rates)
    parts = max(1, -(-rates.count() // CELL))
    cell = [
        F.coalesce("source", F.lit("")).alias("at"), F.round(F.log2(F.col("tokens").cast("double")) * 8).cast("int").alias("class"),
        F.pmod(F.xxhash64(key), F.lit(parts)).alias("part"),
    ]
    rows = rates.select("*", *cell)
    sums = rows.groupBy("at", "class", "part").agg(F.sum("rate").alias("sum"))
    order = Window.partitionBy("at").orderBy("class", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("at", "class", "part", F.coalesce(F.sum("sum").over(order), F.lit(0.0)).alias("before"))
    within = Window.partitionBy("at", "class", "part").orderBy("tokens", key).rowsBetween(Window.unboundedPreceding, 0)
    running = rows.select("*", F.sum("rate").over(within).alias("to")).join(before, ["at", "class", "part"])
    end = F.col("before") + F.col("to") + 0.5
    copies = F.least(F.floor(end) - F.floor(end - F.col("rate")), F.col("most").cast("bigint"))
    return running.select(*rates.columns, copies.alias("copies"))


def mix(documents: DataFrame, targets: DataFrame, key: str, text: str, source: str, **how) -> DataFrame:
    """``key, source, tokens, rate, copies``: how often each document that may be used is in the mix (perhaps 0 times)."""
    rates, _ = document_rates(documents, targets, key, text, source, **how)
    return mixed_copies(rates, key).select(key, "source", "tokens", "rate", "copies")


def mix_shares(documents: DataFrame, targets: DataFrame, key: str, text: str, source: str, **how) -> DataFrame:
    """A row per listed source: target and reached share, and what they are made of.

    ``reached_share`` counts documents by their membership, ``labelled_share`` counts only what names its source, both of
    all tokens in the mix. A listed source without documents has 0. ``wanted_share`` is what the rates were fitted to (the
    others take the weight of a source without documents), ``missed_share`` what they missed it by; ``settled`` says
    whether the steps came to rest.
    """
    rates, fit = document_rates(documents, targets, key, text, source, **how)
    return shares(mixed_copies(rates, key), fit)


def shares(used: DataFrame, fit: Fit) -> DataFrame:
    """mix_shares() of documents with their ``copies`` and what they were fitted to."""
    goal, size = fit.goal, F.col("copies") * F.col("tokens")
    aggs = [F.sum(size).cast("double").alias("all")]
    for k, n in enumerate(goal.names):
        own = F.col("source") == n
        aggs += [
            F.sum(size * F.col("p")[k]).alias(f"soft{k}"), F.sum(F.when(own, size)).cast("double").alias(f"own{k}"),
            F.sum(F.when(own, F.col("tokens"))).alias(f"have{k}"), F.count(F.when(own & (F.col("copies") > 0), 1)).alias(f"used{k}"),
            F.max(F.when(own, F.col("copies"))).alias(f"most{k}"),
        ]
    one, total = used.agg(*aggs), sum(fit.wanted) or 1.0
    listed = [
        F.struct(
            F.lit(n).alias("source"), F.lit(w).alias("target_share"), F.lit(c).alias("max_repeats"),
            F.coalesce(F.col(f"have{k}"), F.lit(0)).cast("bigint").alias("available_tokens"),
            F.col(f"used{k}").alias("documents_used"), F.coalesce(F.col(f"most{k}"), F.lit(0)).cast("bigint").alias("most_copies"),
            F.coalesce(F.col(f"own{k}"), F.lit(0.0)).cast("bigint").alias("labelled_tokens"),
            F.coalesce(F.try_divide(f"own{k}", "all"), F.lit(0.0)).alias("labelled_share"),
            F.coalesce(F.try_divide(f"soft{k}", "all"), F.lit(0.0)).alias("reached_share"),
            F.lit(fit.wanted[k] / total).alias("wanted_share"), F.lit((fit.expected[k] - fit.wanted[k]) / total).alias("missed_share"),
            F.lit(fit.settled).alias("settled"),
        )
        for k, (n, w, c) in enumerate(zip(goal.names, goal.weights, goal.caps))
    ]
    if not listed:
        kinds = "max_repeats int, available_tokens bigint, documents_used bigint, most_copies bigint, labelled_tokens bigint"
        rest = "labelled_share double, reached_share double, wanted_share double, missed_share double, settled boolean"
        return used.sparkSession.createDataFrame([], f"source string, target_share double, {kinds}, {rest}")
    return one.select(F.inline(F.array(*listed)))
