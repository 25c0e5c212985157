"""Toxicity scores from class-conditional Kneser-Ney models."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vernissage.llm.collocations import phrase_hashes, word_hashes
from vernissage.llm.common import carried, named, slices, tidy, whole
from vernissage.session import materialize

RESULTS = ["score", "predicted"]
_WORD = re.compile(r"[^\W\d_]+")
#: What is taken off every count for the backoff: words and pairs seen no more often say nothing of a class by themselves.
_DISCOUNT = 2.0
#: The counts of both classes together stop here, so that a word frequent in one class alone stays rare in their backoff.
_SHARED = 4.0
#: Weight of the single word in the backoff of a pair, in counts of pairs.
_SINGLE = 4.0
#: Ratios above these count as strong evidence, which the calibration sees apart from the mean.
_STRONG = (1.0, 2.5)
FEATURES = ["mean", "size", "peak", *[f"strong{i}" for i in range(len(_STRONG))]]


@dataclass(frozen=True)
class ToxicityModel:
    """What a word, and what a known pair of words beyond its words, adds to the log-likelihood ratio; and the calibration.

    Words and pairs are looked up by 64-bit hashes, which are held in ascending order beside their values.
    """

    words: tuple[np.ndarray, np.ndarray]
    pairs: tuple[np.ndarray, np.ndarray]
    unknown: float
    weights: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0, 0.0)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _counted(rows: DataFrame) -> DataFrame:
    """``first, second, n0, n1``: in how many texts of either class each pair of words follows (``text``, ``label``)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            pairs = list(counts[0].keys() | counts[1].keys())
            columns = [[p[0] for p in pairs], [p[1] for p in pairs], *[[c[p] for p in pairs] for c in counts]]
            for c in counts:
                c.clear()
            types = (pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["first", "second", "n0", "n1"])

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                words = words_of(text.as_py())
                counts[label.as_py()].update(set(zip(["", *words], words)))
                if len(counts[0]) + len(counts[1]) > 1_000_000:
                    yield flush()
        yield flush()

    found = rows.select("text", "label").mapInArrow(run, "first string, second string, n0 bigint, n1 bigint")
    return found.groupBy("first", "second").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return phrase_hashes(np.column_stack([first, second]))


def _table(rows: DataFrame, *words: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words, or pairs of words, of ``rows`` in ascending order, with their ``value``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [word_hashes(batch.column(i).cast(pa.binary()), np.uint64(0)) for i in range(len(words))]
            keys = hashes[0] if len(hashes) == 1 else _pair_hashes(*hashes)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(len(words)).cast(pa.float32())], ["key", "value"])

    found = rows.select(*words, "value").mapInArrow(run, "key bigint, value float").toArrow()
    keys = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys, kind="stable")
    return keys[order], found.column("value").to_numpy()[order]


def _limited() -> Column:
    """What a pair counts in the backoff of both classes: discounted like any count, and limited."""
    return F.least(F.greatest(F.col("n0") + F.col("n1") - _DISCOUNT, F.lit(0.0)), F.lit(_SHARED))


def _fit_language_models(rows: DataFrame) -> ToxicityModel:
    """Both models from the pair counts of the bounded sample ``rows``; every word and pair that adds anything is kept."""
    counts = materialize(_counted(rows))
    seen = [(F.col(f"n{c}") > 0).cast("bigint") for c in (0, 1)]
    before = counts.groupBy(F.col("first").alias("word")).agg(
        *[F.sum(f"n{c}").alias(f"n{c}") for c in (0, 1)], *[F.sum(F.least(f"n{c}", F.lit(_DISCOUNT))).alias(f"t{c}") for c in (0, 1)],
        F.sum(_limited()).alias("shared"),
    )
    after = counts.groupBy(F.col("second").alias("word")).agg(*[F.sum(seen[c]).alias(f"k{c}") for c in (0, 1)])
    total = after.agg(
        *[F.sum(f"k{c}") for c in (0, 1)], *[F.sum(F.least(f"k{c}", F.lit(_DISCOUNT))) for c in (0, 1)],
        F.sum(F.least(F.col("k0") + F.col("k1"), F.lit(_SHARED))),
    ).first()
    size, taken, shared = *((max(1.0, total[i] or 0), max(1.0, total[i + 1] or 0)) for i in (0, 2)), max(1.0, total[4] or 0)

    # continuation probabilities of either class, backing off to the limited counts of both classes together
    both = F.greatest(F.lit(1.0), F.least(F.col("k0") + F.col("k1"), F.lit(_SHARED))) / shared
    single = [(F.greatest(F.col(f"k{c}") - _DISCOUNT, F.lit(0.0)) + taken[c] * both) / size[c] for c in (0, 1)]
    back = [F.when(F.col(f"n{c}") > 0, F.col(f"t{c}") / F.col(f"n{c}")).otherwise(1.0) for c in (0, 1)]
    words = before.join(after, "word", "full").fillna(0).select(
        "word", "n0", "n1", "shared", *[single[c].alias(f"s{c}") for c in (0, 1)], *[back[c].alias(f"b{c}") for c in (0, 1)]
    )
    words = words.withColumn("own", F.log("s1") - F.log("s0")).withColumn("context", F.log("b1") - F.log("b0"))
    words = materialize(words)
    unknown = float(np.log(taken[1] / size[1]) - np.log(taken[0] / size[0]))

    heads = words.select(F.col("word").alias("first"), F.col("n0").alias("m0"), F.col("n1").alias("m1"), "shared", "b0", "b1", "context")
    pairs = counts.join(heads, "first").join(words.select(F.col("word").alias("second"), "s0", "s1", "own"), "second")
    # a pair that one class lacks backs off to the limited counts of both, so a passage copied in one class weighs little
    full = [
        F.greatest(F.col(f"n{c}") - _DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"m{c}"), F.lit(1))
        + F.col(f"b{c}") * (_limited() + _SINGLE * F.col(f"s{c}")) / (F.col("shared") + _SINGLE)
        for c in (0, 1)
    ]
    # whatever is seen no more often than the discount backs off to its words in both classes alike, and adds nothing to them
    pairs = pairs.filter(F.col("n0") + F.col("n1") > _DISCOUNT).withColumn("value", F.log(full[1]) - F.log(full[0]) - F.col("context") - F.col("own"))
    return ToxicityModel(_table(words.withColumn("value", F.col("own") + F.col("context")), "word"), _table(pairs, "first", "second"), unknown)


def _look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
    known, values = table
    if not len(known):
        return np.full(len(keys), missing)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at].astype(np.float64), missing)


def text_ratios(texts: list[str], model: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The log-likelihood ratio of each distinct pair of words of each text, and the text's number."""
    words, pairs, unknown = model
    tokens = [words_of(text) for text in texts]
    sizes = np.array([len(t) for t in tokens], np.int64)
    kinds = pa.array([w for t in tokens for w in t], pa.string()).dictionary_encode()
    hashes = word_hashes(kinds.dictionary.cast(pa.binary()), np.uint64(0))
    which, owner = kinds.indices.to_numpy(), np.repeat(np.arange(len(texts)), sizes)
    second = hashes[which] if len(which) else np.zeros(0, np.uint64)
    first = np.append(np.uint64(0), second[:-1])[: len(second)]  # the hash of no word
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
    keys = _pair_hashes(first, second)
    order = np.lexsort((keys, owner))
    keys, owner, which = keys[order], owner[order], which[order]
    new = np.ones(len(keys), bool)  # a pair counts once: repeats say no more
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    single = _look_up(words, hashes, unknown)
    return single[which[new]] + _look_up(pairs, keys[new], 0.0), owner[new]


def _ratios(rows: DataFrame, model: ToxicityModel, columns: list[str]) -> DataFrame:
    """``columns`` with ``FEATURES`` of ``text``.

    ``mean`` is the log-likelihood ratio per distinct pair of words, ``size`` the logarithm of their number, ``peak``
    the largest ratio, and ``strong*`` the logarithm of the summed ratios above each bar, so that a few strong expressions
    count in a long text as well.
    """
    shared = rows.sparkSession.sparkContext.broadcast((model.words, model.pairs, model.unknown))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20):
            ratios, owner = text_ratios(batch.column(batch.num_columns - 1).to_pylist(), shared.value)
            n = np.bincount(owner, minlength=batch.num_rows)
            total = lambda values: np.bincount(owner, weights=values, minlength=batch.num_rows)
            peak = np.zeros(batch.num_rows)
            if len(owner):
                peak[np.flatnonzero(n)] = np.maximum.reduceat(ratios, np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]))
            strong = [np.log1p(total(np.where(ratios > bar, ratios, 0.0))) for bar in _STRONG]
            found = [total(ratios) / np.maximum(n, 1), np.log1p(n), peak, *strong]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, found)], [*columns, *FEATURES])

    kinds = dict(rows.dtypes)
    schema = "".join(f"{c} {kinds[c]}, " for c in columns)
    return rows.select(*columns, "text").mapInArrow(run, schema + ", ".join(f"{f} double" for f in FEATURES))


def _calibrate(features: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, ...]:
    """Logistic regression of the label on the features, by damped Newton steps."""
    centre, scale = features.mean(axis=0), features.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    z = np.column_stack([np.ones(len(features)), (features - centre) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(hessian, z.T @ (labels - p) - 1e-2 * w), -2, 2)
    slopes = w[1:] / scale
    return (float(w[0] - slopes @ centre), *slopes.tolist())


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    most_documents: int = 10_000,
) -> ToxicityModel | float:
    """A model from labelled documents; the share of toxic labels if one class has none.

    Of four fifths of the labelled rows, drawn by hash, the two classes give equally many documents, at most
    ``most_documents``, to the language models, which keep all their counts; the rest, under the same bound, gives the
    calibration. A document with
    several labels counts as toxic if one says so; null labels and identifiers are ignored.
    """
    labels = labels.select(named(id_col).alias("id"), named(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    labels = labels.groupBy("id").agg(F.max("label").alias("label")).withColumn("draw", F.xxhash64(F.lit("toxicity"), "id"))
    labels = materialize(labels.withColumn("tune", F.pmod("draw", F.lit(5)) == 0))
    sizes = {(r["tune"], r["label"]): r["n"] for r in labels.groupBy("tune", "label").agg(F.count("*").alias("n")).collect()}
    both = sum(sizes.values())
    toxic = sum(n for (_, label), n in sizes.items() if label)
    if min(sizes.get((False, c), 0) for c in (0, 1)) == 0:
        return toxic / both if both else 0.0
    texts = docs.select(named(id_col).alias("id"), whole(text_col).alias("text"))
    equal = min(most_documents, *[sizes[False, c] for c in (0, 1)])
    part = [labels.filter(~F.col("tune") & (F.col("label") == c)).orderBy("draw", "id").limit(equal) for c in (0, 1)]
    drawn = materialize(part[0].unionByName(part[1]).select("id", "label"))
    texts_drawn = texts.join(F.broadcast(drawn), "id").dropDuplicates(["text"])  # at most 2 x most_documents rows
    model = _fit_language_models(texts_drawn)
    tune = materialize(labels.filter("tune").orderBy("draw", "id").limit(most_documents).select("id", "label"))
    scored = _ratios(texts.join(F.broadcast(tune), "id"), model, ["label"]).toPandas()
    if scored["label"].nunique() < 2:
        return model
    weights = _calibrate(scored[FEATURES].to_numpy(float), scored["label"].to_numpy(float))
    return ToxicityModel(model.words, model.pairs, model.unknown, weights)


def score_toxicity(
    docs: DataFrame, model: ToxicityModel | float, text_col: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """The ``carry`` columns (default all) with ``score``, 0 to 1, and ``predicted``, whether it is at least 0.5.

    The score calibrates the difference of the two models' log-likelihoods over the distinct pairs of words of the whole text. Where a class has
    not seen a pair of words, its model backs off to words by the number of pairs they end, and from there to the counts of
    both classes together, so that rare words weigh little.

    A null text counts as empty; empty texts get the score of ratios of zero. Repeated rows repeat their score. An empty
    table gives an empty result. Columns of ``docs`` named like a result column are replaced by it.
    """
    keep = carried(docs, carry, RESULTS)
    row = F.struct(F.lit(0).alias("_"), *[named(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("row")
    rows = docs.select(row, whole(text_col).alias("text"))
    if isinstance(model, float):
        rows = rows.withColumn("score", F.lit(model))
    else:
        line = F.lit(model.weights[0])
        for weight, feature in zip(model.weights[1:], FEATURES):
            line = line + F.lit(weight) * F.col(feature)
        rows = _ratios(rows, model, ["row"]).withColumn("score", 1 / (1 + F.exp(-line)))
    return rows.select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)], "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
