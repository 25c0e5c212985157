"""Language identification that fuses text, declared markup language, address suffix and host priors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vernissage.llm.common import carried, named, slices, tidy, whole
from vernissage.session import materialize

RESULTS = ["language", "confidence", "rejected"]
#: Byte triples are hashed into so many cells; one more cell takes triples without letters.
_CELLS = 1 << 16
_BATCH = 1 << 20
#: Triples overlap, so each counts for a part of an independent observation.
_TEMPER = 0.2
#: Pseudo-counts: of a cell, of the parent's share in a prior, and of a declared or suffix language before any count.
_CELL, _PARENT, _AGREE = 0.5, 10.0, 20.0
_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[0x80:] = np.arange(0x80, 0x100)


@dataclass(frozen=True)
class TextModel:
    """Log-likelihood of each cell under each language, without its mean over languages; and the languages' shares."""

    languages: list[str]
    scores: np.ndarray
    shares: list[float]


def _cells(data: np.ndarray) -> np.ndarray:
    """The cell of every byte triple that starts in ``data``; the last two bytes start none."""
    x = _LETTER[data].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    a, b, c = x[:-2], x[1:-1], x[2:]
    cell = ((a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + c * np.uint32(0xC2B2AE3D)) >> np.uint32(16)).astype(np.int64)
    cell[(a == 0x20) & (b == 0x20) & (c == 0x20)] = _CELLS
    return cell


def _joined(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([b"  " + t + b"  " for t in texts]), np.uint8)


def fit_text_model(docs: DataFrame, text_col: str = "text", label_col: str = "lang") -> TextModel:
    """Counts of hashed byte triples per language over all labelled rows, summed in tasks and then by Spark.

    Languages are the distinct labels, which are few by nature; null labels are ignored. A column ``label_col`` of nulls
    alone gives a model without languages.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches, _BATCH):
            texts: dict[str, list[bytes]] = {}
            for text, label in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(label, []).append(text)
            for label, own in texts.items():
                counts.setdefault(label, np.zeros(_CELLS + 1, np.int64))
                counts[label] += np.bincount(_cells(_joined(own)), minlength=_CELLS + 1)
        for label, count in counts.items():
            cell = np.flatnonzero(count[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(cell), pa.string()), pa.array(cell), pa.array(count[cell])], ["label", "cell", "n"])

    rows = docs.select(whole(text_col).alias("text"), named(label_col).cast("string").alias("label")).filter("label is not null")
    counted = rows.mapInArrow(run, "label string, cell bigint, n bigint").groupBy("label", "cell").agg(F.sum("n").alias("n"))
    counted = counted.groupBy("label").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))  # at most _CELLS per language
    shares = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    found = {r["label"]: np.array(r["cells"], np.int64).reshape(-1, 2) for r in counted.toLocalIterator()}
    languages = sorted(shares)
    if not languages:
        return TextModel([], np.zeros((0, _CELLS + 1), np.float32), [])
    scores = np.full((len(languages), _CELLS + 1), _CELL)
    for i, language in enumerate(languages):
        cells = found.get(language, np.zeros((0, 2), np.int64))
        scores[i, cells[:, 0]] += cells[:, 1]
    scores = np.log(scores / scores.sum(axis=1, keepdims=True))
    scores -= scores.mean(axis=0)
    scores[:, _CELLS] = 0
    return TextModel(languages, scores.astype(np.float32), [shares[x] / sum(shares.values()) for x in languages])


def _text_scores(rows: DataFrame, model: TextModel) -> DataFrame:
    """``rows`` with ``likelihood``, one number per language, and ``triples`` instead of ``text``, their last column."""
    names, kinds = rows.columns[:-1], dict(rows.dtypes)
    shared = rows.sparkSession.sparkContext.broadcast(model.scores)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = shared.value
        for batch in slices(batches, _BATCH):
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            starts = np.cumsum([0, *[len(t) + 4 for t in texts]])[:-1]
            cells = np.append(_cells(_joined(texts)), [_CELLS, _CELLS])
            found = np.stack([np.add.reduceat(s[cells], starts, dtype=np.float64) for s in scores], axis=1)
            triples = np.add.reduceat(cells < _CELLS, starts, dtype=np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(scores)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, pa.array(triples)], [*names, "likelihood", "triples"])

    schema = "".join(f"{c} {kinds[c]}, " for c in names)
    return rows.mapInArrow(run, schema + "likelihood array<double>, triples bigint")


def _place(values: Column) -> Column:
    """The 1-based place of the largest value, the first of equals."""
    return F.array_position(values, F.array_max(values)).cast("int")


def _counts(rows: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """``key, name``: how many rows of each key have each language as their text's best, as an array."""
    per = rows.filter(F.col(key).isNotNull() & F.col("best").isNotNull()).groupBy(key).agg(
        *[F.sum((F.col("best") == i + 1).cast("double")).alias(f"b{i}") for i in range(n)]
    )
    return per.select(key, F.array(*[f"b{i}" for i in range(n)]).alias(name))


def identify(
    docs: DataFrame, model: TextModel, text: Column, declared: Column | None = None, suffix: Column | None = None,
    host: Column | None = None, domain: Column | None = None, carry: list[str] | None = None, least: float = 0.35,
) -> DataFrame:
    """The ``carry`` columns (default all) with ``language``, ``confidence`` and whether the row is ``rejected``.

    The posterior of each language multiplies the tempered likelihood of the whole text, the likelihoods of the declared
    language and of the address suffix, and a prior of the host. Grouped aggregation over all rows counts the languages
    that the texts alone suggest by declared language, by suffix, and by host; a host's prior backs off to its domain's
    and that to the labelled shares, each row's own count left out. A declared language or suffix counts as a hint for
    the language of the same name until counts say otherwise.

    A row is rejected if its text has no letters, or no language reaches ``least``. Missing evidence, null columns included,
    says nothing. A model without languages rejects every row, with a null language. Repeated rows are rows of
    their own. An empty table gives an empty result. Columns of ``docs`` named like a result column are replaced by it.
    """
    keep, languages = carried(docs, carry, RESULTS), model.languages
    row = F.struct(F.lit(0).alias("_"), *[named(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("row")
    out = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)]
    if not languages:
        nothing = [F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit(True).alias("rejected")]
        return docs.select(row).select(*out, *nothing)
    n, none = len(languages), F.lit(None).cast("string")
    hints = {"declared": declared, "suffix": suffix, "host": host, "domain": domain}
    given = {k: v for k, v in hints.items() if v is not None}
    rows = docs.select(
        row, *[given.get(k, none).cast("string").alias(k) for k in hints], F.coalesce(text.cast("string"), F.lit("")).alias("text")
    )
    rows = _text_scores(rows, model)
    rows = rows.withColumn("best", F.when(F.col("triples") > 0, _place(F.col("likelihood"))))
    if given:
        rows = materialize(rows)
    names, shares = F.array(*[F.lit(x) for x in languages]), F.array(*[F.lit(float(x)) for x in model.shares])
    for key in given:
        rows = rows.join(materialize(_counts(rows.select(key, "best"), key, n, f"{key}_n")), key, "left")
    own = F.transform(names, lambda _, i: F.when(F.col("best") == i + 1, 1.0).otherwise(0.0))

    def others(key: str) -> Column:
        """The counts of a key without the row itself."""
        none_yet = F.transform(names, lambda _: F.lit(0.0))
        return F.coalesce(F.zip_with(f"{key}_n", own, lambda a, b: a - b), none_yet)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)

    prior = shares
    for key in ("domain", "host"):
        if key in given:
            counts = others(key)
            prior = F.zip_with(counts, prior, lambda c, p: c + _PARENT * p)
            rows = rows.withColumn(f"{key}_p", prior).withColumn(f"{key}_s", total(F.col(f"{key}_p")))
            size = F.col(f"{key}_s")
            prior = F.transform(f"{key}_p", lambda p: p / size)
    logs = F.zip_with(F.transform("likelihood", lambda x: x * _TEMPER), prior, lambda a, p: a + F.log(p))
    for key in ("declared", "suffix"):
        if key in given:
            # how often texts of each language come with this hint: its counts over the language's, with a hint of its own
            hint = F.lower(F.col(key))
            like = F.transform(names, lambda x: F.when(hint == x, _AGREE).otherwise(1.0))
            weight = F.zip_with(others(key), like, lambda c, a: c + a)
            share = F.zip_with(weight, shares, lambda w, p: F.log(w) - F.log(p * 100.0 + 1.0))
            logs = F.when(F.col(key).isNull(), logs).otherwise(F.zip_with(logs, share, lambda a, b: a + b))
    rows = rows.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    rows = rows.withColumn("sum", F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    confidence = 1.0 / F.col("sum")
    return rows.select(
        *out, F.get(names, _place(F.col("logs")) - 1).alias("language"), confidence.alias("confidence"),
        ((F.col("triples") == 0) | (confidence < least)).alias("rejected"),
    )


def page_parts(html: Column, url: Column) -> dict[str, Column]:
    """Text, declared language, host, domain and address suffix of a web page; null where it has none."""
    body = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>|&#?\w+;", " ")
    host = F.nullif(F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    return {
        "text": body,
        "declared": F.nullif(F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1)), F.lit("")),
        "host": host,
        "domain": F.substring_index(host, ".", -2),
        "suffix": F.substring_index(host, ".", -1),
    }
