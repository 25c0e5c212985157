"""Fuzzy title join: equal normal forms, or a high whole or partial similarity.

Candidates come from an equi-join on short pieces. If a title matches a longer
one, wholly or in a window, at most so many of its pieces do not occur there; so
of one more than that, the rarest it has, at least one stands in the other, which
lists all of its own. No piece is dropped for being frequent; hot pieces are
salted. Pairs then pass a bit-mask test before they are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vernissage.functions import similarity, text
from vernissage.operators.matching import _COUNTERS, _lost, _mix, _slack, string_pieces
from vernissage.operators.skew import skewed_join
from vernissage.schema import TITLE_THRESHOLD
from vernissage.session import materialize, wide

_WIDEST = 4


def _widths(lengths: np.ndarray, slack: int) -> np.ndarray:
    """Characters of a title's pieces: as many as leave it a fifth of its pieces; single ones are always left."""
    chosen = np.ones(len(lengths), np.int64)
    for width in range(2, _WIDEST + 1):
        left = lengths - width + 1 - _lost(lengths, slack, width)
        chosen[left >= np.maximum(1, lengths // 5)] = width
    return chosen


def _pieces(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of ``width`` characters of each text, without its edges, and the text's number; and the lengths."""
    pieces, owner, lengths = string_pieces(texts, width)
    at = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(texts)))[owner] if len(owner) else owner
    inner = (at >= width - 1) & (at < lengths[owner])
    return _mix(pieces[inner] ^ np.uint64(width)), owner[inner], lengths


def _used(slack: int) -> list[int]:
    """The widths that titles of any length take; beyond some length it is one."""
    return sorted(set(_widths(np.arange(1, 400), slack).tolist()))


def _counters(forms: DataFrame, widths: list[int]) -> np.ndarray:
    """How often the pieces of all forms fall on each counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_COUNTERS, np.int64)
        for batch in batches:
            for width in widths:
                pieces = _pieces(batch.column(0).to_pylist(), width)[0]
                total += np.bincount((pieces & np.uint64(_COUNTERS - 1)).astype(np.int64), minlength=_COUNTERS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["counter", "n"])

    found = forms.select("norm").mapInArrow(run, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(_COUNTERS, np.int64)
    out[found.column("counter").to_numpy()] = found.column("n").to_numpy()
    return out


def _asked(forms: DataFrame, slack: int, counters: np.ndarray) -> DataFrame:
    """``norm, piece`` for the rarest pieces of every form: one more than a match can lose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = np.array(batch.column(0).to_pylist(), object)
            chosen = _widths(np.array([len(t) for t in texts], np.int64), slack)
            for width in np.unique(chosen).tolist():
                mine = np.flatnonzero(chosen == width)
                pieces, owner, lengths = _pieces(texts[mine].tolist(), width)
                order = np.lexsort((pieces, counters[(pieces & np.uint64(_COUNTERS - 1)).astype(np.int64)], owner))
                pieces, owner = pieces[order], owner[order]
                at = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(mine)))[owner]
                take = at <= _lost(lengths, slack, width)[owner]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(mine[owner[take]])), pa.array(pieces[take].view(np.int64))], ["norm", "piece"]
                )

    return forms.select("norm").mapInArrow(run, "norm string, piece bigint")


def _listed(forms: DataFrame, widths: list[int]) -> DataFrame:
    """``norm, piece`` for all pieces of every form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width in widths:
                pieces, owner, _ = _pieces(batch.column(0).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(pieces.view(np.int64))], ["norm", "piece"])

    return forms.select("norm").mapInArrow(run, "norm string, piece bigint")


_MASKS = 4


def _with_masks(forms: DataFrame) -> DataFrame:
    """Add ``m0..m3``: which of 252 hash buckets hold a pair of neighbouring characters of ``norm``."""
    bits = 63 * _MASKS
    pairs = "transform(sequence(1, length(norm) - 1), p -> int(pmod(xxhash64(substring(norm, p, 2)), {})))".format(bits)
    slots = forms.withColumn("_b", F.when(F.length("norm") > 1, F.array_distinct(F.expr(pairs))).otherwise(F.array().cast("array<int>")))
    masks = {
        f"m{i}": F.expr(
            f"aggregate(filter(_b, b -> b div 63 = {i}), 0L, (s, b) -> s | shiftleft(1L, int(b - {63 * i})))"
        )
        for i in range(_MASKS)
    }
    return slots.withColumns(masks).drop("_b")


def _near(slack: int) -> str:
    """Whether enough neighbour pairs of ``a`` also occur in ``b`` (SQL, bit operations only).

    A match damages at most ``4 * slack * m / (200 + slack)`` of the pairs of the
    shorter title: two for each character it loses, one for each that is put in.
    Every other pair stands in ``b``, so no more buckets than that can be missing.
    """
    missing = " + ".join(f"bit_count(m{i} & ~w{i})" for i in range(_MASKS))
    return f"{missing} <= int((4 * {slack} * length(a)) div {200 + slack})"


def title_candidates(short: DataFrame, long: DataFrame, slack: int, strict: bool) -> DataFrame:
    """Candidate (a, b) with ``a`` from ``short`` no longer than ``b`` from ``long``; both have ``norm`` and masks."""
    widths = _used(slack)
    short, long = materialize(wide(short, "norm")), materialize(wide(long, "norm"))
    counters = _counters(long, widths)
    asked = _asked(short, slack, counters).withColumnRenamed("norm", "a")
    listed = materialize(_listed(long, widths).withColumnRenamed("norm", "b"))
    size = "length(a) < length(b)" if strict else "length(a) <= length(b)"
    pairs = skewed_join(asked, listed, "piece", F.col("a"), right_spread=F.col("b")).filter(size).select("a", "b").distinct()
    own = [f"m{i}" for i in range(_MASKS)]
    pairs = pairs.join(short.select(F.col("norm").alias("a"), *own), "a")
    pairs = pairs.join(long.select(F.col("norm").alias("b"), *[F.col(m).alias(f"w{i}") for i, m in enumerate(own)]), "b")
    return pairs.filter(_near(slack)).select("a", "b")


def match_title_forms(left: DataFrame, right: DataFrame, threshold: int = TITLE_THRESHOLD) -> DataFrame:
    """Matching pairs (a, b, score) of distinct normal forms in column ``norm``."""
    slack = _slack(threshold)
    equal = left.join(right, "norm").select(F.col("norm").alias("a"), F.col("norm").alias("b"), F.lit(100).alias("score"))
    lefts, rights = materialize(_with_masks(left)), materialize(_with_masks(right))
    forth = title_candidates(lefts, rights, slack, strict=False)
    back = title_candidates(rights, lefts, slack, strict=True).select(F.col("b").alias("a"), F.col("a").alias("b"))
    fuzzy = (
        forth.unionByName(back)
        .filter("a != b")
        .withColumn("score", similarity.sequence_score("a", "b"))
        .filter(F.col("score") >= threshold)
    )
    return equal.unionByName(fuzzy)


def match_titles(left: DataFrame, right: DataFrame, threshold: int = TITLE_THRESHOLD) -> DataFrame:
    """Matching pairs (left_title, right_title, score) of distinct titles in column ``title``."""

    def forms(df: DataFrame) -> DataFrame:
        named = df.select("title").distinct().withColumn("norm", text.normalize_title("title"))
        return materialize(named.filter("norm != ''"))

    lefts, rights = forms(left), forms(right)
    pairs = match_title_forms(lefts.select("norm").distinct(), rights.select("norm").distinct(), threshold)
    return (
        pairs.join(lefts.select(F.col("norm").alias("a"), F.col("title").alias("left_title")), "a")
        .join(rights.select(F.col("norm").alias("b"), F.col("title").alias("right_title")), "b")
        .select("left_title", "right_title", "score")
    )
