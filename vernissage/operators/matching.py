"""Artist names against an authority list: equal, same tokens, then fuzzy.

The work is done once per distinct name and joined back to the catalog. The
fuzzy tier is an equi-join on short pieces of the strings, never a nested loop:
two close strings keep most of their pieces, so if each of them lists its rarest
ones, a few more than a match can lose, the two lists have one in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vernissage.functions import similarity, text
from vernissage.operators.skew import skewed_join
from vernissage.schema import ARTIST_THRESHOLD, INGEST_THRESHOLD, UNKNOWN_ARTIST
from vernissage.session import materialize, wide

TIER_EXACT, TIER_TOKENS, TIER_FUZZY = 1, 2, 3


def prepare_names(names: DataFrame, column: str) -> DataFrame:
    """Distinct names with their normal form, token set and sorted tokens; blank forms dropped."""
    return (
        names.select(F.col(column).alias("name"))
        .distinct()
        .withColumn("norm", text.normalize_name("name"))
        .filter(F.col("norm") != "")
        .withColumn("tokens", text.token_set("norm"))
        .withColumn("sorted", text.sorted_tokens("norm"))
    )


def _first_by(prepared: DataFrame, key: str) -> DataFrame:
    return prepared.groupBy(key).agg(F.min("name").alias("canonical"))


def match_exact(names: DataFrame, authority: DataFrame) -> DataFrame:
    """Names whose normal form equals an authority name's; both sides prepared."""
    return names.join(_first_by(authority, "norm"), "norm").select("name", "canonical")


def match_token_set(names: DataFrame, authority: DataFrame) -> DataFrame:
    """Names whose set of tokens equals an authority name's; both sides prepared."""
    return names.join(_first_by(authority, "tokens"), "tokens").select("name", "canonical")


def _slack(threshold: int) -> int:
    """Allowed edits per character in 1/200ths: score >= t means edits <= slack * L / 200."""
    if not 0 < threshold <= 100:
        raise ValueError("a score threshold lies in 1..100")
    return 201 - 2 * threshold


#: Counters that tell how rare a piece is; pieces that share one count as equally rare.
_COUNTERS = 1 << 14
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _width(slack: int) -> int:
    """Characters of a piece: as many as leave each string two fifths of its pieces."""
    return max(1, min(4, int(60 / slack + 0.5)))


def _lost(length: np.ndarray, slack: int, width: int) -> np.ndarray:
    """The most pieces of a string that can be missing from a string it matches.

    A match of strings of lengths ``m`` and ``n`` takes ``x`` characters from the first and puts ``y`` in, with
    ``x + y <= slack * (m + n) / 200`` and ``x - y = m - n``; that destroys ``width * x + (width - 1) * y`` pieces at most.
    Without rounding this is linear in ``n``, so it is largest at one end of the lengths that can match: where all edits
    take characters out, or all put them in.
    """
    out, put = 2 * slack * length / (200 + slack), 2 * slack * length / (200 - slack)
    return np.floor(np.maximum(width * out, (width - 1) * put) + 1e-9).astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(_ODD[1])
    return x ^ (x >> np.uint64(29))


def string_pieces(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all pieces of ``width`` characters of each text, edges included, with the text's number; and the lengths.

    A piece that occurs several times in a text is told apart by how many there were before it.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    edge = "\x00" * (width - 1)
    points = np.frombuffer((edge + edge.join(texts) + edge if texts else "").encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    count = lengths + width - 1
    if width == 1:
        count, owner = lengths, np.repeat(np.arange(len(texts)), lengths)
        value = _mix(points * np.uint64(_ODD[0]))
    else:
        owner = np.repeat(np.arange(len(texts)), count)
        start = np.arange(len(owner))  # texts and edges follow each other, so every start is the start of a piece
        value = np.zeros(len(owner), np.uint64)
        for j in range(width):
            value = value * np.uint64(_ODD[0]) + points[start + j]
        value = _mix(value)
    order = np.lexsort((value, owner))
    new = np.ones(len(order), bool)
    new[1:] = (value[order][1:] != value[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    first = np.flatnonzero(new)
    nth = np.empty(len(order), np.int64)
    nth[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return np.where(nth > 0, _mix(value + nth.astype(np.uint64) * np.uint64(_ODD[2])), value), owner, lengths


def _rare_pieces(texts: list[str], slack: int, width: int, counters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rarest pieces of each text, one more than a match can lose, and the text's number."""
    pieces, owner, lengths = string_pieces(texts, width)
    order = np.lexsort((pieces, counters[(pieces & np.uint64(_COUNTERS - 1)).astype(np.int64)], owner))
    owner, pieces = owner[order], pieces[order]
    first = np.searchsorted(owner, np.arange(len(texts)))
    take = np.arange(len(owner)) - first[owner] <= _lost(lengths, slack, width)[owner]
    return pieces[take], owner[take]


def _counters(forms: DataFrame, column: str, width: int) -> np.ndarray:
    """How often the pieces of all forms fall on each counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_COUNTERS, np.int64)
        for batch in batches:
            pieces = string_pieces(batch.column(0).to_pylist(), width)[0]
            total += np.bincount((pieces & np.uint64(_COUNTERS - 1)).astype(np.int64), minlength=_COUNTERS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["counter", "n"])

    found = forms.select(column).mapInArrow(run, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(_COUNTERS, np.int64)
    out[found.column("counter").to_numpy()] = found.column("n").to_numpy()
    return out


def with_rare_pieces(forms: DataFrame, column: str, slack: int, width: int, counters: np.ndarray) -> DataFrame:
    """A row ``column, piece`` for each of the rarest pieces of every form: linear in its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, owner = _rare_pieces(batch.column(0).to_pylist(), slack, width, counters)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(pieces.view(np.int64))], [column, "piece"])

    return forms.select(column).mapInArrow(run, f"{column} string, piece bigint")


def fuzzy_candidates(names: DataFrame, authority: DataFrame, threshold: int) -> DataFrame:
    """Pairs of sorted-token strings that may reach ``threshold``; a superset without a loss.

    Columns ``sorted`` and ``other``. Strings meet by their rarest pieces; the order from rare to frequent is the same for
    both sides. Length and edit-distance guards run in the JVM, so only near misses and matches go on to be scored.
    """
    slack = _slack(threshold)
    width = _width(slack)
    forms = materialize(wide(names.select("sorted"), "sorted").distinct())
    others = materialize(authority.select(F.col("sorted").alias("other")).distinct())
    counters = _counters(others, "other", width) + _counters(forms, "sorted", width)
    probes = with_rare_pieces(forms, "sorted", slack, width, counters)
    index = materialize(with_rare_pieces(others, "other", slack, width, counters))
    edits = f"int(({slack} * (length(sorted) + length(other))) div 200)"
    return (
        skewed_join(probes, index, "piece", F.col("sorted"), right_spread=F.col("other"))
        .filter(F.expr(f"abs(length(sorted) - length(other)) <= {edits}"))
        .filter(F.expr(f"levenshtein(sorted, other, {edits}) >= 0"))
        .select("sorted", "other")
        .distinct()
    )


def match_fuzzy(names: DataFrame, authority: DataFrame, threshold: int = ARTIST_THRESHOLD) -> DataFrame:
    """All (name, canonical, score) pairs with a token-sort score of at least ``threshold``."""
    scored = (
        fuzzy_candidates(names, authority, threshold)
        .withColumn("score", similarity.indel_ratio("sorted", "other"))
        .filter(F.col("score") >= threshold)
    )
    canon = authority.select(F.col("sorted").alias("other"), F.col("name").alias("canonical"))
    return scored.join(canon, "other").join(names.select("name", "sorted"), "sorted").select("name", "canonical", "score")


def best_matches(names: DataFrame, authority: DataFrame, threshold: int = INGEST_THRESHOLD) -> DataFrame:
    """One row per matched name: the best of (tier, highest score, first name).

    ``names`` and ``authority`` are prepared. Names settled by equality or by
    token set never enter the fuzzy tier.
    """
    settled = materialize(
        names.join(_first_by(authority, "norm").withColumnRenamed("canonical", "c1"), "norm", "left")
        .join(_first_by(authority, "tokens").withColumnRenamed("canonical", "c2"), "tokens", "left")
        .select("name", "norm", "sorted", "c1", "c2")
    )
    direct = settled.filter("c1 is not null or c2 is not null").select(
        "name",
        F.coalesce("c1", "c2").alias("canonical"),
        F.when(F.col("c1").isNotNull(), TIER_EXACT).otherwise(TIER_TOKENS).alias("tier"),
        F.lit(100).alias("score"),
    )
    open_names = settled.filter("c1 is null and c2 is null")
    # equal sorted tokens give equal scores: choose the canonical name once per form
    forms = authority.groupBy(F.col("sorted").alias("other")).agg(F.min("name").alias("canonical"))
    scored = (
        fuzzy_candidates(open_names, authority, threshold)
        .withColumn("score", similarity.indel_ratio("sorted", "other"))
        .filter(F.col("score") >= threshold)
        .join(forms, "other")
        .groupBy("sorted")
        .agg(F.min(F.struct((-F.col("score")).alias("neg"), "canonical")).alias("best"))
    )
    fuzzy = open_names.join(scored, "sorted").select(
        "name",
        F.col("best.canonical").alias("canonical"),
        F.lit(TIER_FUZZY).alias("tier"),
        (-F.col("best.neg")).alias("score"),
    )
    return direct.unionByName(fuzzy)


def authority_filter(
    catalog: DataFrame,
    authority: DataFrame,
    threshold: int = INGEST_THRESHOLD,
    artist: str = "artist",
    spread: str = "idx",
) -> DataFrame:
    """Catalog rows whose artist matches the authority, with ``canonical`` added.

    An empty authority lets every row through under its own name. ``authority``
    has a ``name`` column. A missing artist counts as ``Unknown``.
    """
    named = catalog.withColumn("_raw", text.or_default(artist, UNKNOWN_ARTIST))
    if authority.isEmpty():
        return named.withColumn("canonical", text.title_case("_raw")).drop("_raw")
    known = materialize(prepare_names(authority, "name"))
    found = best_matches(prepare_names(named, "_raw"), known, threshold)
    mapping = materialize(
        found.select(F.col("name").alias("_raw"), text.title_case("canonical").alias("canonical"))
    )
    return skewed_join(named, mapping, "_raw", F.col(spread)).drop("_raw")
