"""Hard negatives for labelled vectors, from exact integer products that are packed into wide integers."""

from __future__ import annotations

from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vernissage.llm.common import named
from vernissage.session import materialize

#: Candidates whose components share one wide integer.
_FIELDS = 2048


def packed_products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The exact inner products of integer vectors, ``len(anchors)`` by ``len(rows)``.

    Biased to be non-negative, the k-th components of many rows stand in separate fields of one wide integer, each field
    wide enough for a whole product. Each component of an anchor is multiplied once with that integer; the sum over the
    components then holds the products of all those rows side by side, less a bias that is known.
    """
    n, width = len(rows), rows.shape[1]
    out = np.zeros((len(anchors), n), np.int64)
    if not out.size or not width:
        return out
    bias_a, bias_r = max(0, -int(anchors.min())), max(0, -int(rows.min()))
    largest = width * (int(anchors.max()) + bias_a) * (int(rows.max()) + bias_r)
    if largest >= 1 << 63:
        raise ValueError("inner products of these vectors go beyond 64 bits")
    size = 4 if largest < 1 << 32 else 8
    factors = (anchors + bias_a).tolist()
    known = bias_r * anchors.sum(axis=1)[:, None] + bias_a * rows.sum(axis=1)[None, :] + width * bias_a * bias_r
    fields = np.ascontiguousarray((rows + bias_r).T).astype(f"<u{size}")
    for at in range(0, n, _FIELDS):
        wide = [int.from_bytes(f.tobytes(), "little") for f in fields[:, at : at + _FIELDS]]
        count = min(_FIELDS, n - at)
        for i, factor in enumerate(factors):
            total = sum(map(mul, factor, wide))
            out[i, at : at + count] = np.frombuffer(total.to_bytes(size * count, "little"), f"<u{size}")
    return out - known


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of integers as rows; a shorter one ends with zeros."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def _first(score: np.ndarray, ids: np.ndarray, which: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``which``, the ``k`` with the highest scores, ties by smaller identifier, in order."""
    if len(which) > k:
        own = score[which]
        which = which[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return which[np.lexsort((ids[which], -score[which]))][:k]


def _tile_rows(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    tiles = max(1, -(-rows.count() // size))
    return rows.withColumn("tile", F.pmod(F.xxhash64("n"), F.lit(tiles)).cast("int")), tiles


def _meet(anchors: DataFrame, rows: DataFrame, run, schema: str, tile_rows: int, tile_anchors: int) -> DataFrame:
    """Every tile of anchors with every tile of rows, each pair as one piece of work."""
    (left, left_tiles), (right, right_tiles) = _tile_rows(anchors, tile_anchors), _tile_rows(rows, tile_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumnRenamed("tile", "mine").withColumn("other", every(right_tiles))
    right = right.withColumnRenamed("tile", "other").withColumn("mine", every(left_tiles))
    return left.groupBy("mine", "other").cogroup(right.groupBy("mine", "other")).applyInArrow(run, schema)


def hard_negatives(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256,
    positives: int = 5, negatives: int = 5, least_percent: int = 80, most_percent: int = 100, tile_rows: int = 4096,
    tile_anchors: int = 1024,
) -> DataFrame:
    """For each anchor and each of its positives, the rows of another label that score nearly as high.

    Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. Components are scaled and rounded
    down to integers; a score is the integer inner product with the anchor, in exact arithmetic. Higher scores come first,
    ties by smaller identifier. An anchor's positives are its first ``positives`` other rows of the same label; the
    negatives of a positive are the first ``negatives`` rows of other labels whose score lies between ``least_percent`` and
    ``most_percent`` per cent of the positive's, ends included, so none if that is below zero.

    Anchors (rows for which the condition ``anchors`` holds) meet all rows in tiles of bounded size, dealt by row, so a
    label that most rows have does no harm. A tile passes on its best rows per anchor alone.

    Rows with a null identifier, label or vector, or with a null or non-finite component, take no part. Vectors of different
    lengths are compared as if the shorter ended with zeros. Rows that share an identifier are rows of their own, and only
    the anchor's own row is left out. An empty table gives an empty result. Products beyond 64 bits are an error. Other
    columns are not read, whatever their names.
    """
    vec = named(vec_col)
    whole = F.forall(vec, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    used = rows.filter(named(id_col).isNotNull() & named(label_col).isNotNull() & vec.isNotNull() & whole)
    label = named(label_col)
    if dict(rows.dtypes)[label_col] not in ("tinyint", "smallint", "int", "bigint"):
        label = label.cast("string")
    values = F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    stored = used.select(
        F.monotonically_increasing_id().alias("n"), named(id_col).cast("bigint").alias("id"), label.alias("label"), values.alias("v"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )
    stored = materialize(stored)
    width = stored.agg(F.max(F.size("v"))).first()[0] or 0
    kind = dict(stored.dtypes)["label"]
    asked, others = stored.filter("anchor").drop("anchor"), stored.drop("anchor")

    def unpacked(left: pa.Table, right: pa.Table) -> tuple:
        columns = [t.column(c).to_numpy() for t in (left, right) for c in ("n", "id", "label")]
        return *columns, packed_products(_matrix(left.column("v"), width), _matrix(right.column("v"), width))

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            ns, _, labels, row_ns, ids, row_labels, scores = unpacked(left, right)
            for i, (n, own) in enumerate(zip(ns, labels)):
                best = _first(scores[i], ids, np.flatnonzero((row_labels == own) & (row_ns != n)), positives)
                found.append((np.full(len(best), n), ids[best], scores[i][best]))
        found = [np.concatenate(x) for x in zip(*found)] or [np.zeros(0, np.int64)] * 3
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("n", "id", "score"), found)})

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            ns, own_ids, labels, _, ids, row_labels, scores = unpacked(left, right)
            for i, wanted in enumerate(left.column("positives")):
                other = np.flatnonzero(row_labels != labels[i])
                score = scores[i][other]
                for p in wanted.as_py():
                    low, high = -(-least_percent * p["score"] // 100), most_percent * p["score"] // 100
                    best = _first(scores[i], ids, other[(score >= low) & (score <= high)], negatives)
                    found.append((*(np.full(len(best), x) for x in (ns[i], own_ids[i], p["rank"], p["id"], p["score"])), ids[best], scores[i][best]))
        names = ("n", "anchor_id", "nth", "positive_id", "positive_score", "negative_id", "negative_score")
        found = [np.concatenate(x) for x in zip(*found)] or [np.zeros(0, np.int64)] * len(names)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(names, found)})

    first = _meet(asked, others, find_positives, "n bigint, id bigint, score bigint", tile_rows, tile_anchors)
    place = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "id"))
    first = first.withColumn("rank", place).filter(F.col("rank") <= positives)
    first = first.groupBy("n").agg(F.collect_list(F.struct("rank", "id", "score")).alias("positives"))  # few for each anchor
    asked = materialize(asked.join(first, "n").select("n", "id", F.col("label").cast(kind).alias("label"), "v", "positives"))
    schema = "n bigint, anchor_id bigint, nth bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    found = _meet(asked, others, find_negatives, schema, tile_rows, tile_anchors)
    place = F.row_number().over(Window.partitionBy("n", "nth").orderBy(F.desc("negative_score"), "negative_id"))
    found = found.withColumn("rank", place).filter(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
