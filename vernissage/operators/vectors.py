"""Nearest stored vector for many queries at once.

Scores come from matrix products on Arrow batches. Few queries travel to the stored
rows, which are scanned where they lie; more of them meet the rows in tiles of
bounded size. A task keeps only its best rows per query, and only those are
shuffled. Signatures close to one another meet by equal or nearly equal parts of theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from vernissage.session import has_at_most, materialize

PROBE_BYTES = 64 << 20
#: Queries of :func:`nearest` that travel through the driver, at most; more meet the rows in tiles.
SCAN_BYTES = 8 << 20
#: Vectors on either side of a tile, at most.
TILE_BYTES = 32 << 20
TILE_QUERIES = 1024
TILE_ROWS = 8192
SIGNATURE_BITS = 32
#: Hits that a task piles up before it keeps the best of them.
_PILE = 1 << 19
#: Pairs that are scored in double precision at once.
_PAIRS = 1 << 16
_HITS = "qid string, id string, score double"

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a 2-D array, a number column as one column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False).reshape(-1, 1)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1.0)


def cosine(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of every query with every row, to six places."""
    return np.round(unit(queries) @ unit(rows).T, 6) + 0.0


def hamming(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Minus the number of differing bits of signatures, summed over their words."""
    if queries.shape[1] > 1 and len(queries) and len(rows) and max(queries.max(), rows.max()) < 1 << 32 and min(queries.min(), rows.min()) >= 0:
        queries, rows = _paired(queries), _paired(rows)
    differ = np.zeros((len(queries), len(rows)), np.uint16)
    for word in range(queries.shape[1]):
        differ += np.bitwise_count(queries[:, word, None] ^ rows[None, :, word])
    return -differ.astype(np.float32)


def _paired(words: np.ndarray) -> np.ndarray:
    """Two 32-bit words in each 64-bit one."""
    if words.shape[1] % 2:
        words = np.column_stack([words, np.zeros(len(words), words.dtype)])
    words = words.astype(np.uint64)
    return words[:, ::2] | words[:, 1::2] << np.uint64(32)


def signature(vec: Column | str) -> Column:
    """Signs of all components as bits: an array with one bigint for every ``SIGNATURE_BITS`` of them."""
    vec = F.col(vec) if isinstance(vec, str) else vec
    bits = F.transform(vec, lambda x: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    starts = F.sequence(F.lit(1), F.greatest(F.size(vec), F.lit(1)), F.lit(SIGNATURE_BITS))
    # highest component first, so that component i ends up at bit i of its word
    word = lambda at: F.aggregate(F.reverse(F.slice(bits, at, SIGNATURE_BITS)), F.expr("0L"), lambda acc, b: acc * 2 + b)
    return F.transform(starts, word)


def coded(ids: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Ids as numbers in their order, and the ids by number."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    listed = ids.dictionary_encode()
    order = pc.sort_indices(listed.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[listed.indices.to_numpy()], listed.dictionary.take(pa.array(order))


def _best(q: np.ndarray, codes: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best (highest score, then lowest id) different ids of every query."""
    order = np.lexsort((codes, -score, q))
    if len(order):  # an id counts once, with its best score
        pair = q[order].astype(np.int64) * (int(codes.max()) + 1) + codes[order]
        order = order[np.sort(np.unique(pair, return_index=True)[1])]
    q = q[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[place < k]


class Pile:
    """The best stored ids per query so far, over blocks of rows with ids of their own."""

    def __init__(self, kernel: Kernel, k: int) -> None:
        self.kernel, self.k, self.parts, self.size = kernel, k, [], 0

    def add(self, queries: np.ndarray, which: np.ndarray, rows: np.ndarray, codes: np.ndarray, names: pa.Array) -> None:
        """Compare the queries at ``which`` with ``rows``, whose ids are ``names`` by ``codes``."""
        if not len(rows) or not len(which):
            return
        # an id may be listed several times: look so much further that k different ones are certain
        most = self.k * int(np.bincount(codes).max())
        for start in range(0, len(rows), TILE_ROWS):
            stop = min(start + TILE_ROWS, len(rows))
            for left in range(0, len(which), TILE_QUERIES):
                self._tile(queries, which[left : left + TILE_QUERIES], rows[start:stop], codes[start:stop], names, most)

    def _tile(self, queries, at, rows, codes, names, most) -> None:
        scores = self.kernel(queries[at], rows)
        if scores.shape[1] > most:
            floor = np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most]
            qi, ri = np.nonzero(scores >= floor[:, None])  # ties kept, settled by id
        else:
            qi, ri = np.nonzero(np.ones_like(scores, dtype=bool))
        score = scores[qi, ri].astype(np.float64)
        keep = _best(at[qi], codes[ri], score, self.k)
        self.parts.append((at[qi[keep]], names.take(pa.array(codes[ri[keep]])), score[keep]))
        self.size += len(keep)
        if self.size > _PILE and len(self.parts) > 1:
            self._merge()

    def _merge(self) -> None:
        q, score = (np.concatenate([p[i] for p in self.parts]) for i in (0, 2))
        ids = pa.concat_arrays([p[1] for p in self.parts])
        keep = _best(q, coded(ids)[0], score, self.k)
        self.parts, self.size = [(q[keep], ids.take(pa.array(keep)), score[keep])], len(keep)

    def hits(self, names: pa.Array) -> pa.Table:
        """(qid, id, score) of what is left; ``names`` are the queries' ids."""
        if not self.parts:
            return pa.table({"qid": pa.array([], pa.string()), "id": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        if len(self.parts) > 1:
            self._merge()
        q, ids, score = self.parts[0]
        return pa.table({"qid": names.take(pa.array(q)), "id": ids, "score": pa.array(score)})


def _scan(names: pa.Array, queries: np.ndarray, by_cell: dict | None, kernel: Kernel, k: int):
    """A pass over stored rows that keeps the best per query of a whole partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everyone, pile = np.arange(len(names)), Pile(kernel, k)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, (codes, ids) = matrix(batch.column("key")), coded(batch.column("id"))
            if by_cell is None:
                pile.add(queries, everyone, rows, codes, ids)
                continue
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            for cell in np.unique(cells):
                which = by_cell.get(int(cell))
                if which is not None:
                    mine = cells == cell
                    pile.add(queries, which, rows[mine], codes[mine], ids)
        yield from pile.hits(names).to_batches()

    return run


def best_hits(hits: DataFrame, k: int) -> DataFrame:
    """The k best of hits that tasks have found: (qid, id, score, rank)."""
    if k == 1:
        # highest score, then lowest id, with partial aggregation in every task
        best = F.min(F.struct((-F.col("score")).alias("neg"), "id")).alias("best")
        return hits.groupBy("qid").agg(best).select(
            "qid", F.col("best.id").alias("id"), (F.lit(0.0) - F.col("best.neg")).alias("score"), F.lit(1).alias("rank")
        )
    place = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    hits = hits.groupBy("qid", "id").agg(F.max("score").alias("score"))
    return hits.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def slice_rows(width: int, probe_bytes: int = PROBE_BYTES) -> int:
    """How many queries of ``width`` components travel to the stored rows at once."""
    return max(TILE_QUERIES, probe_bytes // (8 * width + 64))  # 64 bytes stand for the id and its cells


def scan_hits(asked: pa.Table, rows: DataFrame, kernel: Kernel, k: int) -> DataFrame:
    """One pass over ``rows`` with a slice of queries (``qid``, ``key``, with or without ``cell``): the best of every task."""
    by_cell = None
    if "cell" in asked.column_names:
        cells = asked.column("cell").to_numpy()
        by_cell = {int(c): np.flatnonzero(cells == c) for c in np.unique(cells)}
        rows = rows.filter(F.col("cell").isin(list(by_cell)))
    names = asked.column("qid").combine_chunks()
    return rows.mapInArrow(_scan(names, matrix(asked.column("key")), by_cell, kernel, k), _HITS)


def _closest(asked: np.ndarray, rows: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries by place, ids by code and cosines: for each of ``asked`` the k best different ids of ``rows``.

    Single precision rules out what is clearly below the k-th best so far; what is left is scored in double precision.
    """
    asked, rows = unit(asked), unit(rows)
    # of equal vectors no more than the k lowest ids can be an answer
    _, same = np.unique(rows.view(f"V{rows.strides[0]}").ravel(), return_inverse=True)
    kept = np.sort(_best(same, codes, np.zeros(len(rows)), k))
    rows, codes = rows[kept], codes[kept]
    small = rows.astype(np.float32)
    slack = np.float32(1e-6 + 1.2e-7 * (rows.shape[1] + 4))  # rounding, and the error of a product in single precision
    most = k * int(np.bincount(codes).max())
    down, across = max(1, TILE_QUERIES // 2), max(1, TILE_ROWS // 2)  # products that stay in the cache
    room, found = np.empty(down * across, np.float32), []
    for left in range(0, len(asked), down):
        mine = asked[left : left + down]
        rough, bar = mine.astype(np.float32), np.full(len(mine), -np.inf, np.float32)
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

        def merge() -> None:
            q, code, score = (np.concatenate(x) for x in zip(*parts))
            keep = _best(q, code, score, k)
            q, score = q[keep], score[keep]
            parts[:] = [(q, code[keep], score)]
            last = np.flatnonzero(np.r_[q[1:] != q[:-1], True]) if len(q) else np.zeros(0, np.int64)
            full = last[np.diff(np.r_[-1, last]) == k]
            bar[q[full]] = score[full].astype(np.float32) - slack

        for start in range(0, len(rows), across):
            these = small[start : start + across]
            products = room[: len(mine) * len(these)].reshape(len(mine), len(these))
            np.matmul(rough, these.T, out=products)
            floor = bar
            if products.shape[1] > most and np.isneginf(bar).any():
                floor = np.maximum(bar, np.partition(products, -most, axis=1)[:, -most] - 2 * slack)
            at = np.flatnonzero(products >= floor[:, None])
            for first in range(0, len(at), _PAIRS):
                q, r = np.divmod(at[first : first + _PAIRS], products.shape[1])
                r += start
                parts.append((q, codes[r], np.round(np.einsum("ij,ij->i", mine[q], rows[r]), 6) + 0.0))
                if sum(len(p[0]) for p in parts) > max(_PAIRS, 4 * k * len(mine)):
                    merge()
            if np.isneginf(bar).any() or sum(len(p[0]) for p in parts) > 2 * k * len(mine):
                merge()
        merge()
        found.append((parts[0][0] + left, *parts[0][1:]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _meet(queries: DataFrame, rows: DataFrame, kernel: Kernel, k: int, width: int) -> DataFrame:
    """Every tile of queries with every tile of rows of its cell, each pair as one piece of work: the best of every piece.

    Tiles hold at most ``TILE_BYTES`` and are dealt row by row, so copies of an id or a vector do no harm.
    """
    if "cell" not in queries.columns:
        side = isqrt(4 * queries.sparkSession.sparkContext.defaultParallelism) + 1  # enough pieces for all cores
        queries, rows = queries.withColumn("cell", F.lit(0)), rows.withColumn("cell", F.lit(0))
    else:
        side = 1
    size = max(TILE_QUERIES, TILE_BYTES // (8 * width + 64))
    count = F.count("*")
    tiles = F.greatest(F.ceil(count / size), F.least(F.lit(side), F.ceil(count / TILE_QUERIES))).cast("int")
    left, right = (materialize(df.withColumn("n", F.monotonically_increasing_id())) for df in (queries, rows))
    grid = left.groupBy("cell").agg(tiles.alias("down")).join(right.groupBy("cell").agg(tiles.alias("across")), "cell")
    grid = F.broadcast(materialize(grid))  # one row for each cell
    deal = lambda n: F.pmod(F.xxhash64("n"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(grid, "cell").withColumn("i", deal("down")).withColumn("j", every("across")).select("cell", "i", "j", "qid", "key")
    right = right.join(grid, "cell").withColumn("j", deal("across")).withColumn("i", every("down")).select("cell", "i", "j", "id", "key")

    def run(asked: pa.Table, stored: pa.Table) -> pa.Table:
        pile = Pile(kernel, k)
        names = asked.column("qid").combine_chunks()
        if asked.num_rows and stored.num_rows:
            codes, ids = coded(stored.column("id"))
            wanted, kept = matrix(asked.column("key")), matrix(stored.column("key"))
            if kernel is cosine and all(np.isfinite(x).all() and np.isfinite((x * x).sum(axis=1)).all() for x in (wanted, kept)):
                q, code, score = _closest(wanted.astype(np.float64), kept.astype(np.float64), codes, k)
                return pa.table({"qid": names.take(pa.array(q)), "id": ids.take(pa.array(code)), "score": pa.array(score)})
            pile.add(wanted, np.arange(len(names)), kept, codes, ids)
        return pile.hits(names)

    keys = "cell", "i", "j"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, _HITS)


def nearest(
    queries: DataFrame,
    rows: DataFrame,
    k: int = 1,
    kernel: Kernel = cosine,
    probe_bytes: int = PROBE_BYTES,
    width: int | None = None,
) -> DataFrame:
    """The k best rows per query as (qid, id, score, rank).

    ``queries`` has ``qid`` and ``key``, ``rows`` has ``id`` and ``key``: a vector
    for :func:`cosine`, a signature for :func:`hamming`. With a ``cell`` column on
    both, a query meets only rows of its cells. Ties go to the lowest id.
    ``width`` is the number of components, looked up if not given. An id that is
    listed several times counts once, with its best score; so does a query that
    is asked with several vectors. Null keys and ids take no part.

    Queries of at most ``probe_bytes`` and ``SCAN_BYTES``, or ``TILE_QUERIES``
    of them, travel through the driver to the rows, which are neither moved nor
    written. More of them are dealt into tiles, as the rows are, and every tile
    of queries meets every tile of rows of its cell as one piece of work.
    """
    celled = "cell" in queries.columns
    columns = ["id", "key", "cell"] if celled else ["id", "key"]
    q = queries.filter(F.col("key").isNotNull()).select(["qid", *columns[1:]])
    r = rows.filter(F.col("key").isNotNull() & F.col("id").isNotNull()).select(columns)
    if width is None:
        first = q.select("key").first()
        if first is None:
            return q.sparkSession.createDataFrame([], _HITS + ", rank int")
        width = len(first["key"]) if isinstance(first["key"], list) else 1

    if not has_at_most(q, slice_rows(width, min(probe_bytes, SCAN_BYTES))):
        return best_hits(_meet(q, r, kernel, k, width), k)
    table = q.toArrow()
    if not table.num_rows:
        return q.sparkSession.createDataFrame([], _HITS + ", rank int")
    return best_hits(scan_hits(table, r, kernel, k), k)


def _flips(bits: int, most: int) -> list[int]:
    """All values of ``bits`` bits of which at most ``most`` are set."""
    return [sum(1 << b for b in chosen) for n in range(most + 1) for chosen in combinations(range(bits), n)]


def within_hamming(left: DataFrame, right: DataFrame, radius: int, words: int, chunk_bits: int | None = None) -> DataFrame:
    """Pairs of different signatures ``a`` and ``b`` that differ in at most ``radius`` bits, with their ``distance``.

    Both sides have a column ``sig`` of ``words`` words, each signature once. Signatures are cut into chunks of
    ``chunk_bits`` bits (16, 8 or 4: the widest that takes at most a few hundred look-ups). Among ``n`` chunks one differs in
    at most ``radius // n`` bits, so every signature is listed under all values near its chunks, the right up to half so many
    bits away and the left up to the rest: chunks so close meet in a value between them. No pair is lost, and only pairs
    that share such a value are compared, bit by bit in generated code.

    The lists are many times what they come from, which the planner does not see: they are never broadcast.
    """
    count = lambda bits: words * SIGNATURE_BITS // bits
    few = lambda bits: sum(comb(bits, n) for n in range(radius // count(bits) + 1)) <= 700
    chunk_bits = chunk_bits or next((bits for bits in (16, 8) if few(bits)), 4)
    far = radius // count(chunk_bits)
    mask = (1 << chunk_bits) - 1

    def keys(df: DataFrame, name: str, flips: list[int]) -> DataFrame:
        parts = [
            F.shiftrightunsigned(F.element_at("sig", word + 1), low).bitwiseAND(F.lit(mask)) + F.lit((word * SIGNATURE_BITS + low) << 32)
            for word in range(words) for low in range(0, SIGNATURE_BITS, chunk_bits)
        ]
        listed = df.select(F.col("sig").alias(name), F.explode(F.array(*parts)).alias("chunk"))
        if len(flips) == 1:
            return listed
        every = F.explode(F.array(*[F.lit(f).cast("bigint") for f in flips]))
        return listed.withColumn("flip", every).withColumn("chunk", F.col("chunk").bitwiseXOR(F.col("flip"))).drop("flip")

    bits = sum((F.bit_count(F.element_at("a", w + 1).bitwiseXOR(F.element_at("b", w + 1))) for w in range(words)), F.lit(0))
    # a pair may share several chunks: counted once or more, it stays one pair for a smallest distance
    listed = keys(right, "b", _flips(chunk_bits, far // 2)).hint("merge")
    pairs = keys(left, "a", _flips(chunk_bits, far - far // 2)).join(listed, "chunk").drop("chunk")
    return pairs.withColumn("distance", bits.cast("int")).filter(F.col("distance") <= radius)


def _distinct_signatures(df: DataFrame, name: str) -> DataFrame:
    usable = df.filter(F.col("sig").isNotNull() & F.col(name).isNotNull())
    return materialize(usable.groupBy("sig").agg(F.min(name).alias("id")))


def _words(*sides: DataFrame) -> int:
    """The number of words of the signatures, which is the same for all."""
    sizes = [row[0] for df in sides for row in df.select(F.size("sig")).distinct().limit(2).collect()]
    if len(set(sizes)) > 1:
        raise ValueError("signatures have different lengths")
    return sizes[0] if sizes else 0


def nearest_hamming(queries: DataFrame, rows: DataFrame, radius: int, chunk_bits: int | None = None) -> DataFrame:
    """The closest row of every query (``qid, sig``) within ``radius`` bits: (qid, id, distance); ties to the lowest id.

    ``rows`` have ``id`` and ``sig``. Equal signatures are compared once. Queries without a row so close are left out.
    """
    stored, asked = _distinct_signatures(rows, "id"), queries.filter(F.col("sig").isNotNull())
    forms = materialize(asked.select("sig").distinct())
    words = _words(forms, stored)
    if not words:
        return queries.sparkSession.createDataFrame([], "qid string, id string, distance int")
    pairs = within_hamming(forms, stored, radius, words, chunk_bits)
    pairs = pairs.join(stored.select(F.col("sig").alias("b"), "id").hint("merge"), "b")
    best = pairs.groupBy(F.col("a").alias("sig")).agg(F.min(F.struct("distance", "id")).alias("best"))
    return asked.select("qid", "sig").join(best, "sig").groupBy("qid").agg(F.min("best").alias("best")).select(
        "qid", F.col("best.id").alias("id"), F.col("best.distance").alias("distance")
    )


def mutual_nearest(left: DataFrame, right: DataFrame, max_hamming: int, chunk_bits: int | None = None) -> DataFrame:
    """Pairs that are each other's closest signature, within ``max_hamming`` bits.

    Both sides have ``id`` and ``sig``; equal distances go to the lowest id. Of equal signatures only the lowest id can be
    anyone's closest, so each signature is compared once.
    """
    one, two = _distinct_signatures(left, "id"), _distinct_signatures(right, "id")
    words = _words(one, two)
    if not words:
        return left.sparkSession.createDataFrame([], "left_id string, right_id string, distance int")
    pairs = within_hamming(one, two, max_hamming, words, chunk_bits)
    pairs = pairs.join(one.select(F.col("sig").alias("a"), F.col("id").alias("left_id")).hint("merge"), "a")
    pairs = pairs.join(two.select(F.col("sig").alias("b"), F.col("id").alias("right_id")).hint("merge"), "b")
    # the closest of either side, whoever shares a chunk: added up before the shuffle
    forth = pairs.groupBy("left_id").agg(F.min(F.struct("distance", "right_id")).alias("best"))
    back = pairs.groupBy("right_id").agg(F.min(F.struct("distance", "left_id")).alias("best"))
    forth = forth.select("left_id", F.col("best.right_id").alias("right_id"), F.col("best.distance").alias("distance"))
    return forth.join(back.select(F.col("best.left_id").alias("left_id"), "right_id"), ["left_id", "right_id"])
