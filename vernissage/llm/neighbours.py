"""Approximate nearest neighbours: a graph by NN-descent, searched greedily."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vernissage.llm.common import named, tidy
from vernissage.session import materialize

#: Unit components times this, rounded: dot products of such vectors are exact in double precision.
_SCALE = 32_767
#: Copies of a vector that are remembered, smallest identifiers first: as many as any answer needs.
_COPIES = "copies"


def usable(vector: Column) -> Column:
    """Whether a vector can be compared: not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at unit length in double precision; scaled first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    """A column of equally long lists, or of equally long binaries, as one matrix."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _top(k: int, *fields: str) -> Column:
    """The ``k`` largest distinct structs of ``fields`` in a group."""
    return F.slice(F.sort_array(F.collect_set(F.struct(*fields)), asc=False), 1, k)


def prepare(rows: DataFrame, id_col: str, vector_col: str, copies: int) -> DataFrame:
    """``id, vec, code, copies``: one row per distinct usable vector, with its ``copies`` smallest identifiers.

    Copies are cut by a hash of their identifiers before they meet, so that a very common vector gathers nowhere.
    """
    vec = F.transform(named(vector_col), lambda x: x.cast("double"))
    rows = rows.select(named(id_col).cast("bigint").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & usable(F.col("vec")))
    rows = rows.groupBy("vec", "id").agg(F.lit(1)).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (["vec", "part"], ["vec"]):
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).filter(F.col("nth") <= copies)
    kept = rows.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias(_COPIES))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.rint(_unit(_matrix(batch.column(1), np.float64)) * _SCALE).astype("<i2") if batch.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "vec", _COPIES, "code"]
            )

    kept = kept.select(F.col(_COPIES)[0].alias("id"), "vec", _COPIES)
    return materialize(kept.mapInArrow(run, f"id bigint, vec array<double>, {_COPIES} array<bigint>, code binary"))


def _lists(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """For each row of a list of structs in column 0, the given fields as arrays."""
    lists = batch.column(0)
    inner = lists.flatten()
    ends = np.cumsum(lists.value_lengths().to_numpy())
    fields = [inner.field(n) for n in names]
    start = 0
    for end in ends:
        yield tuple(f.slice(start, end - start) for f in fields)
        start = end


def _compared(groups: DataFrame, k: int) -> DataFrame:
    """``id, other, sim`` from lists of members ``(id, code, bar, new)``: for each member its ``k`` nearest in the list.

    Only pairs with a new member count, and only those nearer than the member's present bar.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[], [], []]
            for ids, codes, bars, new in _lists(batch, "id", "code", "bar", "new"):
                ids, bars, new = ids.to_numpy(), bars.to_numpy(), new.to_numpy(zero_copy_only=False)
                codes = _matrix(codes, "<i2").astype(np.float64)
                sims = codes @ codes.T
                sims[ids[:, None] == ids[None, :]] = -np.inf
                sims[~(new[:, None] | new[None, :])] = -np.inf
                if len(ids) > k + 1:
                    rank = np.argsort(np.argsort(ids)) / (len(ids) + 1)  # products are whole numbers: smaller ids win ties
                    order = np.argpartition(rank - sims, k, axis=1)[:, :k]
                else:
                    order = np.tile(np.arange(len(ids)), (len(ids), 1))
                best = np.take_along_axis(sims, order, 1)
                i, j = np.nonzero(best > bars[:, None])
                for column, values in zip(found, (ids[i], ids[order[i, j]], best[i, j])):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c or [[]])).cast(t) for c, t in zip(
                found, (pa.int64(), pa.int64(), pa.float64()))], ["id", "other", "sim"])

    return groups.mapInArrow(run, "id bigint, other bigint, sim double")


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    """``id, near``: the ``k`` nearest of each identifier, nearest first, from rows ``id, other, sim, new``."""
    pairs = pairs.groupBy("id", "other").agg(F.max("sim").alias("sim"), F.min("new").alias("new")).withColumn("least", -F.col("other"))
    near = pairs.groupBy("id").agg(_top(k, "sim", "least", "new").alias("near"))  # smaller identifiers first on ties
    return near.withColumn("near", F.transform("near", lambda e: F.struct(e["sim"].alias("sim"), (-e["least"]).alias("other"), e["new"].alias("new"))))


def _leaves(points: DataFrame, trees: int, leaf: int, seed: int) -> DataFrame:
    """Lists of about ``leaf`` members on the same side of random hyperplanes, ``trees`` times over.

    Larger cells are cut by a hash, so that no list grows with the data.
    """
    dims = F.octet_length("code")
    size = points.agg(F.count("*"), F.max(dims)).first()
    levels = max(0, int(np.ceil(np.log2(max(1, size[0]) / leaf))))
    planes = np.random.default_rng(seed).standard_normal((trees, max(1, levels), (size[1] or 0) // 2))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(planes.shape[1], dtype=np.int64)
        for batch in batches:
            codes = _matrix(batch.column(1), "<i2").astype(np.float64)
            for tree in range(trees):
                sides = (codes @ planes[tree].T > 0) @ weights if levels else np.zeros(len(codes), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(np.full(len(codes), tree, np.int32)), pa.array(sides)], ["id", "code", "tree", "cell"]
                )

    cells = points.select("id", "code").mapInArrow(run, "id bigint, code binary, tree int, cell bigint")
    sizes = materialize(cells.groupBy("tree", "cell").agg(F.ceil(F.count("*") / (2 * leaf)).cast("int").alias("parts")))
    cells = cells.join(sizes, ["tree", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", "tree"), "parts"))
    member = F.struct("id", "code", F.lit(float("-inf")).alias("bar"), F.lit(True).alias("new"))
    return cells.groupBy("tree", "cell", "part").agg(F.collect_list(member).alias("members")).select("members")


def build_graph(points: DataFrame, k: int = 32, trees: int = 8, leaf: int = 512, sample: int = 20, rounds: int = 4, seed: int = 7) -> DataFrame:
    """``id, near``: about the ``k`` nearest of every point (``near``: structs of ``sim, other, new``), by NN-descent.

    The first neighbours come from random cells. Each round joins every point's neighbours, forward and reverse, with each
    other: pairs among them that were not compared before replace farther neighbours. At most ``sample`` of each kind
    take part per point and round, reverse ones thinned by their number before they are gathered, so no hub gathers more.
    Rounds stop early once fewer than a thousandth of the neighbours change.
    """
    graph = materialize(_ranked(_compared(_leaves(points, trees, leaf, seed), k).withColumn("new", F.lit(True)), k))
    for turn in range(rounds):
        edges = graph.select("id", F.explode("near").alias("e")).select("id", "e.other", "e.new", "e.sim")
        draw = F.xxhash64("id", "other", F.lit(turn))
        forward = edges.select(F.col("id").alias("centre"), F.col("other").alias("id"), "new", draw.alias("draw"))
        degree = edges.groupBy("other").agg(F.count("*").alias("degree"))
        reverse = edges.join(degree, "other").filter(F.pmod(draw, F.col("degree")) < 2 * sample)
        reverse = reverse.select(F.col("other").alias("centre"), "id", "new", draw.alias("draw"))
        members = forward.withColumn("back", F.lit(0)).unionByName(reverse.withColumn("back", F.lit(1)))
        lists = members.groupBy("centre", "back").agg(
            F.slice(F.sort_array(F.collect_list(F.struct((~F.col("new")).alias("old"), "draw", "id"))), 1, sample).alias("m")
        )
        lists = lists.select("centre", F.explode("m").alias("m")).groupBy("centre", F.col("m.id").alias("id")).agg(F.max(~F.col("m.old")).alias("new"))
        bars = graph.select("id", F.when(F.size("near") >= k, F.element_at("near", -1)["sim"]).otherwise(float("-inf")).alias("bar"))
        known = points.select("id", "code").join(bars, "id")
        groups = lists.join(known, "id").groupBy("centre").agg(F.collect_list(F.struct("id", "code", "bar", "new")).alias("members"))
        fresh = _compared(groups.filter(F.exists("members", lambda m: m["new"])).select("members"), k // 2).withColumn("new", F.lit(True))
        # what has met its neighbours in this round counts as old from now on
        old = edges.select("id", "other", "sim", F.lit(False).alias("new"))
        graph = materialize(_ranked(old.unionByName(fresh), k))
        changed = graph.select(F.sum(F.size(F.filter("near", lambda e: e["new"]))), F.sum(F.size("near"))).first()
        if not changed[0] or changed[0] < changed[1] / 1000:
            break
    return graph


def _links(graph: DataFrame, k: int) -> DataFrame:
    """``id, links``: forward neighbours and at most about ``k`` reverse ones, drawn by hash."""
    edges = graph.select("id", F.explode("near").alias("e")).select("id", F.col("e.other").alias("other"))
    degree = edges.groupBy("other").agg(F.count("*").alias("degree"))
    back = edges.join(degree, "other").filter(F.pmod(F.xxhash64("id", "other"), F.col("degree")) < k)
    both = edges.unionByName(back.select(F.col("other").alias("id"), F.col("id").alias("other")))
    return materialize(both.groupBy("id").agg(F.collect_set("other").alias("links")))


def search(
    points: DataFrame, graph: DataFrame, queries: DataFrame, beam: int = 192, step: int = 48, entries: int = 512, block_rows: int = 2048
) -> DataFrame:
    """``query, near``: up to ``beam`` points near each query (``query, code``, optionally ``start``), by greedy search.

    A search starts from ``entries`` points drawn by hash, and from the query's own point where ``start`` names it. Each
    round follows the links of the ``step`` nearest points not yet followed and scores what they lead to; a search ends
    when its ``beam`` nearest have all been followed. Candidates meet their vectors by blocks, so a block's vectors move
    once a round for all queries.
    """
    spark = points.sparkSession
    links = _links(graph, 32)
    blocks = max(1, points.count() // block_rows)
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    stored = materialize(points.select(block, "id", "code"))
    first = points.orderBy(F.xxhash64("id"), "id").limit(entries).select("id").toPandas()["id"].tolist()  # bounded by entries

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, codes = left["id"].to_numpy(), _matrix(left["code"].combine_chunks(), "<i2").astype(np.float64) if len(left) else None
        order = np.argsort(ids)
        found = [[], [], []]
        for query, code, wanted in zip(right["query"].to_pylist(), right["code"].to_pylist(), right["wanted"]):
            wanted = wanted.values.to_numpy()
            at = order[np.searchsorted(ids, wanted, sorter=order)]
            for column, values in zip(found, (np.full(len(wanted), query), wanted, codes[at] @ np.frombuffer(code, "<i2").astype(np.float64))):
                column.append(values)
        return pa.table([pa.array(np.concatenate(c or [[]])).cast(t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float64()))],
                        names=["query", "id", "sim"])

    queries = materialize(queries)
    starts = F.array(*[F.lit(i).cast("bigint") for i in first]) if first else F.array().cast("array<bigint>")
    if "start" in queries.columns:
        starts = F.array_union(starts, F.filter(F.array("start"), lambda x: x.isNotNull()))
    wanted = queries.select("query", F.explode(starts).alias("id"))
    pool = None
    while True:
        asks = wanted.withColumn("block", block).groupBy("block", "query").agg(F.collect_list("id").alias("wanted"))
        asks = asks.join(queries.select("query", "code"), "query").select("block", "query", "code", "wanted")
        scored = stored.groupBy("block").cogroup(asks.groupBy("block")).applyInArrow(score, "query bigint, id bigint, sim double")
        scored = scored.withColumn("fresh", F.lit(True))
        if pool is not None:
            scored = scored.unionByName(pool.select("query", F.explode("near").alias("e")).select("query", "e.id", "e.sim", "e.fresh"))
            scored = scored.groupBy("query", "id").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
        ranked = scored.withColumn("least", -F.col("id")).groupBy("query").agg(_top(beam, "sim", "least", "fresh").alias("near"))
        # the nearest fresh ones, smaller identifiers first on ties, are followed now and are no longer fresh in the pool
        follow = F.slice(F.filter("near", lambda e: e["fresh"]), 1, step)
        near = F.transform("near", lambda e: F.struct(
            e["sim"].alias("sim"), (-e["least"]).alias("id"), (e["fresh"] & ~F.array_contains("follow", -e["least"])).alias("fresh")))
        ranked = ranked.withColumn("follow", F.transform(follow, lambda e: -e["least"])).withColumn("near", near)
        pool = materialize(ranked)
        front = pool.select("query", F.explode("follow").alias("id"))
        if front.isEmpty():
            return pool.select("query", F.transform("near", lambda e: e["id"]).alias("near"))
        reached = front.join(links, "id").select("query", F.explode("links").alias("id")).distinct()
        held = pool.select("query", F.explode("near").alias("e")).select("query", F.col("e.id").alias("id"))
        wanted = reached.join(held, ["query", "id"], "left_anti")


def nearest_neighbours(
    rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", spare: int = 48, **options
) -> DataFrame:
    """The ``k`` nearest rows of each query row: ``query_id, rank, vec_id, score``, by cosine, ties to the smaller id.

    ``queries`` are rows of ``rows``. Distinct vectors are indexed by ``build_graph`` over 16-bit codes; ``search`` finds
    candidates, the best ``spare`` of which are scored on the original vectors in double precision. A query's own row is
    no candidate, its copies are. Every row is indexed; which candidates are found is approximate, their scores are not.

    Null, zero and non-finite vectors and rows without identifier take no part, as queries or candidates. All vectors must
    have one length. Repeated rows count once. Fewer candidates than ``k`` give fewer rows; an empty table gives none.
    """
    points = prepare(rows, id_col, vector_col, k + 1)
    vec = F.transform(named(vector_col), lambda x: x.cast("double"))
    asked = queries.select(named(id_col).cast("bigint").alias("query"), vec.alias("vec"))
    asked = asked.filter(F.col("query").isNotNull() & usable(F.col("vec"))).dropDuplicates(["query"])
    asked = materialize(asked.join(points.select("vec", "code", F.col("id").alias("start")), "vec"))
    graph = build_graph(points, **options)
    found = search(points, graph, asked.select("query", "code", "start"))
    own = asked.select("query", F.array("start").alias("near"))
    near = found.select("query", F.slice("near", 1, spare).alias("near")).unionByName(own)
    pairs = near.select("query", F.explode("near").alias("id")).distinct()
    pairs = pairs.join(points.select("id", "vec", _COPIES), "id").join(asked.select("query", F.col("vec").alias("asked")), "query")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_matrix(batch.column(i), np.float64) for i in (2, 3))
                scores = np.clip(np.einsum("ij,ij->i", _unit(a), _unit(b)), -1, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], ["query", _COPIES, "score"])

    scored = pairs.select("query", _COPIES, "vec", "asked").mapInArrow(score, f"query bigint, {_COPIES} array<bigint>, score double")
    scored = scored.select("query", "score", F.explode(_COPIES).alias("id")).filter("id <> query")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    scored = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return scored.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
