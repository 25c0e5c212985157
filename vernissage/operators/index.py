"""A cell index over vectors: centroids, bucketed postings and a two-pass search.

``centroids(cell, vec)`` are tiled wherever all of them are looked at. Cells are cut into parts of bounded size; a
slot is one part of a cell. ``postings(id, vec, sig, cell, slot)`` are dealt to bucket files by slot and sorted by it, so a
search reads the buckets and row groups of the slots it probes, and a join by slot moves queries alone.
``cells(cell, rows, parts)`` tells the slots of a cell. Every build, append and compaction writes new folders, and
becomes visible as a whole with the next version of the manifest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from vernissage.operators.sampling import sample_n
from vernissage.operators.skew import first_n, with_ordinal
from vernissage.operators.vectors import PROBE_BYTES, Pile, best_hits, coded, cosine, matrix, scan_hits, signature, slice_rows, unit
from vernissage.schema import UNKNOWN_LABEL, SearchConfig
from vernissage.session import materialize
from vernissage.sources.bucketed import MOST_BUCKETS, open_segments, write_segment
from vernissage.sources.manifest import Version, commit, current, fresh_folder, read_table

#: Bytes of centroids that are looked at in one pass, and scores that are computed at once.
CENTER_BYTES = 64 << 20
_SCORES = 1 << 22
#: Rows of a bucket, of which a part of a cell has a 32nd at most, and bytes of a row group.
FILE_ROWS = 1_000_000
_GROUP_BYTES = 16 << 20
#: Queries that meet one part of a cell at once.
ROUND_QUERIES = 65_536
#: A slot is ``cell << _PART_BITS | part``; a cell's closeness is ``1_000_000 - score in millionths << _CELL_BITS | cell``.
_PART_BITS, _CELL_BITS = 24, 40
_POSTINGS = "id string, vec array<double>, sig array<bigint>, cell int, slot bigint"
_CELLS = "cell int, rows bigint, parts bigint"
_CENTROIDS = "cell int, vec array<double>"


@dataclass(frozen=True)
class CellIndex:
    """The tables of an index."""

    centroids: DataFrame
    postings: DataFrame
    cells: DataFrame


def train_seeded(vectors: DataFrame, cells: int) -> DataFrame:
    """The vectors with the lowest ``ord`` as centroids: reproducible in any engine."""
    first = with_ordinal(first_n(vectors.select("ord", "vec"), cells, "ord"), "ord", name="cell")
    return first.select(F.col("cell").cast("int").alias("cell"), "vec")


def train_kmeans(vectors: DataFrame, cells: int, seed: int = 42, rounds: int = 20, per_cell: int | None = None) -> DataFrame:
    """Spherical k-means centroids of all vectors; zero vectors have no direction and are left out.

    With ``per_cell`` training takes no more than so many vectors per cell, by a
    hash of the id; every vector is assigned to a cell afterwards.
    """
    spark = vectors.sparkSession
    chosen = vectors.select("id", "vec").filter(F.exists("vec", lambda x: x != 0))
    chosen = materialize(sample_n(chosen, per_cell * cells, seed) if per_cell else chosen)
    rows = chosen.select(array_to_vector("vec").alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=rounds, distanceMeasure="cosine").fit(rows)
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(centers, "cell int, vec array<double>")


def _center_slices(centroids: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers and unit vectors of all centroids, in slices of bounded size, one after another."""
    stored = centroids.select("cell", "vec")
    first = stored.select(F.size("vec").alias("width")).first()
    if first is None:
        return
    most = max(1, CENTER_BYTES // (8 * max(1, first["width"])))
    rows = stored.limit(most + 1).toArrow()
    if rows.num_rows <= most:
        yield rows.column("cell").to_numpy().astype(np.int64), unit(matrix(rows.column("vec")))
        return
    stored = materialize(stored)
    slices = -(-stored.count() // most)
    for i in range(slices):
        rows = stored.filter(F.pmod("cell", F.lit(slices)) == i).toArrow()
        if rows.num_rows:
            yield rows.column("cell").to_numpy().astype(np.int64), unit(matrix(rows.column("vec")))


def _closest(numbers: np.ndarray, centers: np.ndarray, probes: int):
    """A function from vectors to their closest cells as sortable numbers: by cosine, then by cell."""

    @F.arrow_udf("array<bigint>")
    def closest(vec: pa.Array) -> pa.Array:
        if not len(vec):
            return pa.array([], pa.list_(pa.int64()))
        rows, tile = unit(matrix(vec)), max(1, _SCORES // len(vec))
        best = np.zeros((len(rows), 0), np.int64)
        for at in range(0, len(centers), tile):
            score = np.rint((rows @ centers[at : at + tile].T) * 1e6).astype(np.int64)
            best = np.concatenate([best, (1_000_000 - score) << _CELL_BITS | numbers[at : at + tile]], axis=1)
            if best.shape[1] > probes:
                best = np.partition(best, probes - 1, axis=1)[:, :probes]
        best.sort(axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, best.shape[1], dtype=np.int32)), pa.array(best.ravel()))

    return closest


def rank_cells(vectors: DataFrame, centroids: DataFrame, probes: int, vec: str = "vec") -> DataFrame:
    """Add ``cells``, the ``probes`` closest cells of every vector: best first, lowest number on ties.

    All centroids are compared, a slice of them at a time; a vector keeps its best so far between slices.
    """
    found = None
    for numbers, centers in _center_slices(centroids):
        keys = _closest(numbers, centers, probes)(vec)
        if found is None:
            found = vectors.withColumn("_keys", keys)
        else:  # written in between, so that a task holds one slice
            found = materialize(found).withColumn("_fresh", keys)
            found = found.withColumn("_keys", F.slice(F.array_sort(F.concat("_keys", "_fresh")), 1, probes)).drop("_fresh")
    if found is None:
        return vectors.withColumn("cells", F.array().cast("array<int>"))
    cell = lambda key: key.bitwiseAND(F.lit((1 << _CELL_BITS) - 1)).cast("int")
    return found.withColumn("cells", F.transform("_keys", cell)).drop("_keys")


def assign_cells(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """Add the closest ``cell`` and the bit signature ``sig``."""
    ranked = rank_cells(vectors, centroids, 1)
    return ranked.withColumn("cell", F.get("cells", F.lit(0))).drop("cells").withColumn("sig", signature("vec"))


def _slot(cell: str, part: str):
    return F.shiftleft(F.col(cell).cast("bigint"), _PART_BITS).bitwiseOR(F.col(part).cast("bigint"))


def _add_postings(assigned: DataFrame, path: str, cells: DataFrame, postings: str | None, buckets: int) -> tuple[dict, dict]:
    """Write rows as a new segment of ``postings`` (a new table if none): the folders and figures it adds.

    New rows fill the parts that a cell has, or new parts of it once these are full.
    """
    spark, most = assigned.sparkSession, max(1, FILE_ROWS // 32)
    stored = materialize(assigned.select("id", "vec", "sig", "cell").withColumn("place", F.monotonically_increasing_id()))
    fresh = stored.groupBy("cell").agg(F.count("*").alias("fresh"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    sizes = cells.withColumnRenamed("rows", "old").join(fresh, "cell", "full").select(
        "cell", (none("old") + none("fresh")).alias("rows"), none("parts").alias("old_parts"), none("fresh").alias("fresh")
    )
    more = F.when(F.col("rows") > F.col("old_parts") * most, F.ceil(F.col("fresh") / most)).otherwise(0).cast("bigint")
    sizes = materialize(sizes.withColumn("more", more).withColumn("parts", F.col("old_parts") + F.col("more")))
    if postings is None:
        rows = stored.count()
        buckets = min(MOST_BUCKETS, max(-(-rows // FILE_ROWS), spark.sparkContext.defaultParallelism))
        postings = fresh_folder("postings")
    low = F.when(F.col("more") > 0, F.col("old_parts")).otherwise(0)
    dealt = stored.join(sizes.select("cell", "old_parts", "more", "parts"), "cell")
    dealt = dealt.withColumn("part", low + F.pmod("place", F.col("parts") - low)).withColumn("slot", _slot("cell", "part"))
    segment = write_segment(dealt, path, postings, _POSTINGS, "slot", buckets, _GROUP_BYTES)
    counts = fresh_folder("cells")
    sizes.select("cell", "rows", "parts").write.parquet(f"{path}/{counts}")
    return {"cells": [counts], "postings": [segment]}, {"buckets": buckets}


def build_index(vectors: DataFrame, path: str, cells: int, seeded: bool = False, seed: int = 42) -> None:
    """Train cells, assign every vector (``id``, ``vec``; ``ord`` if seeded) and store the index."""
    spark, before = vectors.sparkSession, current(vectors.sparkSession, path)
    tables, figures = write_index(vectors, path, train_seeded(vectors, cells) if seeded else train_kmeans(vectors, cells, seed))
    commit(spark, path, before, tables, figures)


def write_index(vectors: DataFrame, path: str, centroids: DataFrame) -> tuple[dict, dict]:
    """Write an index over given centroids without committing it: the tables and figures for a version."""
    spark, folder = vectors.sparkSession, fresh_folder("centroids")
    centroids.select(F.col("cell").cast("int").alias("cell"), "vec").write.parquet(f"{path}/{folder}")
    stored = spark.read.schema(_CENTROIDS).parquet(f"{path}/{folder}")
    tables, figures = _add_postings(assign_cells(vectors, stored), path, spark.createDataFrame([], _CELLS), None, 0)
    return {"centroids": [folder], **tables}, figures


def write_append(vectors: DataFrame, path: str, version: Version) -> tuple[dict, dict]:
    """Write more vectors for an index without training again and without committing: the tables and figures."""
    spark = vectors.sparkSession
    assigned = assign_cells(vectors, read_table(spark, path, version, "centroids", _CENTROIDS))
    segments, cells = version.tables["postings"], read_table(spark, path, version, "cells", _CELLS)
    tables, figures = _add_postings(assigned, path, cells, segments[0].split("/")[0], version.figures["buckets"])
    return {**tables, "postings": [*segments, *tables["postings"]]}, figures


def append_index(vectors: DataFrame, path: str) -> None:
    """Add vectors to a stored index without training again."""
    spark, before = vectors.sparkSession, current(vectors.sparkSession, path)
    tables, figures = write_append(vectors, path, before)
    commit(spark, path, before, {**before.tables, **tables}, figures)


def compact_postings(index: CellIndex, path: str) -> tuple[dict, dict]:
    """Write the postings of all segments anew, without committing: parts filled, buckets for the present size."""
    spark = index.postings.sparkSession
    return _add_postings(index.postings, path, spark.createDataFrame([], _CELLS), None, 0)


def compact_index(spark: SparkSession, path: str) -> None:
    """Write the postings of a stored index anew."""
    before = current(spark, path)
    tables, figures = compact_postings(open_index(spark, path, before), path)
    commit(spark, path, before, {**before.tables, **tables}, figures)


def open_index(spark: SparkSession, path: str, version: Version) -> CellIndex:
    """The index of one version."""
    postings = open_segments(spark, path, version.tables["postings"], _POSTINGS, "slot", version.figures["buckets"])
    tables = [read_table(spark, path, version, t, schema) for t, schema in (("centroids", _CENTROIDS), ("cells", _CELLS))]
    return CellIndex(tables[0], postings, tables[1])


def load_index(spark: SparkSession, path: str) -> CellIndex:
    """Open a stored index."""
    version = current(spark, path)
    if "postings" not in version.tables:
        raise ValueError(f"{path} holds no index")
    return open_index(spark, path, version)


def _meet(k: int):
    """The best rows of one part of a cell for the queries that ask for it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pile = Pile(cosine, k)
        if left.num_rows and right.num_rows:
            codes, ids = coded(right.column("id"))
            pile.add(matrix(left.column("key")), np.arange(left.num_rows), matrix(right.column("key")), codes, ids)
        return pile.hits(left.column("qid").combine_chunks())

    return run


def search_slots(probed: DataFrame, rows: DataFrame, k: int = 1) -> DataFrame:
    """The k best rows for any number of queries (``qid, key, slot``) among stored ``id, key, slot``.

    The rows stay where they lie in their buckets: only the queries are dealt by slot. Where a slot is asked for by
    more than ``ROUND_QUERIES`` queries, they come in several rounds, each over the slots it asks for.
    """
    probed = materialize(probed)
    most = probed.groupBy("slot").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    rounds = max(1, -(-5 * most // (4 * ROUND_QUERIES)) if most > ROUND_QUERIES else 1)
    hits = None
    for i in range(rounds):
        asked = probed if rounds == 1 else probed.filter(F.pmod(F.xxhash64("qid", "key"), F.lit(rounds)) == i)
        wanted = rows.join(asked.select("slot").distinct(), "slot", "left_semi")
        found = asked.groupBy("slot").cogroup(wanted.groupBy("slot")).applyInArrow(_meet(k), "qid string, id string, score double")
        hits = found if hits is None else hits.unionByName(found)
    return best_hits(hits, k)


def search_cells(index: CellIndex, queries: DataFrame, config: SearchConfig = SearchConfig(), probe_bytes: int = PROBE_BYTES) -> DataFrame:
    """Two-pass search: (qid, label, confidence, fallback_used) for every query (``qid``, ``vec``).

    The first pass probes few cells; queries below the confidence threshold go
    on to many. What stays below it is ``Unknown``, and so is a query without a vector.
    Queries of up to ``probe_bytes`` travel to the stored rows, more are joined to them by slot.
    """
    deep = max(config.nprobe_fast, config.nprobe_deep)
    asked = materialize(queries.select("qid", F.col("vec").alias("key")))
    placed = materialize(rank_cells(asked.filter("key is not null"), index.centroids, deep, "key"))
    nothing = asked.filter("key is null").select(
        "qid", F.lit(UNKNOWN_LABEL).alias("label"), F.lit(0.0).alias("confidence"), F.lit(True).alias("fallback_used")
    )
    rows = index.postings.select("id", F.col("vec").alias("key"), "slot").filter("id is not null and key is not null")
    width = (placed.select(F.size("key")).first() or [1])[0]
    most = slice_rows(max(1, width), probe_bytes)
    slots = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda p: F.shiftleft(F.col("cell").cast("bigint"), _PART_BITS).bitwiseOR(p))

    def one_pass(asked: DataFrame, probes: int) -> DataFrame:
        probed = asked.select("qid", "key", F.explode(F.slice("cells", 1, probes)).alias("cell"))
        probed = probed.join(index.cells.filter("parts > 0"), "cell").select("qid", "key", F.explode(slots).alias("slot"))
        few = probed.limit(most + 1).withColumnRenamed("slot", "cell").toArrow()
        if few.num_rows > most:
            return search_slots(probed, rows).select("qid", "id", "score")
        if not few.num_rows:
            return probed.sparkSession.createDataFrame([], "qid string, id string, score double")
        return best_hits(scan_hits(few, rows.withColumnRenamed("slot", "cell"), cosine, 1), 1).select("qid", "id", "score")

    first = materialize(placed.select("qid").join(one_pass(placed, config.nprobe_fast), "qid", "left"))
    sure = first.filter(F.col("score") >= config.confidence_threshold)
    unsure = placed.join(sure.select("qid"), "qid", "left_anti")
    second = unsure.select("qid").join(one_pass(unsure, deep), "qid", "left")
    kept = F.col("score") >= config.confidence_threshold
    return sure.select("qid", F.col("id").alias("label"), F.col("score").alias("confidence"), F.lit(False).alias("fallback_used")).unionByName(
        second.select(
            "qid",
            F.when(kept, F.col("id")).otherwise(F.lit(UNKNOWN_LABEL)).alias("label"),
            F.coalesce("score", F.lit(0.0)).alias("confidence"),
            F.lit(True).alias("fallback_used"),
        )
    ).unionByName(nothing)


def index_stats(index: CellIndex) -> DataFrame:
    """One row: n_images, n_features, nlist, is_built."""
    none = F.lit(0).cast("long")
    per_cell = index.postings.groupBy("cell").agg(F.count("*").alias("n"))
    sizes = per_cell.agg(none.alias("n_images"), F.sum("n").alias("n_features"), F.count("*").alias("nlist"))
    images = index.postings.select("id").distinct().agg(
        F.count("*").alias("n_images"), none.alias("n_features"), none.alias("nlist")
    )
    figures = [F.coalesce(F.max(c), none).alias(c) for c in ("n_images", "n_features", "nlist")]
    return sizes.unionByName(images).agg(*figures).withColumn("is_built", F.col("n_features") > 0)
