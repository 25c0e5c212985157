"""Near-duplicate groups from SimHash fingerprints, compared exactly in tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vernissage.llm.common import carried, hash128, named, tidy, whole
from vernissage.llm.components import connected_components, roots
from vernissage.session import materialize

RESULTS = ["fingerprint", "component_id"]
#: Matches within a task are reduced to a forest whenever so many have come together.
_MATCHES = 2_000_000


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """The 64-bit hashes of all word shingles of a UTF-8 text, in order; a shorter text is one shingle, an empty one none."""
    tokens = text.lower().split()  # bytes: A-Z only, and the six ASCII space characters
    if not tokens:
        return np.zeros(0, np.uint64)
    n = max(1, len(tokens) - words + 1)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[min(words, len(tokens)) - 1 :].tolist()
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of hashes: a bit is set if over half of them have it."""
    counts, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 255 * 256):
        part = hashes[at : at + 255 * 256]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        counts += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[full:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text over all its word shingles, repeats included."""
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``id, fp`` of every row; the unsigned fingerprint is held in a bigint."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.array([fingerprint(t.as_py(), words) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    kind = docs.select(named(id_col)).schema[0].dataType.simpleString()
    return docs.select(named(id_col).alias("id"), whole(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def _classes(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints sorted by the population counts of their four quarters: the order, the counts per class, the class edges."""
    quarters = np.bitwise_count((prints[:, None] >> np.array([0, 16, 32, 48], np.uint64)) & np.uint64(0xFFFF)).astype(np.int64)
    order = np.lexsort(quarters.T)
    quarters = quarters[order]
    edges = np.flatnonzero(np.concatenate(([True], (np.diff(quarters, axis=0) != 0).any(axis=1), [True])))
    return order, quarters[edges[:-1]], edges


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, cells: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever the pairs of ``a`` and ``b`` within ``radius`` bits connect, as two arrays.

    Exclusive-or and bit count over whole blocks; blocks whose population counts, taken by quarters, already differ by
    more than the radius are skipped. Matches are reduced to a spanning forest, so that a dense group gives few links.
    """
    order_a, class_a, edge_a = _classes(a)
    order_b, class_b, edge_b = _classes(b)
    a, b = a[order_a], b[order_b]
    n, left, right, held = len(a) + len(b), [], [], 0

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        root = roots(n, np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right]))
        nodes = np.flatnonzero(root != np.arange(n))
        return nodes, root[nodes]

    for k, counts in enumerate(class_a):
        near = np.flatnonzero(np.abs(class_b - counts).sum(axis=1) <= radius)
        if not len(near):
            continue
        columns = np.concatenate([np.arange(edge_b[j], edge_b[j + 1]) for j in near])
        step = max(1, cells // len(columns))
        for at in range(edge_a[k], edge_a[k + 1], step):
            rows = np.arange(at, min(at + step, edge_a[k + 1]))
            i, j = np.nonzero(np.bitwise_count(a[rows][:, None] ^ b[columns][None, :]) <= radius)
            left.append(rows[i])
            right.append(columns[j] + len(a))
            held += len(i)
            if held > _MATCHES:
                one, two = reduced()
                left, right, held = [one], [two], 0
    one, two = reduced()
    both = np.concatenate([a, b])
    one, two = both[one], both[two]
    return one[one != two], two[one != two]


def links(prints: DataFrame, radius: int, tile_rows: int) -> DataFrame:
    """Edges ``a, b`` over distinct fingerprints ``fp`` that connect all pairs within ``radius`` bits.

    A tile holds fingerprints of one population count, at most about ``tile_rows``. Each tile meets the tiles whose
    population count is up to ``radius`` higher; every such pair of tiles is one row of work.
    """
    prints = prints.withColumn("ones", F.bit_count("fp").cast("int"))
    sizes = {r["ones"]: r["n"] for r in prints.groupBy("ones").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    tiles = [-(-sizes.get(p, 0) // tile_rows) for p in range(65 + radius)]
    of = F.array(*[F.lit(t) for t in tiles])
    cell = F.pmod(F.xxhash64("fp"), F.greatest(F.get(of, F.col("ones")), F.lit(1))).cast("int")
    tiled = materialize(prints.withColumn("cell", cell).groupBy("ones", "cell").agg(F.collect_list("fp").alias("fps")))

    higher = F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda d: F.struct((F.col("ones") + d).alias("ones"), d.alias("d")))
    asks = tiled.withColumn("to", F.explode(higher)).withColumn("count", F.get(of, F.col("to.ones")))
    first = F.when(F.col("to.d") == 0, F.col("cell")).otherwise(F.lit(0))
    asks = asks.withColumn("first", first).filter("first < count")
    asks = asks.withColumn("other", F.explode(F.sequence("first", F.col("count") - 1)))
    asks = asks.select(
        F.col("to.ones").alias("ones"), F.col("other").alias("cell"), F.col("fps").alias("left"),
        ((F.col("to.d") == 0) & (F.col("cell") == F.col("other"))).alias("same"),
    )

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                a, b = (x.values.to_numpy().view(np.uint64) for x in (left, right))
                one, two = tile_links(a, b, radius)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (one, two)], ["a", "b"])

    parts = max(prints.sparkSession.sparkContext.defaultParallelism, sum(tiles) * (radius + 1))
    pairs = asks.join(tiled, ["ones", "cell"]).select("left", "fps").repartition(min(parts, 100_000))
    return pairs.mapInArrow(run, "a bigint, b bigint")


def _components(rows: DataFrame, radius: int, tile_rows: int) -> DataFrame:
    """``fp, component, least`` of every distinct fingerprint of ``rows`` (``id, fp``); ``least`` is its smallest ``id``."""
    prints = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")))
    edges = materialize(links(prints.select("fp"), radius, tile_rows))
    group = connected_components(edges).withColumnRenamed("node", "fp")
    return materialize(prints.join(group, "fp", "left").withColumn("component", F.coalesce("component", "fp")))


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, tile_rows: int = 16_384
) -> DataFrame:
    """``id_col, fingerprint, component_id`` of every row of ``docs``.

    The fingerprint covers all word shingles of the whole text, repeats included. Fingerprints link at ``radius`` or fewer
    differing bits; a component is what links reach, and is named by its smallest identifier. Equal fingerprints are
    compared once. All others are compared exactly, in tiles; no link is lost, and no group's pairs are emitted.

    A null text counts as empty and has fingerprint zero, which links like any other. Rows with a null identifier belong
    to their component but do not name it; a component of such rows alone has a null name. Repeated rows repeat their
    result. An empty table gives an empty result. Other columns are not read, whatever their names.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, words))
    least = _components(rows, radius, tile_rows)
    name = least.groupBy("component").agg(F.min("least").alias("component_id"))
    prints = least.join(name, "component").select("fp", "component_id")
    return rows.join(prints, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, tile_rows: int = 16_384
) -> DataFrame:
    """One row of each component of ``simhash_groups``: the smallest identifier stays, a null one comes last.

    Rows are told apart by identifier and text, as 128 bits of hash, so of rows that share an identifier exactly one stays
    if they are near copies, and each stays if their texts are not. Of rows that repeat both, one stays, whichever. A null
    text counts as empty; empty texts are copies of one another. An empty table gives an empty result. All columns are
    passed on as they are, whatever their names.
    """
    columns = carried(docs, None, [])
    h1, h2 = hash128(named(id_col), whole(text_col))
    key = F.struct(named(id_col).isNull().alias("no_id"), named(id_col).alias("id"), h1.alias("h1"), h2.alias("h2"))
    rows = materialize(fingerprints(docs.select(key.alias("key"), whole(text_col).alias("text")), "key", "text", words))
    least = _components(rows, radius, tile_rows)
    first = least.groupBy("component").agg(F.min("least").alias("stays"))
    prints = least.join(first, "component").select("fp", F.col("stays.h1").alias("s1"), F.col("stays.h2").alias("s2"))
    judged = rows.join(prints, "fp").select(F.col("id.h1").alias("h1"), F.col("id.h2").alias("h2"), "s1", "s2")
    stays = (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2"))
    dropped = materialize(judged.filter(~stays).select("h1", "h2").distinct())
    repeated = materialize(judged.filter(stays).groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2"))
    keyed = docs.select(F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(columns)]).alias("row"), h1.alias("h1"), h2.alias("h2"))
    left = keyed.join(dropped, ["h1", "h2"], "left_anti")
    if not repeated.isEmpty():
        once = left.join(repeated, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
        left = left.join(repeated, ["h1", "h2"], "left_anti").unionByName(once)
    return left.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)])
