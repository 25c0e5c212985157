"""Removal of passages that repeat across documents, by MinHash banding of content-defined paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window, functions as F

from vernissage.llm.common import SPACES, carried, named, slices, tidy, whole
from vernissage.llm.components import connected_components, roots
from vernissage.session import materialize

#: Words to either side over which a paragraph's first word pair has the smallest hash.
REACH = 5
#: A paragraph has at most so many words.
_MOST_WORDS = 64
_SHINGLE = 5
#: Bands of one MinHash value each: a pair of similarity 0.8 shares one with probability 1 - 0.2 ** 3 = 0.992.
BANDS = 3
_FILTER_BITS = 1 << 27
_BLOCK = 512
_BYTES = 1 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a public finaliser of xor-shifts and multiplications)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, base, np.uint64))))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of ``data``, bytes with A-Z already in lower case."""
    hit = np.concatenate(([False], ~_SPACE[data], [False]))
    edge = np.flatnonzero(hit[1:] != hit[:-1])
    starts, ends = edge[::2], edge[1::2]
    hashes, power, at = np.empty(len(starts), np.uint64), _powers(_ODD[0], 256), 0
    while at < len(starts):  # a few words' bytes at a time: the arrays below take eight times their room
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _BYTES)))
        first, last = starts[at], ends[to - 1]
        place = np.arange(first, last) - np.repeat(starts[at:to], np.append(np.diff(starts[at:to]), last - starts[to - 1]))
        if (longest := int((ends[at:to] - starts[at:to]).max())) >= len(power):
            power = _powers(_ODD[0], longest)
        inside = hit[1:-1][first:last]
        value = np.where(inside, (data[first:last].astype(np.uint64) + np.uint64(1)) * power[np.where(inside, place, 0)], 0)
        hashes[at:to] = np.add.reduceat(value.astype(np.uint64), starts[at:to] - first)
        at = to
    return starts, ends, _mix(hashes)


class Paragraphs:
    """The paragraphs of a batch of texts, as arrays with one entry per paragraph of at least five words.

    A paragraph starts at a word whose pair hash is the smallest among the ``REACH`` words on either side, so where it
    starts and ends depends on the words around alone, and equal passages fall into equal paragraphs but for their edges.
    """

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        # a space after each text keeps its last word apart from the next text
        data = np.frombuffer(b" ".join([raw[a:b].tobytes().lower() for a, b in zip(offsets[:-1], offsets[1:])]) + b" ", np.uint8)
        offsets = offsets + np.arange(len(offsets))
        starts, ends, words = _words(data)
        owner = np.searchsorted(offsets, starts, side="right") - 1
        # between texts stand as many blanks as the window and the shingles reach, whose hash is never the smallest
        place = np.arange(len(words)) + (owner + 1) * (REACH + 1)
        n = len(words) + (len(texts) + 1) * (REACH + 1)
        padded, real = np.zeros(n, np.uint64), np.zeros(n, bool)
        padded[place], real[place] = words, True
        pair = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        both = real[:-1] & real[1:]
        pair[:-1][both] = _mix(padded[:-1] * _ODD[1] + padded[1:] * _ODD[2])[both]
        first = np.zeros(n, bool)
        if n > 2 * REACH:
            around = sliding_window_view(pair, REACH)
            left, right = around[: n - 2 * REACH].min(axis=1), around[REACH + 1 :].min(axis=1)
            middle = pair[REACH : n - REACH]
            first[REACH : n - REACH] = (middle < left) & (middle <= right)
        first &= real
        first[1:] |= real[1:] & ~real[:-1]
        begin = np.flatnonzero(first)
        stop = np.flatnonzero(real[:-1] & ~real[1:]) + 1
        end = np.minimum(np.append(begin[1:], n), stop[np.searchsorted(stop, begin, side="right")] if len(stop) else n)
        pieces = -(-(end - begin) // _MOST_WORDS)
        if len(pieces) and pieces.max() > 1:  # cut what has no smallest pair for long, such as one word repeated
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin, end = np.repeat(begin, pieces) + nth * _MOST_WORDS, np.repeat(end, pieces)
            end = np.minimum(begin + _MOST_WORDS, end)
        long_enough = end - begin >= _SHINGLE
        self.begin, self.end = begin[long_enough], end[long_enough]
        word = np.cumsum(real) - 1
        self.row = owner[word[self.begin]] if len(self.begin) else np.zeros(0, np.int64)
        self.start = starts[word[self.begin]] - offsets[self.row]
        self.stop = ends[word[self.end - 1]] - offsets[self.row]
        self.ordinal = word[self.begin]
        self.words = self.end - self.begin
        self.padded = padded
        mixed = [padded[i : n - _SHINGLE + 1 + i] * _ODD[i] for i in range(_SHINGLE)] if n >= _SHINGLE else []
        self.shingles = _mix(sum(mixed[1:], mixed[0])) if mixed else np.zeros(0, np.uint64)

    def _spans(self, ends: np.ndarray) -> np.ndarray:
        return np.stack([self.begin, ends], axis=1).ravel()

    def bands(self) -> list[np.ndarray]:
        """One key per band: the smallest shingle hash, under the band's own order of hashes."""
        spans, found = self._spans(self.end - _SHINGLE + 1), []
        for k in range(BANDS):
            order = np.append(_mix(self.shingles ^ _ODD[k]), np.iinfo(np.uint64).max)
            low = np.minimum.reduceat(order, spans)[::2] if len(spans) else np.zeros(0, np.uint64)
            found.append(_mix(low + _ODD[k + 1]))
        return found

    def identity(self) -> list[np.ndarray]:
        """128 bits that tell paragraphs apart by all their words."""
        spans, found = self._spans(self.end), []
        place = np.zeros(len(self.padded) + 1, np.int64)
        place[:-1] = np.arange(len(self.padded))
        owner = np.repeat(self.begin, self.words)
        inside = owner + np.arange(len(owner)) - np.repeat(np.cumsum(self.words) - self.words, self.words)
        for base in (_ODD[3], _ODD[4]):
            power, value = _powers(base, _MOST_WORDS), np.zeros(len(self.padded) + 1, np.uint64)
            value[inside] = _mix(self.padded[inside] ^ base) * power[inside - owner]
            found.append(_mix(np.add.reduceat(value, spans)[::2]) if len(spans) else np.zeros(0, np.uint64))
        return found


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _keys(rows: DataFrame) -> DataFrame:
    """``key`` of every band value that paragraphs of two or more documents share."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _BYTES):
            found = Paragraphs(batch.column(1))
            doc = batch.column(0).to_numpy()[found.row]
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(found.bands())), pa.array(np.tile(doc, BANDS))], ["key", "doc"])

    found = rows.select("doc", "text").mapInArrow(run, "key bigint, doc bigint")
    return found.groupBy("key").agg(F.min("doc").alias("one"), F.max("doc").alias("two")).filter("one <> two").select("key")


def _filter(keys: DataFrame) -> bytes:
    """A bit for each key, in a filter of fixed size; more keys make it pass more, never less."""
    place = F.col("key").bitwiseAND(F.lit(_FILTER_BITS - 1)) + 1
    parts = keys.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit"))
    bits = np.zeros((_FILTER_BITS >> 15, 4096), np.uint8)
    for row in parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():  # 16 MB in all
        bits[row["part"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return bits.tobytes()


def _shared_paragraphs(rows: DataFrame, bits: bytes) -> DataFrame:
    """The paragraphs with a key in the filter: place, identity, band keys and distinct shingles."""
    kind, shared = dict(rows.dtypes)["id"], rows.sparkSession.sparkContext.broadcast(bits)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, np.uint8)
        for batch in slices(batches, _BYTES):
            found = Paragraphs(batch.column(2))
            bands = found.bands()
            places = [b & np.uint64(_FILTER_BITS - 1) for b in bands]
            take = np.flatnonzero(np.any([known[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1 for p in places], axis=0))
            sets = [np.unique(found.shingles[a:b]).tobytes() for a, b in zip(found.begin[take], found.end[take] - _SHINGLE + 1)]
            row = pa.array(found.row[take])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(found.ordinal[take]),
                 pa.array(found.start[take]), pa.array(found.stop[take]), pa.array(found.words[take].astype(np.int32)),
                 *[_signed(x[take]) for x in (*found.identity(), *bands)], pa.array(sets, pa.binary())],
                ["id", "doc", "ordinal", "start", "stop", "words", "h1", "h2", *[f"k{i}" for i in range(BANDS)], "shingles"],
            )

    schema = f"id {kind}, doc bigint, ordinal bigint, start bigint, stop bigint, words int, h1 bigint, h2 bigint, "
    return rows.mapInArrow(run, schema + "".join(f"k{i} bigint, " for i in range(BANDS)) + "shingles binary")


def _similar(sets: list[np.ndarray], block: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets with a Jaccard similarity of at least ``similarity``; across blocks where two meet."""
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    table = np.zeros((len(sets), len(names)), np.float32)
    table[np.repeat(np.arange(len(sets)), sizes), flat] = 1
    common = table @ table.T
    near = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-6
    if block.min() != block.max():
        near &= block[:, None] != block[None, :]
    return np.nonzero(np.triu(near, 1))


def _near_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """Edges ``a, b`` that connect all distinct paragraphs that share a band key and are similar enough.

    A key with more than ``_BLOCK`` paragraphs is cut into blocks, and each pair of blocks is compared by itself.
    """
    keyed = nodes.select("h1", "h2", F.explode(F.array(*[f"k{i}" for i in range(BANDS)])).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = materialize(sizes.select("key", F.ceil(F.col("n") / _BLOCK).cast("int").alias("blocks")))
    members = keyed.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("h1", "h2"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = members.withColumn("other", other).select(
        "h1", "h2", "key", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    members = members.join(nodes.select("h1", "h2", "shingles"), ["h1", "h2"])
    cells = members.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def links(h1: np.ndarray, block: np.ndarray, sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        one, two = _similar([np.frombuffer(s, np.uint64) for s in sets], block, similarity)
        root = roots(len(h1), one, two)
        left = np.flatnonzero(root != np.arange(len(h1)))
        return h1[left], h1[root[left]]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            frame = batch.to_pandas()
            held = frame if held is None else type(frame)(
                {c: np.concatenate([held[c].to_numpy(), frame[c].to_numpy()]) for c in frame.columns}
            )
            cell = held[["key", "low", "high"]].to_numpy()
            edge = np.flatnonzero((np.diff(cell, axis=0) != 0).any(axis=1)) + 1
            for a, b in zip([0, *edge[:-1]], edge):
                yield from group(held.iloc[a:b])
            held = held.iloc[edge[-1] if len(edge) else 0 :]
        if held is not None and len(held):
            yield from group(held)

    def group(rows) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            a, b = links(rows["h1"].to_numpy(), rows["block"].to_numpy(), rows["shingles"].tolist())
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return cells.select("key", "low", "high", "h1", "block", "shingles").mapInArrow(run, "a bigint, b bigint")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole(text_col)
    return docs.select(named(id_col).alias("id"), F.xxhash64(named(id_col), text).alias("doc"), text.alias("text"))


def _passages(docs: DataFrame, id_col: str, text_col: str, similarity: float, min_words: int) -> DataFrame:
    rows = _rows(docs, id_col, text_col)
    shared = materialize(_shared_paragraphs(rows, _filter(_keys(rows))))
    nodes = shared.groupBy("h1", "h2").agg(*[F.first(f"k{i}").alias(f"k{i}") for i in range(BANDS)], F.first("shingles").alias("shingles"))
    group = connected_components(materialize(_near_links(nodes, similarity))).withColumnRenamed("node", "h1")
    places = shared.select("id", "doc", "ordinal", "start", "stop", "words", "h1", "h2")
    places = materialize(
        places.join(group, "h1", "left").select(
            "id", "doc", "ordinal", "start", "stop", "words",
            F.coalesce("component", "h1").alias("g1"), F.when(F.col("component").isNull(), F.col("h2")).otherwise(0).alias("g2"),
        )
    )
    # the document that keeps a passage: the smallest identifier, a null one last
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("doc")))
    owner = places.groupBy("g1", "g2").agg(first.alias("keep"), F.min("doc").alias("one"), F.max("doc").alias("two"))
    owner = owner.filter("one <> two").select("g1", "g2", F.col("keep.id").alias("keep_id"), F.col("keep.doc").alias("keep_doc"))
    found = places.join(owner, ["g1", "g2"]).withColumn("removed", F.col("doc") != F.col("keep_doc"))
    found = found.dropDuplicates(["doc", "ordinal"])
    # paragraphs in a row, of one document, that are all removed or all kept make one passage
    order = Window.partitionBy("doc").orderBy("ordinal")
    new = (F.lag("removed").over(order) != F.col("removed")) | (F.lag(F.col("ordinal") + F.col("words")).over(order) != F.col("ordinal"))
    found = found.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
    found = found.groupBy("doc", "run").agg(
        F.first("id").alias("id"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("n_words"),
        F.min_by("keep_id", "ordinal").alias("keep_id"), F.first("removed").alias("removed"),
    )
    return found.filter(F.col("n_words") >= min_words)


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, min_words: int = 15
) -> DataFrame:
    """Every passage of ``docs`` that stands in more than one document: one row per place, none for other documents.

    Returns ``id_col, start, stop`` (UTF-8 bytes of the text), ``n_words, keep_id, removed``. Texts are cut into paragraphs
    by their content; paragraphs that share one of the MinHash bands are joined and their exact Jaccard similarity over
    five-word shingles (A-Z lower-cased) is verified; links are clustered by components. In each cluster the document
    with the smallest identifier keeps its paragraphs, all others lose theirs. Paragraphs in a row form a passage, which
    counts from ``min_words`` words.

    A first pass finds the band keys that documents share, with a combine before its shuffle; a filter of fixed size
    lets only paragraphs with such a key through the second pass. A key of many different paragraphs is compared in
    blocks. Repeats within a document alone are left. Rows with equal identifier and text are one document. A null text
    counts as empty, and a null identifier comes last. An empty table gives an empty result. Other columns are not read.
    """
    found = _passages(docs, id_col, text_col, similarity, min_words)
    return found.select(
        F.col("id").alias(id_col), "start", "stop", F.col("n_words").cast("bigint").alias("n_words"), "keep_id", "removed"
    )


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, similarity: float = 0.8, min_words: int = 15
) -> DataFrame:
    """``docs`` without the repeated passages that another document keeps; rows left with nothing but space go.

    Untouched rows are passed on as they are. ``size_col`` is set to the new number of code points where a text changes.
    """
    found = _passages(docs, id_col, text_col, similarity, min_words).filter("removed")
    spans = found.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    columns = carried(docs, None, [])
    rows = docs.select(
        F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(columns)]).alias("row"), F.xxhash64(named(id_col), whole(text_col)).alias("doc")
    ).join(materialize(spans), "doc", "left")
    # the text is taken from the row after the join, so that it is moved once
    text = F.col(f"row.c{[c.lower() for c in columns].index(text_col.lower())}").cast("string")
    rows = rows.withColumn("text", F.coalesce(text, F.lit("")))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                if (cut := spans.as_py()) is None:
                    texts.append(None)
                    continue
                data, parts, at = text.as_py().encode(), [], 0
                for span in cut:
                    parts.append(data[at : span["start"]])
                    at = max(at, span["stop"])
                texts.append(b"".join([*parts, data[at:]]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "rest"])

    rows = rows.select("row", "text", "spans")
    left = rows.mapInArrow(run, f"row {dict(rows.dtypes)['row']}, rest string")
    left = left.filter(F.col("rest").isNull() | (F.btrim("rest", F.lit(SPACES)) != ""))
    changed = {text_col: F.col("rest")} | ({size_col: F.char_length("rest").cast(dict(docs.dtypes)[size_col])} if size_col else {})
    return left.select(*[
        (F.when(F.col("rest").isNotNull(), changed[c]).otherwise(F.col(f"row.c{i}")) if c in changed else F.col(f"row.c{i}")).alias(c)
        for i, c in enumerate(columns)
    ])
