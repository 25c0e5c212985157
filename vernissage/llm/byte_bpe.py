"""Byte-level BPE: ranked merges folded by Spark over the bytes of distinct words, and decoding."""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from vernissage.llm.common import named, slices, tidy, whole
from vernissage.session import materialize

#: What the pattern takes as white space (\s).
_WHITE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
#: A space next to other white space or at an end: such texts are matched whole instead of being cut at spaces.
_UNEVEN = rf"\A | \z|[{_WHITE}] | [{_WHITE}]"
#: Words of more bytes are merged by a heap: the cost of merging in rounds grows with the square of the length.
_LONG = 256
_BUCKETS = 1 << 17
#: So many bytes of text are held in pieces at a time.
_SLICE = 16 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The token of each rank in a ``tiktoken`` rank file; a token's rank is its id."""
    lines = Path(path).read_bytes().split(b"\n")
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}


def merge_pairs(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Which two ids may merge, and into which: every cut of a token into two tokens."""
    cuts = ((ranks.get(t[:i]), ranks.get(t[i:]), rank) for t, rank in ranks.items() for i in range(1, len(t)))
    return {(a, b): rank for a, b, rank in cuts if a is not None and b is not None}


def _rank_map(pairs: dict[tuple[int, int], int]) -> Callable[[Column, Column], Column]:
    """A literal map from two ids to the id of their merge, or null: hashed buckets, as Spark scans a map from its start."""
    buckets: list[list[int]] = [[] for _ in range(_BUCKETS)]
    for (a, b), rank in pairs.items():
        buckets[(a * 50261 + b) % _BUCKETS].append((a << 40) + (b << 20) + rank)
    literal = _literal(buckets)

    def look(a: Column, b: Column) -> Column:
        a, b = a.cast("bigint"), b.cast("bigint")
        key = F.shiftleft(a, 20) + b
        own = F.get(literal, F.pmod(a * 50261 + b, F.lit(_BUCKETS)).cast("int"))
        return F.get(F.filter(own, lambda v: F.shiftright(v, 20) == key), F.lit(0)).bitwiseAND(F.lit((1 << 20) - 1)).cast("int")

    return look


def _literal(values: list) -> Column:
    """A literal array, nested as ``values`` are; written as JSON, which Spark reads once when it plans."""
    kind = T.LongType() if isinstance(values[0], list) else T.IntegerType()
    kind = T.ArrayType(T.ArrayType(kind)) if isinstance(values[0], list) else T.ArrayType(kind)
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), kind)


def merge_fold(ranks: dict[bytes, int], pairs: dict[tuple[int, int], int]) -> Callable[[Column], Column]:
    """From a word's bytes (an array of numbers) to its ids: folds merges of the leftmost pair of the lowest rank.

    The fold keeps the rank of every neighbouring pair; a merge looks up the two pairs that it makes.
    """
    look, single = _rank_map(pairs), [ranks[bytes([b])] for b in range(256)]
    first = _literal([pairs.get((x, y)) for x in single for y in single])
    letters, none = _literal(single), F.array().cast("array<int>")

    def step(state: Column, _: Column) -> Column:
        ids, left = state["ids"], state["ranks"]

        def merged(pair: Column) -> Column:
            low, at = pair["low"], pair["at"]
            before = F.when(at > 1, F.array(look(F.get(ids, at - 2), low))).otherwise(none)
            after = F.when(at < F.size(left), F.array(look(low, F.get(ids, at + 1)))).otherwise(none)
            return F.struct(
                F.concat(F.slice(ids, F.lit(1), at - 1), F.array(low), F.slice(ids, at + 2, F.size(ids))).alias("ids"),
                F.concat(F.slice(left, F.lit(1), F.greatest(at - 2, F.lit(0))), before, after, F.slice(left, at + 2, F.size(left))).alias("ranks"),
            )

        low = F.array_min(left)
        pair = F.struct(low.alias("low"), F.array_position(left, low).cast("int").alias("at"))
        return F.when(low.isNull(), state).otherwise(F.transform(F.array(pair), merged)[0])

    def fold(word: Column) -> Column:
        start = F.struct(
            F.transform(word, lambda b: F.get(letters, b)).alias("ids"),
            F.slice(F.transform(word, lambda b, i: F.get(first, b * 256 + F.get(word, i + 1))), 1, F.size(word) - 1).alias("ranks"),
        )
        folded = F.aggregate(F.sequence(F.lit(1), F.size(word) - 1), start, step, lambda state: state["ids"])
        return F.when(F.size(word) < 2, F.transform(word, lambda b: F.get(letters, b))).otherwise(folded)

    return fold


def merge_long(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The same merges for one long word, with a heap of candidates: about ``n log n`` steps."""
    after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
    ids, heap = list(ids), []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0 and (rank := pairs.get((ids[i], ids[after[i]]))) is not None:
            heapq.heappush(heap, (rank, i, ids[i], ids[after[i]]))

    for i in range(len(ids)):
        offer(i)
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i]
        if ids[i] != left or j < 0 or ids[j] != right:
            continue
        ids[i], ids[j], after[i] = rank, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(i)
        offer(before[i])
    return [x for x in ids if x >= 0]


def merge_many(words: pa.Array, single: np.ndarray, keys: np.ndarray, ranks: np.ndarray) -> pa.ListArray:
    """The same merges for many words at once, each in rounds of one merge; ``keys`` are the sorted pairs ``a << 20 | b``."""
    none = np.iinfo(np.int64).max

    def look(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 20) + b
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, ranks[at], none)

    sizes, number = pc.binary_length(words).to_numpy().astype(np.int64), np.arange(len(words))
    done = [(number[sizes == 0], sizes[sizes == 0], single[:0])]
    number, sizes = number[sizes > 0], sizes[sizes > 0]
    ids = single[np.frombuffer(b"".join(words.cast(pa.binary()).to_pylist()), np.uint8)]
    left = np.full(len(ids), none)  # the rank of the pair that begins here; none where a word ends
    inner = np.ones(len(ids), bool)
    inner[np.cumsum(sizes) - 1] = False
    begin = np.flatnonzero(inner)
    left[begin] = look(ids[begin], ids[begin + 1])
    while len(number):
        starts = np.cumsum(sizes) - sizes
        low = np.minimum.reduceat(left, starts)
        ended = low == none
        if ended.any():
            mine = np.repeat(ended, sizes)
            done.append((number[ended], sizes[ended], ids[mine]))
            ids, left, number, sizes, low = ids[~mine], left[~mine], number[~ended], sizes[~ended], low[~ended]
        if not len(number):
            break
        hits = np.flatnonzero(left == np.repeat(low, sizes))
        owner = np.searchsorted(np.cumsum(sizes), hits, "right")
        at = hits[np.append(True, owner[1:] != owner[:-1])]  # the leftmost of each word
        ids[at] = low
        stay = np.ones(len(ids), bool)
        stay[at + 1] = False
        left[at] = left[at + 1]  # none if the word ends there now
        ids, left, sizes, at = ids[stay], left[stay], sizes - 1, at - np.arange(len(at))
        starts = np.cumsum(sizes) - sizes
        after, before = at[at + 1 < starts + sizes], at[at > starts] - 1
        left[after], left[before] = look(ids[after], ids[after + 1]), look(ids[before], ids[before + 1])
    number, sizes, ids = map(np.concatenate, zip(*done))
    return lists(ids, sizes).take(pa.array(np.argsort(number)))


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Numbers, cut into lists of the given sizes."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, pa.int32()))


def binaries(data: pa.Buffer | None, ends: np.ndarray) -> pa.Array:
    """Bytes, cut into values at the given places."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), data or pa.py_buffer(b"")])


def cut(texts: pa.Array, find: Callable[[str], list[str]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, the numbers of all words in their order, and how many each text has.

    No match of the pattern crosses from a word into white space, so a text is cut at its spaces first, and each
    distinct piece is matched once; a piece keeps the space before it.
    """
    marked = pc.binary_join_element_wise("\n", texts, "")  # a text's first piece has no space before it
    uneven = pc.match_substring_regex(texts, _UNEVEN)
    pieces = pc.split_pattern(marked.filter(pc.invert(uneven)), " ")
    if len(pieces) < len(texts):
        kept = marked.filter(uneven)
        order = np.argsort(uneven.to_numpy(zero_copy_only=False), kind="stable")
        pieces = pa.concat_arrays([pieces, pa.ListArray.from_arrays(pa.array(range(len(kept) + 1), pa.int32()), kept)])
        pieces = pieces.take(pa.array(np.argsort(order)))
    numbered = pieces.flatten().dictionary_encode()
    found = [find(p[1:] if p[0] == "\n" else " " + p) for p in numbered.dictionary.to_numpy(zero_copy_only=False)]
    words = pa.array(chain.from_iterable(found), pa.string()).dictionary_encode()
    of_piece = lists(words.indices.to_numpy(), np.fromiter(map(len, found), np.int64, len(found))).take(numbered.indices)
    ends = of_piece.offsets.to_numpy()[pieces.offsets.to_numpy()]
    return words.dictionary, of_piece.flatten().to_numpy(), np.diff(ends)


def count_words(docs: DataFrame, pattern: str) -> DataFrame:
    """``word, n``: the matches of ``pattern`` in all texts (``text``), counted within tasks before the shuffle."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        for batch in slices(batches, _SLICE):
            words, numbers, _ = cut(batch.column(0), find)
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(numbers, minlength=len(words)))], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int, most_bytes: int = 64) -> DataFrame:
    """The most frequent words, at most ``most`` of at most ``most_bytes``; equal steps of frequency stay together."""
    step = F.floor(8 * F.log2("n")).cast("int")
    counts = counts.filter(F.octet_length("word") <= most_bytes).withColumn("step", step)
    bar, total = 1 << 30, 0
    for row in counts.groupBy("step").count().orderBy(F.desc("step")).collect():  # at most 8 x 63 rows
        total += row["count"]
        if total > most:
            break
        bar = row["step"]
    return counts.filter(F.col("step") >= bar).select("word")


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    dictionary: int = 750_000, with_text: bool = False,
) -> DataFrame:
    """``id_col, ids`` for every row: the ids of the whole text as little-endian 32-bit integers in one binary.

    Spark counts the distinct words (matches of ``pattern``) of all texts. Higher-order functions fold the ranked merges
    over the bytes of the frequent ones, against a literal rank map; the at most ``dictionary`` results, of at most 64
    bytes each, are broadcast. A task merges the other words of its texts once per slice, all of them in the same rounds
    over arrays, so no text is shuffled and no word is left out. Words of over 256 bytes are merged by a heap.
    ``with_text`` adds ``decoded``, the decoded bytes.

    A null or empty text has no ids. A null identifier is kept, repeated rows repeat their result, an empty table gives an
    empty result. Other columns are not read, whatever their names.
    """
    ranks = read_ranks(ranks_path)
    pairs = merge_pairs(ranks)
    fold, single = merge_fold(ranks, pairs), [ranks[bytes([b])] for b in range(256)]
    tokens = sorted(ranks, key=ranks.get)
    kind = docs.select(named(id_col)).schema[0].dataType.simpleString()
    rows = docs.select(named(id_col).alias("id"), whole(text_col).alias("text"))

    @tidy
    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = [list(word.as_py().encode()) for word in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(states, pa.list_(pa.int32()))], ["word", "state"])

    words = frequent_words(materialize(count_words(rows, pattern)), dictionary)
    words = words.mapInArrow(as_bytes, "word string, state array<int>").select("word", fold(F.col("state")).alias("ids"))
    known = materialize(words).toArrow()
    names, known = known["word"].combine_chunks(), known["ids"].combine_chunks()
    known = lists(known.flatten().to_numpy(), known.value_lengths().to_numpy())
    merges = np.array(sorted(((a << 20) + b, rank) for (a, b), rank in pairs.items()), np.int64).reshape(-1, 2)
    table = {"names": names, "known": known, "keys": merges[:, 0].copy(), "ranks": merges[:, 1].copy(), "tokens": pa.array(tokens, pa.binary())}
    shared = docs.sparkSession.sparkContext.broadcast(table)
    del names, known, merges, table, pairs, tokens, ranks

    @tidy
    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, find = shared.value, regex.compile(pattern).findall
        names, known, keys, ranks = held["names"], held["known"], held["keys"], held["ranks"]

        def ids_of(words: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
            """Lists of ids, and which of them is whose: those of the dictionary, then those that are merged here."""
            own = pc.index_in(words, value_set=names).fill_null(-1).to_numpy().copy()
            size = pc.binary_length(words).to_numpy()
            short, long = np.flatnonzero((own < 0) & (size <= _LONG)), np.flatnonzero((own < 0) & (size > _LONG))
            if len(long) and "pairs" not in held:
                held["pairs"] = dict(zip(zip((keys >> 20).tolist(), (keys & (1 << 20) - 1).tolist()), ranks.tolist()))
            heaped = [merge_long([single[b] for b in word.encode()], held["pairs"]) for word in words.take(long).to_pylist()]
            own[short], own[long] = len(known) + np.arange(len(short)), len(known) + len(short) + np.arange(len(long))
            merged = merge_many(words.take(short), np.array(single), keys, ranks)
            return pa.concat_arrays([known, merged, pa.array(heaped, known.type)]), own

        for batch in slices(batches, _SLICE):
            words, numbers, sizes = cut(batch.column(1), find)
            found, own = ids_of(words)
            found = found.take(pa.array(own[numbers]))
            ends, ids = found.offsets.to_numpy()[np.append(0, np.cumsum(sizes))], found.flatten()
            columns = [batch.column(0), binaries(pa.py_buffer(ids.to_numpy().astype("<u4")), 4 * ends)]
            if with_text:
                _, offsets, data = held["tokens"].take(ids).buffers()
                columns.append(binaries(data, np.frombuffer(offsets, np.int32)[ends]))
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])

    found = rows.mapInArrow(look_up, f"id {kind}, ids binary" + ", decoded binary" * with_text)
    return found.withColumnRenamed("id", id_col)


def decode(rows: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, decoded``: the bytes of each row's ids, joined; null ids give no bytes, an unknown id fails."""
    ranks = read_ranks(ranks_path)
    tokens = sorted(ranks, key=ranks.get)
    kind = rows.select(named(id_col)).schema[0].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join([tokens[i] for i in np.frombuffer(ids.as_py() or b"", "<u4").tolist()]) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["id", "decoded"])

    ids = rows.select(named(id_col).alias("id"), named(ids_col).alias("ids"))
    return ids.mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)
