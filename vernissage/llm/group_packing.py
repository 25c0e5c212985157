"""Packing of tokenised documents by first-fit decreasing over a tournament tree, in randomised groups."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from vernissage.llm.common import hash128, named, slices, tidy, whole
from vernissage.session import materialize

#: White space of the tokenizer's pattern (\s).
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Distinct chunks that a worker remembers before it starts again, and the longest of them.
_REMEMBERED, _LONGEST = 1_000_000, 64
#: From this character on, tables of letters and digits differ between versions of Unicode.
_OWN_TABLES = "\u0250"


def byte_encoder(vocabulary: str) -> Callable[[str], bytes]:
    """An encoder by the content of a byte-level ``tokenizers`` file: text to its ids as little-endian 32-bit integers.

    The file's added tokens are cut out of the raw text and give their own ids. A space with a visible character on either
    side is always the edge of a token, so the chunks between such spaces are encoded by themselves, each once while it is
    remembered; within a chunk the tokenizer's own model merges each match of its pattern.
    """
    from tokenizers import Tokenizer

    tokenizer, added = Tokenizer.from_str(vocabulary), {}
    for token in json.loads(vocabulary).get("added_tokens") or []:
        if any(token.get(flag) for flag in ("normalized", "lstrip", "rstrip", "single_word")):
            raise ValueError(f"added token {token['content']!r} is matched otherwise than as it stands")
        added[token["content"]] = struct.pack("<I", token["id"])
    if tokenizer.normalizer is not None or tokenizer.pre_tokenizer.pre_tokenize_str("a")[0][0] != "a":
        raise ValueError("a vocabulary with a normaliser or a prefix space is beyond this encoder")
    model, before = tokenizer.model, tokenizer.pre_tokenizer
    # the letter of each byte: itself where it is printable, else one from 256 on
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in printable]
    letters = {b: 256 + hidden.index(b) if b in hidden else b for b in range(256)}
    pattern = regex.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
    )
    edge, unusual = re.compile(f"(?<=[^{_WHITE}]) | (?=[^{_WHITE}])"), re.compile(rf" (?=[{_WHITE}]|\Z)")

    packers, space = [struct.Struct(f"<{n}I").pack for n in range(33)], chr(letters[0x20])

    def merged(token: str) -> bytes:
        found = [t.id for t in model.tokenize(token)]
        return packers[len(found)](*found) if len(found) < len(packers) else struct.pack(f"<{len(found)}I", *found)

    class Words(dict):
        """Ids of a match of the pattern."""

        def __missing__(self, token: str) -> bytes:
            found = merged(token.encode().decode("latin-1").translate(letters))
            if len(token) <= _LONGEST:
                self[token] = found
            return found

    words = Words()
    marks = {mark: words[mark] for mark in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"}

    def fresh(chunk: str) -> bytes:
        if not chunk:
            return b""
        if max(chunk) < _OWN_TABLES:
            return b"".join(map(words.__getitem__, pattern.findall(chunk)))
        # beyond that the tokenizer's own tables tell letters and digits
        return b"".join([merged(piece) for piece, _ in before.pre_tokenize_str(chunk)])

    class Spaced(dict):
        """Ids of a space and a chunk, by the chunk."""

        def __missing__(self, chunk: str) -> bytes:
            if chunk.isascii() and chunk.isalpha():
                found = merged(space + chunk)
            elif chunk.isalpha() and max(chunk) < _OWN_TABLES:
                found = words[" " + chunk]
            elif (mark := marks.get(chunk[-1:])) and chunk[:-1].isalpha():  # a word and the mark behind it are two tokens
                found = self[chunk[:-1]] + mark
            else:
                found = fresh(" " + chunk)
            if len(chunk) <= _LONGEST:
                self[chunk] = found
            return found

    spaced = Spaced()

    def encode(text: str) -> bytes:
        if len(spaced) + len(words) > _REMEMBERED:
            spaced.clear()
            words.clear()
        chunks = edge.split(text) if unusual.search(text) else text.split(" ")
        return b"".join([fresh(chunks[0]), *map(spaced.__getitem__, chunks[1:])])

    if not added:
        return encode
    cuts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    heads = {token[0] for token in added}

    def encode_all(text: str) -> bytes:
        if not any(head in text for head in heads):
            return encode(text)
        return b"".join([added[part] if i % 2 else encode(part) for i, part in enumerate(cuts.split(text))])

    return encode_all


@lru_cache(maxsize=1)
def kept_encoder(vocabulary: str) -> Callable[[str], bytes]:
    """The encoder of a worker: built once, and what it remembers serves all its tasks, as most of the time goes to new chunks."""
    return byte_encoder(vocabulary)


def first_fit(sizes: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the given order: the first bin with room, found from the root of a tournament tree.

    The leaves hold what each bin has left, every node the larger of its two children.
    """
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
    return bins, offsets


def _powers(n: int) -> list[int]:
    """The powers of two that make up ``n``, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def place(sizes: np.ndarray, capacity: int, slack: int) -> pd.DataFrame:
    """Places of items, largest first: ``item, begin, length, bin, offset``; ``begin`` is over 0 in an item that was cut.

    First-fit decreasing; then the bins that lack more than ``slack`` and are not filled to a power of two are emptied, and
    their items, end to end, are cut into full bins, what remains at the end into bins filled to powers of two.
    """
    bins, offsets = first_fit(sizes.tolist(), capacity)
    filled = np.bincount(bins, weights=sizes).astype(np.int64)
    poor = (capacity - filled > slack) & (filled & (filled - 1) != 0)
    loose = poor[bins]
    kept = pd.DataFrame({"item": np.flatnonzero(~loose), "begin": 0, "length": sizes[~loose], "bin": bins[~loose], "offset": offsets[~loose]})
    items = np.flatnonzero(loose)
    items = items[np.lexsort((offsets[items], bins[items]))]  # what stood together stays together
    total = int(sizes[items].sum())
    if not total:
        return kept
    widths = [capacity] * (total // capacity) + _powers(total % capacity)
    edges = np.concatenate(([0], np.cumsum(widths)))
    starts = np.cumsum(sizes[items]) - sizes[items]
    cuts = np.union1d(starts, edges[:-1])
    owner = np.searchsorted(starts, cuts, side="right") - 1
    target = np.searchsorted(edges, cuts, side="right") - 1
    cut = pd.DataFrame({
        "item": items[owner], "begin": cuts - starts[owner], "length": np.diff(np.append(cuts, total)),
        "bin": len(filled) + target, "offset": cuts - edges[target],
    })
    return pd.concat([kept, cut], ignore_index=True)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, h1, h2, text``; two hashes tell what a row holds."""
    h1, h2 = hash128(named(id_col), whole(text_col))
    return docs.select(named(id_col).alias("id"), h1.alias("h1"), h2.alias("h2"), whole(text_col).alias("text"))


def _pieces(rows: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """Every document in pieces of ``capacity`` tokens and a rest: ``id, h1, h2, start, length, ids_crc32, doc_tokens``."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = kept_encoder(vocabulary), struct.pack("<I", end_id)
        for batch in slices(batches):
            row, start, length, crc, tokens = [], [], [], [], []
            for i, text in enumerate(batch.column(3)):
                ids = encode(text.as_py()) + end
                for at in range(0, len(ids), 4 * capacity):
                    part = ids[at : at + 4 * capacity]
                    row.append(i), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    tokens.append(len(ids) // 4)
            row = pa.array(row, pa.int64())
            columns = [batch.column(i).take(row) for i in range(3)] + [pa.array(x, pa.int64()) for x in (start, length, crc, tokens)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "h1", "h2", "start", "length", "ids_crc32", "doc_tokens"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, h1 bigint, h2 bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def _sums(rows: DataFrame, spans: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """``h1, h2, start, length, ids_crc32`` of pieces given without their sum, from documents encoded again."""
    wanted = spans.groupBy("h1", "h2").agg(F.collect_set(F.struct("start", "length")).alias("spans"))  # a document's own cuts
    texts = rows.select("h1", "h2", "text").join(materialize(wanted), ["h1", "h2"]).dropDuplicates(["h1", "h2"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = kept_encoder(vocabulary), struct.pack("<I", end_id)
        for batch in slices(batches):
            row, start, length, crc = [], [], [], []
            for i, (text, spans) in enumerate(zip(batch.column(2), batch.column(3))):
                ids = encode(text.as_py()) + end
                for span in spans.as_py():
                    at, n = span["start"], span["length"]
                    row.append(i), start.append(at), length.append(n), crc.append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
            row = pa.array(row, pa.int64())
            columns = [batch.column(i).take(row) for i in range(2)] + [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "start", "length", "ids_crc32"])

    return texts.mapInArrow(run, "h1 bigint, h2 bigint, start bigint, length bigint, ids_crc32 bigint")


def pack_groups(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1,
    slack: int = 16, group_rows: int = 32_768, seed: int = 42,
) -> DataFrame:
    """Place every token of ``docs`` in sequences of at most ``capacity`` tokens with little padding: one row per piece.

    Returns ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``. Documents are encoded whole and end with
    ``end_id``. Their full pieces are sequences of their own. The rests are dealt at random into groups of about
    ``group_rows`` documents, and each group is packed by itself, first fit, largest first, the fitting bin being found in a
    tournament tree. A sequence that then lacks more than ``slack`` tokens, unless its length is a power of two, is given up,
    and its documents are cut to fill others of their kind; so no sequence is padded by more than ``slack`` tokens,
    whatever the lengths are, and few documents are cut where lengths vary.

    A task holds the numbers of one group; how many documents a source or a group of copies has is of no matter. Documents
    that were cut are encoded once more to sum up their pieces. A null or empty text is the end token alone. A null
    identifier is kept, and repeated rows are packed each for itself. An empty table gives an empty result. Other columns
    are not read, whatever their names.
    """
    content = Path(vocabulary).read_text()  # travels with the job: executors need no such file
    texts = _rows(docs, id_col, text_col)
    found = _pieces(texts, content, capacity, end_id)
    found = materialize(found.withColumn("n", F.monotonically_increasing_id()))
    kind, numbers = dict(found.dtypes)["id"], ["n", "id", "h1", "h2", "start", "length", "ids_crc32", "doc_tokens"]
    rest = found.filter(F.col("length") < capacity).select(numbers)
    groups = max(1, -(-rest.count() // group_rows))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "n"], ascending=[False, True], ignore_index=True)
        placed = place(rows["length"].to_numpy(), capacity, slack)
        item = placed["item"].to_numpy()
        out = rows.iloc[item].reset_index(drop=True)
        cut = placed["length"].to_numpy() != out["length"].to_numpy()
        out["start"] = out["start"] + placed["begin"].to_numpy()
        out["ids_crc32"] = out["ids_crc32"].astype("Int64").mask(cut)
        for column in ("length", "bin", "offset"):
            out[column] = placed[column].to_numpy()
        return out

    schema = f"n bigint, id {kind}, h1 bigint, h2 bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    grouped = rest.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "n"), F.lit(groups)).cast("int")).groupBy("grp")
    placed = materialize(grouped.applyInPandas(run, f"{schema}, grp int, bin bigint, offset bigint"))
    cut = materialize(placed.filter("ids_crc32 is null").drop("ids_crc32"))
    if not cut.isEmpty():
        keys = ["h1", "h2", "start", "length"]
        sums = materialize(_sums(texts, cut.select(keys).distinct(), content, end_id))
        placed = placed.filter("ids_crc32 is not null").unionByName(cut.join(sums, keys))
    placed = placed.withColumn("sequence_id", (F.col("bin") * groups + F.col("grp")) * 2)
    full = found.filter(F.col("length") == capacity).select(
        *numbers, (F.col("n") * 2 + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    columns = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.select("id", *columns).unionByName(full.select("id", *columns)).withColumnRenamed("id", id_col)
