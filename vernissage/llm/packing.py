"""Packing of tokenised documents into sequences by the sum-of-squares rule."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from vernissage.llm.common import named, tidy, whole
from vernissage.session import materialize

#: What the tokenizer's pattern takes as white space (\s).
_WHITE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
#: White space of Python that is none of the tokenizer's.
_ODD = re.compile("[\x1c-\x1f]")
#: Distinct chunks that a task remembers before it starts again.
_REMEMBERED = 500_000


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


def word_encoder(vocabulary: str) -> Callable[[str], bytes]:
    """An encoder by the content of a ``tokenizers`` file with word ends: text to its ids as little-endian 32-bit integers.

    The file's added tokens count as plain text here, see ``text_encoder``.
    White space separates tokens, so each chunk between white space is encoded once and remembered; within a chunk the
    tokenizer's own model merges each match of its pattern.
    """
    from tokenizers import Tokenizer

    tokenizer, letters = Tokenizer.from_str(vocabulary), _byte_letters()
    model, before, normal = tokenizer.model, tokenizer.pre_tokenizer, tokenizer.normalizer.normalize_str
    pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+")
    space = re.compile(f"[{_WHITE}]+")
    words: dict[str, bytes] = {}

    def ids_of(token: str) -> bytes:
        return np.array([t.id for t in model.tokenize(token)], "<u4").tobytes()

    def word(token: str) -> bytes:
        found = words.get(token)
        if found is None:
            found = words[token] = ids_of("".join([letters[b] for b in token.encode()]))
        return found

    class Chunks(dict):
        def __missing__(self, chunk: str) -> bytes:
            if max(chunk) < "\u0250":
                found = b"".join([word(t) for t in pattern.findall(chunk)])
            else:  # the tokenizer's own tables of letters and digits
                found = b"".join([ids_of(t) for t, _ in before.pre_tokenize_str(chunk)])
            self[chunk] = found
            return found

    chunks = Chunks()

    def encode(text: str) -> bytes:
        if len(chunks) > _REMEMBERED:
            chunks.clear()
            words.clear()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if any(unicodedata.category(c) == "Cn" for c in set(text)):  # newer than Python's tables
                text = normal(text)
        if "Σ" in text:  # one character at a time: no final form
            text = text.replace("Σ", "σ")
        text = text.lower()
        parts = filter(None, space.split(text)) if _ODD.search(text) else text.split()
        return b"".join(map(chunks.__getitem__, parts))

    return encode


def text_encoder(vocabulary: str) -> Callable[[str], bytes]:
    """As ``word_encoder``, with the file's added tokens: they are cut out of the raw text first and give their own ids."""
    encode, ids = word_encoder(vocabulary), {}
    for token in json.loads(vocabulary).get("added_tokens") or []:
        if any(token.get(flag) for flag in ("normalized", "lstrip", "rstrip", "single_word")):
            raise ValueError(f"added token {token['content']!r} is matched otherwise than as it stands")
        ids[token["content"]] = np.array([token["id"]], "<u4").tobytes()
    if not ids:
        return encode
    added = re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")")
    heads = {token[0] for token in ids}

    def encode_all(text: str) -> bytes:
        if not any(head in text for head in heads):
            return encode(text)
        parts = added.split(text)  # texts and added tokens in turn
        if len(parts) == 1:
            return encode(text)
        return b"".join([ids[part] if i % 2 else encode(part) for i, part in enumerate(parts)])

    return encode_all


def pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of every document: ``id, piece, start, length, ids_crc32``; only longer documents are cut."""
    kind = docs.select(named(id_col)).schema[0].dataType.simpleString()
    content = Path(vocabulary).read_text()  # travels with the job: executors need no such file

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = text_encoder(content), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(named(id_col).alias("id"), whole(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item, placed in the given order where the squared counts of gaps grow least.

    ``count[g]`` open bins have ``g`` left. Moving one from gap ``g`` to ``g - s`` changes the sum of squares by
    ``2 (count[g - s] - count[g]) + 2``, closing it by ``1 - 2 count[s]``; a bin that the item fills is closed at once, and
    the smallest gap wins on equal terms. A new bin is opened where no open one has room: with few items for many different
    gaps the rule alone opens bins early that nothing fills later.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, last, never = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0, 1 << 60
    for i, size in enumerate(sizes.tolist()):
        at = capacity
        if size < capacity and count[size]:
            at = size
        elif size < capacity:
            change = np.where(count[size:capacity] > 0, count[: capacity - size] - count[size:capacity], never)
            k = int(change.argmin())
            if change[k] < never:
                at = size + k
        if at == capacity:
            number, last = last, last + 1
        else:
            number = open_bins[at].pop()
            count[at] -= 1
        bins[i], offsets[i] = number, capacity - at
        if at > size:
            open_bins[at - size].append(number)
            count[at - size] += 1
    return bins, offsets


def pack(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1,
    shard_rows: int = 50_000,
) -> DataFrame:
    """Place every token of ``docs`` in sequences of at most ``capacity`` tokens: one row per piece of a document.

    Returns ``id_col, piece, start, length, ids_crc32, sequence_id, offset``. Documents are encoded whole, added tokens of
    the vocabulary included, and end with ``end_id``; only those of over ``capacity`` tokens are cut. Full pieces are sequences of their own. The others are
    dealt by hash into shards of about ``shard_rows`` pieces, which are packed independently, largest first; a shard
    leaves few unfilled sequences, so their share does not grow with the data. A task holds numbers of one shard.

    A null or empty text is the end token alone. A null identifier is kept, repeated rows are packed each for itself. An
    empty table gives an empty result. Other columns are not read, whatever their names.
    """
    found = materialize(pieces(docs, id_col, text_col, vocabulary, capacity, end_id))
    kind = dict(found.dtypes)["id"]
    partial = found.filter(F.col("length") < capacity)
    shards = max(1, -(-partial.count() // shard_rows))
    # the row number of the written table spreads repeated rows, and is the same when a task runs again
    shard = F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)).cast("int")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        rows["bin"], rows["offset"] = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows

    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, shard int, bin bigint, offset bigint"
    packed = partial.withColumn("shard", shard).groupBy("shard").applyInPandas(run, schema)
    full = found.filter(F.col("length") == capacity).withColumn("offset", F.lit(0).cast("bigint"))
    full = full.withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1)
    packed = packed.withColumn("sequence_id", (F.col("bin") * shards + F.col("shard")) * 2).drop("shard", "bin")
    columns = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return packed.unionByName(full).select(F.col("id").alias(id_col), *columns)
