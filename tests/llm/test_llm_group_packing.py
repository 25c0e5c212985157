"""First-fit decreasing in groups against the tokenizer itself, a plain first fit, and awkward lengths."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from vernissage.llm import group_packing
from vernissage.llm.group_packing import byte_encoder, first_fit, pack_groups, place

WORDS = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "a  b", " a", "a ", "a  ", "   a", "\n\n x\ty \n", "a\n \nb", "a \n b", "a\n  b", "x \x85 y\xa0z　  w", "don't  'll x's it'S 're",
    "\x1c \x1d a\x1e b \x1f", "日本語テキスト 中文 123456 ½²", " \n" * 50, "A🙂🙂B ́x", "x" * 3000, "<|endoftext|>", "a <|endoftext|> b<|endoftext|>  c<|endo", "tab\t\ttab \t x",
    "\u1680\u2003x\u2009 \u2028y \u202f\u205f\u3000 z\u200b \ufeff c", "Größe, naïve; école! ¿qué? 12,5 %", "end of line \n", " lead", "ꟉᲉx  \U0001fae8", "a​ b﻿ c",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def encoder():
    return byte_encoder(open(WORDS).read())


def test_ids_match_the_library(library, encoder):
    for text in ODD:
        assert np.frombuffer(encoder(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=400, deadline=None)
@given(text=st.text(st.sampled_from(list(" \n\t\r\x0b\x85\xa0\u3000ab'sSé1½,.!日Σ<|>\x1c\u0301")), max_size=30))
def test_ids_of_any_text(library, encoder, text):
    assert np.frombuffer(encoder(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 50), max_size=80))
def test_first_fit_takes_the_first_bin_with_room(sizes):
    bins, offsets = first_fit(sizes, 50)
    left = []
    for size, number, offset in zip(sizes, bins, offsets):
        want = next((k for k, room in enumerate(left) if room >= size), len(left))
        if want == len(left):
            left.append(50)
        assert (number, offset) == (want, 50 - left[want])
        left[want] -= size


def no_gaps(places, capacity, slack):
    """Sequences have no gaps, and none is padded by more than the slack."""
    sequences = {}
    for number, offset, length in places:
        sequences.setdefault(number, []).append((offset, length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and (capacity - at <= slack or at & (at - 1) == 0)
    return len(sequences)


@given(st.lists(st.integers(1, 63), min_size=1, max_size=120))
def test_places_are_whole_and_little_padded(sizes):
    sizes = np.sort(np.array(sizes))[::-1]
    placed = place(sizes, 64, 2)
    no_gaps(zip(placed["bin"], placed["offset"], placed["length"]), 64, 2)
    for item, own in placed.groupby("item"):
        own = own.sort_values("begin")
        assert own["begin"].tolist() == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() == sizes[item]
    assert set(placed["item"]) == set(range(len(sizes)))


def test_every_token_is_placed_once(spark, library):
    rows = [(i, f"word number {i} " * (i % 40)) for i in range(300)] + [(900, None), (901, "long text " * 900), (None, "x"), (7, "again"), (7, "again"), (903, "a<|endoftext|>b")]
    rows += [(1000 + i, "the same copy " * 15) for i in range(200)]  # a hot group whose length leaves much room
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, offset int, n int")
    found = pack_groups(docs, WORDS, capacity=64, slack=2, group_rows=150).collect()
    no_gaps([(r.sequence_id, r.offset, r.length) for r in found], 64, 2)
    ids = {(i, t): np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in rows}
    want = sorted(len(ids[r]) for r in rows)
    starts = [r for r in found if r.start == 0]
    assert sorted(r.doc_tokens for r in starts) == want and sum(r.length for r in found) == sum(want)
    texts = {}
    for (i, t), own in ids.items():
        texts.setdefault(i, []).append(own)
    for r in found:
        assert any(len(own) == r.doc_tokens and zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for own in texts[r.doc_id])
    spans = {}
    for r in found:
        spans.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
    for i, own in spans.items():
        assert sorted(own) == sorted(x for (j, t) in rows if j == i for x in range(len(ids[(j, t)])))


def test_nothing_to_pack(spark):
    assert pack_groups(spark.createDataFrame([], "doc_id bigint, text string"), WORDS).collect() == []
    assert pack_groups(spark.createDataFrame([(None, None)], "doc_id bigint, text string"), WORDS).first()[1:5] == (0, 1, zlib.crc32(b"\1\0\0\0"), 1)


def test_a_worker_keeps_its_encoder(spark, library, monkeypatch):
    """One task after the other finds what the worker has met, and it starts again when that is much."""
    def run(batches):
        from vernissage.llm.group_packing import kept_encoder

        words = open(WORDS).read()
        for batch in batches:
            kept_encoder(words)
        builds = kept_encoder.cache_info().misses
        yield type(batch).from_pydict({"id": [builds]})

    docs = spark.createDataFrame([(i, text) for i, text in enumerate(ODD)], "doc_id bigint, text string")
    pack_groups(docs.repartition(9), WORDS, capacity=64).count()
    assert {r[0] for r in spark.range(40).repartition(12).mapInArrow(run, "id bigint").collect()} == {1}
    monkeypatch.setattr(group_packing, "_REMEMBERED", 3)
    encode = group_packing.kept_encoder(open(WORDS).read())
    for text in ODD * 2:
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
