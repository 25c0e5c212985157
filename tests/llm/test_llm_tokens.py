"""Byte-level BPE against the public library, packing, and nearest neighbours against brute force."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vernissage.llm.byte_bpe import cut, decode, encode, merge_long, merge_many, merge_pairs, read_ranks
from vernissage.llm.neighbours import nearest_neighbours
from vernissage.llm.packing import pack, sum_of_squares, word_encoder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "  ", "a  b", " a", "a ", "\n\n x\ty \n", "don't  'll x's it'S", " é 　 x y\x1c\x1d z", "=" * 300 + "  " + "ab" * 400,
    "日本語テキスト 中文 123456 ½²", "a\n b\n  c \n", "x" * 3000, " \n" * 50, "A🙂🙂B ́x", "ΣΑΣ Σ İstanbul ẞ", "<|endoftext|> x", "ꟉᲉx",
]


@pytest.mark.parametrize("dictionary", [1_000_000, 0])
def test_ids_match_the_library_and_decode_to_the_text(spark, dictionary):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    rows = [*enumerate(ODD), (None, "a b"), (50, None), (51, "twice"), (51, "twice")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, ids string")
    found = encode(docs, RANKS, public_tokenizers.PATTERN, dictionary=dictionary)
    got = sorted([(r.doc_id, bytes(r.ids)) for r in found.collect()], key=str)
    assert got == sorted([(i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in rows], key=str)
    texts = sorted([(r.doc_id, bytes(r.decoded).decode()) for r in decode(found, RANKS).collect()], key=str)
    assert texts == sorted([(i, t or "") for i, t in rows], key=str)


def test_no_rows_no_ids(spark):
    assert encode(spark.createDataFrame([], "doc_id bigint, text string"), RANKS, public_tokenizers.PATTERN).collect() == []


def test_long_words_merge_alike():
    ranks = read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pairs, single = merge_pairs(ranks), [ranks[bytes([b])] for b in range(256)]
    rng = np.random.default_rng(0)
    for word in ("a" * 5000, "ab" * 777, "".join(rng.choice(list("aeinorst"), 4000))):
        assert merge_long([single[b] for b in word.encode()], pairs) == library.encode_ordinary(word)


def test_words_of_a_batch_merge_in_the_same_rounds():
    ranks = read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    single, merges = np.array([ranks[bytes([b])] for b in range(256)]), sorted(merge_pairs(ranks).items())
    keys, into = np.array([(a << 20) + b for (a, b), _ in merges]), np.array([rank for _, rank in merges])
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list(letters), size)) for letters in ("etaoin", "aé日🙂") for size in (1, 2, 3, 9, 40, 200) for _ in range(20)]
    words += ["a" * 256, "", " x", "x", ""]
    want = [library._core_bpe.encode_single_piece(word.encode()) if word else [] for word in words]
    assert merge_many(pa.array(words), single, keys, into).to_pylist() == want
    assert merge_many(pa.array([], pa.string()), single, keys, into).to_pylist() == []


def test_texts_cut_into_the_words_of_the_pattern():
    find = regex.compile(public_tokenizers.PATTERN).findall
    for texts in (ODD * 2, ["a b\x00c", "a b a", "\na b\n"], [""], []):
        words, numbers, sizes = cut(pa.array(texts, pa.string()), find)
        assert sizes.tolist() == [len(find(t)) for t in texts]
        assert words.take(pa.array(numbers)).to_pylist() == [word for t in texts for word in find(t)]


def test_rare_words_stay_in_their_task(spark):
    """Folded in their own row, they went from Python to the JVM and back, at some 30 microseconds for each occurrence."""
    docs = spark.createDataFrame([(i, f"word{i} again") for i in range(9)], "doc_id bigint, text string")
    found = encode(docs, RANKS, public_tokenizers.PATTERN, dictionary=0, with_text=True)
    assert [bytes(r.decoded).decode() for r in found.orderBy("doc_id").collect()] == [f"word{i} again" for i in range(9)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "lambda" not in plan


def test_word_ids_match_the_library():
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    encode_word = word_encoder(open(WORDS).read())
    for text in ODD:
        assert np.frombuffer(encode_word(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_sum_of_squares_fits_and_is_near_the_bound():
    sizes = np.sort(np.random.default_rng(2).integers(1, 1000, 3000))[::-1]
    bins, offsets = sum_of_squares(sizes, 1000)
    order = np.lexsort((offsets, bins))
    for number in np.unique(bins):
        own = order[bins[order] == number]
        assert np.array_equal(offsets[own], np.concatenate(([0], np.cumsum(sizes[own])[:-1]))) and sizes[own].sum() <= 1000
    assert len(np.unique(bins)) <= 1.01 * sizes.sum() / 1000 + 1


def test_packing_places_every_token_once(spark):
    tokenizer = Tokenizer.from_file(WORDS)
    rows = [(i, "word number %d " % i * (i % 40)) for i in range(200)] + [(900, None), (901, "long text " * 900), (None, "x"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, offset int")
    found = pack(docs, WORDS, capacity=64, shard_rows=100).collect()
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1.05 * sum(r.length for r in found) / 64 + 3
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[start : start + 64], "<u4")
            want.append((i, piece, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found], key=str) == sorted(want, key=str)
    assert pack(docs.limit(0), WORDS).collect() == []


def brute_neighbours(rows, asked, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q in asked:
        if q in ok:
            unit = ok[q] / np.linalg.norm(ok[q])
            score = sorted((-(unit @ v / np.linalg.norm(v)), i) for i, v in ok.items() if i != q)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(score[:k], 1)]
    return out


def test_neighbours_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((1500, 16)))]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    stored = [(i, np.float32(v).tolist()) for i, v in rows]
    asked = range(0, 1500, 50)
    found = nearest_neighbours(frame, frame.filter("vec_id % 50 = 0"), leaf=64, rounds=3).collect()
    want = brute_neighbours(stored, asked, 5)
    hits = {(r.query_id, r.vec_id) for r in found} & {(q, i) for q, _, i, _ in want}
    assert len(hits) >= 0.9 * len(want) and len(found) == len(want)
    vectors = {i: np.array(v) for i, v in stored}
    for r in found:
        a, b = vectors[r.query_id], vectors[r.vec_id]
        assert r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_neighbours_of_copies_and_unusable_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [1.0, 2.0]) for i in range(8)] + [(20, [2.0, 1.0]), (21, [-1.0, 0.0]), (22, [0.0, 0.0]), (23, None), (24, [nan, 1.0]),
            (25, [inf, 1.0]), (26, [None, 1.0]), (None, [1.0, 2.0]), (20, [2.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, score int")
    found = nearest_neighbours(frame, frame.filter("vec_id in (0, 7, 20, 22, 23)")).collect()
    got = sorted((r.query_id, r.rank, r.vec_id) for r in found)
    assert got == sorted((q, n, i) for q, n, i, _ in brute_neighbours(dict(r for r in rows if r[0] is not None).items(), [0, 7, 20], 5))
    few = frame.filter("vec_id in (0, 20)")
    assert sorted((r.query_id, r.vec_id) for r in nearest_neighbours(few, few).collect()) == [(0, 20), (20, 0)]
    assert nearest_neighbours(frame.limit(0), frame.limit(0)).collect() == []


def test_smaller_ids_win_among_many_vectors_of_one_direction(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((300, 8)), 1000)]
    rows += [(int(i), [2.0 ** (n % 7 - 3), 2.0 ** (n % 7 - 2), 0.0, 0.0, 0.0, 0.0, 0.0, float(n % 2) * 0.0]) for n, i in enumerate(rng.permutation(600)[:60])]
    rows = [(i, [x * (1 + (i % 5)) for x in v]) if i < 600 else (i, v) for i, v in rows]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = sorted(i for i, _ in rows if i < 600)[-3:] + [1000, 1001]
    found = nearest_neighbours(frame, frame.filter(F.col("vec_id").isin(asked)), leaf=64, rounds=3).collect()
    exact = {(q, n): round(s, 9) for q, n, i, s in brute_neighbours(rows, asked, 5)}
    assert {(r.query_id, r["rank"]): round(r.score, 9) for r in found} == exact
    assert all(r.vec_id < 600 for r in found if r.query_id < 600)
