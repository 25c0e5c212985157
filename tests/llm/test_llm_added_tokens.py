"""Added tokens of the vocabulary inside texts, against the library as it is set by default."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from vernissage.llm.packing import pack, text_encoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "hello <|endoftext|> world", "<|endoftext|>", "<|startoftext|>a<|endoftext|><|endoftext|>b", "<|ENDOFTEXT|> <|endoftext |>",
    "x<|endoftext|>́y", "ΑΣ<|startoftext|>Σ İ", "<|endof<|endoftext|>text|>", "a\n <|endoftext|> \x1c 日本", "", "plain 'll", "<|endoftext|> x " * 40,
]


def test_ids_of_added_tokens_match_the_library():
    tokenizer, encode = Tokenizer.from_file(WORDS), text_encoder(open(WORDS).read())
    for text in TEXTS:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_sees_added_tokens(spark):
    tokenizer = Tokenizer.from_file(WORDS)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    want = []
    for i, text in enumerate(TEXTS):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        for start in range(0, len(ids), 64):
            part = np.array(ids[start : start + 64], "<u4")
            want.append((i, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in pack(docs, WORDS, capacity=64).collect()) == sorted(want)
