"""Phrase counting in burst tries and collocations against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from vernissage.llm import collocations as module
from vernissage.llm.collocations import PhraseTrie, WordBook, _counted, collocations, plain


def brute(rows, most_words=5, least=100, percent=100, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, most_words + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    candidates, out = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}, {}
    for (lang, p), a in candidates.items():
        cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        longer = [f for (other, q), f in candidates.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if not any(100 * f >= percent * a for f in longer):
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]], totals[lang]))
    return sorted((lang, rank, p.decode(), -a, l, r, n, -s) for lang, own in out.items() for rank, (s, a, p, l, r, n) in enumerate(sorted(own)[:top], 1))


def check(spark, rows, partitions=3, **options):
    docs = spark.createDataFrame([(lang, text, "x", 1) for lang, text in rows], "lang string, text string, phrase string, n int").repartition(partitions)
    assert sorted(map(tuple, collocations(docs, **options).collect())) == brute(rows, **options)


@pytest.fixture(scope="module")
def rows():
    rng, rows = random.Random(7), []
    words = ["the", "of", "Ab", "cd", "é", "日本", "x-y", "don't", "it", "ß", "ÀB"]
    for i in range(150):
        text = [rng.choice(words[: 4 + i % 8]) for _ in range(rng.randint(0, 60))]
        for _ in range(3):
            text.insert(rng.randint(0, len(text)), rng.choice(["New York City", "new york", "a b c d e", "a b c d e", "a a a a a a a", "very\tmuch  so"]))
        rows.append((rng.choice(["en", "de", None, ""]), rng.choice([" ", "  ", " \t"]).join(text).replace("it", rng.choice([", it", "it.\n", "it"]))))
    return rows + [("en", None), ("en", ""), (None, " , . \x0b!"), ("fr", "few words here"), ("de", "the of " * 3000), rows[0], rows[0], ("a\nb", "q r " * 40)]


@pytest.mark.parametrize("least, percent, most_words, top", [(12, 100, 5, 2000), (5, 60, 5, 25), (8, 100, 2, 2000), (20, 90, 4, 7), (3, 30, 7, 2000)])
def test_collocations_match_brute_force(spark, rows, least, percent, most_words, top):
    check(spark, rows, least=least, percent=percent, most_words=most_words, top=top)


def test_small_memory_spills_and_gives_the_same(spark, rows, monkeypatch):
    for name, value in {"_MOST_PHRASES": 40, "_BURST": 3, "_MOST_WORDS": 6, "_BLOCK": 50, "_BYTES": 100}.items():
        monkeypatch.setattr(module, name, value)
    check(spark, rows, least=5)


def test_nothing_to_find(spark):
    check(spark, [])
    check(spark, [("en", "a b"), (None, None)])
    check(spark, [("en", "a b")], least=1)


def test_language_may_be_absent(spark):
    docs = spark.createDataFrame([("a b. a b", 1)], "text string, lang int")
    assert [tuple(r) for r in collocations(docs, lang_col=None, least=2).collect()] == [("und", 1, "a b", 2, 2, 2, 4, 2000)]


def test_trie_counts_bursts_and_spills_whole_subtrees(monkeypatch):
    monkeypatch.setattr(module, "_BURST", 5)
    rng, trie, want, got = np.random.default_rng(1), PhraseTrie(3), Counter(), Counter()
    for _ in range(30):
        rows = rng.integers(2, 9, (200, 3))
        want.update(map(tuple, rows.tolist()))
        trie.add(*_counted(rows))
        if trie.size > 150:
            before = set(trie.roots)
            spilled, counts = trie.spill(60)
            assert trie.size <= 60 and not set(spilled[:, 0].tolist()) & set(trie.roots) and set(spilled[:, 0].tolist()) | set(trie.roots) == before
            got.update({tuple(r): n for r, n in zip(spilled.tolist(), counts.tolist())})
    assert any(branched for branched, _ in trie.roots.values())
    spilled, counts = trie.spill(0)
    got.update({tuple(r): n for r, n in zip(spilled.tolist(), counts.tolist())})
    assert got == want and trie.size == 0 and not trie.roots


def test_words_of_a_text():
    book, every = WordBook(), np.full(module._FILTER_BITS >> 3, 255, np.uint8)
    parts = list(plain("A b,a\t c\n\n É".encode()))
    assert book.numbers(b"en", b" \n ".join(parts), every).tolist() == [2, 3, 1, 2, 4, 1, 1, 5, 1] and book.words[2:] == [b"a", b"b", b"c", "É".encode()]
    assert WordBook().numbers(b"en", b"a b \n a", every * 0).tolist() == [1, 1, 1, 1, 1]
