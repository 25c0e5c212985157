"""Cleaning functions against literal cases and against the Unicode database."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from vernissage.functions import text

CASES = [
    (text.strip_diacritics, "Cézanne", "Cezanne"),
    (text.strip_diacritics, "Münch", "Munch"),
    (text.strip_diacritics, "Dürer", "Durer"),
    (text.strip_diacritics, "Gauguin", "Gauguin"),
    (text.strip_diacritics, "", ""),
    (text.strip_diacritics, None, ""),
    (text.strip_diacritics, "Łukasz Ørsted ß", "Łukasz Ørsted ß"),
    (text.strip_diacritics, "ﬁgure ½", "figure 1⁄2"),
    (text.strip_parentheticals, "Water Lilies (1916)", "Water Lilies "),
    (text.strip_parentheticals, "No parens here", "No parens here"),
    (text.strip_parentheticals, "a (b) c (d", "a  c (d"),
    (text.replace_delimiters, "Mother & Child", "Mother  and  Child"),
    (text.replace_delimiters, "jean-baptiste_camille/corot", "jean baptiste camille corot"),
    (text.remove_punctuation, "O'Keeffe, Georgia.", "OKeeffe Georgia"),
    (text.collapse_whitespace, "  a   b\t c ", "a b c"),
    (text.strip_leading_article, "the starry night", "starry night"),
    (text.strip_leading_article, "a sunday afternoon", "sunday afternoon"),
    (text.strip_leading_article, "an actor", "actor"),
    (text.strip_leading_article, "starry night", "starry night"),
    (text.strip_leading_article, "the", "the"),
    (text.strip_leading_article, " then  more", " then  more"),
    (text.strip_leading_article, "  the  red\tsea ", "red sea"),
    (text.strip_trailing_article, "starry night the", "starry night"),
    (text.strip_trailing_article, "starry night", "starry night"),
    (text.normalize_name, "Vincent van Gogh", "vincent van gogh"),
    (text.normalize_name, "Paul Cézanne", "paul cezanne"),
    (text.normalize_name, "O'Keeffe, Georgia", "okeeffe georgia"),
    (text.normalize_name, "Rembrandt (workshop)", "rembrandt"),
    (text.normalize_name, "", ""),
    (text.normalize_name, None, ""),
    (text.normalize_title, "The Starry Night", "starry night"),
    (text.normalize_title, "Starry Night, The", "starry night"),
    (text.normalize_title, "Guernica", "guernica"),
    (text.normalize_title, "Mother & Child", "mother and child"),
    (text.normalize_title, "Mother and Child", "mother and child"),
    (text.normalize_title, "The A", "the"),
    (text.title_case, "rene bertholo", "Rene Bertholo"),
    (text.title_case, "o'keeffe ABDÜLMECID II x2y", "O'Keeffe Abdülmecid Ii X2Y"),
    (text.token_set, "john french sloan john", "french john sloan"),
    (text.sorted_tokens, "john french sloan john", "french john john sloan"),
    (lambda c: text.or_default(c, "d"), None, "d"),
    (lambda c: text.or_default(c, "d"), "", "d"),
    (lambda c: text.or_default(c, "d"), "x", "x"),
]


def test_literal_cases(spark):
    # one small frame per function, unioned into a single job
    by_fn = {}
    for i, (fn, given, _) in enumerate(CASES):
        by_fn.setdefault(fn, []).append((i, given))
    parts = [
        spark.createDataFrame(rows, "i int, s string").select("i", fn(F.col("s")).alias("out"))
        for fn, rows in by_fn.items()
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    got = {r.i: r.out for r in union.collect()}
    wrong = [(CASES[i][1], got[i], want) for i, (_, _, want) in enumerate(CASES) if got[i] != want]
    assert not wrong


def _bare(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def test_diacritics_agree_with_unicode_on_every_character(spark):
    chars = [
        chr(cp) for cp in range(1, 0x30000)
        if not 0xD800 <= cp < 0xE000 and (cp < 0xAC00 or cp > 0xD7A3 or cp % 7 == 0)
    ]
    lines = ["".join(chars[i : i + 40]) for i in range(0, len(chars), 40)]
    df = spark.createDataFrame([(s,) for s in lines], "s string").repartition(4)
    rows = df.select("s", text.strip_diacritics("s").alias("out")).collect()
    wrong = [r.s for r in rows if r.out != _bare(r.s)]
    assert not wrong, [hex(ord(c)) for c in wrong[0]][:5]


@pytest.mark.parametrize("s", ["a\x1cb", "a b", "a b　", "᠎a b"])
def test_whitespace_is_the_unicode_notion(spark, s):
    df = spark.createDataFrame([(s,)], "s string")
    assert df.select(text.collapse_whitespace("s").alias("o")).first().o == re.sub(r"\s+", " ", s).strip()
