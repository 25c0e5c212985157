"""Text cleaning as native column expressions: no Python runs per row.

Every function takes and returns a ``Column``; null is treated as ``''``.
"""

from __future__ import annotations

import string
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# The articles dropped from titles, and the characters that count as whitespace.
ARTICLES = ("the", "a", "an")
# Characters below 256 are listed one by one and the rest sits behind one range test,
# because the regex engine looks single characters up in a table.
_WIDE_SPACE = r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
_SPACE_NOT_BLANK = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0" + _WIDE_SPACE
SPACE = " " + _SPACE_NOT_BLANK
_ASCII_WORD = string.ascii_letters + string.digits + "_"
CASED = r"\p{IsUppercase}\p{IsLowercase}\p{Lt}"

_RARE = r"[^\x00-\xa7\xa9-\xbb\xbf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u01c3\u2010-\u2023\u20a0-\u20a7\u20a9-\u20ff]"
_HANGUL_FIRST, _HANGUL_LAST = 0xAC00, 0xD7A3
_JAMO_L = "".join(chr(0x1100 + i) for i in range(19))
_JAMO_V = "".join(chr(0x1161 + i) for i in range(21))
_JAMO_T = "".join(chr(0x11A8 + i) for i in range(27))


def _text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(""))


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Compatibility decompositions without combining marks, from the Unicode database.

    Returns (characters with a one-character form, those forms followed by
    nothing for pure marks, longer expansions). Hangul syllables follow an
    arithmetic rule and are left out.
    """
    one_from, one_to, dropped, longer = [], [], [], {}
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp < 0xE000 or _HANGUL_FIRST <= cp <= _HANGUL_LAST:
            continue
        ch = chr(cp)
        bare = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if bare == ch:
            continue
        if not bare:
            dropped.append(ch)
        elif len(bare) == 1:
            one_from.append(ch)
            one_to.append(bare)
        else:
            longer[ch] = bare
    return "".join(one_from + dropped), "".join(one_to), longer


@lru_cache(maxsize=1)
def _longer_class() -> str:
    """A regex class of the characters that expand to several, written as ranges."""
    points = sorted(ord(ch) for ch in _decompositions()[2])
    ranges: list[list[int]] = []
    for cp in points:
        if ranges and cp == ranges[-1][1] + 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    body = "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in ranges)
    return rf"[{body}\x{{{_HANGUL_FIRST:x}}}-\x{{{_HANGUL_LAST:x}}}]"


def _expand_char(ch: Column) -> Column:
    longer = _decompositions()[2]
    keys, values = "".join(longer), "\x00".join(longer.values())
    table = F.split(F.lit(values), "\x00")
    at = F.position(ch, F.lit(keys))
    s = F.ascii(ch) - _HANGUL_FIRST
    tail = F.pmod(s, F.lit(28))
    hangul = F.concat(
        F.substr(F.lit(_JAMO_L), F.floor(s / 588).cast("int") + 1, F.lit(1)),
        F.substr(F.lit(_JAMO_V), F.floor(F.pmod(s, F.lit(588)) / 28).cast("int") + 1, F.lit(1)),
        F.when(tail > 0, F.substr(F.lit(_JAMO_T), tail, F.lit(1))).otherwise(F.lit("")),
    )
    return (
        F.when(s.between(0, _HANGUL_LAST - _HANGUL_FIRST), hangul)
        .when(at > 0, F.element_at(table, at))
        .otherwise(ch)
    )


def strip_diacritics(c: Column | str) -> Column:
    """Compatibility-decompose and drop combining marks: ``Cézanne`` -> ``Cezanne``.

    Letters without a decomposition (``ł``, ``ø``, ``đ``, ``ß``) stay. ASCII
    text is passed through; only text with ligatures, fractions or Hangul pays
    for the per-character branch.
    """
    c = _text(c)
    source, target, _ = _decompositions()
    # common Latin text is told apart by a small class before the large one is tried
    spread = F.when(
        c.rlike(_RARE) & c.rlike(_longer_class()),
        F.array_join(F.transform(F.split(c, ""), _expand_char), ""),
    ).otherwise(c)
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.translate(spread, source, target)).otherwise(c)


def strip_parentheticals(c: Column | str) -> Column:
    """Remove every ``(...)`` group."""
    return F.regexp_replace(_text(c), r"\([^)]*\)", "")


def replace_delimiters(c: Column | str) -> Column:
    """``&`` becomes `` and ``; hyphen, underscore and slash become spaces."""
    return F.regexp_replace(F.replace(_text(c), F.lit("&"), F.lit(" and ")), "[-_/]", " ")


def remove_punctuation(c: Column | str) -> Column:
    """Keep letters, digits, underscore and whitespace of any script."""
    return F.regexp_replace(_text(c), rf"[^{_ASCII_WORD}{SPACE}\p{{L}}\p{{N}}]+", "")


def collapse_whitespace(c: Column | str) -> Column:
    """Whitespace runs become one space; the ends are trimmed."""
    # single spaces are already right and are not matched
    return F.trim(F.regexp_replace(_text(c), f" [{SPACE}]+|[{_SPACE_NOT_BLANK}][{SPACE}]*", " "))


def _drop_article(c: Column | str, pattern: str) -> Column:
    c = _text(c)
    flat = collapse_whitespace(c)
    return F.when(flat.rlike(pattern), F.regexp_replace(flat, pattern, "")).otherwise(c)


def strip_leading_article(c: Column | str) -> Column:
    """Drop a leading article unless it is the only token."""
    return _drop_article(c, f"^({'|'.join(ARTICLES)}) ")


def strip_trailing_article(c: Column | str) -> Column:
    """Drop a trailing article unless it is the only token."""
    return _drop_article(c, f" ({'|'.join(ARTICLES)})$")


def normalize_name(c: Column | str) -> Column:
    """Normal form of a name: no marks, groups, delimiters or punctuation; lower case."""
    cleaned = remove_punctuation(replace_delimiters(strip_parentheticals(strip_diacritics(c))))
    return collapse_whitespace(F.lower(cleaned))


def normalize_title(c: Column | str) -> Column:
    """Normal form of a title: a name form without trailing, then leading article."""
    flat = normalize_name(c)  # already collapsed, so the patterns apply directly
    flat = F.regexp_replace(flat, f" ({'|'.join(ARTICLES)})$", "")
    return F.regexp_replace(flat, f"^({'|'.join(ARTICLES)}) ", "")


def title_case(c: Column | str) -> Column:
    """Capital at the start of every letter run: ``o'keeffe`` -> ``O'Keeffe``."""
    pieces = F.split(_text(c), rf"(?<=[^{CASED}])|(?=[^{CASED}])")
    return F.array_join(F.transform(pieces, F.initcap), "")


def sorted_tokens(norm: Column | str) -> Column:
    """Tokens of a normal form in code-point order, repeats kept."""
    return F.array_join(F.array_sort(F.split(_text(norm), " ")), " ")


def token_set(norm: Column | str) -> Column:
    """Tokens of a normal form in code-point order, repeats dropped."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(_text(norm), " "))), " ")


def or_default(c: Column | str, default: str) -> Column:
    """``default`` for null and for the empty string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(c)
