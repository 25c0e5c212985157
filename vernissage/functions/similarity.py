"""String similarity from the longest common subsequence (LCS).

``ratio = 2 * LCS / (len a + len b)``, scaled to 0..100 and rounded half to
even; the score is 0 when a side is empty. LCS uses the published bit-parallel
recurrence ``u = S & M; S = (S + u) | (S - u)``, here on numpy words with one
lane per pair, so an Arrow batch is scored at once. Longer strings take several
words, and the sum carries from each word to the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from vernissage.functions.text import sorted_tokens

_WORD = 64
#: Characters of the longer strings, times words of the shorter ones, that are scored at once: of one word, and of several.
_LANES, _MANY_LANES = 1 << 16, 1 << 21
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_END_A, _END_B = np.uint32(0xFFFFFFFE), np.uint32(0xFFFFFFFF)


def _codes(texts: list[str], end: np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """Code points as a matrix, short rows padded with ``end``; and the lengths."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    out = np.full((len(texts), max(1, int(lengths.max(initial=0)))), end, dtype=np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out, lengths


def _position_masks(short: np.ndarray, long: np.ndarray) -> list[np.ndarray]:
    """For every character of ``long``, the bits of its positions in ``short``, a word for each 64 of them."""
    words = -(-short.shape[1] // _WORD)
    if words == 1:
        mask = np.zeros(long.shape, dtype=np.uint64)
        for i in range(short.shape[1]):
            mask |= (long == short[:, i : i + 1]).astype(np.uint64) << np.uint64(i)
        return [mask]
    pair = np.arange(len(short), dtype=np.uint64)[:, None] << np.uint64(32)
    known, at = np.unique(pair | short, return_inverse=True)
    place = np.arange(short.shape[1])
    table = np.zeros((len(known) + 1, words), dtype=np.uint64)  # the last row is for characters that do not occur
    np.bitwise_or.at(table, (at.reshape(short.shape), np.broadcast_to(place // _WORD, short.shape)), np.uint64(1) << (place % _WORD).astype(np.uint64))
    wanted = pair | long
    row = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    row[known[row] != wanted] = len(known)
    return [table[:, w][row] for w in range(words)]


def _full(m: np.ndarray, words: int) -> list[np.ndarray]:
    """The bits of all positions of strings of length ``m``."""
    out = []
    for w in range(words):
        bits = np.clip(m - w * _WORD, 0, _WORD).astype(np.uint64)
        out.append(np.where(bits == _WORD, _ALL, (np.uint64(1) << np.minimum(bits, np.uint64(_WORD - 1))) - np.uint64(1)))
    return out


def _step(state: list[np.ndarray], hits: list[np.ndarray], full: list[np.ndarray]) -> None:
    """One step of the recurrence in place, lowest word first."""
    carry = None
    for w, (s, hit, f) in enumerate(zip(state, hits, full)):
        u = s & hit
        total, rest = s + u, s - u
        if w + 1 < len(state):
            over = total < u
            if carry is not None:
                total += carry
                over |= total < carry
        elif carry is not None:
            total += carry
        s[...] = (total | rest) & f
        if w + 1 < len(state):
            carry = over.astype(np.uint64)


def _ones(state: list[np.ndarray]) -> np.ndarray:
    return sum(np.bitwise_count(s).astype(np.int64) for s in state)


def _score(lcs: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.rint(200.0 * lcs / np.maximum(total, 1)).astype(np.int32)


def _in_chunks(short: list[str], long: list[str], kernel) -> np.ndarray:
    """Score pairs in the order of their sizes, so padding stays small and a chunk takes bounded memory."""
    scores = np.zeros(len(short), dtype=np.int32)
    words = np.array([max(1, -(-len(t) // _WORD)) for t in short], dtype=np.int64)
    lengths = np.array([max(1, len(t)) for t in long], dtype=np.int64)
    order, start = np.lexsort((lengths, words)), 0
    while start < len(order):
        stop, longest = start + 1, int(lengths[order[start]])
        while stop < len(order):
            longest = max(longest, int(lengths[order[stop]]))
            deep = int(words[order[stop]])
            if (stop + 1 - start) * deep * longest > (_LANES if deep == 1 else _MANY_LANES) or deep > 2 * words[order[start]]:
                break
            stop += 1
        pick = order[start:stop]
        scores[pick] = kernel(*_prepare([short[i] for i in pick], [long[i] for i in pick]))
        start = stop
    return scores


def _prepare(short: list[str], long: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Position masks and both lengths of every pair."""
    a, m = _codes(short, _END_A)
    b, n = _codes(long, _END_B)
    return _position_masks(a, b), m, n


def _whole(masks: list[np.ndarray], m: np.ndarray, n: np.ndarray) -> np.ndarray:
    full = _full(m, len(masks))
    state = [f.copy() for f in full]
    columns = [np.ascontiguousarray(mask.T) for mask in masks]
    for t in range(masks[0].shape[1]):
        _step(state, [c[t] for c in columns], full)
    return np.where((m > 0) & (n > 0), _score(m - _ones(state), m + n), 0)


def _windowed(masks: list[np.ndarray], m: np.ndarray, n: np.ndarray) -> np.ndarray:
    width = masks[0].shape[1]
    full = [f[:, None] for f in _full(m, len(masks))]
    state = [np.repeat(f, width, axis=1) for f in full]
    for t in range(min(int(m.max(initial=0)), width)):  # one lane per start, one step per window offset
        active = np.where(t < m, _ALL, np.uint64(0))[:, None]
        _step([s[:, : width - t] for s in state], [mask[:, t:] & active for mask in masks], full)
    starts = np.arange(width)
    window = np.minimum(m[:, None], np.maximum(n[:, None] - starts, 0))
    best = np.where(window > 0, 200.0 * (m[:, None] - _ones(state)) / np.maximum(m[:, None] + window, 1), 0.0).max(axis=1)
    return np.where((m > 0) & (n > 0), np.rint(best), 0).astype(np.int32)


def _ordered(a: pa.Array, b: pa.Array) -> tuple[list[str], list[str]]:
    pairs = [(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist())]
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in pairs]
    return [x for x, _ in pairs], [y for _, y in pairs]


def _both(masks: list[np.ndarray], m: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.maximum(_whole(masks, m, n), _windowed(masks, m, n))


def ratio_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(_in_chunks(*_ordered(a, b), _whole), pa.int32())


def partial_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(_in_chunks(*_ordered(a, b), _windowed), pa.int32())


def sequence_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(_in_chunks(*_ordered(a, b), _both), pa.int32())


def _udf(batch):
    # Marked non-deterministic so that filtering on the score does not evaluate it twice.
    @F.arrow_udf("int")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        return batch(a, b)

    return score.asNondeterministic()


def indel_ratio(a: Column | str, b: Column | str) -> Column:
    """Similarity of two whole strings, 0..100."""
    return _udf(ratio_batch)(a, b)


def partial_indel_ratio(a: Column | str, b: Column | str) -> Column:
    """Best similarity of the shorter string with any window of the longer one."""
    return _udf(partial_batch)(a, b)


def token_sort_score(a: Column, b: Column) -> Column:
    """Similarity of the sorted tokens of two normal forms."""
    return indel_ratio(sorted_tokens(a), sorted_tokens(b))


def sequence_score(a: Column | str, b: Column | str) -> Column:
    """The larger of whole and partial similarity."""
    return _udf(sequence_batch)(a, b)


def register(spark) -> None:
    """Make the scores available to SQL as ``indel_ratio`` and ``partial_indel_ratio``."""
    spark.udf.register("indel_ratio", _udf(ratio_batch))
    spark.udf.register("partial_indel_ratio", _udf(partial_batch))
