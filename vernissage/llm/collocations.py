"""Phrases whose words belong together, counted in burst tries that spill sorted runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from vernissage.llm.common import LOWER, UPPER, named, tidy, whole
from vernissage.llm.substring_dedup import _FILTER_BITS, _filter, _mix
from vernissage.session import materialize

#: A-Z in lower case, tab as space, and every character that ends a piece as a line feed.
_PLAIN = bytes.maketrans((UPPER + "\t.,;:!?\x0b\x0c\r").encode(), (LOWER + " " + "\n" * 9).encode())
#: Numbers that stand for an empty string between two spaces and for the end of a piece.
_NOTHING, _END = 0, 1
#: Bytes of a text, and of texts, that are handled at once; texts are cut between pieces only.
_BYTES, _BLOCK = 1 << 20, 6 << 20
#: Words that a task numbers before it starts again, words or phrases that it holds, and those of one container.
_MOST_WORDS, _MOST_PHRASES, _BURST = 400_000, 700_000, 4096
#: Word numbers take so many bits where several are packed.
_BITS = 21
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_POWERS = np.cumprod(np.full(4096, _ODD[0]))
#: Language, line feed and the first word, or the first two of three and more; the other words; how often.
_RUNS = "prefix string, rest string, n bigint"


def plain(text: bytes) -> Iterator[bytes]:
    """A text in parts that end with a piece: words between spaces, line feeds of their own between pieces."""
    text, at = text.translate(_PLAIN), 0
    while at < len(text):
        end = text.find(b"\n", at + _BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].replace(b"\n", b" \n ")
        at = end + 1


def split(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """The different words of a plain text, line feeds and empty strings among them, and which of them stands where."""
    words = pc.split_pattern(pa.array([text], pa.binary()), b" ").flatten().dictionary_encode()
    return words.dictionary, words.indices.to_numpy()


def lang_hash(lang: bytes) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang))


def _lengths(words: pa.Array) -> np.ndarray:
    return np.diff(np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1])


def word_hashes(words: pa.Array, lang: np.uint64 | np.ndarray) -> np.ndarray:
    """Hashes of words by their bytes and the hash of their language."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    starts, lengths = offsets[:-1] - offsets[0], np.diff(offsets)
    place = (np.arange(len(data)) - np.repeat(starts, lengths)) & (len(_POWERS) - 1)
    value = np.append((data.astype(np.uint64) + np.uint64(1)) * _POWERS[place], np.uint64(0))
    total = np.add.reduceat(value, starts) if len(starts) else np.zeros(0, np.uint64)
    return _mix(np.where(lengths > 0, total, 0).astype(np.uint64) ^ lang)


class WordBook:
    """Numbers that a task gives to words that may be frequent, each with its language and hash."""

    def __init__(self) -> None:
        self.langs, self.words, self.hashes, self.by_lang = [b"", b""], [b"", b""], [0, 0], {}

    def full(self) -> bool:
        return len(self.words) > _MOST_WORDS

    def numbers(self, lang: bytes, text: bytes, bits: np.ndarray) -> np.ndarray:
        """The words of a plain text that pass the filter ``bits`` as numbers; rare words and ends of pieces are ``_END``."""
        known, (words, which) = self.by_lang.setdefault(lang, {}), split(text)
        hashes = word_hashes(words, lang_hash(lang))
        frequent = np.flatnonzero(_known(bits, hashes) & ~pc.equal(words, b"\n").to_numpy(zero_copy_only=False) & (_lengths(words) > 0))
        table = np.full(len(words), _END)
        table[_lengths(words) == 0] = _NOTHING
        for i, word in zip(frequent.tolist(), words.take(pa.array(frequent)).to_pylist()):
            number = known.get(word)
            if number is None:
                number = known[word] = len(self.words)
                self.langs.append(lang)
                self.words.append(word)
                self.hashes.append(int(hashes[i]))
            table[i] = number
        found = table[which]
        return np.append(found[found != _NOTHING], _END)


def phrase_hashes(hashes: np.ndarray) -> np.ndarray:
    """A hash of each row of word hashes, by the words and their order."""
    total = np.zeros(len(hashes), np.uint64)
    for j in range(hashes.shape[1]):
        total = _mix(total * _ODD[0] + hashes[:, j] * _ODD[1] + _ODD[2])
    return total


class PhraseTrie:
    """Counts of phrases of ``width`` words.

    The trie branches by word number and is two words deep at most. Its leaves are hash containers, from the rest of a
    phrase to its count; a container with more than ``_BURST`` phrases is replaced by one for each next word.
    """

    def __init__(self, width: int) -> None:
        self.width, self.size, self.roots = width, 0, {}

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        """Add phrases, given as different rows of word numbers in ascending order, with their counts."""
        edges = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0], True]).tolist()
        step, data, counts = 4 * self.width, rows.astype(">u4").tobytes(), counts.tolist()
        heads = rows[edges[:-1], 0].tolist()
        for head, a, b in zip(heads, edges, edges[1:]):
            node = self.roots.get(head)
            if node is None:
                node = self.roots[head] = [False, {}]
            keys = [data[i : i + step - 4] for i in range(a * step + 4, b * step + 4, step)]
            branched, table = node
            if branched:
                for key, n in zip(keys, counts[a:b]):
                    child = table.get(key[:4])
                    if child is None:
                        child = table[key[:4]] = {}
                    rest = key[4:]
                    if rest in child:
                        child[rest] += n
                    else:
                        child[rest] = n
                        self.size += 1
                continue
            before = len(table)
            for key, n in zip(keys, counts[a:b]):
                table[key] = table.get(key, 0) + n
            self.size += len(table) - before
            if len(table) > _BURST and self.width > 2:
                children: dict[bytes, dict[bytes, int]] = {}
                for key, n in table.items():
                    children.setdefault(key[:4], {})[key[4:]] = n
                self.roots[head] = [True, children]

    def spill(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Whole subtrees, those with the lowest counts first, until at most ``most`` phrases stay: their phrases and counts.

        What is often met stays, so that it is spilled as rarely as can be.
        """
        leaves = {h: [*t.values()] if branched else [t] for h, (branched, t) in self.roots.items()}
        sizes = {h: sum(map(len, parts)) for h, parts in leaves.items()}
        heat = {h: sum(sum(part.values()) for part in parts) / sizes[h] for h, parts in leaves.items()} if most else sizes
        heads, keys, counts = [], [], []
        for head in sorted(heat, key=heat.get):
            if self.size <= most:
                break
            branched, table = self.roots.pop(head)
            for prefix, part in table.items() if branched else [(b"", table)]:
                keys += [prefix + key for key in part] if prefix else part
                counts += part.values()
            heads += [head] * sizes[head]
            self.size -= sizes[head]
        rest = np.frombuffer(b"".join(keys), ">u4").reshape(len(keys), self.width - 1).astype(np.int64)
        return np.column_stack([np.array(heads, np.int64), rest]), np.array(counts, np.int64)


def _counted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows in ascending order, and how often each stands there."""
    packed = []
    for at in range(0, rows.shape[1], 3):
        value = np.zeros(len(rows), np.int64)
        for column in rows[:, at : at + 3].T:
            value = value << _BITS | column
        packed.append(value)
    order = np.lexsort(packed[::-1]) if len(packed) > 1 else np.argsort(packed[0])
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for value in packed:
        value = value[order]
        new[1:] |= value[1:] != value[:-1]
    first = np.flatnonzero(new)
    return rows[order[first]], np.diff(np.append(first, len(rows)))


def _run(book: WordBook, rows: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Phrases as a run in the order of their words, cut into prefix and rest."""
    if not len(rows):
        return
    words = pa.array(book.words, pa.binary())
    columns = [words.take(pa.array(c)).cast(pa.string()) for c in rows.T]
    lang = pa.array(book.langs, pa.binary()).take(pa.array(rows[:, 0])).cast(pa.string())
    prefix, deep = pc.binary_join_element_wise(lang, columns[0], "\n"), min(2, len(columns) - 1)
    if deep == 2:
        prefix = pc.binary_join_element_wise(prefix, columns[1], " ")
    rest = pc.binary_join_element_wise(*columns[deep:], " ") if len(columns) > deep + 1 else columns[deep]
    table = pa.table([prefix, rest, pa.array(counts)], names=["prefix", "rest", "n"])
    yield from table.sort_by([("prefix", "ascending"), ("rest", "ascending")]).to_batches(max_chunksize=100_000)


def _known(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(_FILTER_BITS - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _both(at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), bool)
    out[:-1] = at[:-1] & at[1:]
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[bytes, bytes]]:
    """Plain texts of each language, some ``_BLOCK`` bytes at a time."""
    held, size = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            lang = lang.as_py().encode()
            for part in plain(text.as_py().encode()):
                held.setdefault(lang, []).append(part)
                size += len(part)
                if size >= _BLOCK:
                    yield {key: b" \n ".join(parts) for key, parts in held.items()}
                    held, size = {}, 0
    if size:
        yield {key: b" \n ".join(parts) for key, parts in held.items()}


def _merged(runs: DataFrame) -> DataFrame:
    """Runs meet by prefix; tasks have added up their own words and phrases already."""
    return runs.repartition("prefix").groupBy("prefix", "rest").agg(F.sum("n").alias("n"))


def _word_counts(docs: DataFrame) -> DataFrame:
    """Counts of all words, and of the words of a language together as its empty word."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, totals = [], 0, {}

        def added() -> pa.Table:
            table = pa.concat_tables(held).group_by("prefix").aggregate([("n", "sum")])
            return pa.table([table.column("prefix"), table.column("n_sum")], names=["prefix", "n"])

        def spilled(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.sort_by("prefix")
            table = pa.table([table.column("prefix"), pa.array([""] * len(table), pa.string()), table.column("n")], names=["prefix", "rest", "n"])
            yield from table.to_batches(max_chunksize=100_000)

        for block in _blocks(batches):
            for lang, text in block.items():
                words, which = split(text)
                counts = np.bincount(which, minlength=len(words))
                counts[(_lengths(words) == 0) | pc.equal(words, b"\n").to_numpy(zero_copy_only=False)] = 0
                seen = pa.array(np.flatnonzero(counts))
                totals[lang] = totals.get(lang, 0) + int(counts.sum())
                prefix = pc.binary_join_element_wise(pa.scalar(lang.decode()), words.take(seen).cast(pa.string()), "\n")
                held.append(pa.table([prefix, pa.array(counts[counts > 0])], names=["prefix", "n"]))
                size += len(held[-1])
            if size > _MOST_PHRASES:
                held = [added()]
                if len(held[0]) > _MOST_PHRASES // 2:
                    yield from spilled(held[0])
                    held = []
                size = sum(map(len, held))
        if held:
            yield from spilled(added())
        table = pa.table([pa.array([lang.decode() + "\n" for lang in totals], pa.string()), pa.array(totals.values(), pa.int64())], names=["prefix", "n"])
        yield from spilled(table)

    return _merged(docs.mapInArrow(run, _RUNS))


def _phrase_counts(docs: DataFrame, widths: list[int], filters: list[Broadcast]) -> DataFrame:
    """Counts of the phrases of ``widths`` words all of whose shorter parts pass the filters of their width."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(f.value, np.uint8) for f in filters]
        book, tries = WordBook(), {w: PhraseTrie(w) for w in widths}
        for block in _blocks(batches):
            numbers = np.concatenate([book.numbers(lang, text, bits[0]) for lang, text in block.items()])
            hashes, at = np.array(book.hashes, np.uint64), numbers > _END
            for width in range(2, max(widths) + 1):
                at = _both(at)  # both parts of one word less may be frequent
                places = np.flatnonzero(at)
                rows = numbers[places[:, None] + np.arange(width)]
                if width in tries and len(rows):
                    trie = tries[width]
                    trie.add(*_counted(rows))
                    if trie.size > _MOST_PHRASES:
                        yield from _run(book, *trie.spill(_MOST_PHRASES // 2))
                if width <= len(bits):
                    at[places] = _known(bits[width - 1], phrase_hashes(hashes[rows]))
            if book.full():  # numbers start again, so nothing may be left under the old ones
                for trie in tries.values():
                    yield from _run(book, *trie.spill(0))
                book = WordBook()
        for trie in tries.values():
            yield from _run(book, *trie.spill(0))

    return _merged(docs.mapInArrow(run, _RUNS))


def _filter_of(counted: DataFrame, width: int) -> bytes:
    """The bit filter of counted phrases of ``width`` words, by the hash that tasks compute for theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            langs = batch.column(0).dictionary_encode()
            of = np.array([lang_hash(x.encode()) for x in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()]
            words = pc.split_pattern(batch.column(1).cast(pa.binary()), b" ").flatten()
            keys = word_hashes(words, np.repeat(of, width))
            keys = keys if width == 1 else phrase_hashes(keys.reshape(-1, width))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])

    return _filter(counted.select("lang", "phrase").mapInArrow(run, "key bigint"))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", most_words: int = 5, least: int = 100, scale: int = 1000,
    percent: int = 100, top: int = 2000,
) -> DataFrame:
    """The phrases of each language whose words stand together more often than their parts would by chance.

    Returns ``lang, rank, phrase, a, l, r, n, score``. Texts, A-Z lower-cased, are cut into pieces at ``.,;:!?`` and line
    breaks, pieces into words at spaces and tabs. ``n`` counts the words of a language and ``a`` a phrase of two to
    ``most_words`` words, overlaps included; phrases from ``least`` on are candidates. Of the cuts of a candidate into two
    parts, found ``l`` and ``r`` times, the one with the lowest ``floor(scale * a * n / (l * r))`` counts, in exact
    arithmetic, the earliest on ties. A candidate goes that lies in a longer one found at least ``percent`` per cent as often.
    The first ``top`` of each language by score, then ``a``, then phrase are returned.

    Widths are counted one after another, four and more words together: a phrase is counted only if its parts may be
    frequent, which a filter of fixed size tells; it passes too much rather than too little, and the counts decide. A task
    counts in a trie of bounded size and spills whole subtrees as sorted runs, which meet by their first words. So
    frequent words and phrases are added up before the shuffle, and a common one fills no partition.

    A null text counts as empty, a null language as ``und``, as do all rows if ``lang_col`` is null. Repeated rows count as
    often as they stand there. An empty table gives an empty result. Other columns are not read, whatever their names.
    """
    lang = F.coalesce(named(lang_col).cast("string"), F.lit("und")) if lang_col else F.lit("und")
    texts = docs.select(lang.alias("lang"), whole(text_col).alias("text"))
    context, filters, tables = docs.sparkSession.sparkContext, [], []
    steps = [[w] for w in range(1, min(3, most_words) + 1)] + ([list(range(4, most_words + 1))] if most_words > 3 else [])
    for widths in steps:
        counted = _word_counts(texts) if widths == [1] else _phrase_counts(texts, widths, filters)
        first = F.substring_index("prefix", "\n", -1)
        counted = counted.filter((F.col("n") >= least) | (first == "")).withColumn("first", first)
        lang = F.expr("left(prefix, char_length(prefix) - char_length(first) - 1)")
        phrase = F.when(F.col("rest") == "", F.col("first")).otherwise(F.concat_ws(" ", "first", "rest"))
        counted = counted.select(lang.alias("lang"), phrase.alias("phrase"), "n").withColumn("words", F.size(F.split("phrase", " ")))
        tables.append(materialize(counted))
        if widths != steps[-1]:
            filters.append(context.broadcast(_filter_of(tables[-1].filter("phrase <> ''"), widths[0])))
    frequent = tables[0]
    for table in tables[1:]:
        frequent = frequent.unionByName(table)
    totals = tables[0].filter("phrase = ''").select("lang", F.col("n").alias("total"))
    found = frequent.filter("words > 1")
    words = F.split("phrase", " ")

    parts = found.withColumn("w", words).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    parts = parts.select(
        "lang", "phrase", F.col("n").alias("a"), "cut", F.array_join(F.slice("w", 1, F.col("cut")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("cut") + 1, F.col("words") - F.col("cut")), " ").alias("second"),
    )
    for part, count in (("first", "l"), ("second", "r")):
        counts = frequent.select("lang", F.col("phrase").alias(part), F.col("n").alias(count))
        parts = parts.join(counts, ["lang", part])
    parts = parts.join(totals, "lang")
    wide = lambda name: F.col(name).cast("decimal(19,0)")
    parts = parts.withColumn("over", F.lit(scale).cast("decimal(10,0)") * (wide("a") * wide("total"))).withColumn("under", wide("l") * wide("r"))
    parts = parts.withColumn("score", F.expr("over div under"))
    best = parts.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    shorter = F.array(F.array_join(F.slice("w", 1, F.col("words") - 1), " "), F.array_join(F.slice("w", 2, F.col("words") - 1), " "))
    # what lies in a longer phrase lies in one that is longer by a word and at least as frequent
    inside = found.filter("words > 2").withColumn("w", words).select("lang", F.explode(shorter).alias("phrase"), F.col("n").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    best = best.join(inside, ["lang", "phrase"], "left").filter((F.col("longer") * 100 < F.col("a") * percent) | F.col("longer").isNull())

    out = best.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = out.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
