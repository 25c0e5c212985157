"""Exact, line, near and substring deduplication against brute force, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from vernissage.llm.components import connected_components, roots
from vernissage.llm.exact_dedup import exact_dedup
from vernissage.llm.line_dedup import line_dedup
from vernissage.llm.simhash import drop_near_copies, fingerprint, simhash_groups, tile_links
from vernissage.llm.substring_dedup import Paragraphs, drop_repeats, repeated_passages

SCHEMA = "doc_id bigint, text string, kept string, `c.0` int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA)


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    out = []
    for i, t in rows:
        group = groups[norm(t)]
        out.append((i, min(group)[3], len(group), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


EXACT = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \n"), (7, "é"), (None, "ab"), (8, "é" * 5000), (9, "AB")]


@pytest.mark.parametrize("hot", [500, 2])
def test_exact_matches_brute_force_and_splits_hot_groups(spark, hot):
    rows = EXACT + [(100 + i, "copy " * (1 + i % 3)) for i in range(30)] + [(200 + i, "co py" + " " * (i % 5)) for i in range(20)]
    found = exact_dedup(frame(spark, rows), hot_rows=hot).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], key=str) == exact_brute(rows)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({norm(t) for _, t in rows}) and all(r.doc_id == r.keep_id for r in kept)
    assert found[0]["c.0"] == 7 and isinstance(found[0].kept, bool)


@pytest.mark.parametrize("hot", [500, 1])
def test_exact_keeps_one_of_repeated_rows(spark, hot):
    found = exact_dedup(frame(spark, [(1, "a"), (1, "a"), (1, "a"), (None, "b"), (None, "b")]), hot_rows=hot).collect()
    assert sum(r.kept for r in found) == 2 and {r.group_size for r in found} == {2, 3}


def test_exact_of_nothing(spark):
    assert exact_dedup(frame(spark, [])).collect() == []


def test_exact_plan_has_one_exchange_and_no_python(spark):
    plan = exact_dedup(frame(spark, EXACT))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan and "Python" not in plan


def lines_brute(rows, least):
    keys = [[line.strip("\x20\t\n\x0b\x0c\r") for line in (t or "").split("\n")] for _, t in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = [[k.translate(lower) for k in ks] for ks in keys]
    often = {k for ks in keys for k in set(ks) if k and sum(k in set(x) for x in keys) >= least}
    out = []
    for (i, t), ks in zip(rows, keys):
        rest = [line for line, k in zip((t or "").split("\n"), ks) if k not in often]
        out.append((i, len(ks), len(ks) - len(rest), "\n".join(rest)))
    return sorted(out, key=str)


def test_lines_match_brute_force(spark):
    rows = [(i, f"Header\n body {i}\n\t HEADER \nÉcole\nécole{i % 2}\n") for i in range(12)]
    rows += [(50, None), (51, ""), (52, "header"), (53, "\n\n"), (None, "header\nx"), (54, "header\nheader"), (54, "header\nheader")]
    for least in (3, 10, 12):
        found = line_dedup(frame(spark, rows), min_docs=least).collect()
        assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found], key=str) == lines_brute(rows, least)
    assert line_dedup(frame(spark, [])).collect() == []
    assert "Python" not in line_dedup(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()


def test_one_line_in_every_long_document(spark):
    rows = [(i, "same line\n" + f"{i} " * 20_000 + "\nsame line") for i in range(10)]
    found = line_dedup(frame(spark, rows)).collect()
    assert {(r.n_lines, r.n_dropped) for r in found} == {(3, 2)} and all(len(r.kept_text) >= 40_000 for r in found)


def test_components_against_union(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)] + [(5, None), (7, 7)]
    found = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    clean = [(a, b) for a, b in edges if b is not None]
    label = roots(200, np.array([a for a, _ in clean]), np.array([b for _, b in clean]))
    nodes = {x for a, b in clean for x in (a, b) if a != b}
    assert found == {n: label[n] for n in nodes}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def simple_fingerprint(text, words=4):
    tokens = text.encode().lower().split()
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "  ", "One", "one two\tTHREE", "É é a b c D", "a b c d " * 300, " ".join(map(str, range(3000)))])
def test_fingerprint(text):
    assert fingerprint(text.encode()) == simple_fingerprint(text)


def test_tiles_lose_no_link():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    prints = np.unique(np.concatenate([centres ^ sum(np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64) for _ in range(3)) for _ in range(40)]))
    rng.shuffle(prints)
    half = len(prints) // 2
    a, b = prints[:half], prints[half:]
    at = {int(x): i for i, x in enumerate(prints)}
    for left, right in ((a, b), (a, a)):
        one, two = tile_links(left, right, 4, cells=1000)
        found = roots(len(prints), np.array([at[int(x)] for x in one], int), np.array([at[int(x)] for x in two], int))
        i, j = np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= 4)
        want = roots(len(prints), np.array([at[int(x)] for x in left[i]], int), np.array([at[int(x)] for x in right[j]], int))
        assert np.array_equal(found, want)


def test_near_groups(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(300)) for _ in range(6)]
    rows = [(10 * k + j, (t if j == 0 else t + f" end{j}")) for k, t in enumerate(base) for j in range(4)]
    rows += [(90, None), (91, "  "), (None, base[0]), (92, base[1].upper()), (93, "short one"), (93, "short one")]
    found = simhash_groups(frame(spark, rows), tile_rows=4).collect()
    prints = [simple_fingerprint(t or "") for _, t in rows]
    n = len(rows)
    pairs = [(i, j) for i in range(n) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4]
    label = roots(n, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    name = {c: min((rows[i][0] for i in range(n) if label[i] == c and rows[i][0] is not None), default=None) for c in set(label)}
    want = [(rows[i][0], format(prints[i], "016x"), name[label[i]]) for i in range(n)]
    assert sorted([tuple(r) for r in found], key=str) == sorted(want, key=str)
    # one identifier with a text of its own and one that is near others; rows without an identifier alone in their group
    rows += [(0, base[2] + " end9"), (0, "nothing else is like this one"), (None, "alone, without a name"), (None, "alone, without a name")]
    prints = [simple_fingerprint(t or "") for _, t in rows]
    n = len(rows)
    pairs = [(i, j) for i in range(n) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4]
    label = roots(n, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    left = drop_near_copies(frame(spark, rows), tile_rows=4).collect()
    stays = [min(((i is None, i or 0), i) for (i, _), c in zip(rows, label) if c == one)[1] for one in set(label)]
    assert sorted([r.doc_id for r in left], key=str) == sorted(stays, key=str) and left[0]["c.0"] == 7
    assert drop_near_copies(frame(spark, [])).collect() == []
    assert simhash_groups(frame(spark, [])).collect() == []


def passage(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_paragraphs_depend_on_their_own_words_only():
    rng = random.Random(2)
    texts = [passage(rng, 200), "", "one two", "w " * 500, passage(rng, 90) + "\n" + passage(rng, 90), "É" * 50]
    together = Paragraphs(pa.array(texts))
    for i, text in enumerate(texts):
        alone, own = Paragraphs(pa.array([text])), together.row == i
        for a, b in zip([alone.start, alone.stop, *alone.identity(), *alone.bands()], [together.start, together.stop, *together.identity(), *together.bands()]):
            assert np.array_equal(a, b[own])
        for start, stop, words in zip(alone.start, alone.stop, alone.words):
            assert len(text.encode()[start:stop].split()) == words


def test_repeated_passages_are_found_and_others_left(spark):
    rng = random.Random(4)
    shared = [passage(rng, 55) for _ in range(8)]
    rows, owners = [], {}
    for i in range(40):
        parts = [passage(rng, rng.randint(5, 120))]
        if i % 2:
            k = i % 8
            owners.setdefault(k, []).append(i)
            parts += [shared[k], passage(rng, rng.randint(5, 120))]
        rows.append((i, " ".join(parts)))
    rows += [(100, None), (101, ""), (None, rows[3][1] + " " + passage(rng, 30)), (102, rows[0][1].split()[0] * 9)]
    found = repeated_passages(frame(spark, rows)).collect()
    with_passage = {i for ids in owners.values() for i in ids}
    assert {r.doc_id for r in found} == with_passage | {None}
    first = {min(ids) for ids in owners.values()}
    assert {r.doc_id for r in found if r.removed} == (with_passage - first) | {None}
    left = {r.doc_id: r.text for r in drop_repeats(frame(spark, rows)).collect()}
    assert all(left[i] == t for i, t in rows if i is not None and i not in with_passage - first and t)
    for k, ids in owners.items():
        middle = " ".join(shared[k].split()[20:35])
        assert [middle in left[i] for i in ids] == [True] + [False] * (len(ids) - 1)
    assert repeated_passages(frame(spark, [])).collect() == [] and drop_repeats(frame(spark, [])).collect() == []


def test_a_copy_within_one_document_is_no_repeat(spark):
    text = passage(random.Random(6), 60)
    assert repeated_passages(frame(spark, [(1, text + "\n" + text), (1, text + "\n" + text)])).collect() == []


def test_near_equal_paragraphs_link(spark):
    words = passage(random.Random(7), 400).split()
    other = words[:]
    other[200] = "changed"
    found = repeated_passages(frame(spark, [(1, " ".join(words)), (2, " ".join(other))])).collect()
    assert sum(r.n_words for r in found if r.removed and r.doc_id == 2) > 330


def test_many_paragraphs_under_one_key_are_compared_in_blocks(spark, monkeypatch):
    import vernissage.llm.substring_dedup as sd

    rng = random.Random(8)
    core = passage(rng, 60).split()
    rows = [(i, " ".join([*core[:30], f"v{i}", *core[30:]])) for i in range(12)]
    whole = sorted(map(tuple, repeated_passages(frame(spark, rows)).collect()), key=str)
    monkeypatch.setattr(sd, "_BLOCK", 2)
    assert sorted(map(tuple, repeated_passages(frame(spark, rows)).collect()), key=str) == whole and whole


def test_rows_left_with_space_alone_go(spark):
    rng = random.Random(12)
    shared = next(p for p in iter(lambda: passage(rng, 60), None) if Paragraphs(pa.array([p])).words.sum() == 60)  # no short paragraph
    rows = [(1, shared), (2, f"\n\n{shared} \t\n"), (3, f"{passage(rng, 40)}\n{shared}\n"), (4, "\n\n"), (5, None)]
    left = {r.doc_id: r.text for r in drop_repeats(frame(spark, rows)).collect()}
    assert set(left) == {1, 3, 4, 5} and left[1] == shared and len(left[3].split()) < 60
