"""Name and title matching: literal cases, and no loss against brute force."""

import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from vernissage.functions import similarity
from vernissage.operators import matching, titles


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diag = 0
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], diag + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return round(200 * lcs(a, b) / (len(a) + len(b))) if a and b else 0


def partial(a, b):
    s, t = sorted((a, b), key=len)
    if not s:
        return 0
    m = len(s)
    return round(max(200 * lcs(s, t[i : i + m]) / (m + len(t[i : i + m])) for i in range(len(t))))


def _noisy(rng, s, alphabet, edits):
    s = list(s)
    for _ in range(edits):
        at = rng.randrange(len(s) + 1)
        kind = rng.random()
        if kind < 0.4 and s:
            s.pop(min(at, len(s) - 1))
        elif kind < 0.8:
            s.insert(at, rng.choice(alphabet))
        elif s:
            s[min(at, len(s) - 1)] = rng.choice(alphabet)
    return "".join(s)


def _strings(rng, n, lo, hi, alphabet):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(lo, hi))) for _ in range(n)]


def test_scores_equal_the_table_method(spark):
    rng = random.Random(1)
    base = _strings(rng, 250, 0, 30, "ab cdé") + _strings(rng, 30, 55, 150, "abc𝔸")
    pairs = [(s, _noisy(rng, s, "abc d", rng.randint(0, 8))) for s in base]
    pairs += [(rng.choice(base), rng.choice(base)) for _ in range(250)] + [(None, "a"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string").repartition(3)
    got = df.select(
        "a", "b",
        similarity.indel_ratio("a", "b").alias("r"),
        similarity.partial_indel_ratio("a", "b").alias("p"),
        similarity.sequence_score("a", "b").alias("s"),
    ).collect()
    for row in got:
        a, b = row.a or "", row.b or ""
        assert (row.r, row.p, row.s) == (ratio(a, b), partial(a, b), max(ratio(a, b), partial(a, b))), (a, b)


def test_scores_are_symmetric_and_callable_from_sql(spark):
    similarity.register(spark)
    df = spark.createDataFrame([("old anvil", "cold anvil"), ("abc", "xxabcxx")], "a string, b string")
    df.createOrReplaceTempView("pairs_view")
    rows = spark.sql(
        "select indel_ratio(a, b) x, indel_ratio(b, a) y, partial_indel_ratio(a, b) p, partial_indel_ratio(b, a) q"
        " from pairs_view order by a"
    ).collect()
    assert [tuple(r) for r in rows] == [(60, 60, 100, 100), (95, 95, 100, 100)]


ARTISTS = [
    ("Vincent van Gogh", "Vincent van Gogh", True),
    ("Paul Cézanne", "Paul Cezanne", True),
    ("Paul Cezanne", "Paul Cézanne", True),
    ("Cezanne, Paul", "Paul Cezanne", True),
    ("Vincent van Gough", "Vincent van Gogh", True),
    ("Sloan, John French", "John French Sloan", True),
    ("Pablo Picasso", "Claude Monet", False),
    ("Workshop of Rembrandt", "Rembrandt", False),
    ("", "Rembrandt", False),
    ("Rembrandt", "", False),
]


def test_artist_cases(spark):
    for name, known, want in ARTISTS:
        found = matching.best_matches(
            matching.prepare_names(spark.createDataFrame([(name,)], "n string"), "n"),
            matching.prepare_names(spark.createDataFrame([(known,)], "n string"), "n"),
            90,
        )
        assert (found.count() == 1) is want, (name, known)


TITLES = [
    ("Guernica", "Guernica", True),
    ("The Starry Night", "Starry Night", True),
    ("Starry Night, The", "The Starry Night", True),
    ("Le Dejeuner sur l'Herbe", "Le Déjeuner sur l'Herbe", True),
    ("Mother & Child", "Mother and Child", True),
    ("Water Lilies (1916)", "Water Lilies", True),
    ("Water Lilies", "The Scream", False),
    ("", "Guernica", False),
    ("Guernica", "", False),
    ("Q", "Quai", True),
]


def test_title_cases(spark):
    left = spark.createDataFrame([(a,) for a, _, _ in TITLES], "title string")
    right = spark.createDataFrame([(b,) for _, b, _ in TITLES], "title string")
    got = {(r.left_title, r.right_title) for r in titles.match_titles(left, right).collect()}
    for a, b, want in TITLES:
        assert ((a, b) in got) is want, (a, b)


@pytest.mark.parametrize("threshold", [60, 85, 90, 92, 97])
def test_fuzzy_names_lose_nothing(spark, threshold):
    rng = random.Random(threshold)
    known = sorted(set(_strings(rng, 120, 1, 28, "abcde ")))
    names = sorted({_noisy(rng, rng.choice(known), "abcde ", rng.randint(0, 5)) for _ in range(400)})
    n = spark.createDataFrame([(s, s) for s in names], "name string, sorted string")
    k = spark.createDataFrame([(s, s) for s in known], "name string, sorted string")
    got = {(r.name, r.canonical, r.score) for r in matching.match_fuzzy(n, k, threshold).collect()}
    want = {(a, b, ratio(a, b)) for a in names for b in known if ratio(a, b) >= threshold}
    assert got == want and want


@pytest.mark.parametrize("threshold", [30, 60, 85, 90, 92])
def test_listed_pieces_grow_with_the_length_and_lose_nothing(threshold):
    rng, slack = random.Random(threshold), matching._slack(threshold)
    width, counters = matching._width(slack), np.arange(matching._COUNTERS) % 97
    rare = lambda s: set(matching._rare_pieces([s], slack, width, counters)[0].tolist())
    sizes = {n: len(rare("".join(rng.choice("abcdefgh ") for _ in range(n)))) for n in (20, 200, 5000)}
    assert sizes[20] <= 21 and sizes[200] <= 201 and sizes[5000] <= 5001
    base = _strings(rng, 60, 1, 40, "abcde ") + _strings(rng, 20, 1, 14, "ab") + ["a" * n for n in (1, 2, 3, 7, 7, 20)] + ["red rod", "large rod"]
    pairs = [(a, _noisy(rng, a, "abcde ", rng.randint(0, 9))) for a in base for _ in range(6)] + [(a, b) for a in base[::3] for b in base[::4]]
    close = [(a, b) for a, b in pairs if ratio(a, b) >= threshold]
    assert len(close) > 50 and not [p for p in close if not rare(p[0]) & rare(p[1])]


@pytest.mark.parametrize("threshold", [40, 60, 75, 85, 95])
def test_fuzzy_titles_lose_nothing(spark, threshold):
    rng = random.Random(threshold)
    base = sorted(set(_strings(rng, 60, 1, 24, "abcd ")))
    other = sorted(
        {_noisy(rng, rng.choice(base), "abcd ", rng.randint(0, 6)) + rng.choice(["", "ab cd", "ddd"]) for _ in range(90)}
        - {""}
    )
    left = spark.createDataFrame([(s,) for s in base], "norm string")
    right = spark.createDataFrame([(s,) for s in other], "norm string")
    rows = titles.match_title_forms(left, right, threshold).collect()
    got = {(r.a, r.b) for r in rows}
    assert len(rows) == len(got)
    want = {(a, b) for a in base for b in other if a == b or max(ratio(a, b), partial(a, b)) >= threshold}
    assert got == want and want


def test_few_title_pairs_are_scored(spark):
    rng = random.Random(4)
    words = _strings(rng, 600, 3, 9, "abdegiklmnorstu")
    forms = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(2, 5))) for _ in range(500)})
    frame = titles._with_masks(spark.createDataFrame([(s,) for s in forms], "norm string"))
    assert titles.title_candidates(frame, frame, matching._slack(85), strict=False).count() < 0.1 * len(forms) ** 2 / 2


def test_one_python_node_per_score(spark):
    df = spark.createDataFrame([("abc", "abd")], "a string, b string")
    scored = df.withColumn("s", similarity.indel_ratio("a", "b")).filter("s >= 50")
    plan = spark._jvm.PythonSQLUtils.explainString(scored._jdf.queryExecution(), "simple")
    assert plan.count("ArrowEvalPython") == 1, plan


def test_empty_authority_lets_all_pass(spark):
    items = spark.createDataFrame([(0, "john french sloan"), (1, None), (2, "")], "idx long, artist string")
    none = spark.createDataFrame([], "name string")
    rows = matching.authority_filter(items, none).orderBy("idx").collect()
    assert [r.canonical for r in rows] == ["John French Sloan", "Unknown", "Unknown"]


def test_scores_run_where_the_package_is_not_installed(tmp_path):
    payload = tmp_path / "fn.pickle"
    payload.write_bytes(cloudpickle.dumps(similarity.sequence_batch))
    code = (
        "import pickle, pyarrow as pa, importlib.util as u; assert u.find_spec('vernissage') is None;"
        f"fn = pickle.load(open({str(payload)!r}, 'rb')); print(fn(pa.array(['abc']), pa.array(['xabc']))[0])"
    )
    out = subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.strip() == "100", out.stderr
