"""Toxicity, licences, language: held-out accuracy and edge cases; the pipeline as a whole."""

import math
import pickle
import random
import subprocess
import sys
import textwrap
import zlib
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import corpus_pipeline
from vernissage.llm.language import fit_text_model, identify, page_parts
from vernissage.llm.licences import TEMPLATES, best_template, fit_licences, probabilities, scan_licences, tokens
from vernissage.llm.queries import REGISTRY
from vernissage.llm.toxicity import _fit_language_models, fit_toxicity, score_toxicity, text_ratios, words_of

SF = "/root/testdata/sf0.01"


def invented(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def toxic(spark):
    rng, rows, labels = random.Random(1), [], []
    for i in range(800):
        words = invented(rng, ["ta", "ro", "mi", "len", "su", "ka"], rng.randint(5, 80)).split()
        bad = i % 8 == 0
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["nastyword", "vileword", "meanword"]))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxicity_on_documents_it_has_not_learnt_from(spark, toxic):
    docs, labels = toxic
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit_toxicity(docs, labels.filter(~held))
    found = score_toxicity(docs, model, carry=["doc_id"]).filter(held).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    right = [r.predicted == (r.doc_id % 8 == 0) for r in found]
    assert sum(right) >= 0.97 * len(right)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "nastyword"), (3, "ta " * 50_000), (3, "x"), (3, "x")], "doc_id bigint, text string")
    assert len(score_toxicity(odd, model).collect()) == 6
    assert score_toxicity(odd.limit(0), model).collect() == []


def test_toxicity_without_one_class(spark, toxic):
    docs, labels = toxic
    assert score_toxicity(docs.limit(3), fit_toxicity(docs, labels.limit(0))).select("score").distinct().collect()[0][0] == 0.0
    ones = spark.createDataFrame([(1, 1), (2, 1), (2, None)], "doc_id bigint, toxic int")
    assert fit_toxicity(docs, ones) == 1.0


def plain_ratios(rows, texts):
    """The two smoothed models by the formulas, on Python dictionaries."""
    counts = [Counter(), Counter()]
    for text, label in rows:
        words = words_of(text)
        counts[label].update(set(zip(["", *words], words)))
    every = set(counts[0]) | set(counts[1])
    follow = [Counter(b for _, b in c) for c in counts]
    ahead = [Counter(), Counter()]
    for c in (0, 1):
        for (a, _), n in counts[c].items():
            ahead[c][a] += n
    taken = [Counter(), Counter()]
    for c in (0, 1):
        for (a, _), n in counts[c].items():
            taken[c][a] += min(n, 2.0)
    seconds = {b for _, b in every}
    size = [sum(follow[c].values()) for c in (0, 1)]
    off = [sum(min(follow[c][b], 2.0) for b in seconds) for c in (0, 1)]
    shared = sum(min(follow[0][b] + follow[1][b], 4.0) for b in seconds)

    def single(c, w):
        return (max(follow[c][w] - 2.0, 0) + off[c] * min(max(follow[0][w] + follow[1][w], 1), 4.0) / shared) / size[c]

    def back(c, a):
        return taken[c][a] / ahead[c][a] if ahead[c][a] else 1.0

    def ratio(a, b):
        own = math.log(single(1, b) / single(0, b))
        context = math.log(back(1, b) / back(0, b))
        if b not in seconds and not any(x == b for x, _ in every):
            own, context = math.log(off[1] / size[1] / (off[0] / size[0])), 0.0
        if (a, b) not in every:
            return own + context
        n = [counts[c][a, b] for c in (0, 1)]
        limited = lambda p: min(max(counts[0][p] + counts[1][p] - 2.0, 0), 4.0)
        apart = sum(limited(p) for p in every if p[0] == a) + 4.0
        full = [max(n[c] - 2.0, 0) / max(ahead[c][a], 1) + back(c, a) * (limited((a, b)) + 4.0 * single(c, b)) / apart for c in (0, 1)]
        return own + context + math.log(full[1] / full[0]) - math.log(back(1, a) / back(0, a)) - math.log(single(1, b) / single(0, b))

    return [sorted(ratio(a, b) for a, b in set(zip(["", *words_of(t)], words_of(t)))) for t in texts]


def test_ratios_match_plain_counting(spark):
    rng = random.Random(6)
    rows = [(invented(rng, ["ta", "ro", "mi"], rng.randint(1, 30)) + (" vile word" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(60)]
    texts = [t for t, _ in rows[:20]] + ["", "unseen words here", "vile vile word ta", "Ta ro 12 mi"]
    model = _fit_language_models(spark.createDataFrame(rows, "text string, label int"))
    ratios, owner = text_ratios(texts, (model.words, model.pairs, model.unknown))
    for i, want in enumerate(plain_ratios(rows, texts)):
        assert sorted(ratios[owner == i].tolist()) == pytest.approx(want, abs=1e-5)


@pytest.fixture(scope="module")
def licences(spark):
    return fit_licences(spark.read.parquet(f"{SF}/documents.parquet"), most_paragraphs=1500)


def test_every_family_is_found_and_nothing_else(spark, licences):
    rng, rows = random.Random(2), []
    for k, (family, texts) in enumerate(TEMPLATES.items()):
        for j, text in enumerate(texts):
            rows.append((f"{family}-{j}", f"{invented(rng, ['ba', 'de', 'no'], 30)}\n{text}\nend"))
    rows += [("", "The licensed driver read the public library notice."), ("", None), ("", ""), ("", "licensed under the"), ("", "word " * 50_000)]
    rows += [("", "This work is licensed to the public under general terms, version 3."), ("Apache-2.0,MIT", TEMPLATES["MIT"][0] + " " + TEMPLATES["Apache-2.0"][0])]
    docs = spark.createDataFrame([(i, w, t) for i, (w, t) in enumerate(rows)], "doc_id bigint, licences string, text string")
    found = {r.doc_id: r for r in scan_licences(docs, licences).collect()}
    wrong = [(rows[i][0], r.licences) for i, r in found.items() if rows[i][0].rsplit("-", 1)[0] != ",".join(r.licences) and rows[i][0] != ",".join(r.licences)]
    assert not wrong
    assert found[0].n_paragraphs == 3 and found[0].spans[0].paragraph == 1
    assert scan_licences(docs.limit(0), licences).collect() == []


@pytest.mark.parametrize("width, mark", [(72, ""), (40, "# "), (60, " * ")])
def test_wrapped_notices_are_found(spark, licences, width, mark):
    rng, rows = random.Random(width), []
    for family, texts in TEMPLATES.items():
        for text in texts:
            body = "\n".join(mark + line for line in textwrap.wrap(text, width))
            rows.append((family, f"{invented(rng, ['ba', 'de', 'no'], 200)}\n\n{body}\n\n{invented(rng, ['ba', 'de'], 30)}"))
    both = "\n".join(textwrap.wrap(TEMPLATES["MIT"][1], width)) + "\n" + "\n".join(textwrap.wrap(TEMPLATES["BSD"][1], width))
    rows.append(("BSD,MIT", both))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in scan_licences(docs, licences).collect()}
    assert [(rows[i][0], r.licences) for i, r in sorted(found.items()) if ",".join(r.licences) != rows[i][0]] == []
    assert found[0].spans[0].paragraph == 2


def test_scan_needs_no_package_on_the_workers(licences, tmp_path):
    values = (licences.families, licences.features, licences.weights, licences.bias, licences.temperature)
    (tmp_path / "model.pickle").write_bytes(pickle.dumps(values))  # as a broadcast travels
    (tmp_path / "run.pickle").write_bytes(cloudpickle.dumps(probabilities))
    code = (
        "import pickle, importlib.util as u; assert u.find_spec('vernissage') is None;"
        f"m = pickle.load(open({str(tmp_path / 'model.pickle')!r}, 'rb')); f = pickle.load(open({str(tmp_path / 'run.pickle')!r}, 'rb'));"
        "p = f(m, 'released under the mit license'.split()); print(m[0][int(p[:-1].argmax())])"
    )
    out = subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.strip() == "MIT", out.stderr


def test_unseen_variants_and_fragments(spark, licences):
    """Held-out accuracy on reworded notices (not among the training examples) and on unrelated text."""
    rng, right, n = random.Random(11), 0, 0
    rows = []
    for family, texts in TEMPLATES.items():
        for _ in range(10):
            words = rng.choice(texts).split()
            if len(words) > 9:
                words[rng.randrange(len(words))] = "something"
            rows.append((family, invented(rng, ["po", "ki"], 20) + " " + " ".join(words)))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    for r in scan_licences(docs, licences).collect():
        n += 1
        right += r.licences == [rows[r.doc_id][0]]
    assert right >= 0.85 * n


def test_template_places():
    words = tokens("x y Released under the MIT License. z")
    assert best_template(words, [tokens(TEMPLATES["MIT"][0])]) == (1.0, 2, 7)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit_text_model(docs.filter(~held))
    found = identify(docs.filter(held), model, F.col("text"), host=F.col("source")).collect()
    assert sum(r.language == r.lang for r in found) >= 0.98 * len(found) and not any(r.rejected for r in found)


def test_language_evidence_decides_where_the_text_does_not(spark):
    rng = random.Random(3)
    docs = [(invented(rng, parts, 40), lang) for lang, parts in (("de", ["ung", "sch", "keit"]), ("fr", ["eau", "oi", "que"])) for _ in range(60)]
    model = fit_text_model(spark.createDataFrame(docs, "text string, lang string"))
    rows = [(i, "fr", t, "a.example.org", "example.org", "fr" if i % 2 else None) for i, (t, lang) in enumerate(docs) if lang == "fr"]
    rows += [(900, "fr", "xx xx", "a.example.org", "example.org", "fr"), (901, "?", "12 34", "a.example.org", "example.org", "fr"),
             (902, "?", None, None, None, None), (903, "fr", "eau oi", None, None, None), (904, "de", "zz", None, None, "de")]
    frame = spark.createDataFrame(rows, "id bigint, language string, text string, host string, domain string, said string")
    found = {r.id: r for r in identify(frame, model, F.col("text"), F.col("said"), None, F.col("host"), F.col("domain")).collect()}
    assert all(found[r[0]].language == r[1] for r in rows if r[1] != "?")
    assert [i for i, r in sorted(found.items()) if r.rejected] == [901, 902]
    assert identify(frame.limit(0), model, F.col("text")).collect() == []
    none = fit_text_model(spark.createDataFrame([("a", None)], "text string, lang string"))
    assert all(r.rejected and r.language is None for r in identify(frame, none, F.col("text")).collect())


def test_page_parts(spark):
    html = '<html  LANG="de-AT"><!-- <p>no --><script>var t="</p>";</script><p>Ja&amp;nein<br>doch</p></html>'
    row = spark.createDataFrame([(html, "https://me@www.Shop.example.de:80/x?y"), (None, None)], "html string, url string")
    one, two = row.select(*[c.alias(k) for k, c in page_parts(F.col("html"), F.col("url")).items()]).collect()
    assert one.text.split() == ["Ja", "nein", "doch"] and one[1:] == ("de", "www.shop.example.de", "example.de", "de")
    assert tuple(two) == (None,) * 5


def test_pipeline_stages_against_brute_force(spark):
    """Every stage on the small table: what it keeps, what it drops and why."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        from vernissage.session import materialize

        docs = materialize(stage(spark, docs, SF))
        out[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    raw = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {name: {r.doc_id: r.text for r in df.collect()} for name, df in out.items() if name != "packing"}
    assert set(kept["language_id"]) == {i for i, t in raw.items() if any(c.isalpha() for c in t)}
    groups = {}
    for i, t in kept["language_id"].items():
        groups.setdefault("".join(t.split()), []).append((-len(t), i))
    assert set(kept["exact_dedup"]) == {min(g)[1] for g in groups.values()}
    near = {r.doc_id: r.component_id for r in REGISTRY["op8_simhash_near_dedup"](spark, SF).collect()}
    assert {near[i] for i in kept["near_dedup"]} == {near[i] for i in kept["exact_dedup"]}
    unchanged = [i for i, t in kept["substring_dedup"].items() if t == kept["near_dedup"][i]]
    assert len(unchanged) > 0.9 * len(kept["near_dedup"])
    places = out["packing"].collect()
    assert {r.doc_id for r in places} == set(kept["substring_dedup"])
    assert sum(r.length for r in places) <= 4096 * len({r.sequence_id for r in places})
    crc = {r.doc_id for r in REGISTRY["op6_toxicity"](spark, SF).filter("held_out").collect()}
    assert crc == {i for i in raw if zlib.crc32(str(i).encode()) % 5 == 0}
