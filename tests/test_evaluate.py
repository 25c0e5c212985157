"""Evaluation, lookup and report behaviour."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vernissage.functions import perturb as pt
from vernissage.operators import lookup
from vernissage.plans import evaluate as ev
from vernissage.plans import report
from vernissage.schema import META_SCHEMA, RESULT_COLUMNS


def _vectors(spark, n=10, dim=8):
    rng = np.random.default_rng(0)
    return spark.createDataFrame(
        [(f"img_{i}", [float(x) for x in rng.normal(size=dim)]) for i in range(n)], "id string, vec array<double>"
    )


def answering(label, fallback=False, confidence=0.9):
    """A stand-in search that returns ``label`` (an expression over ``own``, the asked id)."""

    def search(queries):
        own = F.substring_index("qid", "|", -1)
        return queries.withColumn("own", own).select(
            "qid", F.expr(label).alias("label"), F.lit(confidence).alias("confidence"), F.lit(fallback).alias("fallback_used")
        )

    return search


def test_all_right(spark):
    r = ev.run_evaluation(_vectors(spark), answering("own"), transform="none").first()
    assert (r.transform, r.n, r.correct, r.accuracy, r.fallbacks) == ("none", 10, 10, 100.0, 0.0)


def test_all_wrong(spark):
    r = ev.run_evaluation(_vectors(spark), answering("'wrong'"), n=7, transform="none").first()
    assert (r.n, r.correct, r.accuracy) == (7, 0, 0.0)


def test_all_fall_back(spark):
    assert ev.run_evaluation(_vectors(spark), answering("own", fallback=True)).first().fallbacks == 100.0


def test_summary_keys_and_latency(spark):
    detail = ev.eval_detail(ev.eval_queries(_vectors(spark), "none"), answering("own")).withColumn(
        "latency_ms", F.substring_index("id", "_", -1).cast("double")
    )
    r = ev.eval_summary(detail, []).first()
    assert set(r.asDict()) == {"accuracy", "fallbacks", "avg_ms", "p95_ms", "correct", "n"}
    assert (r.avg_ms, r.p95_ms) == (4.5, pytest.approx(np.percentile(range(10), 95)))


def test_all_runs_every_real_transform_once_per_item(spark):
    rows = ev.run_evaluation(_vectors(spark), answering("own"), transform="all").collect()
    assert {r.transform: r.n for r in rows} == {"aged": 10, "brightness": 10, "contrast": 10}
    assert "none" in pt.TRANSFORMS and "random" in pt.TRANSFORMS


def test_none_is_identity_and_draws_are_reproducible(spark):
    v = _vectors(spark)
    same = pt.perturb(v, F.lit("none")).join(v.withColumnRenamed("vec", "old"), "id").filter("vec = old").count()
    assert same == 10
    one = {r.id: r.vec for r in pt.perturb(v.repartition(5), F.lit("random")).collect()}
    two = {r.id: r.vec for r in pt.perturb(v.coalesce(1), F.lit("random")).collect()}
    other = {r.id: r.vec for r in pt.perturb(v, F.lit("random"), seed=7).collect()}
    assert one == two != other


def test_contrast_is_clipped_and_own_transforms_can_be_added(spark):
    v = _vectors(spark).withColumn("vec", F.transform("vec", lambda x: x * 10))
    assert all(-1 <= x <= 1 for r in pt.perturb(v, F.lit("contrast")).collect() for x in r.vec)
    mine = {"flip": lambda vec, draw: F.transform(vec, lambda x: -x)}
    assert ev.run_evaluation(_vectors(spark), answering("own"), transform="flip", registry=mine).first().transform == "flip"


def test_live_counts_failed_fetches(spark):
    known = spark.createDataFrame([(f"img_{i}",) for i in range(20)] + [(None,)], "id string")
    detail = ev.live_detail(known, _vectors(spark), answering("own"))
    assert ev.live_summary(detail).first().asDict() == {"n": 20, "correct": 10, "accuracy": 50.0, "avg_ms": 0.0}
    sizes = {r["size"]: r.n for r in ev.scaling_summary(detail, (5, 10, 500)).collect()}
    assert sizes == {5: 5, 10: 10, 500: 20}
    none = ev.live_detail(known.limit(0), _vectors(spark), answering("own"))
    assert (ev.live_summary(none).first().accuracy, ev.live_summary(none).first().avg_ms) == (0.0, 0.0)


def test_detail_lines_show_the_first_and_all_failures(spark):
    rows = [("none", "a", "a", 0.87654, True, 1), ("none", "b", "x", 0.5, False, 2), ("none", "c", "c", 1.0, True, 3)]
    detail = spark.createDataFrame(rows, "transform string, id string, label string, confidence double, correct boolean, rank long")
    got = {r.id: r for r in ev.detail_lines(detail, 1).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].title == "[001] MATCH  |  a  →  a  conf=87.65%"
    assert (got["b"].status, got["b"].file_name) == ("FAIL", "002_fail_b")
    assert ev.detail_lines(detail).count() == 3


def test_report_layout(spark, tmp_path):
    columns = "transform string, n long, correct long, accuracy double, fallbacks double, avg_ms double, p95_ms double"
    stored = spark.createDataFrame([(12345,)], "n_images long")
    lines = lambda rows: [r.line for r in ev.report_lines(spark.createDataFrame(rows, columns), stored).orderBy("n").collect()]
    wall, aged = ("wall", 400, 389, 97.25, 3.0, 10.511, 15.349), ("aged", 400, 400, 100.0, 0.0, 9.0, 12.005)
    row = "  " + "wall".ljust(12) + "97.3".rjust(13) + "%" + "3.0".rjust(13) + "%" + "10.51".rjust(13) + "15.35".rjust(13)
    table = lines([wall, aged])
    assert table[0] == table[-1] == "=" * 56 and table[2] == "  " + "-" * 64 and table[4] == row and table[3].startswith("  aged")
    assert table[1] == f"  {'Transform':<12}{'Accuracy':>13}{'Fallback%':>13}{'Avg ms':>13}{'p95 ms':>13}" and len(table) == 6
    assert lines([wall]) == [
        "=" * 56, "  Transform:         wall", "  Vault size:        12,345 images", "  Evaluated:         400 samples",
        "  Accuracy:          389/400  (97.25%)", "  Fallbacks used:    3.0%", "  Avg latency:       10.51 ms", "  p95 latency:       15.35 ms", "=" * 56,
    ]
    ev.write_report(spark.createDataFrame([wall, aged], columns), str(tmp_path), stored)
    assert spark.read.option("header", True).csv(f"{tmp_path}/summary_csv").count() == 2
    assert [r.value for r in spark.read.text(f"{tmp_path}/summary_text").collect()] == table


# ---- lookup


def _meta(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, title string, artist string, url string, genre string, style string, date string, ord long")


def _hits(spark, *rows):
    return spark.createDataFrame(list(rows), "qid string, label string, confidence double, fallback_used boolean")


def test_find_matches(spark):
    meta = _meta(
        spark, ("a", "old", "x", "u", "g", "s", "1", 1), ("a", "new", "y", "u", "g", "s", "2", 5), ("b", None, None, "u", None, "s", "d", 2)
    )
    hits = _hits(spark, ("q1", "a", 0.9, True), ("q2", "Unknown", 0.2, True), ("q3", "ghost", 0.8, True), ("q4", "b", 0.7, False))
    out = lookup.find_matches(hits, meta)
    assert out.columns == ["qid", *RESULT_COLUMNS]
    got = {r.qid: r for r in out.collect()}
    assert (got["q1"].title, got["q1"].artist, got["q1"].confidence, got["q1"].fallback_triggered) == ("new", "y", 0.9, True)
    for q in ("q2", "q3"):
        r = got[q]
        assert (r.artwork_id, r.title, r.artist, r.source_url, r.confidence, r.fallback_triggered, r.genre) == (
            "unknown", "Unknown", "Unknown", "", 0.0, False, "")
    assert (got["q4"].artwork_id, got["q4"].title) == ("b", "")


def test_dedupe_last(spark):
    meta = _meta(spark, ("a", "1", "", "", "", "", "", 1), ("a", "2", "", "", "", "", "", 2), ("b", "3", "", "", "", "", "", 1))
    assert {(r.id, r.title) for r in lookup.dedupe_last(meta).collect()} == {("a", "2"), ("b", "3")}


def test_resolve_returned(spark):
    detail = spark.createDataFrame(
        [("a", "a"), ("b", "a"), ("c", "far"), ("d", "far"), ("e", "Unknown"), ("f", "lost")], "id string, label string"
    )
    sample = spark.createDataFrame([(i, i.upper()) for i in "abcdef"], "id string, content string")
    store = spark.createDataFrame([("far", "FAR"), ("Unknown", "never"), ("a", "stored a")], "id string, content string")
    got = {r.id: (r.origin, r.content) for r in lookup.resolve_returned(detail, sample, store).collect()}
    assert got == {
        "a": ("same", "A"), "b": ("sample", "A"), "c": ("store", "FAR"), "d": ("store", "FAR"),
        "e": ("original", "E"), "f": ("original", "F"),
    }


# ---- report


def _paintings(spark, *artists):
    rows = [(f"id{i}", "t", a, "", "", "", "") for i, a in enumerate(artists)]
    return spark.createDataFrame(rows, META_SCHEMA)


def test_top_artists_by_count_then_name(spark):
    table = report.top_artists(_paintings(spark, "Monet", "Rembrandt", "Rembrandt", None, "Klimt"))
    assert [tuple(r) for r in table.orderBy("rank").collect()] == [(1, "Rembrandt", 2), (2, "Klimt", 1), (3, "Monet", 1)]


def test_top_n(spark):
    many = _paintings(spark, *[f"Artist {i}" for i in range(10)])
    assert report.top_artists(many, 3).count() == 3 and report.top_artists(many, 0).isEmpty()
    assert tuple(report.diagnostics(_paintings(spark, "Rembrandt", "Monet", None)).first()) == (3, 2)


def test_percentile_of_the_null_group(spark):
    rows = spark.createDataFrame([(None, 5.0), (None, 7.0), ("a", 1.0)], "k string, v double")
    got = {r.k: (r.avg_ms, r.p95_ms) for r in ev.latency_summary(rows, "k", "v").collect()}
    assert got == {None: (6.0, pytest.approx(6.9)), "a": (1.0, 1.0)}


def test_perturbations_of_the_given_registry(spark):
    items = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [2.0, 1.0])], "id string, vec array<double>")
    flip = {"flip": lambda vec, draw: F.transform(vec, lambda x: -x)}
    for name in ("all", "random", ["flip"]):
        queries = ev.eval_queries(items, name, flip)
        assert sorted(r.vec for r in queries.collect()) == [[-2.0, -1.0], [-1.0, -2.0]]
    with pytest.raises(KeyError):
        ev.eval_queries(items, "affine")
    with pytest.raises(Exception, match="unknown perturbation"):
        pt.perturb(items, F.lit("affine")).collect()
