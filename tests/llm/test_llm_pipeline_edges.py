"""Every stage of the pipeline on awkward tables: null and empty texts, repeated rows, extra columns, no rows."""

import pytest

import corpus_pipeline
from vernissage.session import materialize

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string, row int, place int"
def _rows():
    long = "a text that is long enough to have shingles of its own and more of them than a few " * 3
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (4, long), (5, "something else altogether, in words that no other row has"),
            (None, "something else altogether, in words that no other row has"), (6, long.replace(" ", "  ")), (7, None), (8, "x" * 200_000), (9, "word " * 30_000)]
    return [(i, t, "en", "s", len(t or ""), "more", 1, 2) for i, t in rows]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_awkward_rows(spark, name, stage):
    docs = spark.createDataFrame(_rows(), SCHEMA)
    found = materialize(stage(spark, docs, "")).collect()
    if name == "packing":
        assert {r.doc_id for r in found} == {r[0] for r in _rows()}
        return
    assert set(found[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}
    got = sorted((r.doc_id for r in found), key=str)
    if name == "exact_dedup":  # one row of each text without its space: the longest, then the smallest identifier
        assert got == [3, 5, 6, 8, 9]
    elif name == "near_dedup":  # the texts are far apart but for those of space alone and the repeated ones
        assert len(got) == len(set(got)) and {1, 4, 5, 8, 9} <= set(got) and not {2, 3, 6, 7, None} & set(got)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_no_rows(spark, name, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), "").collect() == []
