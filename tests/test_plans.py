"""Shapes of the physical plans."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vernissage.operators import matching
from vernissage.plans import bindings as b
from vernissage.sources import catalog as cat

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def explain(df, mode="formatted"):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.mark.parametrize("name", ["match_fuzzy", "match_titles", "authority_filter", "knn_exact", "ivf_search", "search_lookup",
                                  "resolve_returned", "eval_matrix", "eval_scaling", "index_stats", "dedupe_last", "known_ids"])
def test_no_nested_loops(spark, name):
    plan = explain(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_only_needed_columns_are_read(spark):
    plan = explain(matching.prepare_names(b.catalog(spark, SF), "artist"))
    schema = next(line for line in plan.splitlines() if line.startswith("ReadSchema"))
    assert set(schema.split("<")[1].rstrip(">").split(",")) == {
        "p_partkey:bigint", "p_name:string", "p_brand:string", "p_size:int"
    }


def test_genre_filter_reaches_the_scan(spark):
    plan = explain(b.earlier_ids(spark, SF))
    assert "EqualTo(p_type,ECONOMY)" in plan


def test_catalog_is_not_shuffled_for_a_small_mapping(spark):
    kept = matching.authority_filter(b.catalog(spark, SF), b.authority(spark, SF))
    plan = explain(cat.to_metadata(cat.standard_schema(kept)))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_name_cleaning_runs_in_generated_code(spark):
    plan = explain(b.catalog(spark, SF).select(matching.text.normalize_name("artist").alias("n")), "codegen")
    assert "WholeStageCodegen" in plan and "Python" not in plan
