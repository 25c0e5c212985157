"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local
cores, ``BENCH_REPEATS`` how often each query runs (the best time counts).
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from vernissage.operators import index as ix
from vernissage.plans import bindings as b
from vernissage.plans import queries as q
from vernissage.session import build_session, scratch_dir

HEADLINE = (
    "authority_filter", "match_fuzzy", "match_titles", "fn_normalize_name", "fn_normalize_title", "fn_title_case",
    "score_sequence", "full_rebuild", "incremental_ingest", "stream_ingest", "top_artists", "dedupe_last", "known_ids",
    "asset_store", "knn_exact", "hamming_search", "mutual_nn", "ivf_assign", "ivf_search", "search_lookup",
    "eval_matrix", "eval_latency", "authority_build",
)


def timed(run, repeats: int) -> float:
    best = float("inf")
    for _ in range(repeats):
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = build_session(
        "bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="8g", spark__driver__host="127.0.0.1",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: timed(lambda: q.REGISTRY[name](spark, folder), repeats) for name in HEADLINE}

    # figures next to the published ones: index build, a batch of unchanged queries, and their accuracy
    vectors = b.vectors(spark, folder)
    n = vectors.count()
    path = scratch_dir(spark)
    start = time.perf_counter()
    ix.build_index(vectors, path, q._cells(vectors))
    build = time.perf_counter() - start
    index, asked = ix.load_index(spark, path), vectors.selectExpr("id as qid", "vec")
    start = time.perf_counter()
    hits = ix.search_cells(index, asked).collect()
    search = time.perf_counter() - start
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(folder).name.removeprefix("sf"),
        "index_vectors": n, "index_build_sec": round(build, 3), "search_ms_per_query": round(1000 * search / n, 4),
        "search_accuracy": round(100 * sum(h.qid == h.label for h in hits) / n, 2),
        "search_fallback_rate": round(100 * sum(h.fallback_used for h in hits) / n, 2),
    }))


if __name__ == "__main__":
    main()
