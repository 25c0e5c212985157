"""The registered queries: each operator on the test tables, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vernissage.functions import similarity, text
from vernissage.functions.perturb import REAL, perturb
from vernissage.operators import index as ix
from vernissage.operators import lookup, matching, sampling, titles, vectors as vx
from vernissage.plans import bindings as b
from vernissage.plans import evaluate as ev
from vernissage.plans import report
from vernissage.plans.ingest import IngestConfig, open_dataset, run_incremental, run_rebuild
from vernissage.schema import ARTIST_THRESHOLD, INGEST_THRESHOLD, UNKNOWN_LABEL, SearchConfig
from vernissage.session import materialize, scratch_dir
from vernissage.sources import assets, authority as auth, catalog as cat
from vernissage.streaming import ingest as stream

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
EVERYTHING = IngestConfig(limit=-1, threshold=INGEST_THRESHOLD)
EVAL_TRANSFORMS = ["none", *REAL, "random"]


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# ---- scans, sources, sinks


@query
def scan_catalog(spark, sf):
    path = scratch_dir(spark)
    b.catalog(spark, sf).withColumns({"description": F.lit(None).cast("string"), "filename": F.concat("idx", F.lit(".jpg"))}).write.parquet(path)
    return cat.open_catalog(spark, path).select("idx", "title", "artist", "date", "genre", "style", "filename")


@query
def authority_load(spark, sf):
    path = scratch_dir(spark)
    auth.write_authority(b.table(spark, sf, "part").select(F.col("p_name").alias("name")), path)
    return auth.load_authority(spark, path)


def _ranked_labels(spark, sf):
    weight = b.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.count("*").alias("weight"))
    part = b.table(spark, sf, "part").select(
        F.col("p_partkey").alias("key"),
        F.when(F.col("p_size") <= 5, F.concat(F.lit("Q"), F.col("p_partkey").cast("string")))
        .otherwise(F.col("p_name")).alias("name"),
    )
    return weight.join(part, "key")


@query
def authority_build(spark, sf):
    return auth.authority_json(auth.top_names(_ranked_labels(spark, sf), 1000).select("name"))


@query
def known_ids(spark, sf):
    pages = b.table(spark, sf, "pages").select(F.regexp_replace("url", r"[?#].*$", "").alias("key"))
    return assets.known_ids(pages, "key")


def _stored_documents(spark, sf):
    path = scratch_dir(spark)
    assets.store_assets(b.document_assets(spark, sf), path)
    return assets.load_assets(spark, path)


@query
def asset_store(spark, sf):
    stored = _stored_documents(spark, sf)
    return stored.select("id", "bucket", F.octet_length("content").alias("bytes"), F.md5("content").alias("digest"))


@query
def asset_fetch(spark, sf):
    wanted = b.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"))
    found = assets.fetch_assets(wanted, _stored_documents(spark, sf))
    size = F.coalesce(F.octet_length("content"), F.lit(-1))
    return found.select("id", size.alias("bytes"), F.md5("content").alias("digest"))


@query
def metadata_roundtrip(spark, sf):
    path = scratch_dir(spark)
    cat.write_metadata(b.metadata_history(spark, sf), path)
    return cat.load_metadata(spark, path)


def _dataset_rows(spark, path):
    """Every id that any of the three tables of a dataset holds, with what each of them has; -1 for nothing."""
    data = open_dataset(spark, path)
    assets = data.assets.select("id", F.octet_length("content").alias("asset_bytes"))
    rows = data.metadata.join(assets, "id", "full").join(data.index.postings.select("id", "cell"), "id", "full")
    return rows.fillna(-1, ["asset_bytes", "cell"])


def _tables(spark, sf) -> dict:
    """Assets and vectors of all items, and the training of an index over those that are kept."""
    vectors = b.vectors(spark, sf)
    cells = _cells(vectors)
    return {"contents": b.item_contents(spark, sf), "vectors": vectors, "train": lambda kept: ix.train_seeded(kept, cells)}


@query
def full_rebuild(spark, sf):
    path, items, known = scratch_dir(spark), b.catalog(spark, sf), materialize(b.authority(spark, sf))
    older = items.withColumn("genre", F.lit("older")).filter("idx % 3 = 0")
    run_rebuild(older, known, path, EVERYTHING, **_tables(spark, sf))  # a dataset of other items, to be replaced
    run_rebuild(items, known, path, EVERYTHING, **_tables(spark, sf))
    return _dataset_rows(spark, path)


def _after_update(spark, sf, config, **tables):
    path, items, known = scratch_dir(spark), b.catalog(spark, sf), materialize(b.authority(spark, sf))
    run_rebuild(items.filter(F.col("genre") == "ECONOMY"), known, path, EVERYTHING, **tables)
    return path, run_incremental(items, known, path, config, **tables)[0]


@query
def incremental_ingest(spark, sf):
    return _dataset_rows(spark, _after_update(spark, sf, EVERYTHING, **_tables(spark, sf))[0])


@query
def incremental_limit(spark, sf):
    return _after_update(spark, sf, IngestConfig(limit=200))[1]


@query
def stream_ingest(spark, sf):
    root, known = scratch_dir(spark), materialize(b.authority(spark, sf))
    items = b.catalog(spark, sf)
    # several files, taken one or two at a time
    items.repartitionByRange(4, "idx").write.parquet(f"{root}/raw")
    source = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/raw")
    vectors = b.vectors(spark, sf)
    centroids = materialize(ix.train_seeded(vectors, _cells(vectors)))
    tables = {"vectors": vectors, "centroids": centroids, "contents": b.item_contents(spark, sf)}
    stream.start_ingest(source, known, f"{root}/out", f"{root}/progress", **tables).awaitTermination()
    return _dataset_rows(spark, f"{root}/out")


# ---- projections and name matching


@query
def standard_schema(spark, sf):
    items = b.catalog(spark, sf).withColumn("canonical", text.title_case(text.or_default("artist", "Unknown")))
    return cat.standard_schema(items)


@query
def authority_filter(spark, sf):
    kept = matching.authority_filter(b.catalog(spark, sf), b.authority(spark, sf))
    return cat.to_metadata(cat.standard_schema(kept))


@query
def authority_passthrough(spark, sf):
    none = spark.createDataFrame([], "name string")
    kept = matching.authority_filter(b.catalog(spark, sf), none)
    return cat.to_metadata(cat.standard_schema(kept))


def _prepared(spark, sf):
    names = materialize(matching.prepare_names(b.catalog(spark, sf), "artist"))
    return names, materialize(matching.prepare_names(b.authority(spark, sf), "name"))


@query
def match_exact(spark, sf):
    return matching.match_exact(*_prepared(spark, sf))


@query
def match_token_set(spark, sf):
    return matching.match_token_set(*_prepared(spark, sf))


@query
def match_fuzzy(spark, sf):
    return matching.match_fuzzy(*_prepared(spark, sf), ARTIST_THRESHOLD)


@query
def match_titles(spark, sf):
    part = b.table(spark, sf, "part")
    return titles.match_titles(
        part.select(F.concat(F.lit("The "), "p_name").alias("title")), part.select(F.col("p_name").alias("title"))
    )


# ---- text functions, on whole documents and all artists


def _texts(spark, sf):
    docs = b.table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), "text")
    names = b.catalog(spark, sf).select(F.concat(F.lit("a"), F.col("idx").cast("string")).alias("key"), F.col("artist").alias("text"))
    return docs.unionByName(names)


def _text_query(name: str, *fns: Callable[[Column], Column]) -> None:
    def run(spark, sf):
        outs = [fn(F.col("text")).alias("out" if len(fns) == 1 else f"out{i}") for i, fn in enumerate(fns, 1)]
        return _texts(spark, sf).select("key", *outs)

    run.__name__ = name
    query(run)


_text_query("fn_strip_diacritics", text.strip_diacritics)
_text_query("fn_strip_parens", text.strip_parentheticals)
_text_query("fn_delimiters", text.replace_delimiters)
_text_query("fn_punct", text.remove_punctuation)
_text_query("fn_collapse_ws", text.collapse_whitespace)
_text_query(
    "fn_articles",
    lambda c: text.strip_leading_article(F.lower(c)),
    lambda c: text.strip_trailing_article(F.lower(c)),
)
_text_query("fn_normalize_name", text.normalize_name)
_text_query("fn_normalize_title", text.normalize_title)
_text_query("fn_title_case", text.title_case)


def _name_pairs(spark, sf, normal: Callable[[Column], Column], other: Column):
    part = b.table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), "p_name", "p_type")
    pairs = b.catalog(spark, sf).filter(F.col("artist").isNotNull()).join(part, "idx")
    return pairs.select(normal(F.col("artist")).alias("a"), normal(other).alias("b")).distinct()


@query
def score_token_sort(spark, sf):
    pairs = _name_pairs(spark, sf, text.normalize_name, F.col("p_name"))
    return pairs.select("a", "b", similarity.token_sort_score(F.col("a"), F.col("b")).alias("score"))


@query
def score_long(spark, sf):
    """Strings of up to some thousand characters: every turn of a conversation against the next."""
    pairs = b.turn_pairs(spark, sf).select("conv_id", "turn", text.normalize_title("text").alias("a"), text.normalize_title("answer").alias("b"))
    return pairs.select("conv_id", "turn", similarity.indel_ratio("a", "b").alias("score"))


@query
def score_sequence(spark, sf):
    pairs = _name_pairs(spark, sf, text.normalize_title, F.concat("p_type", F.lit(" "), "p_name"))
    return pairs.select("a", "b", similarity.sequence_score("a", "b").alias("score"))


# ---- vectors and search


def _one_transform(spark, sf, name: str):
    changed = perturb(b.vectors(spark, sf), F.lit(name))
    return changed.select(F.col("id").alias("qid"), "vec")


@query
def perturb_vector(spark, sf):
    every = b.vectors(spark, sf).select("id", "vec", F.explode(F.array(*[F.lit(t) for t in EVAL_TRANSFORMS])).alias("transform"))
    long = perturb(every, F.col("transform")).select("id", "transform", F.posexplode("vec").alias("pos", "x"))
    return long.select("id", "transform", "pos", (F.round("x", 6) + 0.0).alias("x"))


@query
def knn_exact(spark, sf):
    asked = _one_transform(spark, sf, "contrast").select("qid", F.col("vec").alias("key"))
    stored = b.vectors(spark, sf).select("id", F.col("vec").alias("key"))
    return vx.nearest(asked, stored, k=5).select("qid", "id", F.col("score").alias("confidence"), "rank")


@query
def knn_tiled(spark, sf):
    """More queries than travel to the rows at once, with ids stored twice and queries asked twice under one name."""
    asked = _one_transform(spark, sf, "contrast").unionByName(_one_transform(spark, sf, "brightness"))
    stored = b.vectors(spark, sf).select("id", "vec").unionByName(_one_transform(spark, sf, "aged").withColumnRenamed("qid", "id"))
    stored = stored.select("id", F.col("vec").alias("key"))
    hits = vx.nearest(asked.select("qid", F.col("vec").alias("key")), stored, k=5, probe_bytes=0)
    return hits.select("qid", "id", F.col("score").alias("confidence"), "rank")


@query
def hamming_search(spark, sf):
    asked = _one_transform(spark, sf, "brightness").select("qid", vx.signature("vec").alias("sig"))
    changed = _one_transform(spark, sf, "contrast").select(F.concat("qid", F.lit("c")).alias("qid"), vx.signature("vec").alias("sig"))
    stored = b.vectors(spark, sf).select("id", vx.signature("vec").alias("sig"))
    return vx.nearest_hamming(asked.unionByName(changed), stored, SearchConfig().max_hamming)


@query
def mutual_nn(spark, sf):
    """Changed items against the stored ones, within the bound of the search."""
    changed = _one_transform(spark, sf, "contrast").select(F.col("qid").alias("id"), vx.signature("vec").alias("sig"))
    stored = b.vectors(spark, sf).select("id", vx.signature("vec").alias("sig"))
    pairs = vx.mutual_nearest(changed, stored, max_hamming=SearchConfig().max_hamming)
    best = pairs.orderBy("distance", "left_id", "right_id").limit(50)
    place = Window.orderBy("distance", "left_id", "right_id")  # over the 50 kept pairs
    return best.withColumn("rank", F.row_number().over(place))


def _cells(vectors: DataFrame) -> int:
    """The number of cells grows with the square root of the data."""
    return max(16, int(vectors.count() ** 0.5))


def _index(spark, sf, vectors: DataFrame | None = None) -> tuple[str, ix.CellIndex]:
    path, stored = scratch_dir(spark), b.vectors(spark, sf)
    ix.build_index(vectors if vectors is not None else stored, path, _cells(stored), seeded=True)
    return path, ix.load_index(spark, path)


def _sig_text() -> Column:
    return F.array_join(F.transform("sig", lambda x: x.cast("string")), ",").alias("sig")


@query
def ivf_assign(spark, sf):
    return _index(spark, sf)[1].postings.select("id", "cell", _sig_text())


@query
def ivf_append(spark, sf):
    vectors = b.vectors(spark, sf)
    path, _ = _index(spark, sf, vectors.filter("label < 5"))
    ix.append_index(vectors.filter("label >= 5"), path)
    return ix.load_index(spark, path).postings.select("id", "cell", _sig_text())


@query
def ivf_kmeans(spark, sf):
    path, vectors = scratch_dir(spark), b.vectors(spark, sf)
    ix.build_index(vectors, path, _cells(vectors))
    hits = ix.search_cells(ix.load_index(spark, path), vectors.select(F.col("id").alias("qid"), "vec"))
    return hits.select("qid", "label", "confidence", "fallback_used")


@query
def ivf_search(spark, sf):
    hits = ix.search_cells(_index(spark, sf)[1], _one_transform(spark, sf, "contrast"))
    return hits.select("qid", "label", "confidence", "fallback_used")


@query
def ivf_search_joined(spark, sf):
    """More queries than travel to the postings at once, after an append, against a compacted index."""
    vectors = b.vectors(spark, sf)
    path = scratch_dir(spark)
    ix.build_index(vectors.filter("label < 5"), path, _cells(vectors), seeded=True)
    ix.append_index(vectors.filter("label >= 5"), path)
    ix.compact_index(spark, path)
    asked = _one_transform(spark, sf, "contrast").unionByName(_one_transform(spark, sf, "aged").withColumn("qid", F.concat("qid", F.lit("a"))))
    hits = ix.search_cells(ix.load_index(spark, path), asked, probe_bytes=0)
    return hits.select("qid", "label", "confidence", "fallback_used")


@query
def index_stats(spark, sf):
    return ix.index_stats(_index(spark, sf)[1])


@query
def dedupe_last(spark, sf):
    return lookup.dedupe_last(b.metadata_history(spark, sf))


@query
def search_lookup(spark, sf):
    hits = ix.search_cells(_index(spark, sf)[1], _one_transform(spark, sf, "contrast"))
    return lookup.find_matches(hits, b.metadata_history(spark, sf)).drop("latency_ms")


@query
def resolve_returned(spark, sf):
    """Every stored vector asked; items of even number are the sample that holds its contents, all documents the store."""
    stored = b.vectors(spark, sf).select("id", F.col("vec").alias("key"))
    second = vx.nearest(stored.select(F.col("id").alias("qid"), "key"), stored, k=2).filter("rank = 2 or score < 0.9")
    label = F.when(F.col("score") < 0.36, F.lit(UNKNOWN_LABEL)).otherwise(F.col("id"))
    detail = second.select(F.col("qid").alias("id"), label.alias("label"))
    docs = b.table(spark, sf, "documents").select(cat.visual_id("doc_id").alias("id"), F.col("text").alias("content"), "doc_id")
    out = lookup.resolve_returned(detail, docs.filter("doc_id % 2 = 0").select("id", "content"), docs.select("id", "content"))
    return out.select("id", "label", "origin", F.md5(F.encode("content", "UTF-8")).alias("digest"))


# ---- sampling, evaluation, reports


@query
def sample_n(spark, sf):
    return sampling.sample_n(b.metadata_history(spark, sf).select("id").distinct(), 100)


def _eval(spark, sf, transforms, latency: bool = True):
    search = ev.cell_search(_index(spark, sf)[1])
    detail = ev.eval_detail(ev.eval_queries(b.vectors(spark, sf), transforms), search)
    return detail.join(b.latencies(spark, sf), "id", "left") if latency else detail


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query
def eval_summary(spark, sf):
    summary = ev.eval_summary(_eval(spark, sf, "contrast"), [])
    return _rounded(summary, "accuracy", "fallbacks", "avg_ms", "p95_ms")


@query
def eval_matrix(spark, sf):
    summary = ev.eval_summary(_eval(spark, sf, EVAL_TRANSFORMS), ["transform"])
    return _rounded(summary, "accuracy", "fallbacks", "avg_ms", "p95_ms")


@query
def eval_report(spark, sf):
    """Both layouts: the table over all perturbations and the block for one."""
    stats, out = ix.index_stats(_index(spark, sf)[1]), None
    for layout, transforms in (("table", "all"), ("block", "contrast")):
        path = scratch_dir(spark)
        ev.write_report(ev.eval_summary(_eval(spark, sf, transforms), ["transform"]), path, stats)
        lines = spark.read.text(f"{path}/summary_text").select(F.lit(layout).alias("layout"), F.col("value").alias("line"))
        out = lines if out is None else out.unionByName(lines)
    return out


@query
def eval_latency(spark, sf):
    return _rounded(ev.latency_summary(b.table(spark, sf, "events"), "event_type", "value"), "avg_ms", "p95_ms")


@query
def eval_detail(spark, sf):
    ranked = sampling.sample_rank(b.vectors(spark, sf).select("id"), -1)
    return ev.detail_lines(_eval(spark, sf, "all", latency=False).join(ranked, "id"), 20)


def _live(spark, sf, n):
    search = ev.cell_search(_index(spark, sf)[1])
    known = b.metadata_history(spark, sf).select("id").distinct()
    detail = ev.live_detail(known, b.vectors(spark, sf), search, n)
    return detail.join(b.latencies(spark, sf), "id", "left").withColumn(
        "latency_ms", F.when(F.col("label").isNotNull(), F.col("latency_ms"))
    )


@query
def eval_live(spark, sf):
    return _rounded(ev.live_summary(_live(spark, sf, 100)), "accuracy", "avg_ms")


@query
def eval_scaling(spark, sf):
    return _rounded(ev.scaling_summary(_live(spark, sf, 500)), "accuracy", "avg_ms")


@query
def eval_stress(spark, sf):
    search = ev.cell_search(_index(spark, sf)[1])
    known = b.metadata_history(spark, sf).select("id").distinct()
    detail = ev.stress_detail(known, b.vectors(spark, sf), search, list(REAL), n=-1)
    detail = detail.join(b.latencies(spark, sf), "id", "left")
    detail = detail.withColumn("latency_ms", F.when(F.col("label").isNotNull(), F.col("latency_ms")))
    return _rounded(ev.stress_summary(detail), "accuracy", "avg_ms")


def _filtered_metadata(spark, sf):
    return cat.to_metadata(cat.standard_schema(matching.authority_filter(b.catalog(spark, sf), b.authority(spark, sf))))


@query
def diagnostics(spark, sf):
    return report.diagnostics(_filtered_metadata(spark, sf))


@query
def top_artists(spark, sf):
    return report.top_artists(_filtered_metadata(spark, sf), 100)
