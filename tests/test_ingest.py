"""Records, metadata, rebuild, incremental and streaming ingest."""

import pytest
from pyspark.sql import functions as F

from vernissage.functions.text import title_case
from vernissage.operators import index as ix
from vernissage.plans import ingest as plans
from vernissage.plans.ingest import IngestConfig, compact_dataset, open_dataset, run_incremental, run_rebuild
from vernissage.schema import META_SCHEMA
from vernissage.session import scratch_dir
from vernissage.sources import assets, authority as auth, catalog as cat, manifest
from vernissage.streaming import ingest as stream

ALL = IngestConfig(limit=-1)
SCHEMA = "idx long, title string, artist string, date string, genre string, style string"


def _item(idx, **changes):
    base = dict(
        idx=idx, title="Cornelia Street", artist="John French Sloan", date="1920", genre="cityscape", style="New Realism"
    )
    return tuple({**base, **changes}.values())


def _items(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def _names(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def test_record_fields(spark):
    items = _items(spark, _item(0), _item(1, title=None, genre=None, style=None, date=None), _item(5, artist="rene bertholo"))
    rows = {r.visual_id: r for r in cat.standard_schema(items.withColumn("canonical", title_case("artist"))).collect()}
    first = rows["wikiart_0"]
    assert first.asDict() == {
        "visual_id": "wikiart_0", "title": "Cornelia Street", "artist": "John French Sloan", "genre": "cityscape",
        "style": "New Realism", "date": "1920", "filename": "wikiart_0.jpg", "ImageURL": "hf://wikiart/0",
        "SourceURL": "https://www.wikiart.org", "Source": "wikiart",
    }
    assert (rows["wikiart_1"].title, rows["wikiart_1"].genre, rows["wikiart_1"].style, rows["wikiart_1"].date) == ("Unknown Title", "", "", "")
    assert rows["wikiart_5"].artist == "Rene Bertholo"


def test_rebuild_filters_and_keeps_the_position(spark):
    items = _items(spark, _item(0), _item(1, artist="Some Random Artist"), _item(2, artist="Sloan, John French"))
    path = scratch_dir(spark)
    rows = run_rebuild(items, _names(spark, "John French Sloan"), path).orderBy("id").collect()
    assert [(r.id, r.artist) for r in rows] == [("wikiart_0", "John French Sloan"), ("wikiart_2", "John French Sloan")]
    assert run_rebuild(items, _names(spark, "Rembrandt", "Vermeer"), path).count() == 0
    assert run_rebuild(items, _names(spark), path).count() == 3


def _many(spark, lo, hi):
    names = ["Claude Monet", "Monet, Claude", "claude monnet", "Paul Cézanne", "Unlisted", None]
    return _items(spark, *[_item(i, artist=names[i % 6]) for i in range(lo, hi)])


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_two_increments_equal_one_rebuild(spark):
    known, path = _names(spark, "Claude Monet", "Paul Cezanne"), scratch_dir(spark)
    table, added = run_incremental(_many(spark, 0, 30), known, path, ALL)
    assert added == 20 and table.columns == META_SCHEMA.names
    table, more = run_incremental(_many(spark, 0, 60), known, path, ALL)
    assert more == 20
    assert _rows(table) == _rows(run_rebuild(_many(spark, 0, 60), known, scratch_dir(spark), ALL))
    before = sorted(table.inputFiles())
    table, none = run_incremental(_many(spark, 0, 60), known, path, ALL)
    assert none == 0 and sorted(table.inputFiles()) == before


def test_limit_counts_new_rows_only(spark):
    known, path = _names(spark, "Claude Monet"), scratch_dir(spark)
    run_incremental(_many(spark, 0, 12), known, path, ALL)
    table, added = run_incremental(_many(spark, 0, 60), known, path, IngestConfig(limit=5))
    assert added == 5
    assert {r.id for r in table.collect()} == {f"wikiart_{i}" for i in (0, 1, 2, 6, 7, 8, 12, 13, 14, 18, 19)}
    assert run_incremental(_many(spark, 0, 60), known, path, IngestConfig(limit=0))[1] == 0


def _stream(spark, root, known, **more):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/raw")
    stream.start_ingest(source, known, f"{root}/out", f"{root}/progress", **more).awaitTermination()
    return stream.load_ingested(spark, f"{root}/out")


def test_stream_equals_batch_and_resumes(spark):
    known, root = _names(spark, "Claude Monet", "Paul Cezanne").cache(), scratch_dir(spark)
    _many(spark, 0, 20).coalesce(1).write.parquet(f"{root}/raw")
    _many(spark, 10, 30).coalesce(1).write.mode("append").parquet(f"{root}/raw")  # overlaps the first file
    _stream(spark, root, known)
    _many(spark, 25, 60).coalesce(1).write.mode("append").parquet(f"{root}/raw")
    got = _stream(spark, root, known)
    assert _rows(got) == _rows(run_rebuild(_many(spark, 0, 60), known, scratch_dir(spark), ALL))


def test_replayed_batch_changes_nothing(spark):
    known, root = _names(spark, "Claude Monet"), scratch_dir(spark)
    stream.ingest_batch(_many(spark, 0, 12), 0, known, root)
    assert stream.ingest_batch(_many(spark, 6, 24), 1, known, root) == 6
    once = _rows(stream.load_ingested(spark, root))
    assert stream.ingest_batch(_many(spark, 6, 24), 1, known, root) == 6
    assert _rows(stream.load_ingested(spark, root)) == once


def test_a_new_checkpoint_loses_nothing(spark):
    known, root = _names(spark, "Claude Monet"), scratch_dir(spark)
    for k in range(2):
        _many(spark, 12 * k, 12 * k + 12).write.parquet(f"{root}/in{k}")
        source = spark.readStream.schema(spark.read.parquet(f"{root}/in{k}").schema).parquet(f"{root}/in{k}")
        stream.start_ingest(source, known, f"{root}/out", f"{root}/progress{k}").awaitTermination()
    ids = [r.id for r in stream.load_ingested(spark, f"{root}/out").collect()]
    stream.ingest_batch(_many(spark, 0, 24), 0, known, f"{root}/all")
    assert sorted(ids) == sorted(r.id for r in stream.load_ingested(spark, f"{root}/all").collect()) and ids


def test_stream_limit_counts_over_batches(spark):
    known, root = _names(spark, "Claude Monet"), scratch_dir(spark)
    assert stream.ingest_batch(_many(spark, 0, 12), 0, known, root, IngestConfig(limit=8)) == 6
    assert stream.ingest_batch(_many(spark, 12, 24), 1, known, root, IngestConfig(limit=8)) == 2
    assert stream.ingest_batch(_many(spark, 24, 36), 2, known, root, IngestConfig(limit=8)) == 0


def _vectors(spark, n):
    return spark.range(n).select(
        cat.visual_id("id").alias("id"), F.col("id").alias("ord"), F.array(F.col("id").cast("double") - 10, F.lit(1.0)).alias("vec")
    )


def _contents(spark, n):
    return spark.range(n).select(cat.visual_id("id").alias("id"), F.encode(F.concat(F.lit("bytes of "), F.col("id").cast("string")), "UTF-8").alias("content"))


def _two_cells(spark):
    return spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0])], "cell int, vec array<double>")


def _ids(data):
    """The ids of metadata, assets and index, which are the same."""
    three = [sorted(r.id for r in df.select("id").collect()) for df in (data.metadata, data.assets, data.index.postings)]
    assert three[0] == three[1] == three[2]
    return three[0]


def test_stream_feeds_the_index(spark):
    known, root = _names(spark, "Claude Monet"), scratch_dir(spark)
    tables = {"vectors": _vectors(spark, 40), "centroids": _two_cells(spark), "contents": _contents(spark, 40)}
    stream.ingest_batch(_many(spark, 0, 24), 0, known, root, **tables)
    assert stream.ingest_batch(_many(spark, 12, 36), 1, known, root, **tables) == 6
    data = open_dataset(spark, root)
    assert len(_ids(data)) == 18
    assert {r.cell for r in data.index.postings.filter("id = 'wikiart_0'").collect()} == {1}
    assert stream.ingest_batch(_many(spark, 12, 36), 1, known, root, **tables) == 6  # comes again after its commit
    assert _ids(open_dataset(spark, root)) == _ids(data)


def test_a_batch_that_dies_before_its_commit_is_not_seen(spark, monkeypatch):
    known, root = _names(spark, "Claude Monet"), scratch_dir(spark)
    tables = {"vectors": _vectors(spark, 40), "centroids": _two_cells(spark), "contents": _contents(spark, 40)}
    stream.ingest_batch(_many(spark, 0, 12), 0, known, root, **tables)

    def die(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(plans, "commit", die)  # everything is written, nothing is committed
        with pytest.raises(OSError):
            stream.ingest_batch(_many(spark, 12, 24), 1, known, root, **tables)
        with pytest.raises(OSError):
            run_rebuild(_many(spark, 0, 40), known, root, ALL, tables["contents"], tables["vectors"], lambda _: tables["centroids"])
    assert len(_ids(open_dataset(spark, root))) == 6
    assert stream.ingest_batch(_many(spark, 12, 24), 1, known, root, **tables) == 6
    assert len(_ids(open_dataset(spark, root))) == 12
    left = manifest.vacuum(spark, root)
    assert len(left) > 4 and len(_ids(open_dataset(spark, root))) == 12 and manifest.vacuum(spark, root) == []


def test_rebuild_replaces_assets_and_vectors_as_well(spark):
    known, root = _names(spark, "Claude Monet", "Paul Cezanne"), scratch_dir(spark)
    train = lambda vectors: ix.train_seeded(vectors, 3)
    tables = (_contents(spark, 70), _vectors(spark, 70), train)
    run_rebuild(_many(spark, 0, 60), known, root, ALL, *tables)
    first = _ids(open_dataset(spark, root))
    run_rebuild(_many(spark, 0, 30), known, root, ALL, *tables)
    data = open_dataset(spark, root)
    assert len(first) == 40 and len(_ids(data)) == 20
    assert run_incremental(_many(spark, 0, 60), known, root, ALL, *tables)[1] == 20
    run_incremental(_many(spark, 0, 66), known, root, ALL, *tables)
    before = open_dataset(spark, root)
    ids, cells = _ids(before), sorted(tuple(r) for r in before.index.postings.select("id", "cell").collect())
    assert set(first) < set(ids)
    compact_dataset(spark, root)
    after = open_dataset(spark, root)
    assert _ids(after) == ids and sorted(tuple(r) for r in after.index.postings.select("id", "cell").collect()) == cells
    assert [len(folders) for _, folders in sorted(after.version.tables.items())] == [1] * 5
    wanted = after.metadata.select("id")
    for few in (1000, 0):
        got = {r.id: bytes(r.content).decode() for r in assets.fetch_assets(wanted, after.assets, few).collect()}
        assert got == {i: f"bytes of {i.split('_')[1]}" for i in ids}


def test_many_ids_are_fetched_without_moving_what_is_stored(spark):
    root = scratch_dir(spark)
    assets.store_assets(_contents(spark, 500), root)
    wanted = spark.range(400, 700).select(cat.visual_id("id").alias("id"))
    found = assets.fetch_assets(wanted, assets.load_assets(spark, root), few=10)
    lines = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple").splitlines()
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "content" in line)
    assert "Bucketed: true" in lines[at]
    depth, above = lines[at].index("FileScan"), []
    for line in reversed(lines[:at]):
        own = len(line) - len(line.lstrip(" :+-*"))
        if own < depth:
            depth = own
            above.append(line)
    assert any("Join" in line for line in above) and not any("Exchange" in line for line in above)
    assert found.count() == 300 and found.filter("content is null").count() == 200


def test_the_number_of_buckets_grows_with_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(assets, "BUCKET_BYTES", 100)
    root = scratch_dir(spark)
    assets.store_assets(_contents(spark, 500), root)
    stored = assets.load_assets(spark, root)
    assert manifest.current(spark, root).figures["asset buckets"] == -(-sum(len(f"bytes of {i}") for i in range(500)) // 100)
    assert stored.count() == 500 and stored.select("bucket").distinct().count() > 40
    assets.store_assets(_contents(spark, 9), root, mode="append")
    assert assets.load_assets(spark, root).count() == 509


# ---- sources


def test_authority_file(spark, tmp_path):
    path = str(tmp_path / "names")
    auth.write_authority(_names(spark, "Émile", "Zed", "Adélaïde", "Abe"), path)
    (value,) = spark.read.text(path).collect()
    assert value.value == '["Abe","Adélaïde","Zed","Émile"]'
    assert sorted(r.name for r in auth.load_authority(spark, path).collect()) == ["Abe", "Adélaïde", "Zed", "Émile"]
    (tmp_path / "one.json").write_text('[\n  "A b",\n  "C", "C"\n]', encoding="utf-8")
    assert sorted(r.name for r in auth.load_authority(spark, str(tmp_path / "one.json")).collect()) == ["A b", "C"]


def test_missing_authority_is_empty(spark, tmp_path):
    assert auth.load_authority(spark, str(tmp_path / "absent.json")).isEmpty()


def test_top_names_drop_labels_after_the_limit(spark):
    rows = [(1, 9, "Ann"), (2, 9, "Q17"), (3, 5, ""), (4, 4, "Bob"), (5, 3, "Cid")]
    ranked = spark.createDataFrame(rows, "key int, weight int, name string")
    assert {r.name for r in auth.top_names(ranked, 4).collect()} == {"Ann", "Bob"}


def test_asset_files_and_store(spark, tmp_path):
    folder = tmp_path / "images"
    folder.mkdir()
    for name in ("a", "b", "x.y"):
        (folder / f"{name}.jpg").write_bytes(name.encode() * 3)
    (folder / "note.txt").write_text("no image")
    assert {r.id for r in assets.list_asset_ids(spark, str(folder)).collect()} == {"a", "b", "x.y"}
    path = str(tmp_path / "store")
    assets.store_assets(assets.read_asset_files(spark, str(folder)), path)
    wanted = spark.createDataFrame([("a",), ("gone",), ("a",)], "id string")
    for few in (1000, 0):
        got = {r.id: r.content for r in assets.fetch_assets(wanted, assets.load_assets(spark, path), few).collect()}
        assert {k: v and bytes(v) for k, v in got.items()} == {"a": b"aaa", "gone": None}
    plan = assets.fetch_assets(wanted, assets.load_assets(spark, path))._jdf.queryExecution()
    assert "PushedFilters: [In(id" in spark._jvm.PythonSQLUtils.explainString(plan, "formatted")


def test_missing_metadata_is_an_empty_table(spark, tmp_path):
    none = cat.load_metadata(spark, str(tmp_path / "absent"))
    assert none.columns == META_SCHEMA.names and none.isEmpty()


def test_images_are_not_read_for_metadata(spark, tmp_path):
    path = str(tmp_path / "raw")
    _many(spark, 0, 6).withColumn("image", F.lit(b"x")).write.parquet(path)
    out = cat.to_metadata(cat.standard_schema(cat.open_catalog(spark, path).withColumn("canonical", F.col("artist"))))
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    assert "ReadSchema" in plan and "image" not in plan[plan.index("ReadSchema"):].split("\n")[0]


@pytest.mark.parametrize("text", ['["A", "B"', '{"A": 1}', ""])
def test_damaged_authority_list_is_an_error(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text or " ")
    with pytest.raises(Exception):
        auth.load_authority(spark, str(tmp_path / "bad.json")).collect()


def test_unreadable_metadata_is_an_error(spark, tmp_path):
    (tmp_path / "part-0.parquet").write_text("no table")
    with pytest.raises(Exception):
        cat.load_metadata(spark, str(tmp_path)).collect()
