"""Vector search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vernissage.operators import index as ix, vectors as vx
from vernissage.schema import SearchConfig
from vernissage.session import scratch_dir
from vernissage.sources import manifest


def _frame(spark, ids, rows, name="id", col="vec"):
    data = [(i, [float(x) for x in r]) for i, r in zip(ids, rows)]
    return spark.createDataFrame(data, f"{name} string, {col} array<double>")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    stored = rng.normal(size=(300, 64))
    stored[5] = stored[17]  # an exact tie
    asked = stored[::5] + 0.3 * rng.normal(size=(60, 64))
    asked[3] = stored[17]
    return [f"v{i:03d}" for i in range(300)], stored, [f"q{i}" for i in range(60)], asked


def _brute(ids, stored, names, asked, k):
    s = vx.cosine(asked, stored)
    out = set()
    for i, name in enumerate(names):
        order = sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:k]
        out |= {(name, ids[j], s[i, j], r + 1) for r, j in enumerate(order)}
    return out


@pytest.mark.parametrize("k", [1, 4, 500])
@pytest.mark.parametrize("probe_bytes", [vx.PROBE_BYTES, 100])
def test_nearest_scanned_and_tiled(spark, data, k, probe_bytes, monkeypatch):
    monkeypatch.setattr(vx, "TILE_QUERIES", 16)
    monkeypatch.setattr(vx, "TILE_ROWS", 40)
    ids, stored, names, asked = data
    q = _frame(spark, names, asked, "qid", "key").repartition(3)
    rows = _frame(spark, ids, stored, "id", "key").repartition(5)
    hits = vx.nearest(q, rows, k=k, probe_bytes=probe_bytes).collect()
    got = {(r.qid, r.id, r.score, r["rank"]) for r in hits}
    assert len(got) == len(hits) and got == _brute(*data, k)


def test_many_queries_do_not_pass_through_the_driver(spark, data, monkeypatch):
    """More queries than may travel meet the rows in tiles: with copies of vectors and of ids, ties, and every kernel."""
    monkeypatch.setattr(vx, "TILE_QUERIES", 16)
    monkeypatch.setattr(vx, "TILE_ROWS", 40)
    monkeypatch.setattr(vx, "TILE_BYTES", 1 << 15)
    ids, stored, names, asked = data
    stored = np.concatenate([stored, stored[:100], np.repeat(stored[17:18], 90, axis=0), np.round(stored[100:200], 3)])
    ids = ids + ids[:100] + [f"w{i:02d}" for i in range(90)] + ids[100:200]
    q = _frame(spark, names, asked, "qid", "key").repartition(3)
    rows = _frame(spark, ids, stored, "id", "key").repartition(5)
    seen = []
    monkeypatch.setattr(vx, "scan_hits", lambda *a: seen.append(a))
    score = vx.cosine(asked, stored)
    best = {}
    for i, j in np.ndindex(score.shape):
        at = names[i], ids[j]
        best[at] = max(best.get(at, -2), score[i, j])
    want = set()
    for name in names:
        order = sorted({i for i in ids}, key=lambda j: (-best[name, j], j))[:7]
        want |= {(name, j, best[name, j], r + 1) for r, j in enumerate(order)}
    hits = vx.nearest(q, rows, k=7, probe_bytes=0).collect()
    assert {(r.qid, r.id, r.score, r["rank"]) for r in hits} == want and len(hits) == len(want) and not seen


def test_tiles_keep_to_their_cells(spark, data, monkeypatch):
    monkeypatch.setattr(vx, "TILE_QUERIES", 16)
    ids, stored, names, asked = data
    q = _frame(spark, names, asked, "qid", "key").withColumn("cell", F.crc32("qid") % 3)
    rows = _frame(spark, ids, stored, "id", "key").withColumn("cell", F.crc32("id") % 4)
    few, many = ({tuple(r) for r in vx.nearest(q, rows, k=3, probe_bytes=b).collect()} for b in (vx.PROBE_BYTES, 0))
    monkeypatch.setattr(vx, "TILE_QUERIES", 100)
    assert many == {tuple(r) for r in vx.nearest(q, rows, k=3).collect()} == few and len(many) == 180


def test_tiles_hold_when_one_id_has_many_copies(spark, monkeypatch):
    monkeypatch.setattr(vx, "TILE_ROWS", 10)
    rows = _frame(spark, ["a"] * 200 + ["b"], [[1, 0]] * 200 + [[0, 1]], "id", "key")
    q = _frame(spark, ["q"], [[0.9, 0.1]], "qid", "key")
    assert [tuple(r)[:2] for r in vx.nearest(q, rows, probe_bytes=0).collect()] == [("q", "a")]


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "qid string, key array<double>")
    rows = _frame(spark, ["a"], [[1, 0]], "id", "key")
    assert vx.nearest(none, rows).count() == 0


@pytest.mark.parametrize("probe_bytes", [vx.PROBE_BYTES, 0])
def test_repeated_ids_and_queries_have_one_meaning(spark, probe_bytes):
    rows = _frame(spark, ["a", "a", "a", "b", "c"], [[1, 0], [1, 0], [0.9, 0.1], [0, 1], [1, 1]], "id", "key")
    asked = _frame(spark, ["q", "q", "r"], [[1, 0], [0, 1], [1, 0.01]], "qid", "key")
    got = sorted((r.qid, r.rank, r.id) for r in vx.nearest(asked, rows, k=2, probe_bytes=probe_bytes).collect())
    assert got == [("q", 1, "a"), ("q", 2, "b"), ("r", 1, "a"), ("r", 2, "c")]


def test_queries_without_a_vector_are_unknown(spark, built):
    asked = spark.createDataFrame([("x", None), ("z", [0.0] * 64)], "qid string, vec array<double>")
    got = {r.qid: (r.label, r.fallback_used) for r in ix.search_cells(ix.load_index(spark, built), asked).collect()}
    assert got == {"x": ("Unknown", True), "z": ("Unknown", True)}


def test_training_leaves_out_zero_vectors(spark, data):
    ids, stored, _, _ = data
    zero = _frame(spark, ["zero"], [np.zeros(len(stored[0]))])
    assert ix.train_kmeans(_frame(spark, ids, stored).unionByName(zero), 4).count() == 4


def test_signature_bits(spark, data):
    ids, stored, _, _ = data
    got = {r.id: r.s for r in _frame(spark, ids, stored).select("id", vx.signature("vec").alias("s")).collect()}
    for i, row in zip(ids, stored):
        assert got[i] == [sum(1 << j for j in range(32) if at + j < len(row) and row[at + j] > 0) for at in range(0, len(row), 32)]


@pytest.mark.parametrize("probe_bytes", [vx.PROBE_BYTES, 0])
def test_mutual_nearest(spark, probe_bytes, monkeypatch):
    monkeypatch.setattr(vx.nearest, "__defaults__", (1, vx.cosine, probe_bytes, None))
    rng = np.random.default_rng(2)
    a = {f"a{i:02d}": int(x) for i, x in enumerate(rng.integers(0, 2**20, 40))}
    b = {f"b{i:02d}": int(x) for i, x in enumerate(rng.integers(0, 2**20, 50))}
    df = lambda d: spark.createDataFrame([(k, [v & 1023, v >> 10]) for k, v in d.items()], "id string, sig array<bigint>")
    got = {tuple(r) for r in vx.mutual_nearest(df(a), df(b), 6).collect()}
    dist = lambda x, y: (a[x] ^ b[y]).bit_count()
    fwd = {x: min(b, key=lambda y: (dist(x, y), y)) for x in a}
    back = {y: min(a, key=lambda x: (dist(x, y), x)) for y in b}
    assert got == {(x, y, dist(x, y)) for x, y in fwd.items() if back[y] == x and dist(x, y) <= 6} and got


@pytest.fixture(scope="module")
def built(spark, data):
    ids, stored, _, _ = data
    path = scratch_dir(spark)
    vectors = _frame(spark, ids, stored).withColumn("ord", F.substring("id", 2, 3).cast("int"))
    ix.build_index(vectors, path, 12, seeded=True)
    return path


def test_probing_every_cell_is_exact(spark, data, built):
    ids, stored, names, asked = data
    config = SearchConfig(nprobe_fast=12, nprobe_deep=12, confidence_threshold=-1.0)
    hits = ix.search_cells(ix.load_index(spark, built), _frame(spark, names, asked, "qid"), config).collect()
    assert {(r.qid, r.label, r.confidence, 1) for r in hits} == _brute(*data, 1)
    assert not any(r.fallback_used for r in hits)


def test_unsure_queries_fall_back_and_may_stay_unknown(spark, data, built):
    ids, stored, _, _ = data
    rng = np.random.default_rng(4)
    asked = np.vstack([stored[8], rng.normal(size=64)])
    hits = {r.qid: r for r in ix.search_cells(ix.load_index(spark, built), _frame(spark, ["own", "noise"], asked, "qid")).collect()}
    assert (hits["own"].label, hits["own"].confidence, hits["own"].fallback_used) == ("v008", 1.0, False)
    assert hits["noise"].label == "Unknown" and hits["noise"].fallback_used


def test_append_equals_one_build(spark, data):
    ids, stored, _, _ = data
    vectors = _frame(spark, ids, stored).withColumn("ord", F.substring("id", 2, 3).cast("int"))
    whole, parts = scratch_dir(spark), scratch_dir(spark)
    ix.build_index(vectors, whole, 12, seeded=True)
    ix.build_index(vectors.filter("ord < 100"), parts, 12, seeded=True)
    ix.append_index(vectors.filter("ord >= 100"), parts)
    rows = lambda p: sorted((r.cell, r.id, r.sig) for r in ix.load_index(spark, p).postings.collect())
    assert rows(whole) == rows(parts)
    stats = ix.index_stats(ix.load_index(spark, parts)).first()
    assert (stats.n_images, stats.n_features, stats.is_built) == (300, 300, True)


def test_large_cells_get_several_files(spark, data, monkeypatch):
    monkeypatch.setattr(ix, "FILE_ROWS", 50)
    ids, stored, _, _ = data
    path = scratch_dir(spark)
    vectors = _frame(spark, ids, stored).withColumn("ord", F.substring("id", 2, 3).cast("int")).repartition(6)
    ix.build_index(vectors, path, 1, seeded=True)
    index = ix.load_index(spark, path)
    assert index.postings.count() == 300
    assert index.postings.select(F.input_file_name()).distinct().count() > 1


def _plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_search_reads_only_the_probed_cells(spark, built):
    postings = ix.load_index(spark, built).postings.filter(F.col("slot").isin([1 << 24, 2 << 24]))
    plan = _plan(postings)
    assert "PushedFilters: [In(slot, [16777216,33554432])]" in plan
    probed = spark.createDataFrame([("q", [1.0] * 64, 1 << 24)], "qid string, key array<double>, slot bigint").groupBy("slot")
    plan = _plan(probed.cogroup(postings.groupBy("slot")).applyInArrow(lambda a, b: a, "qid string, key array<double>, slot bigint"))
    chosen, every = plan.split("SelectedBucketsCount: ")[1].split("\n")[0].split(" out of ")
    assert int(chosen) <= 2 <= int(every)


def test_many_queries_meet_the_postings_in_place(spark, data, built, monkeypatch):
    monkeypatch.setattr(vx, "TILE_QUERIES", 1)
    monkeypatch.setattr(ix, "ROUND_QUERIES", 8)
    ids, stored, names, asked = data
    index, queries = ix.load_index(spark, built), _frame(spark, names, asked, "qid")
    few, many = (sorted(map(tuple, ix.search_cells(index, queries, probe_bytes=b).collect())) for b in (vx.PROBE_BYTES, 0))
    assert few == many
    probed = _frame(spark, names, asked, "qid", "key").withColumn("slot", F.lit(1 << 24))
    hits = ix.search_slots(probed, index.postings.select("id", F.col("vec").alias("key"), "slot"))
    lines = spark._jvm.PythonSQLUtils.explainString(hits._jdf.queryExecution(), "simple").splitlines()
    scans = [i for i, line in enumerate(lines) if "FileScan" in line and "key" not in line and "slot" in line and "vec" in line]
    assert len(scans) > 4  # a round each
    for at in scans:  # between the postings and their meeting with the queries nothing is exchanged
        assert "Bucketed: true" in lines[at]
        depth, above = lines[at].index("FileScan"), []
        for line in reversed(lines[:at]):
            own = len(line) - len(line.lstrip(" :+-*()0123456789"))
            if own < depth:
                depth = own
                above.append(line)
                if "FlatMapCoGroups" in line:
                    break
        assert "FlatMapCoGroups" in above[-1] and not any("Exchange" in line for line in above)


def test_compaction_fills_parts_and_keeps_every_row(spark, data, monkeypatch):
    monkeypatch.setattr(ix, "FILE_ROWS", 320)  # parts of ten rows
    ids, stored, names, asked = data
    path, vectors = scratch_dir(spark), _frame(spark, ids, stored).withColumn("ord", F.substring("id", 2, 3).cast("int"))
    ix.build_index(vectors.filter("ord < 40"), path, 3, seeded=True)
    for low in range(40, 300, 65):
        ix.append_index(vectors.filter(f"ord >= {low} and ord < {low + 65}"), path)
    index = ix.load_index(spark, path)
    rows = lambda: sorted((r.id, r.cell) for r in ix.load_index(spark, path).postings.collect())
    before, hits = rows(), sorted(map(tuple, ix.search_cells(index, _frame(spark, names, asked, "qid")).collect()))
    assert index.postings.groupBy("slot").count().agg(F.max("count")).first()[0] <= 20
    ix.compact_index(spark, path)
    assert len(manifest.vacuum(spark, path)) >= 5
    after = ix.load_index(spark, path)
    sizes = [r["count"] for r in after.postings.groupBy("slot").count().collect()]
    assert max(sizes) <= 20 and sum(sizes) == 300 and rows() == before
    assert sorted(map(tuple, ix.search_cells(after, _frame(spark, names, asked, "qid")).collect())) == hits
    assert after.cells.agg(F.sum("rows"), F.sum("parts")).first()[:] == (300, len(sizes))


def test_an_append_that_dies_changes_nothing(spark, data):
    ids, stored, _, _ = data
    path, vectors = scratch_dir(spark), _frame(spark, ids, stored).withColumn("ord", F.substring("id", 2, 3).cast("int"))
    ix.build_index(vectors.filter("ord < 100"), path, 4, seeded=True)
    before = manifest.current(spark, path)
    ix.write_append(vectors.filter("ord >= 100"), path, before)  # written, never committed
    assert ix.load_index(spark, path).postings.count() == 100
    ix.append_index(vectors.filter("ord >= 100"), path)
    assert ix.load_index(spark, path).postings.count() == 300
    with pytest.raises(RuntimeError):
        manifest.commit(spark, path, before, {})


@pytest.mark.parametrize("center_bytes", [64 << 20, 3000])
def test_closest_cells_against_brute_force(spark, data, center_bytes, monkeypatch):
    monkeypatch.setattr(ix, "CENTER_BYTES", center_bytes)
    monkeypatch.setattr(ix, "_SCORES", 100)
    ids, stored, _, _ = data
    centers = np.vstack([stored[:40], stored[:3]])  # equal centres: the lowest number wins
    centroids = _frame(spark, [str(i) for i in range(43)], centers, "cell").selectExpr("cast(cell as int) as cell", "vec")
    got = {r.id: r.cells for r in ix.rank_cells(_frame(spark, ids, stored), centroids, 5).collect()}
    score = vx.cosine(stored, centers)
    assert got == {i: sorted(range(43), key=lambda c: (-score[n, c], c))[:5] for n, i in enumerate(ids)}


@pytest.mark.parametrize("radius, chunk_bits", [(0, None), (6, None), (6, 8), (11, 16), (20, 4), (25, 8)])
def test_signatures_within_a_radius(spark, radius, chunk_bits):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 14), replace=False)) for b in base for _ in range(12)]
    left, right = near[::2], near[1::2] + [int(b) for b in base] + near[:1]
    frame = lambda xs, name: spark.createDataFrame([(f"{name}{i:03d}", [x & 0xFFFFFFFF, x >> 32]) for i, x in enumerate(xs)] + [(None, [1, 1]), ("none", None)], "id string, sig array<bigint>")
    far = lambda x, y: (x ^ y).bit_count()
    hits = {r.qid: (r.distance, r.id) for r in vx.nearest_hamming(frame(left, "q").withColumnRenamed("id", "qid"), frame(right, "r"), radius, chunk_bits).collect() if r.qid}
    want = {f"q{i:03d}": min((far(x, y), f"r{j:03d}") for j, y in enumerate(right)) for i, x in enumerate(left)}
    assert hits == {q: best for q, best in want.items() if best[0] <= radius}
    back = {j: min((far(x, y), f"q{i:03d}") for i, x in enumerate(left)) for j, y in enumerate(right)}
    got = {tuple(r) for r in vx.mutual_nearest(frame(left, "q"), frame(right, "r"), radius, chunk_bits).collect()}
    assert got == {(q, r, d) for q, (d, r) in want.items() if d <= radius and back[int(r[1:])][1] == q}


def test_listed_signatures_are_not_broadcast(spark):
    """A list holds hundreds of rows for each signature, which its planned size does not show."""
    frame = spark.createDataFrame([(f"v{i}", [i * 7919, i * 104729]) for i in range(50)], "id string, sig array<bigint>")
    pairs = vx.within_hamming(frame.select("sig"), frame.select("sig"), 11, 2)
    for df in (pairs, vx.mutual_nearest(frame, frame, 11), vx.nearest_hamming(frame.withColumnRenamed("id", "qid"), frame, 11)):
        plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
        assert "SortMergeJoin [chunk" in plan and "BroadcastHashJoin [chunk" not in plan
    close = {(tuple(r.a), tuple(r.b)) for r in pairs.collect()}
    bits = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b))
    sigs = [(i * 7919, i * 104729) for i in range(50)]
    assert close == {(a, b) for a in sigs for b in sigs if bits(a, b) <= 11}


def test_signatures_of_two_lengths_are_an_error(spark):
    frame = spark.createDataFrame([("a", [1]), ("b", [1, 2])], "id string, sig array<bigint>")
    with pytest.raises(ValueError):
        vx.mutual_nearest(frame, frame, 3)
    assert vx.mutual_nearest(frame.limit(0), frame.limit(0), 3).collect() == []


def test_trained_cells_find_the_items_themselves(spark, data):
    ids, stored, _, _ = data
    path = scratch_dir(spark)
    ix.build_index(_frame(spark, ids, stored), path, 12)
    hits = ix.search_cells(ix.load_index(spark, path), _frame(spark, ids, stored, "qid"), SearchConfig(nprobe_fast=8)).collect()
    assert np.mean([r.qid == r.label or {r.qid, r.label} == {"v005", "v017"} for r in hits]) >= 0.9
