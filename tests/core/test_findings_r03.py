"""What the reviewer of round 3 found."""

import duckdb
import numpy as np
import pytest
from acquira.operators import allocation, campaign, cells, clusters, density, research, sequential
from acquira.plans import catalog
from acquira.sources import readers, writers
from pyspark.sql import functions as F

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
#: Of images on which an overlap is 0.6 but for the last digits: image, part, supplier, quantity, tax, discount, line.
EDGES = [
    (2742478, 364602, 18732, 41.0, 0.05, 0.08, 1), (2742478, 362250, 18820, 47.0, 0.05, 0.04, 2), (2742478, 367867, 18404, 6.0, 0.06, 0.04, 3), (2742478, 366609, 18374, 34.0, 0.07, 0.01, 5),
    (5782969, 778650, 38452, 29.0, 0.05, 0.09, 1), (5782969, 765866, 38718, 3.0, 0.07, 0.06, 1), (5782969, 760575, 38126, 1.0, 0.07, 0.1, 1), (5782969, 777321, 38374, 47.0, 0.02, 0.08, 2), (5782969, 772625, 38096, 13.0, 0.04, 0.08, 2),
    (5782969, 766406, 38461, 18.0, 0.07, 0.01, 4), (5782969, 766982, 38618, 20.0, 0.06, 0.05, 4), (5782969, 768103, 38286, 34.0, 0.03, 0.06, 6), (5782969, 775817, 38109, 39.0, 0.01, 0.06, 7), (5782969, 760615, 38233, 31.0, 0.01, 0.04, 7),
]


@pytest.mark.parametrize("name", ["nms_fold", "population_nms_gate", "pseudo_reference"])
def test_suppression_at_the_threshold(spark, tmp_path, name):
    lines = [(o + k, p, s, n, q, 1.0, d, x, "N", "O", None) for k in range(4) for o, p, s, q, x, d, n in EDGES]
    spark.createDataFrame(lines, LINES).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    for t in ("lineitem", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(r[0] for r in con.execute(catalog.ORACLE[name]).fetchall())
    assert sorted(r.pos for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()) == want


def test_artefacts_lose_no_file(spark, tmp_path):
    """Documents that met in one file were read as the first of them alone."""
    ids = spark.range(3000).repartition(24)
    counts = ids.select(F.lpad(F.col("id").cast("string"), 12, "0").alias("image_id"), F.lit("c").alias("class_name"), F.lit(1).cast("long").alias("n"))
    box = F.struct(*[F.lit(float(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])
    boxes = ids.select(F.col("id").cast("string").alias("image_id"), F.lit("c").alias("class_name"), F.lit(0.5).alias("score"), box.alias("box"))
    for i, files in enumerate((None, 16, 40)):
        writers.write_counts(counts, str(tmp_path / f"c{i}"), files=files)
        assert readers.read_counts(spark, str(tmp_path / f"c{i}")).select("image_id").distinct().count() == 3000
        writers.write_detections(boxes.drop("score"), boxes, str(tmp_path / f"d{i}"), "v", files=files)
        assert [d.select("image_id").distinct().count() for d in readers.read_detections(spark, str(tmp_path / f"d{i}"), "v")] == [3000, 3000]


def test_meetings_of_copies_and_shelves(spark, monkeypatch):
    """Copies ask once, and what a meeting compares and sends at a time is bounded."""
    monkeypatch.setattr(cells, "PART_ROWS", 16)
    monkeypatch.setattr(cells, "HELD", 400)
    monkeypatch.setattr(cells, "SENT", 50)
    x = np.random.default_rng(4).normal(size=(40, 12))[np.arange(200) % 40]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "pos long, embedding array<double>")
    plain = cells.best_of
    monkeypatch.setattr(cells, "best_of", lambda s, ids, k: (_ for _ in ()).throw(ValueError(f"{s.size} at once")) if s.size > 400 else plain(s, ids, k))
    got, found = cells.knn(df, df, k=7, id_col="pos")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    assert {r.pos: [n.id for n in r.near] for r in got.collect()} == {i: [j for _, j in sorted(zip(-s[i], range(200), strict=True))[:7]] for i in range(200)}
    assert found.compared <= 2 * 40 * 200  # 40 vectors ask, not 200
    status = {r.pos: (r.status, r.cluster) for r in clusters.dbscan(df, eps=1e-6, minimum=5, key="pos").collect()}
    assert status == {i: ("core", i % 40) for i in range(200)}


def test_later_meetings_order_only_what_reaches_the_bound(spark, monkeypatch):
    """Only the first cells of an asker are ordered; of the others, only rows as near as the k-th found there."""
    monkeypatch.setattr(cells, "PART_ROWS", 16)
    x = np.random.default_rng(6).normal(size=(300, 12))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "pos long, embedding array<double>")
    plain = cells.best_of
    monkeypatch.setattr(cells, "best_of", lambda s, ids, k: (_ for _ in ()).throw(ValueError(f"{s.shape[1]} rows ordered")) if s.shape[1] > 64 else plain(s, ids, k))
    got, _ = cells.knn(df, df, k=5, id_col="pos")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    assert {r.pos: [n.id for n in r.near] for r in got.collect()} == {i: [j for _, j in sorted(zip(-s[i], range(300), strict=True))[:5]] for i in range(300)}


def test_counting_neighbours_spreads_no_mask(spark, monkeypatch):
    """Neighbours are counted from the pairs in reach alone; here no row is a core, so nothing but the count looks at pairs."""
    monkeypatch.setattr(cells, "PART_ROWS", 16)
    monkeypatch.setattr(clusters, "spread", lambda mask: (_ for _ in ()).throw(ValueError("a mask was spread")))
    x = np.random.default_rng(7).normal(size=(300, 12))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    most = int((1 - u @ u.T <= 0.5).sum(1).max())
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    status = lambda minimum: {r.vec_id: r.status for r in clusters.dbscan(df, eps=0.5, minimum=minimum).collect()}
    assert set(status(most + 1).values()) == {"noise"}
    monkeypatch.undo()
    core = (1 - u @ u.T <= 0.5).sum(1) >= most
    assert {i for i, s in status(most).items() if s == "core"} == set(np.flatnonzero(core))


@pytest.mark.parametrize("known", [0, 3])
def test_k_centre_reads_vectors_once_each(spark, known):
    """A pool that names its vectors has the choices of one that carries them."""
    r = np.random.default_rng(8)
    u = r.normal(size=(20, 6))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    rows = [(i, i // 3, 1 + i // 3 % 4, float(i % 7), int(v)) for i, v in enumerate(r.integers(0, 20, 240))]
    pool = spark.createDataFrame(rows, "pos long, image_id long, cost long, tie double, vec_id long")
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "vec_id long, embedding array<double>")
    reference = r.normal(size=(known, 6)) if known else None
    want = sequential.k_centre(pool.join(vectors, "vec_id"), budget=40, reference=reference, ahead=1000)
    got = sequential.k_centre(pool, budget=40, reference=reference, ahead=8, vectors=vectors)
    assert len(want) > 8 and got.fillna(-1).to_dict("records") == want.fillna(-1).to_dict("records")


def test_distances_to_many_centres_are_bounded():
    import tracemalloc

    x, c = np.eye(4).repeat(1000, 0), np.eye(4).repeat(2500, 0)
    tracemalloc.start()
    assert (sequential._far(x, c) == 0).all()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50e6  # all at once: 320 MB


@pytest.mark.parametrize("size", [30, 170, 399])
def test_core_distances_are_counted_between_bounds(spark, monkeypatch, size):
    """Where a core distance has many rows within, they are counted; what is listed is one bin of them."""
    monkeypatch.setattr(cells, "PART_ROWS", 32)
    for name, value in (("LISTED", 4), ("SAMPLE", 100)):
        monkeypatch.setattr(density, name, value)
    listed, plain = [], density._lists
    monkeypatch.setattr(density, "_lists", lambda who, d, w, n: listed.append((len(d), n)) or plain(who, d, w, n))
    monkeypatch.setattr(density.Cells, "meet", everything)
    r = np.random.default_rng(10)
    x, weight = r.normal(size=(300, 6)), r.integers(1, 4, 300)
    x[200:] = x[200] + 0.02 * r.normal(size=(100, 6))
    df = spark.createDataFrame([(i, v.tolist(), int(w)) for i, (v, w) in enumerate(zip(x, weight, strict=True))], "k long, v array<double>, weight long")
    got = {c.k: c.core for c in density.core_distances(df, cells.Cells(df), size).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.sqrt(np.maximum(2 - 2 * np.round(u @ u.T, 12), 0))
    want = [np.sort(np.repeat(row, weight))[size - 1] for row in d]
    assert np.allclose([got[i] for i in range(300)], want, atol=1e-9)
    assert sum(n for n, _ in listed) < 300 * 300 / 4


def everything(self, askers, choose, compare, schema):
    """One meeting of all askers with all rows, in this process."""
    import pyarrow as pa

    a, b = askers.toArrow(), self.homes.toArrow()
    cosines = cells.directions(a["v"], True) @ cells.directions(b["v"], False).T
    d = np.sqrt(np.maximum(2 - 2 * (cells.directions(a["v"], True) @ self.pivots.T), 0))
    wanted = choose(d, pa.RecordBatch.from_arrays([c.combine_chunks() for c in a.columns], a.column_names)) if len(a) else np.zeros((0, len(self.pivots)), bool)
    rows = compare(a, b, cosines, (wanted, cells.numbers(b["cell"]))) if len(a) else [[] for _ in schema.names]
    lists = [c.to_pylist() if isinstance(c, (pa.Array, pa.ChunkedArray)) else np.asarray(c).tolist() for c in rows]
    return self.spark.createDataFrame(list(zip(*lists, strict=True)), schema)


@pytest.mark.parametrize("coherence", ["density", "continuous"])
def test_campaign_holds_a_vector_once(spark, monkeypatch, coherence):
    """Rows name their vectors; no table that is written has a vector in each row, and the choices are the same."""
    r = np.random.default_rng(11)
    u = r.normal(size=(12, 5))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    rows = [(i, float(e), i // 2, 1 + i // 2 % 3, int(v)) for i, (e, v) in enumerate(zip(np.round(r.random(240), 1), r.integers(0, 12, 240), strict=True))]
    pool = spark.createDataFrame(rows, "pos long, entropy double, image_id long, cost long, vec_id long")
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "vec_id long, embedding array<double>")
    spec, reference = research.Spec("combined", coherence), vectors.where("vec_id < 3").select("embedding")
    want = research.campaign(pool.join(vectors, "vec_id"), spec, budget=20, rounds=2, reference=reference).collect()
    plain, seen = research.written, []

    def checked(df):
        out = plain(df)
        if any(f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "double" for f in out.schema):
            seen.append(out.count())
        return out

    for m in (research, cells, clusters, density):
        monkeypatch.setattr(m, "written", checked)
    got = research.campaign(pool, spec, budget=20, rounds=2, reference=reference, ahead=7, vectors=vectors).collect()
    assert len(want) > 8 and got == want and max(seen) < 60


def test_rounds_find_novelty_once_for_each_vector(spark, monkeypatch):
    """Rows that name their vectors have the picks of rows that carry them, and only vectors are searched."""
    r = np.random.default_rng(12)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(15, 5)))], "vec_id long, embedding array<double>")
    rows = [(i, i // 2, int(v), *map(float, x)) for i, (v, x) in enumerate(zip(r.integers(0, 15, 300), np.round(r.random((300, 4)), 1), strict=True))]
    pool = spark.createDataFrame(rows, "pos long, image_id long, vec_id long, u double, a double, r double, g double").withColumn("d", F.lit(0.0))
    config = campaign.ARMS["admissible_plan"]
    want = sorted(map(tuple, campaign.select(pool.join(vectors, "vec_id"), config, budget=30, rounds=2).collect()))
    plain, asked = campaign.neighbours.nearest, []
    monkeypatch.setattr(campaign.neighbours, "nearest", lambda df, *a, **k: asked.append(df.count()) or plain(df, *a, **k))
    for ahead in (16, 1000):
        assert sorted(map(tuple, campaign.select(pool, config, budget=30, rounds=2, vectors=vectors, ahead=ahead).collect())) == want
    assert asked == [15, 15]


def test_order_clusters_vectors_by_their_rows(spark, monkeypatch):
    """The pool is clustered by its vectors, each with the number of its rows; the order is that of a pool that carries them."""
    r = np.random.default_rng(13)
    centres = r.normal(size=(4, 5))
    vectors = spark.createDataFrame([(i, (centres[i % 4] + 0.1 * r.normal(size=5)).tolist()) for i in range(40)], "vec_id long, embedding array<double>")
    rows = [(i, float(e), i // 2, 1, int(v)) for i, (e, v) in enumerate(zip(np.round(r.random(240), 1), r.integers(0, 40, 240), strict=True))]
    pool = spark.createDataFrame(rows, "pos long, entropy double, image_id long, cost long, vec_id long")
    reference = vectors.where("vec_id < 3").select("embedding")
    want = allocation.order(pool.join(vectors, "vec_id"), reference, budget=20).orderBy("seq").collect()
    plain, seen = density.hdbscan, []
    monkeypatch.setattr(density, "hdbscan", lambda df, **k: seen.append(df.count()) or plain(df, **k))
    assert allocation.order(pool, reference, budget=20, vectors=vectors).orderBy("seq").collect() == want and seen == [40]


def edges(dims=12, eps=0.5):
    """Pairs of unit rows whose cosine is 1 - eps but for the last digits in single precision, on either side, and others."""
    r = np.random.default_rng(14)
    a = r.normal(size=(100, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.normal(size=(100, dims))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = (1 - eps + np.where(np.arange(100) % 2, 1e-8, -1e-8))[:, None]
    return np.concatenate([a, c * a + np.sqrt(1 - c * c) * b])


def no_matrix(monkeypatch, most):
    """From now on a meeting that hands on more than ``most`` cosines at a time fails."""
    plain = cells.Cells.meet

    def meet(self, askers, choose, compare, schema, *more):
        def few(a, b, *found):
            size = max(x.size for x in found if isinstance(x, np.ndarray))
            if size > most:
                raise ValueError(f"{len(a)} askers and {len(b)} rows hand on {size} cosines")
            return compare(a, b, *found)

        return plain(self, askers, choose, few, schema, *more)

    monkeypatch.setattr(cells.Cells, "meet", meet)


def test_counting_neighbours_holds_no_matrix(spark, monkeypatch):
    """Of all pairs, the counting of neighbours gets those in reach alone, and none is lost or added by single precision."""
    x = edges()
    near = 1 - x @ x.T <= 0.5 + 1e-9
    most = int(near.sum(1).max())
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for minimum in (3, 8, most):
        core = {i for i, c in enumerate(near.sum(1) >= minimum) if c}
        assert {r.vec_id for r in clusters.dbscan(df, eps=0.5, minimum=minimum).collect() if r.status == "core"} == core
    no_matrix(monkeypatch, int(near.sum()) + 10)  # of 40,000 pairs; no row is a core, so nothing but the count looks at pairs
    assert {r.status for r in clusters.dbscan(df, eps=0.5, minimum=most + 1).collect()} == {"noise"}


def test_dense_pairs_are_handed_on_some_at_a_time(spark, monkeypatch):
    """Where all rows are in reach of each other, the pairs that a task holds are bounded."""
    monkeypatch.setattr(cells, "PART_ROWS", 64)
    x = np.array([1.0, 0, 0]) + 0.4 * np.random.default_rng(15).normal(size=(300, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = 1 - u @ u.T <= 0.2 + 1e-9
    sizes = [n for _, _, (who, _, _) in cells.reaching(u, u.T, u.T.astype(np.float32), np.full(300, -1.0), None) for n in [len(who)]]
    assert sum(sizes) == 300 * 300
    monkeypatch.setattr(cells, "HELD", 4000)
    sizes = [n for _, _, (who, _, _) in cells.reaching(u, u.T, u.T.astype(np.float32), np.full(300, -1.0), None) for n in [len(who)]]
    assert sum(sizes) == 300 * 300 and max(sizes) <= 1000
    minimum = int(np.median(near.sum(1)))
    assert {r.vec_id for r in clusters.dbscan(df, eps=0.2, minimum=minimum).collect() if r.status == "core"} == set(np.flatnonzero(near.sum(1) >= minimum))


def test_zero_vector_is_its_own_neighbour(spark, monkeypatch):
    """Also where the ball of its cell holds zero vectors alone, and is out of its own reach."""
    monkeypatch.setattr(cells, "PART_ROWS", 4)
    x = np.vstack([np.zeros((18, 3)), np.array([1.0, 0, 0]) + 0.1 * np.random.default_rng(16).normal(size=(18, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.status, r.cluster) for r in clusters.dbscan(df, eps=0.5, minimum=1).collect()} == {(i, "core", min(i, 18)) for i in range(36)}


def test_later_meetings_hold_no_matrix(spark, monkeypatch):
    """Later meetings of a nearest search get the nearest of the pairs that reach the k-th found, and none is lost by single precision."""
    monkeypatch.setattr(cells, "PART_ROWS", 64)
    x = np.repeat(edges(), 2, 0)  # each twice, so that nearest rows tie
    x[1::4] += 1e-8  # apart in double precision only
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pos long, embedding array<double>")
    no_matrix(monkeypatch, 64 * 64)
    got, found = cells.knn(df, df, k=5, id_col="pos")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    assert {r.pos: [n.id for n in r.near] for r in got.collect()} == {i: [j for _, j in sorted(zip(-s[i], range(400), strict=True))[:5]] for i in range(400)}
    y = u[:300].T
    few = sum(len(who) for _, _, (who, _, _) in cells.reaching(u, y, y.astype(np.float32), np.full(400, -1.0), None, 5))
    assert 400 * 5 <= few < 400 * 12  # of 120,000 pairs that all reach
