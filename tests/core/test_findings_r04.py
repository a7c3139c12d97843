"""What the reviewer of round 4 found."""

import random

import numpy as np
from acquira.operators import allocation, clusters, density, gates, protocol, sequential, terms
from pyspark.sql import functions as F


def test_continuous_coherence(spark):
    """Copies too; of k rows or fewer each is supported."""
    x = np.random.default_rng(17).normal(size=(60, 5))[np.arange(80) % 60]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.sort(np.sqrt(np.maximum(2 - 2 * np.delete((u @ u.T).ravel(), np.arange(80) * 81).reshape(80, 79), 0)), 1)[:, 2]
    got = {r.vec_id: r.g for r in protocol.coherence(df, "continuous", k=3, key="vec_id").collect()}
    assert len(got) == 80 and np.allclose([got[i] for i in range(80)], 1 / (1 + d / np.median(d)), atol=1e-6)
    assert {r.g for r in protocol.coherence(df, "continuous", k=80, key="vec_id").collect()} == {1.0}


def test_novelty_of_sums_in_any_order(spark, monkeypatch):
    """Centroids whose last digits differ each time that they are computed, as those of sums over many tasks do."""
    x = np.random.default_rng(18).normal(size=(200, 5))
    assign = spark.createDataFrame([(i, i % 6 - 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, cluster int, embedding array<double>")
    c = np.stack([x[np.arange(200) % 6 - 1 == k].mean(0) for k in range(5)])
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    want = np.append(1 - (c @ c[:2].T).max(1), 1.0)  # the last is that of noise
    plain = clusters.centroids
    off = F.udf(lambda v: [y + 1e-13 * random.SystemRandom().random() for y in v], "array<double>").asNondeterministic()
    monkeypatch.setattr(clusters, "centroids", lambda *a, **k: plain(*a, **k).withColumn("centroid", off("centroid")))
    got = {r.vec_id: r.novelty for r in terms.cluster_novelty(assign, assign.where("cluster IN (0, 1)").select("cluster")).collect()}
    assert len(got) == 200 and np.allclose([got[i] for i in range(200)], want[np.arange(200) % 6 - 1], atol=1e-9)


def test_rounds_hold_a_vector_once(spark, monkeypatch):
    """Rows name their vectors, and no table that is written has one in each row; images are those of whole orders."""
    r = np.random.default_rng(19)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(40, 5)))], "vec_id long, embedding array<double>")
    rows = [(i, float(e), i // 2, 1 + i // 2 % 3, int(v)) for i, (e, v) in enumerate(zip(np.round(r.random(240), 1), r.integers(0, 40, 240), strict=True))]
    pool = spark.createDataFrame(rows, "pos long, entropy double, image_id long, cost long, vec_id long")
    monkeypatch.setattr(density, "hdbscan", lambda df, **k: df.select("pos", (F.col("vec_id") % 4 - 1).alias("cluster")))  # not what is tested
    reference, want, spent = vectors.where("vec_id < 3").select("embedding"), [], 0
    for number in (1, 2):
        opened = [x[1] for x in want]
        known = pool.where(F.col("image_id").isin(opened)).join(vectors, "vec_id").select("embedding")
        left, allowed = pool.where(~F.col("image_id").isin(opened)), 20 * number - spent
        for p in allocation.order(left, reference.unionByName(known), budget=allowed, vectors=vectors).orderBy("seq").collect():
            _, _, image, cost, _ = rows[p.pos]
            if image not in [x[1] for x in want]:
                if cost > allowed:
                    break
                allowed, spent = allowed - cost, spent + cost
                want.append((number, image, cost))
    plain, seen = allocation.written, []

    def checked(df):
        out = plain(df)
        if any(f.dataType.typeName() == "array" for f in out.schema):
            seen.append(out.count())
        return out

    monkeypatch.setattr(allocation, "written", checked)
    got = allocation.rounds(pool, reference, budget=40, n=2, vectors=vectors)
    assert len(want) > 8 and list(got.itertuples(index=False, name=None)) == want and max(seen) == 40


def test_first_images_of_an_order(spark):
    """Those that quotas pay for, then the others by their first row; as whole orders have them."""
    r = np.random.default_rng(20)
    rows = [(i, int(c), float(e), int(m), 1 + int(m) % 3) for i, (c, e, m) in enumerate(zip(r.integers(-1, 3, 150), np.round(r.random(150), 1), r.integers(0, 50, 150), strict=True))]
    pool = spark.createDataFrame(rows, "pos long, cluster long, entropy double, image_id long, cost long")
    for quota in ({}, {0: 5.0, 2: 9.5}):
        want = dict.fromkeys((rows[p.pos][3], rows[p.pos][4]) for p in sequential.emitted(pool, quota).orderBy("seq").collect())
        for number in (3, 30, 99):
            assert sequential.first_images(pool, pool, quota, number) == list(want)[:number]


def test_survivors_carry_their_columns(spark):
    """What suppression keeps, with its columns, and no join by position."""
    r = np.random.default_rng(21)
    rows = [(i, i // 12, int(v), *map(float, x)) for i, (v, x) in enumerate(zip(r.integers(0, 9, 240), np.round(0.2 + 0.6 * r.random((240, 5)), 1), strict=True))]
    df = spark.createDataFrame(rows, "pos long, image_id long, vec_id long, cx double, cy double, w double, h double, a double")
    want = gates.suppress(df, F.col("a"), threshold=0.4).where("kept").select("pos", "image_id", "vec_id", "a").collect()
    got = gates.survivors(df, F.col("a"), ["vec_id", "a"], threshold=0.4)
    assert sorted(got.collect()) == sorted(want) and 20 < len(want) < 240
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
