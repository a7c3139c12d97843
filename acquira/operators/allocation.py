"""Distribution-aware purchases: clusters that the references lack get the budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acquira.functions import vec
from acquira.operators import clusters, density, sampling, sequential
from acquira.sources.shared import written


def least_cluster(rows: int, budget: float, mean_cost: float) -> int:
    """Smallest size of a cluster that the budget can serve: 5, or the rows that each affordable image stands for."""
    return max(5, int(-(-rows * mean_cost // max(budget, 1e-12))))


def nearest_medoid(reference: DataFrame, medoids: DataFrame, *, vector: str = "embedding") -> DataFrame:
    """cluster, references: reference rows by their nearest medoid (ties to the smaller cluster), clusters without any at 0.

    medoids (cluster, vector): a row a cluster, so it is broadcast.
    """
    m = medoids.select("cluster", vec.unit(F.col(vector)).alias("_m")).agg(F.array_sort(F.collect_list(F.struct("cluster", "_m"))).alias("ms"))
    r = reference.select(vec.unit(F.col(vector)).alias("_r")).crossJoin(F.broadcast(m))
    best = F.array_max(F.transform("ms", lambda x: F.struct(F.round(vec.dot(F.col("_r"), x["_m"]), 9).alias("s"), (-x["cluster"]).alias("c"))))
    hits = r.select((-best["c"]).alias("cluster")).groupBy("cluster").agg(F.count("*").alias("references"))
    return medoids.select("cluster").join(hits, "cluster", "left").select("cluster", F.coalesce("references", F.lit(0)).alias("references"))


def _clustered(pool: DataFrame, reference: DataFrame, budget: float, vectors: DataFrame, by: str) -> tuple[DataFrame, dict]:
    """``by``, cluster of the pool's vectors, clustered by the number of their rows, and the quotas of clusters."""
    n, mean = pool.agg(F.count("*"), F.avg("cost")).first()
    points = written(pool.groupBy(by).agg(F.count("*").alias("n"), F.min("pos").alias("pos")).join(vectors.select(by, "embedding"), by))
    found = density.hdbscan(points, size=least_cluster(n, budget, mean or 1.0), key="pos", weight="n")
    points = written(points.join(found, "pos"))
    centres = clusters.medoids(points, key="pos", weight="n").join(points.select(F.col("pos").alias("medoid"), "embedding"), "medoid").select("cluster", "embedding")
    refs = nearest_medoid(reference, centres)
    sizes = points.where("cluster >= 0").groupBy("cluster").agg(F.sum("n").alias("candidates")).join(refs, "cluster")
    return points.select(by, "cluster"), {r.cluster: r.quota for r in sampling.quotas(sizes, budget=budget).collect() if r.quota}


def order(pool: DataFrame, reference: DataFrame, *, budget: float, vectors: DataFrame | None = None, by: str = "vec_id") -> DataFrame:
    """seq, pos, paid: cluster the gated pool, set quotas by what the reference lacks, emit by turns.

    pool: pos, entropy, image_id, cost, embedding. Clusters are dense regions of the smallest size that the budget can serve and more;
    the rest is noise, which only spills. With ``vectors`` (``by``, each key once, and embedding) the pool names its vectors by ``by``, and
    they are clustered by the number of their rows.
    """
    if vectors is None:
        by, pool = "_by", pool.withColumn("_by", F.col("pos"))
        vectors = pool.select(by, "embedding")
    points, quota = _clustered(pool, reference, budget, vectors, by)
    return sequential.emitted(written(pool.select("pos", by, "entropy", "image_id", "cost").join(points, by).drop(by)), quota)


def rounds(pool: DataFrame, reference: DataFrame, *, budget: int, n: int, vectors: DataFrame | None = None, by: str = "vec_id") -> pd.DataFrame:
    """round, image_id, cost: the order is drawn anew each round against a reference that has what was opened before.

    Before round r + 1 ends, budget * (r + 1) // n may be spent; a round stops at the first image that it can't pay. ``vectors`` and
    ``by`` are those of ``order``; then no row of the pool carries a vector.
    """
    spent, out = 0, []
    if vectors is None:
        by, pool = "_by", pool.withColumn("_by", F.col("pos"))
        vectors = pool.select(by, "embedding")
    ref, pool = reference.select("embedding"), pool.select("pos", "entropy", "image_id", "cost", by)
    for r in range(n):
        left = sequential.without(pool, [x[1] for x in out])
        if left.isEmpty():
            break
        allowed = budget * (r + 1) // n - spent
        points, quota = _clustered(left, ref, max(allowed, 1), vectors, by)
        # an image costs 1 or more, so the walk ends among the first allowed + 1 of them
        for image, cost in sequential.first_images(left, left.join(points, by), quota, allowed + 1):
            if cost > allowed:
                break
            allowed -= cost
            spent += cost
            out.append((r + 1, image, cost))
        if out:
            images = pool.sparkSession.createDataFrame([(x[1],) for x in out], pool.select("image_id").schema)
            got = pool.join(F.broadcast(images), "image_id", "left_semi").join(vectors, by)
            ref = reference.select("embedding").unionByName(got.select("embedding"))
    return pd.DataFrame(out, columns=["round", "image_id", "cost"])
