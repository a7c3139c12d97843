"""Clusterings and projections: KMeans and PCA of Spark's library, DBSCAN by neighbour links, medoids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acquira.functions import vec
from acquira.operators.cells import HELD, SLACK, Cells, allowed, by_vector, directions, meeting, numbers, spread
from acquira.operators.graph import components, forest
from acquira.sources.shared import written

def kmeans(df: DataFrame, *, k: int, vector: str = "embedding", seed: int = 0) -> DataFrame:
    """df with cluster."""
    d = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(d).transform(d).drop("_v")


def centroids(assign: DataFrame, *, vector: str = "embedding") -> DataFrame:
    """cluster, size, centroid (unit)."""
    d = assign.where("cluster >= 0").select("cluster", F.posexplode(F.transform(vector, lambda x: x.cast("double"))).alias("d", "x"))
    per = d.groupBy("cluster", "d").agg(F.avg("x").alias("x"), F.count("*").alias("n")).groupBy("cluster").agg(F.max("n").alias("size"), F.array_sort(F.collect_list(F.struct("d", "x"))).alias("c"))
    return per.select("cluster", "size", vec.unit(F.transform("c", lambda s: s["x"])).alias("centroid"))


def pca(df: DataFrame, *, dims: int, vector: str = "embedding", whiten: bool = False) -> DataFrame:
    """df with reduced: centred, projected (over the deviation of each dimension, if whitened), unit length."""
    d = df.withColumn("_a", vec.unit(F.col(vector)))
    mean = d.select(F.posexplode("_a").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m")).agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("m")).select(F.transform("m", lambda s: s["m"]).alias("_m"))
    d = d.crossJoin(F.broadcast(mean)).withColumn("_v", array_to_vector(F.zip_with("_a", "_m", lambda x, m: x - m)))
    out = PCA(k=dims, inputCol="_v", outputCol="_p").fit(d).transform(d).withColumn("_p", vector_to_array("_p"))
    if whiten:
        sd = out.select(F.posexplode("_p").alias("d", "x")).groupBy("d").agg(F.stddev_pop("x").alias("s")).agg(F.array_sort(F.collect_list(F.struct("d", "s"))).alias("s")).select(F.transform("s", lambda q: q["s"]).alias("_s"))
        out = out.crossJoin(F.broadcast(sd)).withColumn("_p", F.zip_with("_p", "_s", lambda x, s: x / F.greatest(s, F.lit(1e-12)))).drop("_s")
    return out.withColumn("reduced", vec.unit(F.col("_p"))).drop("_a", "_m", "_v", "_p")


def spectrum(df: DataFrame, *, dims: int, vector: str = "embedding", share: float = 0.9) -> tuple[float, int | None]:
    """Share of the first component and the components that hold ``share`` of the variance."""
    d = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    held = PCA(k=dims, inputCol="_v", outputCol="_p").fit(d).explainedVariance.toArray()
    reach = [i + 1 for i in range(dims) if held[: i + 1].sum() >= share]
    return float(held[0]), reach[0] if reach else None


def dbscan(df: DataFrame, *, eps: float, minimum: int, key: str = "vec_id", vector: str = "embedding", weight: str | None = None) -> DataFrame:
    """key, status (core, border, noise), cluster: the smallest core key reached (border: of its nearest in key), -1 for noise.

    A core row has ``minimum`` neighbours, itself included. No pair is written: cells that lie within a row's reach are counted, and
    linked by their smallest core, as a whole; what other cells are looked at for are a count for each row and a forest of the links of
    a slot. Equal vectors are one row with a weight. Keys differ and are read as long; null vectors are noise.

    With ``weight`` a row of df stands for so many with its vector, the least key of which is its own; ``minimum`` is 2 then, or more.
    """
    reach = float(np.sqrt(2 * max(eps, 0.0)))
    every_row = by_vector(df, key, vector, weight)
    zero = F.when(~F.exists("v", lambda x: x != 0), F.col("k"))  # at right angles to their copies too
    stand = F.when(zero.isNotNull() & F.lit(eps + 1e-9 < 1), 1).otherwise(F.col("w")) if weight else None  # each copy of zero sees itself alone
    rows = every_row.where("v IS NOT NULL").groupBy("h", "v", zero.alias("z")).agg(F.min("k").cast("long").alias("k"), F.count("*").alias("weight") if weight is None else F.sum(stand).alias("weight"))
    rows = written(rows.withColumn("q", F.col("k")))
    on = meeting(rows.where("z IS NULL"))
    cells = Cells(rows.drop("h", "z"))
    if not cells.n:
        return df.select(key, F.lit("noise").alias("status"), F.lit(-1).cast("long").alias("cluster"))
    touched = lambda d, ball: (d - ball[0][None, :] <= reach + SLACK) & (ball[1] > 0)[None, :]
    whole = lambda d, ball: (d + ball[0][None, :] <= reach - SLACK) & (ball[1] > 0)[None, :]

    def close_by(a, b, cosines):
        out, q, k = 1 - cosines <= eps + 1e-9, numbers(a["q"]), numbers(b["k"])
        order = np.argsort(k, kind="stable")
        at = order[np.minimum(np.searchsorted(k, q, sorter=order), len(k) - 1)]
        own = np.flatnonzero(k[at] == q)  # keys are met once
        out[own, at[own]] = True
        return out

    def near(a, b, cosines, mask):
        out = close_by(a, b, cosines)
        return out if mask is None else out & spread(mask)

    def weigh(a, b, who, row, cosines):
        close = 1 - cosines <= eps + 1e-9
        n = np.bincount(who[close], numbers(b["weight"])[row[close]], len(a)).astype(np.int64)
        return [numbers(a["q"])[n > 0], n[n > 0]]

    askers = rows.select("q", "v", "weight")

    # which rows are cores: whole cells first, a look at others only for rows that these leave short
    pivots, every = cells.shared, (cells.radius, cells.count)
    weight = np.zeros(len(cells.pivots), np.int64)
    for r in cells.homes.groupBy("cell").agg(F.sum("weight").alias("n")).collect():  # a row a pivot
        weight[r.cell] = r.n
    step = max(1, HELD // max(len(cells.pivots), 1))
    pieces = lambda batches: (b.slice(lo, step) for b in batches for lo in range(0, b.num_rows, step))

    def counted(batches):
        for b in pieces(batches):
            d = np.sqrt(np.maximum(2 - 2 * (directions(b.column(1), True) @ pivots.value.T), 0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(whole(d, every) @ weight)], ["q", "v", "weight", "sure"])

    sure = written(askers.mapInArrow(counted, T.StructType([*askers.schema.fields, T.StructField("sure", T.LongType())])))
    number = T.StructType([T.StructField("q", T.LongType()), T.StructField("n", T.LongType())])
    looked = cells.meet(written(sure.where(F.col("sure") < minimum).select("q", "v")), lambda d, b: touched(d, every) & ~whole(d, every), weigh, number, lambda a: np.full(len(a), 1 - eps - 2e-9))
    found = F.greatest(F.col("sure") + F.coalesce("n", F.lit(0)), "weight")  # a zero vector doesn't reach its own cell
    total = written(sure.select("q", "weight", "sure").join(looked.groupBy("q").agg(F.sum("n").alias("n")), "q", "left").select(F.col("q").alias("k"), (found >= minimum).alias("core")))
    cores = cells.only(total.where("core").select("k"))
    if not cores.n:
        return df.select(key, F.lit("noise").alias("status"), F.lit(-1).cast("long").alias("cluster"))

    held = (cores.radius, cores.count)
    # cells all of whose cores are in reach of each other are one
    least = np.full(len(cells.pivots), np.iinfo(np.int64).max)
    for r in cores.homes.groupBy("cell").agg(F.min("k").alias("k")).collect():  # a row a pivot
        least[r.cell] = r.k
    apart = np.sqrt(np.maximum(2 - 2 * (cells.pivots @ cells.pivots.T), 0))
    close = (apart + cores.radius[:, None] + cores.radius[None, :] <= reach - SLACK) & np.isfinite(cores.radius)[:, None] & np.isfinite(cores.radius)[None, :]
    one = np.arange(len(least))
    while True:
        new = np.minimum(one, np.where(close, one[None, :], len(one)).min(1, initial=len(one)))
        if (new == one).all():
            break
        one = new

    def by_cell(batches):  # a row is linked to the smallest core of one whole cell of each kind; a row that is no core takes the smallest
        for b in pieces(batches):
            d = np.sqrt(np.maximum(2 - 2 * (directions(b.column(1), True) @ pivots.value.T), 0))
            who, cell = np.nonzero(whole(d, held))
            core = b.column(2).to_numpy(zero_copy_only=False)[who]
            key = b.column(0).to_numpy()
            first = np.unique(np.stack([who, np.where(core, one[cell], -1), np.where(core, cell, least[cell])], 1), axis=0)
            start = np.concatenate([[True], (first[1:, :2] != first[:-1, :2]).any(1)]) if len(first) else np.zeros(0, bool)
            w, kind, c = first[start].T if len(first) else np.zeros((3, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[w]), pa.array(np.where(kind >= 0, least[np.where(kind >= 0, c, 0)], c)), pa.array(kind >= 0)], ["u", "v", "core"])

    edge = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType()), T.StructField("core", T.BooleanType())])
    told = written(askers.join(total.select(F.col("k").alias("q"), "core"), "q").select("q", "v", "core"))

    def look(a, b, cosines, mask):
        core, linked, k = numbers(a["core"]), near(a, b, cosines, mask), numbers(b["k"])
        u, v = forest(linked[core], numbers(a["q"])[core], k)
        rest = linked[~core]
        some = rest.any(1)
        return [np.concatenate([u, numbers(a["q"])[~core][some]]), np.concatenate([v, np.where(rest, k[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)[some]]), np.concatenate([np.ones(len(u), bool), np.zeros(int(some.sum()), bool)])]

    looked = cores.meet(told, lambda d, b: touched(d, held) & ~whole(d, held), look, edge)
    within = [least[one[i]] for i in np.flatnonzero(cores.count)]
    links = written(told.mapInArrow(by_cell, edge).unionByName(looked))
    joined = [(int(least[i]), int(w), True) for i, w in zip(np.flatnonzero(cores.count), within, strict=True)]  # a row a pivot
    label = components(links.where("core").select("u", "v").unionByName(df.sparkSession.createDataFrame(joined, edge).select("u", "v")).unionByName(cores.homes.select(F.col("k").alias("u"), F.col("k").alias("v"))))
    rest = links.where("NOT core").groupBy("u").agg(F.min("v").alias("node")).join(label, "node").select(F.col("u").alias("k"), "label")
    both = label.select(F.col("node").alias("k"), "label").withColumn("status", F.lit("core")).unionByName(rest.withColumn("status", F.lit("border")))
    # what is true of a vector is true of its copies
    told = rows.select("k", "z", *on).join(both, "k").drop("k")
    zeros, others = told.where("z IS NOT NULL").select(F.col("z").alias("k"), "label", "status"), told.where("z IS NULL").drop("z")
    a = every_row.withColumn("z", zero.isNotNull()).select("k", "z", *on)
    out = a.where("z").join(zeros, "k", "left").select("k", "label", "status").unionByName(a.where("NOT coalesce(z, false)").join(others, on, "left").select("k", "label", "status"))
    return out.select(F.col("k").alias(key), F.coalesce("status", F.lit("noise")).alias("status"), F.coalesce("label", F.lit(-1)).alias("cluster"))


def medoids(assign: DataFrame, *, key: str = "vec_id", vector: str = "embedding", weight: str | None = None) -> DataFrame:
    """cluster, medoid: the row most similar to its cluster's sum, ties to the smaller key; a row counts ``weight`` times, if told."""
    u = assign.where("cluster >= 0").select("cluster", F.col(key).alias("k"), vec.unit(F.col(vector)).alias("v"), F.lit(1).alias("w") if weight is None else F.col(weight).alias("w"))
    sums = u.select("cluster", "w", F.posexplode("v").alias("d", "x")).groupBy("cluster", "d").agg(F.sum(F.col("x") * F.col("w")).alias("x")).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("s"))
    d = u.join(sums, "cluster").withColumn("dot", F.round(vec.dot(F.col("v"), F.transform("s", lambda q: q["x"])), 9))
    return d.withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("dot"), "k"))).where("rn = 1").select("cluster", F.col("k").alias("medoid"))
