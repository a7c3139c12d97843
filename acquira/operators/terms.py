"""Terms of research scores: diversity, rarity, consistency, density radius, and what a partition does to known content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acquira.functions import ranking, vec
from acquira.operators import clusters, neighbours
from acquira.sources.shared import written

#: Which diversity a score takes.
DIVERSITY = ("none", "labelled", "batch", "combined")


def research_score(mode: str, *, diversity: float = 1.0, rarity: float = 1.0) -> Column:
    """u + weight * D + weight * r * g, from u, d_labelled, d_batch, r, g; D is none, one of the two or their mean."""
    if mode not in DIVERSITY:
        raise ValueError(f"{mode!r} isn't one of {DIVERSITY}")
    a, b = F.col("d_labelled"), F.col("d_batch")
    d = {"none": F.lit(0.0), "labelled": a, "batch": b, "combined": (a + b) / 2}[mode]
    return F.col("u") + diversity * d + rarity * F.col("r") * F.col("g")


def consistency(base: Column, first: Column, second: Column) -> dict[str, Column]:
    """Cosines of unit vectors with two other views of the same rows; the smaller one counts, the mean describes."""
    a, b = vec.dot(base, first), vec.dot(base, second)
    return {"sim_a": a, "sim_b": b, "consistency": F.least(a, b), "consistency_mean": (a + b) / 2}


def kth_distance(df: DataFrame, reference: DataFrame, *, k: int, itself: bool, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, distance: Euclidean distance of unit vectors to the k-th row of the reference, or to its last if it has fewer.

    ``itself`` says that the rows are in the reference too; then their own place isn't counted.
    """
    near = neighbours.nearest(df, reference, k=k + int(itself), id_col=key, vector_col=vector)
    return near.select(key, F.sqrt(F.greatest(2 - 2 * F.element_at("near", -1), F.lit(0.0))).alias("distance"))


def coverage_deficit(df: DataFrame, reference: DataFrame, *, k: int, key: str = "vec_id", eps: float = 1e-8) -> DataFrame:
    """key, rarity: log of the distance to the k-th labelled row over that to the k-th other candidate."""
    own = kth_distance(df, df, k=k, itself=True, key=key).withColumnRenamed("distance", "_c")
    told = kth_distance(df, reference, k=k, itself=False, key=key).withColumnRenamed("distance", "_l")
    return own.join(told, key).select(key, F.ln((eps + F.col("_l")) / (eps + F.col("_c"))).alias("rarity"))


def partition_deficit(assign: DataFrame) -> DataFrame:
    """assign (cluster, labelled) with rarity: log of the cluster's candidates over its labelled rows, each plus one."""
    n = assign.groupBy("cluster").agg(F.count(F.when(~F.col("labelled"), 1)).alias("_c"), F.count(F.when(F.col("labelled"), 1)).alias("_l"))
    return assign.join(n, "cluster").withColumn("rarity", F.ln((1 + F.col("_c")) / (1 + F.col("_l")))).drop("_c", "_l")


def cluster_novelty(assign: DataFrame, known: DataFrame, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, novelty: 1 less the greatest cosine of the row's cluster's centroid to that of a cluster in ``known`` (cluster).

    1 for noise (-1), and for all where no cluster is known. Centroids are a row a cluster.
    """
    # written, as the order of a sum changes its last digits, and equal vectors have to meet
    c = written(clusters.centroids(assign, vector=vector).select("cluster", F.col("centroid").alias("embedding")))
    held = c.join(known.select("cluster").distinct(), "cluster", "left_semi")
    if held.isEmpty():
        return assign.select(key, F.lit(1.0).alias("novelty"))
    near = neighbours.nearest(c, held, k=1, id_col="cluster").select("cluster", (1 - F.col("near")[0]).alias("_n"))
    return assign.join(F.broadcast(near), "cluster", "left").select(key, F.coalesce("_n", F.lit(1.0)).alias("novelty"))


def density_radius(df: DataFrame, *, minimum: int, quantile: float, key: str = "vec_id", vector: str = "embedding") -> float:
    """The quantile of all rows' distances to their ``minimum``-th neighbour; infinite if there are no more rows than that."""
    if minimum < 1:
        raise ValueError("a neighbourhood has one row at least")
    if df.count() <= minimum:
        return float("inf")
    return ranking.quantile(kth_distance(df, df, k=minimum, itself=True, key=key, vector=vector), "distance", quantile)


def gate_summary(status: DataFrame) -> DataFrame:
    """One row from (status, cluster): candidates, clusters, noise and its rate, core, border, accepted, sizes of the clusters."""
    n = lambda c: F.count(F.when(c, 1))
    s = F.col("status")
    every = status.agg(F.count("*").alias("candidates"), n(s == "noise").alias("noise"), n(s == "core").alias("core"), n(s == "border").alias("border"), n(s != "noise").alias("accepted"))
    size = status.where("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("n")).agg(F.count("*").alias("clusters"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_size"), F.coalesce(F.min("n"), F.lit(0)).alias("smallest"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    return every.crossJoin(size).withColumn("noise_rate", F.col("noise") / F.greatest("candidates", F.lit(1)))  # one row each


def known_contamination(assign: DataFrame) -> DataFrame:
    """One row from (cluster, known), -1 being noise: how the labelled rows spread over the clusters that candidates hold."""
    per = assign.where("cluster >= 0").groupBy("cluster").agg(F.count(F.when(F.col("known"), 1)).alias("k"), F.count(F.when(~F.col("known"), 1)).alias("c"))
    n = lambda c: F.count(F.when(c, 1))
    k, c = F.col("k"), F.col("c")
    found = per.agg(
        F.count("*").alias("clusters"), n((k == 0) & (c > 0)).alias("candidate_only"), n((c == 0) & (k > 0)).alias("known_only"), n((k > 0) & (c > 0)).alias("mixed"),
        F.coalesce(F.sum(F.when(c > 0, k)), F.lit(0)).alias("leaked"), F.coalesce(F.avg(k / (k + c)), F.lit(0.0)).alias("purity"),
    )
    rows = assign.agg(F.count(F.when(F.col("known"), 1)).alias("known_rows"), F.count(F.when(~F.col("known"), 1)).alias("candidate_rows"), n(F.col("known") & (F.col("cluster") < 0)).alias("_kn"), n(~F.col("known") & (F.col("cluster") < 0)).alias("_cn"))
    one = F.lit(1)
    return rows.crossJoin(found).select(  # one row each
        "known_rows", "candidate_rows", "clusters", "candidate_only", "known_only", "mixed", "leaked", (F.col("leaked") / F.greatest("known_rows", one)).alias("contamination"),
        (F.col("_kn") / F.greatest("known_rows", one)).alias("known_noise_rate"), (F.col("_cn") / F.greatest("candidate_rows", one)).alias("candidate_noise_rate"), "purity",
    )


def least_contaminated(sweep: DataFrame, *, min_recall: float = 0.5, min_size: float = 25.0) -> DataFrame:
    """sweep (setting, contamination, unknown_recall, mean_size) with eligible and chosen: the least contaminated eligible setting.

    Ties go to the setting that comes first; a sweep without an eligible setting raises when it is read.
    """
    d = sweep.withColumn("eligible", F.coalesce((F.col("unknown_recall") >= min_recall) & (F.col("mean_size") >= min_size), F.lit(False)))
    best = F.row_number().over(Window.orderBy(F.desc("eligible"), "contamination", "setting")) == 1  # one row a setting
    any_ = F.count(F.when(F.col("eligible"), 1)).over(Window.partitionBy()) > 0
    return d.withColumn("chosen", F.when(any_, best & F.col("eligible")).otherwise(F.raise_error(F.lit("no setting reaches the floors")).cast("boolean")))


def prototypes(df: DataFrame, *, known: int, posterior: str = "q", vector: str = "embedding") -> DataFrame:
    """class_pos, n, prototype: unit mean of the vectors of the rows whose greatest posterior is one of the first ``known`` classes."""
    best = F.array_position(F.col(posterior), F.array_max(posterior)) - 1
    d = df.withColumn("cluster", best).where(F.col("cluster") < known)
    return clusters.centroids(d, vector=vector).select(F.col("cluster").alias("class_pos"), F.col("size").alias("n"), F.col("centroid").alias("prototype"))


def relation_similarity(df: DataFrame, *, seed: object, vector: str = "embedding", key: str = "pos") -> DataFrame:
    """relation, pairs, similarity: mean cosine of rows of one object, of one class but two objects, and of two classes.

    df: key, object_id, class_name, unit vectors. One pair an object (its first two rows); the other pairs are neighbours in a
    seeded hash order within the class and over all rows, so pairs grow with the rows and not with their square.
    """
    from acquira.functions import text

    h = text.ordered_hash(seed, F.col(key))
    d = df.select(key, "object_id", "class_name", vector).withColumn("_h", h)
    pair = lambda w: F.lead(F.struct("object_id", "class_name", F.col(vector).alias("v"))).over(w)
    first = Window.partitionBy("object_id").orderBy(key)
    same = d.withColumn("rn", F.row_number().over(first)).withColumn("o", pair(first)).where("rn = 1 AND o IS NOT NULL").withColumn("relation", F.lit("same_object"))
    # salted by the hash, so that no class is one task; the last row of a salt has no partner
    other = d.withColumn("o", pair(Window.partitionBy("class_name", F.substring("_h", 1, 1)).orderBy("_h", key))).where("o.object_id <> object_id").withColumn("relation", F.lit("same_class"))
    apart = d.withColumn("o", pair(Window.partitionBy(F.substring("_h", 1, 2)).orderBy("_h", key))).where("o.class_name <> class_name").withColumn("relation", F.lit("different_class"))
    both = [x.select("relation", vec.dot(F.col(vector), F.col("o.v")).alias("s")) for x in (same, other, apart)]
    return both[0].unionByName(both[1]).unionByName(both[2]).groupBy("relation").agg(F.count("*").alias("pairs"), F.avg("s").alias("similarity"))


def check_vectors(df: DataFrame, *, key: str, vector: str, dims: int, tolerance: float = 1e-3) -> DataFrame:
    """rows, keys, and how many vectors have another length, components that aren't finite, or another norm than 1."""
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    n = lambda c: F.count(F.when(c, 1))
    return df.agg(
        F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), n(F.size(vector) != dims).alias("other_length"), n(~finite).alias("not_finite"),
        n(finite & (F.abs(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)) - 1) > tolerance)).alias("not_unit"),
    )


def density_gate_report(df: DataFrame, *, least_tail: float = 0.9, least_noise: float = 0.05) -> DataFrame:
    """One row on a gate within its scope, from (in_scope, open, noise, kind, object_id, grp): whom it removes, what it keeps, and four criteria."""
    s, o, z, u = F.col("in_scope"), F.col("in_scope") & F.col("open"), F.col("noise"), F.col("kind") == "unknown"
    n = lambda c: F.count(F.when(c, 1))
    ids = lambda c: F.countDistinct(F.when(c & (F.col("object_id") >= 0), F.col("object_id")))
    rate = lambda mask, kind: n(mask & (F.col("kind") == kind)) / F.nullif(n(mask), F.lit(0))
    tail = F.col("grp") == "tail"
    d = df.agg(
        n(s).alias("scope"), (n(z) / F.greatest(n(s), F.lit(1))).alias("noise_share"), rate(o, "unknown").alias("unknown_open"), rate(z, "unknown").alias("unknown_noise"),
        rate(o, "background").alias("background_open"), rate(z, "background").alias("background_noise"), rate(o, "known").alias("known_open"),
        ids(s & u).alias("objects_scope"), ids(o & u).alias("objects_kept"), ids(s & u & tail).alias("tail_scope"), ids(o & u & tail).alias("tail_kept"),
        (n(o & (F.col("kind") == "known")) / F.nullif(n(s & (F.col("kind") == "known")), F.lit(0))).alias("known_kept"),
    ).withColumn("tail_retained", F.col("tail_kept") / F.nullif(F.col("tail_scope"), F.lit(0)))
    holds = [F.col("unknown_open") > F.col("unknown_noise"), F.col("background_noise") > F.col("background_open"), F.col("tail_retained") >= least_tail, F.col("noise_share") >= least_noise]
    d = d.withColumns({f"c{i + 1}": F.coalesce(c, F.lit(False)) for i, c in enumerate(holds)})
    return d.withColumn("accepted", F.col("c1") & F.col("c2") & F.col("c3") & F.col("c4"))
