"""Sampling, allocation, sequential selection and clustering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from acquira.functions import vec
from acquira.operators import clusters, gates, sampling, sequential
from acquira.plans.core import by_admissibility, nms_sql, r6, scored
from acquira.plans.registry import query
from acquira.sources import tables as t
from acquira.sources.shared import written


def counts(spark, sf):
    return t.image_counts(t.oracle(t.proposals(spark, sf)))


_POOL = ", pool AS (SELECT image_id, class_name, CAST(unnest(range(n)) AS BIGINT) AS ordinal FROM image_counts) "


@query(_POOL + "SELECT image_id, class_name, ordinal, rn FROM (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY sha256('3|' || class_name || '|' || image_id || '|' || ordinal), image_id, ordinal) AS rn FROM pool) z WHERE rn <= 40")
def exemplar_quota(spark, sf):
    c = counts(spark, sf)
    demand = c.groupBy("class_name").agg(F.least(F.sum("n"), F.lit(40)).alias("quota"))
    return sampling.exact_quota(sampling.objects(c), demand, seed=3)


@query(_POOL + ", held AS (SELECT * FROM pool WHERE image_id % 9 = 0) SELECT image_id, class_name, ordinal, rn FROM (SELECT p.*, row_number() OVER (PARTITION BY class_name ORDER BY CASE WHEN image_id % 9 = 0 THEN 0 ELSE 1 END, sha256('3|' || class_name || '|' || image_id || '|' || ordinal), image_id, ordinal) AS rn FROM pool p) z WHERE rn <= 60")
def exemplar_incumbents(spark, sf):
    c = counts(spark, sf)
    pool = sampling.objects(c)
    demand = c.groupBy("class_name").agg(F.least(F.sum("n"), F.lit(60)).alias("quota"))
    return sampling.exact_quota(pool, demand, seed=3, held=pool.where("image_id % 9 = 0"))


@query(", r AS (SELECT image_id, row_number() OVER (PARTITION BY class_name ORDER BY sha256('5|' || class_name || '|' || image_id), image_id) AS rn FROM image_counts), q AS (SELECT DISTINCT image_id FROM r WHERE rn <= 30), o AS (SELECT image_id FROM (SELECT DISTINCT image_id FROM image_counts) z WHERE image_id NOT IN (SELECT image_id FROM q) ORDER BY sha256('5|' || image_id), image_id LIMIT CAST((SELECT count(*) FROM q) * 2 AS BIGINT)) SELECT image_id, true AS required FROM q UNION ALL SELECT image_id, false FROM o")
def eval_subset(spark, sf):
    return sampling.evaluation_subset(counts(spark, sf), cap=30, remainder=2.0, seed=5)


@query(", r AS (SELECT pos, vec_id % 40 AS cluster, round(a, 9) AS a FROM scored), k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY a DESC, pos) AS rn FROM r) SELECT pos, cluster FROM k WHERE rn <= 10 ORDER BY a DESC, pos LIMIT 300")
def cluster_cap(spark, sf):
    d = by_admissibility(spark, sf).withColumn("cluster", F.col("vec_id") % 40)
    return sampling.cluster_cap(d, "cluster", "a", cap=10, limit=300).select("pos", "cluster")


@query(", r AS (SELECT pos, vec_id % 40 AS cluster, round(a, 9) AS a FROM scored), k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY a DESC, pos) AS rn FROM r) SELECT pos, cluster, rn FROM k ORDER BY rn, cluster LIMIT 300")
def cluster_round_robin(spark, sf):
    d = by_admissibility(spark, sf).withColumn("cluster", F.col("vec_id") % 40)
    return sampling.cluster_rounds(d, "cluster", "a", limit=300).select("pos", "cluster", "rn")


@query(", w AS (SELECT class_name, n, row_number() OVER (ORDER BY n DESC, class_name) - 1 AS rank, pow(10.0, -CAST(row_number() OVER (ORDER BY n DESC, class_name) - 1 AS DOUBLE) / (count(*) OVER () - 1)) AS weight FROM class_groups), f AS (SELECT *, floor(min(n / weight) OVER () * sum(weight) OVER ()) AS feasible FROM w), r AS (SELECT *, weight / sum(weight) OVER () * feasible AS raw FROM f), l AS (SELECT *, feasible - sum(floor(raw)) OVER () AS left_over, row_number() OVER (ORDER BY round(raw - floor(raw), 9) DESC, rank) AS rn FROM r) SELECT class_name, CAST(feasible AS BIGINT) AS feasible, CAST(floor(raw) + CASE WHEN rn <= left_over THEN 1 ELSE 0 END AS BIGINT) AS target FROM l")
def largest_remainder(spark, sf):
    return sampling.long_tail_targets(t.class_groups(counts(spark, sf)), 10.0).select("class_name", "feasible", "target")


@query(", c AS (SELECT vec_id % 40 AS cluster, count(*) AS candidates, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS refs FROM proposals GROUP BY 1), r AS (SELECT *, ln((1 + candidates) / CAST(1 + refs AS DOUBLE)) AS rarity FROM c) SELECT cluster, round(rarity, 6) AS rarity, round(600 * greatest(rarity, 0) / sum(greatest(rarity, 0)) OVER (), 6) AS quota FROM r")
def quotas(spark, sf):
    c = t.proposals(spark, sf).groupBy((F.col("vec_id") % 40).alias("cluster")).agg(F.count("*").alias("candidates"), F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("references"))
    return sampling.quotas(c, budget=600).select("cluster", r6(F.col("rarity"), "rarity"), r6(F.col("quota"), "quota"))


@query(", cheap AS (SELECT image_id, cost, row_number() OVER (ORDER BY cost, image_id) AS rn, sum(cost) OVER (ORDER BY cost, image_id) AS cum FROM image_cost) SELECT image_id, cost FROM cheap WHERE cum <= 500")
def ceiling_cheapest(spark, sf):
    from acquira.operators import ledger

    p = t.proposals(spark, sf)
    cost = t.image_cost(p, counts(spark, sf))
    walk = cost.select("image_id", F.col("image_id").alias("pos"), (-F.col("cost")).alias("key"))
    return ledger.spend(walk, "key", cost, budget=500).select("image_id", "cost")


@query()
def power_allocation(spark, sf):
    n = {r.class_name: r.n for r in t.class_groups(counts(spark, sf)).orderBy("class_name").collect()}  # one row a class
    return spark.createDataFrame([(c, a, m) for a in (0.0, 0.5, 1.0) for c, m in sequential.power_allocation(n, total=2000, alpha=a).items()], "class_name string, alpha double, memory long")


_HERDING = """WITH RECURSIVE e AS (SELECT label, vec_id AS pos, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
 m AS (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(v[i]) AS x FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM e) z GROUP BY label, i) y GROUP BY label),
 w AS (SELECT label, CAST(0 AS INT) AS step, list_transform(m, lambda x: CAST(0 AS DOUBLE)) AS s, CAST([] AS BIGINT[]) AS taken, CAST(-1 AS BIGINT) AS pos FROM m
 UNION ALL SELECT label, step, s, taken, pos FROM (SELECT w.label, w.step + 1 AS step, list_transform(list_zip(w.s, e.v), lambda z: z[1] + z[2]) AS s, list_append(w.taken, e.pos) AS taken, e.pos,
  row_number() OVER (PARTITION BY w.label ORDER BY list_sum(list_transform(list_zip(w.s, e.v, m.m), lambda z: pow((z[1] + z[2]) / (w.step + 1) - z[3], 2))), e.pos) AS rn
  FROM w JOIN e ON e.label = w.label JOIN m ON m.label = w.label WHERE NOT list_contains(w.taken, e.pos)) q WHERE rn = 1)
 SELECT label, pos, step FROM w WHERE step > 0"""


@query(_HERDING, base=False)
def herding(spark, sf):
    return sequential.herding(t.read(spark, sf, "embeddings").select("label", F.col("vec_id").alias("pos"), "embedding"), "label")


def gated_rows(spark, sf, share: float = 0.3):
    """What survives suppression and is in the top share by admissibility, with costs and the ids of vectors."""
    p = t.proposals(spark, sf)
    kept = written(gates.survivors(by_admissibility(spark, sf), F.col("a"), ["vec_id", "objectness", "a", "u", "l_linestatus"]))  # the gate reads it more than once
    return written(gates.admissible(kept, "a", share).where("in_gate").drop("in_gate").join(t.image_cost(p, counts(spark, sf)), "image_id"))


def unit_vectors(spark, sf):
    return t.read(spark, sf, "embeddings").select("vec_id", vec.unit(F.col("embedding")).alias("embedding"))


def gated_pool(spark, sf, share: float = 0.3):
    """``gated_rows`` with vectors and clusters: what sequential selection works on."""
    return gated_rows(spark, sf, share).join(unit_vectors(spark, sf), "vec_id").withColumn("cluster", F.col("vec_id") % 20)


_GATED_POOL = """, e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings)
, g AS (SELECT k.pos, image_id, vec_id, objectness, l_linestatus, round(u, 9) AS u, round(a, 9) AS a, row_number() OVER (ORDER BY round(a, 9) DESC, k.pos) AS rn, count(*) OVER () AS n FROM scored JOIN kept k USING (pos))
, pool AS (SELECT g.*, cost, v FROM g JOIN e USING (vec_id) JOIN image_cost USING (image_id) WHERE rn <= greatest(CAST(round_even(n * CAST(0.3 AS DOUBLE), 0) AS BIGINT), 1)) """
_BY_A = ("ORDER BY objectness DESC, pos) AS r FROM scored", "ORDER BY round(a, 9) DESC, pos) AS r FROM scored")
_CENTRES = nms_sql(_GATED_POOL + """, b AS (SELECT 0 AS step, pos, image_id, cost, objectness AS tie, v, CAST('infinity' AS DOUBLE) AS far, true AS free, CAST(100 AS BIGINT) AS purse, CAST(NULL AS BIGINT) AS pi, CAST(NULL AS BIGINT) AS pp, CAST(NULL AS DOUBLE) AS pf, CAST(NULL AS BIGINT) AS pc FROM pool
 UNION ALL SELECT step + 1, pos, image_id, cost, tie, v, least(far, round(1 - list_max(list_transform(vs, lambda c: list_dot_product(v, c))), 9) + 0.0), free AND image_id <> qi, purse - qc, qi, qp, qf, qc FROM
  (SELECT *, list(v) FILTER (WHERE image_id = qi) OVER () AS vs FROM (SELECT *, first_value(image_id) OVER o AS qi, first_value(cost) OVER o AS qc, first_value(pos) OVER o AS qp, first_value(far) OVER o AS qf, bool_or(free) OVER () AS still FROM b WINDOW o AS (ORDER BY free DESC, far DESC, tie DESC, pos)) x) y WHERE qc <= purse AND still)
 SELECT DISTINCT pi AS image_id, pp AS anchor_pos, CASE WHEN isfinite(pf) THEN round(pf, 6) END AS distance, pc AS cost FROM b WHERE step > 0""").replace(*_BY_A)


@query(_CENTRES, base=False)
def k_centre(spark, sf):
    picks = sequential.k_centre(gated_pool(spark, sf).withColumn("tie", F.col("objectness")), budget=100)
    return spark.createDataFrame(picks, "image_id long, anchor_pos long, distance double, cost long").withColumn("distance", F.when(~F.isnan("distance"), F.round("distance", 6)))


_BATCH = nms_sql(_GATED_POOL + """, c AS (SELECT pos, a AS base, v FROM pool ORDER BY a DESC, pos LIMIT 1000)
, b AS (SELECT 0 AS step, pos, base, v, CAST(0 AS DOUBLE) AS near, true AS alive, CAST(NULL AS BIGINT) AS pick, CAST(NULL AS DOUBLE) AS score FROM c
 UNION ALL SELECT step + 1, pos, base, v, greatest(near, list_dot_product(v, pv)), alive AND pos <> pp, pp, ps FROM (SELECT *, first_value(v) OVER o AS pv, first_value(pos) OVER o AS pp, first_value(s) OVER o AS ps FROM
  (SELECT *, base - 0.3 * (rank() OVER (ORDER BY near) - 1 + (count(*) OVER (PARTITION BY near) - 1) / CAST(2 AS DOUBLE)) / greatest(count(*) OVER () - 1, 1) AS s FROM b WHERE step < 50) x WINDOW o AS (ORDER BY alive DESC, s DESC, base DESC, pos)) y)
 SELECT DISTINCT pick AS pos, round(score, 6) AS score FROM b WHERE step > 0""").replace(*_BY_A)


@query(_BATCH, base=False)
def greedy_batch(spark, sf):
    return spark.createDataFrame(sequential.greedy_batch(gated_pool(spark, sf).withColumn("base", F.col("a")), quota=50, mu=0.3), "pos long, score double").withColumn("score", F.round("score", 6))


@query()
def emit_order(spark, sf):
    pool = written(gated_pool(spark, sf).withColumn("entropy", F.round("u", 9)).select("pos", "cluster", "entropy", "image_id", "cost", "l_linestatus"))
    q = {r.cluster: r.quota for r in sampling.quotas(pool.groupBy("cluster").agg(F.count("*").alias("candidates"), F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("references")), budget=200).collect()}
    return sequential.emitted(pool, q)


@query()
def set_cover_memory(spark, sf):
    c = written(counts(spark, sf))
    n = {r.class_name: r.n for r in c.groupBy("class_name").agg(F.sum("n").alias("n")).orderBy("class_name").collect()}
    return spark.createDataFrame(pd.DataFrame({"image_id": sequential.image_memory(c, sequential.power_allocation(n, total=200, alpha=0.5))}), "image_id long")


@query()
def kmeans_partition(spark, sf):
    return clusters.centroids(clusters.kmeans(t.read(spark, sf, "embeddings"), k=8)).select("cluster", "size")


@query()
def pca_whitened(spark, sf):
    return clusters.pca(t.read(spark, sf, "embeddings"), dims=4, whiten=True).select("vec_id", "reduced")


_UNIT = "WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings) "


@query(_UNIT + ", p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a, u b WHERE 1 - list_dot_product(a.v, b.v) <= 0.5 + 1e-9 OR a.vec_id = b.vec_id), core AS (SELECT a FROM p GROUP BY a HAVING count(*) >= 5) SELECT vec_id, CASE WHEN vec_id IN (SELECT a FROM core) THEN 'core' WHEN vec_id IN (SELECT p.a FROM p JOIN core c ON c.a = p.b) THEN 'border' ELSE 'noise' END AS status FROM embeddings", base=False)
def dbscan_status(spark, sf):
    e = t.read(spark, sf, "embeddings")
    return clusters.dbscan(e, eps=0.5, minimum=5).select("vec_id", "status")


@query(_UNIT + ", s AS (SELECT label, i, sum(v[i]) AS x FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM u) z GROUP BY 1, 2), sv AS (SELECT label, list(x ORDER BY i) AS s FROM s GROUP BY label) SELECT label AS cluster, vec_id AS medoid FROM (SELECT u.label, vec_id, row_number() OVER (PARTITION BY u.label ORDER BY round(list_dot_product(v, s), 9) DESC, vec_id) AS rn FROM u JOIN sv ON sv.label = u.label) z WHERE rn = 1", base=False)
def medoids(spark, sf):
    return clusters.medoids(t.read(spark, sf, "embeddings").withColumnRenamed("label", "cluster"))


@query(", f AS (SELECT o.object_id, o.pos, row_number() OVER (PARTITION BY image_id, class_name ORDER BY o.pos) - 1 AS ordinal FROM oracle o WHERE object_id >= 0) SELECT pos, ordinal FROM f")
def class_ordinals(spark, sf):
    o = t.oracle(t.proposals(spark, sf)).where("object_id >= 0")
    return o.select("pos", (F.row_number().over(Window.partitionBy("image_id", "class_name").orderBy("pos")) - 1).alias("ordinal"))


@query("SELECT pos, round(CASE WHEN u > 0.9 THEN a * (1 + u) ELSE a END, 6) AS score FROM scored")
def combined_score(spark, sf):
    d = scored(spark, sf)
    return d.select("pos", r6(F.when(F.col("u") > 0.9, F.col("a") * (1 + F.col("u"))).otherwise(F.col("a")), "score"))
