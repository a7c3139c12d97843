"""Populations, joins, curves by level, recall by class and distribution-aware purchases."""

from __future__ import annotations

from pyspark.sql import functions as F

from acquira.functions import text, vec
from acquira.operators import allocation, curves, gates, match
from acquira.operators.ledger import round_budgets
from acquira.plans.analytics import _MATCH, _RUNS, _TRUTH, runs, truths_and_detections
from acquira.plans.core import by_admissibility, nms_sql, r6
from acquira.plans.registry import query
from acquira.plans.selection import gated_pool, gated_rows, unit_vectors
from acquira.sources import readers
from acquira.sources.shared import written
from acquira.sources import tables as t


@query(nms_sql("SELECT pos FROM kept", where="WHERE pos IN (SELECT pos FROM (SELECT pos, row_number() OVER (ORDER BY objectness DESC, pos) AS rn, count(*) OVER () AS n FROM scored) q WHERE rn <= greatest(CAST(round_even(n * CAST(0.3 AS DOUBLE), 0) AS BIGINT), 1))"), base=False)
def population_gate_nms(spark, sf):
    return gates.gate_then_suppress(t.proposals(spark, sf), "objectness", share=0.3).where("kept").select("pos")


_BY_CLASS = (_TRUTH + _MATCH).replace("tr AS (SELECT s.image_id,", "tr AS (SELECT s.image_id || '|' || o.class_name AS image_id,").replace("dt AS (SELECT image_id,", "dt AS (SELECT image_id || '|C' || class_id AS image_id,").replace("WHERE l_linestatus = 'O')", "WHERE l_linestatus = 'O' AND objectness >= 0.6)")


@query((t.BASE + _BY_CLASS + "SELECT coalesce(tr.class_name, 'all') AS class_name, count(*) AS truths, count(w.pos) AS recalled, round(CAST(count(w.pos) AS DOUBLE)/count(*), 6) AS recall FROM tr LEFT JOIN won w ON w.pos = tr.pos GROUP BY GROUPING SETS ((tr.class_name), ())").replace("WITH ", "WITH RECURSIVE ", 1), base=False)
def recall_by_class(spark, sf):
    truth, found = truths_and_detections(spark, sf)
    found = found.withColumn("class_name", F.concat(F.lit("C"), F.col("class_id").cast("string")))
    return match.recall(match.greedy(found, truth.select("pos", "image_id", "class_name", "box"), ["image_id", "class_name"], least_score=0.6), "class_name")


@query("SELECT p.pos, p.image_id || '#' || p.pos AS key, e.label FROM proposals p JOIN embeddings e ON e.vec_id = p.vec_id")
def key_align(spark, sf):
    e = t.read(spark, sf, "embeddings").select("vec_id", "label")
    d = readers.align(e, t.proposals(spark, sf).select("pos", "image_id", "vec_id"), "vec_id")
    return d.select("pos", text.keyed(F.col("image_id"), F.col("pos")).alias("key"), "label")


@query("SELECT o.pos, coalesce(g.grp, 'unknown') AS grp FROM oracle o LEFT JOIN class_groups g ON g.class_name = o.class_name")
def group_lookup(spark, sf):
    o = t.oracle(t.proposals(spark, sf))
    return o.join(F.broadcast(t.class_groups(t.image_counts(o)).select("class_name", "grp")), "class_name", "left").select("pos", F.coalesce("grp", F.lit("unknown")).alias("grp"))


_U = "WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings), "


@query(_U + "m AS (SELECT label AS cluster, v FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM u) z WHERE rn = 1), d AS (SELECT u.vec_id, m.cluster, row_number() OVER (PARTITION BY u.vec_id ORDER BY round(list_dot_product(u.v, m.v), 9) DESC, m.cluster) AS rn FROM u, m) SELECT m.cluster, count(d.vec_id) AS references FROM m LEFT JOIN d ON d.cluster = m.cluster AND d.rn = 1 GROUP BY m.cluster".replace("AS references", 'AS "references"'), base=False)
def nearest_medoid(spark, sf):
    from pyspark.sql import Window

    e = t.read(spark, sf, "embeddings")
    m = e.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("rn = 1").select(F.col("label").alias("cluster"), "embedding")
    return allocation.nearest_medoid(e, m)


@query(_RUNS + """, lv AS (SELECT metric AS level, cost AS reference_cost FROM c WHERE arm = 'view'), l AS (SELECT *, lag(cost) OVER w AS pc, lag(metric) OVER w AS pm FROM c WINDOW w AS (PARTITION BY arm ORDER BY cost))
, h AS (SELECT arm, level, reference_cost, arg_min(CASE WHEN pm IS NULL OR metric = pm THEN cost ELSE pc + (cost - pc) * (level - pm) / (metric - pm) END, cost) AS reach FROM l JOIN lv ON metric >= level GROUP BY arm, level, reference_cost)
 SELECT a.arm, CAST(lv.level AS BIGINT) AS level, lv.reference_cost, round(reach, 3) AS cost_to_reach, round(1 - reach / lv.reference_cost, 5) AS saving FROM (SELECT DISTINCT arm FROM c) a CROSS JOIN lv LEFT JOIN h ON h.arm = a.arm AND h.level = lv.level AND h.reference_cost = lv.reference_cost""", base=False)
def efficiency(spark, sf):
    d = curves.efficiency(runs(spark, sf), "arm", "cost", "metric", "view")
    return d.select("arm", "level", "reference_cost", F.round("cost_to_reach", 3).alias("cost_to_reach"), F.round("saving", 5).alias("saving"))


@query("SELECT CAST(r AS INT) AS round, CAST(601 // 6 + CASE WHEN r < 601 % 6 THEN 1 ELSE 0 END AS INT) AS quota FROM (SELECT unnest(range(6)) AS r) z", base=False)
def round_split(spark, sf):
    return spark.createDataFrame(list(enumerate(round_budgets(601, 6))), "round int, quota int")


@query(", s AS (SELECT o.object_id, o.class_name, p.pos, round(a, 9) AS a FROM scored p JOIN oracle o ON o.pos = p.pos WHERE o.object_id >= 0), x AS (SELECT a.object_id, max(b.a) - min(b.a) AS spread, count(*) AS n FROM s a JOIN s b ON a.object_id = b.object_id GROUP BY a.object_id) SELECT object_id, round(spread, 6) AS spread, CAST(sqrt(n) AS BIGINT) AS proposals FROM x WHERE n > 1")
def same_object_spread(spark, sf):
    o = t.oracle(t.proposals(spark, sf)).where("object_id >= 0").select("pos", "object_id")
    d = by_admissibility(spark, sf).join(o, "pos").groupBy("object_id").agg((F.max("a") - F.min("a")).alias("spread"), F.count("*").alias("proposals"))
    return d.where("proposals > 1").select("object_id", r6(F.col("spread"), "spread"), "proposals")


def reference(spark, sf):
    return t.read(spark, sf, "embeddings").where("label < 3").select(vec.unit(F.col("embedding")).alias("embedding"))


def gated_names(spark, sf):
    """The gated pool as orders by vectors take it: rows name their vectors; and these."""
    e = unit_vectors(spark, sf)
    return written(gated_rows(spark, sf).select("pos", F.round("u", 9).alias("entropy"), "image_id", "cost", "vec_id").join(e.select("vec_id"), "vec_id", "left_semi")), e


@query()
def distribution_aware_order(spark, sf):
    pool, e = gated_names(spark, sf)
    return allocation.order(pool, reference(spark, sf), budget=200, vectors=e)


@query()
def distribution_aware_rounds(spark, sf):
    pool, e = gated_names(spark, sf)
    return spark.createDataFrame(allocation.rounds(pool, reference(spark, sf), budget=120, n=2, vectors=e), "round int, image_id long, cost long")


# ---- research campaigns and registered arms


def named_pool(spark, sf):
    """``arm_pool`` whose rows name their vectors, and these."""
    e = unit_vectors(spark, sf)
    return gated_rows(spark, sf, share=1.0).select("pos", "image_id", "cost", "a", F.round("u", 9).alias("entropy"), "vec_id").join(e.select("vec_id"), "vec_id", "left_semi"), e


def arm_pool(spark, sf):
    return gated_pool(spark, sf, share=1.0).select("pos", "image_id", "cost", "a", F.round("u", 9).alias("entropy"), "embedding")


@query()
def research_campaign(spark, sf):
    from acquira.operators import arms, research

    pool, vectors = named_pool(spark, sf)
    return research.campaign(arms.candidates("research_v2", pool), arms.ARMS["research_v2"].spec, budget=60, rounds=2, reference=reference(spark, sf), vectors=vectors).withColumn("score", F.round("score", 6))


def _arm(name: str):
    def plan(spark, sf):
        from acquira.operators import arms

        if arms.ARMS[name].kind in ("coverage", "research"):
            pool, e = named_pool(spark, sf)
            return arms.select(name, pool, budget=60, seed=3, reference=reference(spark, sf), vectors=e)
        pool = arm_pool(spark, sf)
        return arms.select(name, pool if arms.ARMS[name].semantic else pool.drop("embedding"), budget=60, seed=3, reference=reference(spark, sf))

    plan.__name__ = f"arm_{name}"
    return plan


_GATED = ", g AS (SELECT k.pos, image_id, round(a, 9) AS a, round(u, 9) AS u, row_number() OVER (ORDER BY round(a, 9) DESC, k.pos) AS rn, count(*) OVER () AS n FROM scored JOIN kept k USING (pos)), f AS ({first}), r AS (SELECT row_number() OVER (ORDER BY key, pos) AS seq, f.image_id, cost, sum(cost) OVER (ORDER BY key, pos) AS cum FROM f JOIN image_cost USING (image_id)) SELECT seq, image_id, cost FROM r WHERE cum <= 60"
_ARM_SQL = {
    "admissibility": "SELECT image_id, min(rn) AS key, min(rn) AS pos FROM g GROUP BY image_id",
    "entropy": "SELECT image_id, min(o) AS key, min(o) AS pos FROM (SELECT image_id, row_number() OVER (ORDER BY u DESC, pos) AS o FROM g) z GROUP BY image_id",
    "cost_aware": "SELECT image_id, -round(sum(a), 9) AS key, image_id AS pos FROM g WHERE rn <= greatest(CAST(round_even(n * CAST(0.3 AS DOUBLE), 0) AS BIGINT), 1) GROUP BY image_id",
    "random": "SELECT image_id, CAST('0x' || substr(min(sha256('3|' || pos)), 1, 13) AS BIGINT) AS key, image_id AS pos FROM g GROUP BY image_id",
}
for _name in ("random", "admissibility", "proposed", "entropy", "coreset", "proposed_v2", "cost_aware", "distribution_aware_v1", "research_v2_plan", "research_v2_no_gate"):
    query(nms_sql(_GATED.format(first=_ARM_SQL[_name])).replace("ORDER BY objectness DESC, pos) AS r FROM scored", "ORDER BY round(a, 9) DESC, pos) AS r FROM scored") if _name in _ARM_SQL else None, base=False)(_arm(_name))
