"""Chains, epochs, splits, coherence and anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from acquira.functions import vec
from acquira.operators import protocol
from acquira.plans.audits import _AP, _ap, _groups
from acquira.plans.analytics import _RUNS, runs
from acquira.plans.core import LEDGER, by_admissibility, opened, r6
from acquira.plans.registry import query
from acquira.plans.terms import _U, unit
from acquira.sources import tables as t


@query(", c AS (SELECT list(class_name ORDER BY class_pos) AS l FROM classes) SELECT 1 AS task, NULL AS new_class, 0 AS previous, 8 AS current, array_to_string(l[1:8], ';') AS known FROM c UNION ALL SELECT CAST(k + 2 AS INT), l[9 + k], CAST(8 + k AS INT), CAST(9 + k AS INT), array_to_string(l[1:9 + k], ';') FROM c, (SELECT unnest(range(3)) AS k) z")
def task_chain(spark, sf):
    return protocol.chain(t.classes(t.proposals(spark, sf)), tasks=4, start=8)


@query("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY sha256('5|2|' || o_orderkey), o_orderkey) - 1 AS place FROM orders) SELECT o_orderkey, place // 16 AS batch, place % 16 AS slot FROM o WHERE place < 400 AND place // 16 >= 7", base=False)
def epoch_batches(spark, sf):
    order = protocol.epoch_order(t.read(spark, sf, "orders"), "o_orderkey", size=400, seed=5, epoch=2)
    return protocol.remaining_batches(order, "o_orderkey", batch=16, steps=7)


@query("SELECT DISTINCT image_id FROM image_counts WHERE class_name IN ('C20', 'C25')")
def evaluation_split(spark, sf):
    return protocol.evaluation_split(t.image_counts(t.oracle(t.proposals(spark, sf))), scope="declared", declared=["C20", "C25"])


@query("SELECT vec_id, 1.0::DOUBLE AS off, CASE WHEN count(*) OVER (PARTITION BY label) >= 50 THEN 1.0::DOUBLE ELSE 0.0 END AS binary FROM embeddings", base=False)
def coherence_simple(spark, sf):
    u = unit(spark, sf).withColumn("cluster", F.col("label"))
    a = protocol.coherence(u, "off", key="vec_id").withColumnRenamed("g", "off")
    return a.join(protocol.coherence(u, "binary", minimum=50, key="vec_id").withColumnRenamed("g", "binary"), "vec_id")


@query(_U + ", s AS (SELECT vec_id, v, row_number() OVER (ORDER BY label DESC, vec_id) AS rn, count(*) OVER () AS n FROM u), i AS (SELECT * FROM s WHERE rn <= greatest(CAST(round_even(n * CAST(0.5 AS DOUBLE), 0) AS BIGINT), 1)), p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM i a, i b WHERE 1 - list_dot_product(a.v, b.v) <= 0.5 + 1e-9 OR a.vec_id = b.vec_id), core AS (SELECT a FROM p GROUP BY a HAVING count(*) >= 4) SELECT vec_id, CASE WHEN vec_id IN (SELECT p.a FROM p JOIN core c ON c.a = p.b) THEN 1.0::DOUBLE ELSE 0.0 END AS g FROM u", base=False)
def coherence_density(spark, sf):
    return protocol.coherence(unit(spark, sf), "density", minimum=4, eps=0.5, share=0.5, key="vec_id", score="label")


@query(_U + ", o AS (SELECT a.vec_id, sqrt(greatest(2 - 2 * list_dot_product(a.v, b.v), 0)) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC) AS rn FROM u a JOIN u b ON a.vec_id <> b.vec_id), k AS (SELECT vec_id, d FROM o WHERE rn = 5) SELECT vec_id, round(1 / (1 + d / (SELECT median(d) FROM k)), 5) AS g FROM k", base=False)
def coherence_continuous(spark, sf):
    return protocol.coherence(unit(spark, sf), "continuous", k=5, key="vec_id").select("vec_id", F.round("g", 5).alias("g"))


@query(_AP + ", x AS (SELECT ap.*, grp FROM ap JOIN class_groups USING (class_name) WHERE task = 0) SELECT coalesce(grp, 'all') AS grp, round(avg(ap), 4) AS mean FROM x GROUP BY GROUPING SETS ((grp), ())")
def anchor_summary(spark, sf):
    ap = _ap(spark, sf).where("task = 0")
    mean = ap.agg(F.avg("ap")).first()[0]
    return protocol.anchor_summary(ap, _groups(spark, sf), mean).withColumn("mean", F.round("mean", 4))


@query(_AP + "SELECT 'c' || (x.n % 3) AS condition, x.class_name, round(a.ap - b.ap, 5) AS absolute, round((a.ap - b.ap) / (a.ap + 1e-12), 5) AS relative FROM class_groups x JOIN ap a ON a.class_name = x.class_name AND a.task = 0 JOIN ap b ON b.class_name = x.class_name AND b.task = 1")
def condition_forgetting(spark, sf):
    d = _ap(spark, sf).join(_groups(spark, sf).select("class_name", F.concat(F.lit("c"), (F.col("n") % 3).cast("string")).alias("condition")), "class_name")
    return protocol.condition_forgetting(d.where("task = 0"), d.where("task = 1")).select("condition", "class_name", F.round("absolute", 5).alias("absolute"), F.round("relative", 5).alias("relative"))


@query(", h AS (SELECT DISTINCT image_id % 3 AS task, image_id FROM proposals WHERE image_id % 5 = 0), d AS (SELECT class_pos % 3 AS task, class_name FROM classes UNION SELECT 0, class_name FROM classes WHERE class_pos < 4), j AS (SELECT h.task, h.image_id, c.n, grp, d.class_name IS NOT NULL AS told FROM h LEFT JOIN image_counts c ON c.image_id = h.image_id LEFT JOIN d ON d.task = h.task AND d.class_name = c.class_name LEFT JOIN class_groups g ON g.class_name = c.class_name) SELECT task, count(DISTINCT image_id) AS images, CAST(coalesce(sum(CASE WHEN told THEN n END), 0) AS BIGINT) AS trained, CAST(coalesce(sum(n), 0) AS BIGINT) AS total, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN told AND grp = '{g}' THEN n END), 0) AS BIGINT) AS trained_{g}" for g in ("head", "medium", "tail")) + ", CAST(coalesce(sum(n), 0) - coalesce(sum(CASE WHEN told THEN n END), 0) AS BIGINT) AS dropped FROM j GROUP BY task")
def trained_boxes(spark, sf):
    p = t.proposals(spark, sf)
    c = t.classes(p)
    handed = p.where("image_id % 5 = 0").select((F.col("image_id") % 3).alias("task"), "image_id")
    declared = c.select((F.col("class_pos") % 3).cast("long").alias("task"), "class_name").union(c.where("class_pos < 4").select(F.lit(0).cast("long"), "class_name")).distinct()
    return protocol.trained_boxes(handed, t.image_counts(t.oracle(p)), declared, _groups(spark, sf))


@query(_RUNS + ", p AS (SELECT a.users AS au, b.users AS bu, a.asked AS aa, b.asked AS ba FROM c a JOIN c b ON a.task = b.task WHERE a.arm = 'view' AND b.arm = 'click') SELECT 'users' AS field, count(*) AS pairs, count(CASE WHEN au <> bu THEN 1 END) AS differing, CAST(max(abs(au - bu)) AS DOUBLE) AS largest FROM p UNION ALL SELECT 'asked', count(*), count(CASE WHEN aa <> ba THEN 1 END), round(max(abs(aa - ba)), 6) FROM p", base=False)
def paired_identity(spark, sf):
    c = runs(spark, sf)
    return protocol.paired_identity(c.where("arm = 'view'"), c.where("arm = 'click'"), "task", ["users", "asked"]).withColumn("largest", F.round("largest", 6))


@query("SELECT vec_id, round(-ln(CAST(count(*) OVER (PARTITION BY label) AS DOUBLE) / count(*) OVER ()), 6) AS log_inverse, round(1.0 / count(*) OVER (PARTITION BY label), 6) AS inverse FROM embeddings", base=False)
def rarity_methods(spark, sf):
    e = t.read(spark, sf, "embeddings")
    n = e.count()
    d = e.join(F.broadcast(e.groupBy("label").agg(F.count("*").alias("size"))), "label")  # one row a label
    return d.select("vec_id", *[r6(protocol.rarity(F.col("size"), F.lit(n), m), m) for m in ("log_inverse", "inverse")])


@query(LEDGER + "SELECT coalesce(grp, 'none') AS grp, CAST(sum(c.n) AS BIGINT) AS boxes, count(DISTINCT c.class_name) AS classes, count(DISTINCT c.image_id) AS images FROM opened o JOIN image_counts c ON c.image_id = o.image_id LEFT JOIN class_groups g ON g.class_name = c.class_name WHERE c.class_name NOT IN ('C0', 'C1') GROUP BY 1")
def band_ledger(spark, sf):
    return protocol.band_ledger(t.image_counts(t.oracle(t.proposals(spark, sf))), opened(spark, sf), _groups(spark, sf), known=["C0", "C1"])


@query("SELECT pos, score, row_number() OVER (ORDER BY score DESC, pos) AS rn FROM (SELECT pos, round(round(a, 9) * (0.5 + cx / 2), 9) AS score FROM scored) z ORDER BY score DESC, pos LIMIT 300")
def ranked_product(spark, sf):
    return protocol.ranked_product(by_admissibility(spark, sf).withColumn("c", 0.5 + F.col("cx") / 2), "c", 300)


@query("SELECT vec_id, round(sqrt(abs(CAST(embedding[1] AS DOUBLE)) / list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))))), 6) AS first FROM embeddings", base=False)
def hellinger_first(spark, sf):
    e = t.read(spark, sf, "embeddings")
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return e.select("vec_id", r6(vec.hellinger(v)[0], "first"))
