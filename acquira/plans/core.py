"""Scalars, gates, ledgers and aggregates over proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acquira.functions import boxes, numbers, text, vec
from acquira.operators import gates, ledger
from acquira.plans.registry import query
from acquira.sources import tables as t
from acquira.sources.shared import written


def scored(spark, sf, p: DataFrame | None = None) -> DataFrame:
    """Proposals (those given, if so) with a (admissibility) and u (entropy)."""
    p = p if p is not None else t.proposals(spark, sf)
    return p.withColumns({"a": boxes.admissibility(F.col("objectness"), F.col("w"), F.col("h")), "u": vec.entropy(vec.rows_to_one(F.col("q")))})


def r6(c, name):
    return F.round(c, 6).alias(name)


# ---- scalars


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)*x))), 6) AS n, round(CAST(embedding[1] AS DOUBLE)/greatest(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)*x))), 1e-9), 6) AS first FROM embeddings", base=False)
def unit_norm(spark, sf):
    e = t.read(spark, sf, "embeddings")
    return e.select("vec_id", r6(vec.norm(F.col("embedding")), "n"), r6(vec.unit(F.col("embedding"))[0], "first"))


@query("SELECT pos, round(q0/(q0+q1+q2+q3), 6) AS p0, round(q3/(q0+q1+q2+q3), 6) AS p3 FROM proposals")
def rows_to_one(spark, sf):
    p = vec.rows_to_one(F.col("q"))
    return t.proposals(spark, sf).select("pos", r6(p[0], "p0"), r6(p[3], "p3"))


@query("SELECT pos, round(u, 6) AS u FROM scored")
def entropy(spark, sf):
    return scored(spark, sf).select("pos", r6(F.col("u"), "u"))


@query("SELECT pos, round(w*h, 6) AS area, round(a, 6) AS a FROM scored")
def objectness_prior(spark, sf):
    return scored(spark, sf).select("pos", r6(F.col("w") * F.col("h"), "area"), r6(F.col("a"), "a"))


@query("SELECT pos, greatest(q0, q1) >= greatest(q2, q3) AS known FROM proposals")
def predicted_known(spark, sf):
    return t.proposals(spark, sf).select("pos", vec.predicted_known(vec.rows_to_one(F.col("q")), 2).alias("known"))


@query("SELECT pos, round((cx-w/2)*640, 4) AS x1, round((cy-h/2)*480, 4) AS y1, round((cx+w/2)*640, 4) AS x2, round((cy+h/2)*480, 4) AS y2 FROM proposals")
def cxcywh_to_xyxy(spark, sf):
    c = boxes.corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), 640.0, 480.0)
    return t.proposals(spark, sf).select("pos", *[F.round(x, 4).alias(n) for x, n in zip(c, ("x1", "y1", "x2", "y2"))])


@query("""SELECT a.pos AS pos_a, b.pos AS pos_b, round(i / greatest(a.w*a.h + b.w*b.h - i, 1e-9) + 1e-9, 6) AS iou FROM (SELECT x.pos AS pa, y.pos AS pb,
 greatest(least(x.x2,y.x2)-greatest(x.x1,y.x1),0)*greatest(least(x.y2,y.y2)-greatest(x.y1,y.y1),0) AS i FROM scored x JOIN scored y ON x.image_id = y.image_id AND x.pos < y.pos) z
 JOIN scored a ON a.pos = pa JOIN scored b ON b.pos = pb WHERE i > 0""")
def iou_pairs(spark, sf):
    p = t.proposals(spark, sf).select("image_id", "pos", F.struct(*[c.alias(n) for c, n in zip(boxes.corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("h")), ("x1", "y1", "x2", "y2"))]).alias("b"))
    a, b = p.alias("a"), p.alias("b")
    pairs = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.pos") < F.col("b.pos")))
    v = boxes.iou(boxes.struct_corners(F.col("a.b")), boxes.struct_corners(F.col("b.b")))
    return pairs.select(F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), F.round(v + 1e-9, 6).alias("iou"), v.alias("v")).where("v > 0").drop("v")


@query("""SELECT pos, CAST(round_even(least(greatest(cx*640 - s/2, 0), 640 - s), 0) AS DOUBLE) AS crop_left, CAST(round_even(least(greatest(cy*480 - s/2, 0), 480 - s), 0) AS DOUBLE) AS crop_top, CAST(greatest(round_even(s, 0), 1) AS DOUBLE) AS side
 FROM (SELECT *, least(greatest(w*640, h*480)*(1 + CAST(0.2 AS DOUBLE)), 640, 480) AS s FROM proposals) x""")
def square_crop(spark, sf):
    c = boxes.square_crop(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.lit(640.0), F.lit(480.0), 0.2)
    return t.proposals(spark, sf).select("pos", c[0].alias("crop_left"), c[1].alias("crop_top"), c[2].alias("side"))


@query("""SELECT event_id, CASE trim(name) WHEN 'aeroplane' THEN 'airplane' WHEN 'diningtable' THEN 'dining table' WHEN 'motorbike' THEN 'motorcycle' WHEN 'pottedplant' THEN 'potted plant' WHEN 'sofa' THEN 'couch' WHEN 'tvmonitor' THEN 'tv' ELSE trim(name) END AS class_name
 FROM (SELECT event_id, (['aeroplane', ' sofa ', 'tvmonitor', 'person', 'dog '])[CAST(event_id % 5 AS INT) + 1] AS name FROM events) x""", base=False)
def canonical_names(spark, sf):
    names = F.array(*[F.lit(x) for x in ("aeroplane", " sofa ", "tvmonitor", "person", "dog ")])
    e = t.read(spark, sf, "events")
    return e.select("event_id", text.canonical_name(F.element_at(names, (F.col("event_id") % 5 + 1).cast("int"))).alias("class_name"))


@query("SELECT image_id, string_agg(class_name || ':' || n, ';' ORDER BY class_name) AS quota, CAST(sum(n) AS BIGINT) AS total FROM image_counts GROUP BY image_id")
def quota_round_trip(spark, sf):
    """Counts rendered as quota text, and the total after parsing it."""
    c = t.image_counts(t.oracle(t.proposals(spark, sf)))
    m = c.groupBy("image_id").agg(text.render_quota(F.map_from_entries(F.collect_list(F.struct("class_name", "n")))).alias("quota"))
    return m.select("image_id", "quota", F.aggregate(F.map_values(text.parse_quota(F.col("quota"))), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("SELECT class_name, sha256(string_agg(image_id || '#' || n, chr(10) ORDER BY image_id || '#' || n)) AS print FROM image_counts GROUP BY class_name")
def sha_fingerprint(spark, sf):
    c = t.image_counts(t.oracle(t.proposals(spark, sf)))
    return c.groupBy("class_name").agg(text.fingerprint(F.collect_list(text.keyed(F.col("image_id"), F.col("n")))).alias("print"))


@query("SELECT o_orderkey, '9' || substr(lpad(CAST(o_orderkey AS VARCHAR), 12, '0'), 2) AS alias, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS source FROM orders", base=False)
def alias_ids(spark, sf):
    o = t.read(spark, sf, "orders").select("o_orderkey", text.alias_id(F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("alias"))
    return o.select("o_orderkey", "alias", text.source_id(F.col("alias")).alias("source"))


@query("SELECT class_name, round(pow(50.0, -(CAST(r AS DOUBLE)) / (c - 1)), 6) AS weight FROM (SELECT class_name, row_number() OVER (ORDER BY n DESC, class_name) - 1 AS r, count(*) OVER () AS c FROM class_groups) x")
def schedule_weights(spark, sf):
    g = t.class_groups(t.image_counts(t.oracle(t.proposals(spark, sf))))
    g = g.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "class_name")) - 1).withColumn("c", F.count("*").over(Window.partitionBy()))
    return g.select("class_name", r6(numbers.schedule_weight(F.col("r").cast("double"), F.col("c"), 50.0), "weight"))


@query("SELECT event_id, round(value / nullif(coalesce(nullif(CAST(user_id % 3 AS DOUBLE), 0), CAST(user_id % 5 AS DOUBLE)), 0), 6) AS rate, CASE WHEN user_id % 4 > 0 THEN round((value - user_id % 4) / (user_id % 4), 6) END AS gain, coalesce(value >= 0.5, false) AS met FROM events", base=False)
def exchange_rate(spark, sf):
    e = t.read(spark, sf, "events")
    d = lambda k: (F.col("user_id") % k).cast("double")
    return e.select("event_id", r6(numbers.exchange_rate(F.col("value"), d(3), d(5)), "rate"), r6(numbers.relative_gain(F.col("value"), d(4)), "gain"), numbers.meets(F.col("value"), 0.5).alias("met"))


# ---- gates


@query("SELECT pos FROM (SELECT pos, row_number() OVER (ORDER BY a DESC, pos) AS rn, count(*) OVER () AS n FROM (SELECT pos, round(a, 9) AS a FROM scored) s) x WHERE rn <= greatest(CAST(round_even(n * CAST(0.3 AS DOUBLE), 0) AS BIGINT), 1)")
def admissible_gate(spark, sf):
    return gates.admissible(scored(spark, sf).withColumn("a", F.round("a", 9)), "a", 0.3).where("in_gate").select("pos")


NMS = """, RECURSIVE_ITEMS AS (SELECT image_id, pos, x1, y1, x2, y2, row_number() OVER (PARTITION BY image_id ORDER BY objectness DESC, pos) AS r FROM scored {where})
, walk AS (SELECT image_id, r, [struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2)] AS kept, [pos] AS ids FROM RECURSIVE_ITEMS WHERE r = 1
 UNION ALL SELECT i.image_id, i.r, CASE WHEN hit THEN kept ELSE list_append(kept, struct_pack(x1 := i.x1, y1 := i.y1, x2 := i.x2, y2 := i.y2)) END, CASE WHEN hit THEN ids ELSE list_append(ids, i.pos) END FROM
 (SELECT i.*, w.kept, w.ids, len(list_filter(w.kept, lambda k: greatest(least(k.x2, i.x2) - greatest(k.x1, i.x1), 0) * greatest(least(k.y2, i.y2) - greatest(k.y1, i.y1), 0)
  > CAST(0.6 AS DOUBLE) * greatest((k.x2-k.x1)*(k.y2-k.y1) + (i.x2-i.x1)*(i.y2-i.y1) - greatest(least(k.x2, i.x2) - greatest(k.x1, i.x1), 0) * greatest(least(k.y2, i.y2) - greatest(k.y1, i.y1), 0), 1e-9))) > 0 AS hit
  FROM walk w JOIN RECURSIVE_ITEMS i ON i.image_id = w.image_id AND i.r = w.r + 1) i)
, last_step AS (SELECT image_id, max(r) AS r FROM walk GROUP BY image_id)
, kept AS (SELECT unnest(ids) AS pos FROM walk JOIN last_step USING (image_id, r)) """


def nms_sql(tail: str, where: str = "") -> str:
    return (t.BASE + NMS.format(where=where) + tail).replace("WITH ", "WITH RECURSIVE ", 1)


@query(nms_sql("SELECT pos FROM kept"), base=False)
def nms_fold(spark, sf):
    return gates.suppress(t.proposals(spark, sf), F.col("objectness")).where("kept").select("pos")


@query(nms_sql(", s AS (SELECT pos, row_number() OVER (ORDER BY objectness DESC, pos) AS rn, count(*) OVER () AS n FROM scored JOIN kept USING (pos)) SELECT pos FROM s WHERE rn <= greatest(CAST(round_even(n * CAST(0.3 AS DOUBLE), 0) AS BIGINT), 1)"), base=False)
def population_nms_gate(spark, sf):
    return gates.suppress_then_gate(t.proposals(spark, sf), "objectness", share=0.3).where("in_gate").select("pos")


@query("SELECT pos, round(u, 6) AS u FROM scored WHERE objectness >= 0.8 AND round(u, 9) >= (SELECT median(round(u, 9)) FROM scored WHERE objectness >= 0.8)")
def median_uncertainty_gate(spark, sf):
    d = scored(spark, sf).withColumn("u9", F.round("u", 9))
    return gates.above_median(d, F.col("objectness") >= 0.8, "u9").select("pos", r6(F.col("u"), "u"))


@query("SELECT pos FROM (SELECT pos, round((q0+q1-q3)/(q0+q1+q2+q3), 9) AS v FROM proposals) x WHERE v < (SELECT quantile_cont(round((q0+q1-q3)/(q0+q1+q2+q3), 9), 0.5) FROM proposals)")
def known_reject(spark, sf):
    q = F.col("q")
    return gates.below_quantile(t.proposals(spark, sf), F.round((q[0] + q[1] - q[3]) / (q[0] + q[1] + q[2] + q[3]), 9), 0.5).select("pos")


@query("SELECT pos FROM (SELECT o.pos, row_number() OVER (PARTITION BY object_id ORDER BY objectness, o.pos) AS rn, object_id FROM oracle o JOIN proposals p ON o.pos = p.pos) x WHERE rn = 1 OR object_id < 0")
def oracle_dedup(spark, sf):
    p = t.proposals(spark, sf)
    return gates.one_per_object(t.oracle(p).join(p.select("pos", "objectness"), "pos"), "objectness").select("pos")


@query("SELECT vec_id, CASE WHEN label = 9 THEN 0 WHEN count(*) OVER (PARTITION BY label) >= 50 THEN 1 ELSE 0 END AS gate FROM embeddings", base=False)
def cluster_noise_gate(spark, sf):
    e = t.read(spark, sf, "embeddings").select("vec_id", F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("cluster"))
    return gates.noise_gate(e, minimum=50).select("vec_id", "gate")


@query("SELECT DISTINCT image_id FROM image_counts WHERE class_name IN ('C0', 'C1', 'C25')")
def trainable_images(spark, sf):
    p = t.proposals(spark, sf)
    return ledger.usable_images(t.image_counts(t.oracle(p)), p, spark.createDataFrame([("C0",), ("C1",), ("C25",)], "class_name string"))


@query("SELECT count(*) AS shared FROM (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O') x", base=False)
def leakage(spark, sf):
    p = t.proposals(spark, sf)
    return p.where("l_linestatus = 'F'").select("image_id").intersect(p.where("l_linestatus = 'O'").select("image_id")).agg(F.count("*").alias("shared"))


# ---- selection and ledgers


@query("SELECT pos, round(u, 6) AS u FROM scored ORDER BY round(u, 9) DESC, pos LIMIT 600")
def topk_entropy(spark, sf):
    return scored(spark, sf).orderBy(F.desc(F.round("u", 9)), "pos").limit(600).select("pos", r6(F.col("u"), "u"))


@query("SELECT pos, round(a, 6) AS a FROM scored ORDER BY round(a, 9) DESC, pos LIMIT 600")
def topk_admissibility(spark, sf):
    return scored(spark, sf).orderBy(F.desc(F.round("a", 9)), "pos").limit(600).select("pos", r6(F.col("a"), "a"))


@query("SELECT pos FROM proposals ORDER BY sha256('7|' || pos), pos LIMIT 600")
def hash_random(spark, sf):
    return t.proposals(spark, sf).orderBy(text.ordered_hash(7, F.col("pos")), "pos").limit(600).select("pos")


LEDGER = """, ranked AS (SELECT pos, image_id, row_number() OVER (ORDER BY round(a, 9) DESC, pos) AS rn FROM scored)
, firsts AS (SELECT image_id, min(rn) AS rn, arg_min(pos, rn) AS anchor_pos FROM ranked GROUP BY image_id)
, running AS (SELECT f.image_id, anchor_pos, row_number() OVER (ORDER BY rn) AS seq, cost, CAST(sum(cost) OVER (ORDER BY rn) AS BIGINT) AS cum_cost FROM firsts f JOIN image_cost c ON f.image_id = c.image_id)
, opened AS (SELECT * FROM running WHERE cum_cost <= 600) """


def by_admissibility(spark, sf) -> DataFrame:
    return scored(spark, sf).withColumn("a", F.round("a", 9))


def opened(spark, sf, p: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Images that a budget of 600 opens down the ranking by admissibility; of proposals and counts that are written already, if given."""
    p = p if p is not None else written(t.proposals(spark, sf))
    counts = counts if counts is not None else t.image_counts(t.oracle(p))
    return ledger.spend(scored(spark, sf, p).select("pos", "image_id", F.round("a", 9).alias("a")), "a", t.image_cost(p, counts), budget=600)


@query(LEDGER + "SELECT image_id, anchor_pos, seq, cost, cum_cost FROM opened")
def ledger_spend(spark, sf):
    return opened(spark, sf)


@query(LEDGER + "SELECT image_id, CAST(ceil(cum_cost * 6 / CAST(600 AS DOUBLE)) AS INT) AS round FROM opened")
def ledger_rounds(spark, sf):
    p = t.proposals(spark, sf)
    return ledger.spend_in_rounds(by_admissibility(spark, sf), "a", t.image_cost(p, t.image_counts(t.oracle(p))), budget=600, rounds=6).select("image_id", "round")


DISCOVERY = """count(*) AS proposals, count(DISTINCT CASE WHEN object_id >= 0 THEN object_id END) AS objects, count(DISTINCT CASE WHEN kind = 'unknown' THEN object_id END) AS unknown_objects,
 count(CASE WHEN kind = 'unknown' THEN 1 END) AS unknown_proposals, count(DISTINCT CASE WHEN kind = 'unknown' THEN o.class_name END) AS unknown_classes, count(DISTINCT CASE WHEN kind = 'unknown' AND grp = 'head' THEN object_id END) AS head_objects,
 count(DISTINCT CASE WHEN kind = 'unknown' AND grp = 'medium' THEN object_id END) AS medium_objects, count(DISTINCT CASE WHEN kind = 'unknown' AND grp = 'tail' THEN object_id END) AS tail_objects,
 count(CASE WHEN kind = 'background' THEN 1 END) AS background, count(DISTINCT o.image_id) AS images,
 round(CAST(count(CASE WHEN kind = 'unknown' THEN 1 END) AS DOUBLE) / nullif(count(DISTINCT CASE WHEN kind = 'unknown' THEN object_id END), 0), 6) AS proposals_per_object"""


@query(f", top AS (SELECT pos FROM scored ORDER BY round(a, 9) DESC, pos LIMIT 600) SELECT {DISCOVERY} FROM oracle o JOIN top USING (pos) LEFT JOIN class_groups g ON g.class_name = o.class_name")
def discovery(spark, sf):
    p = t.proposals(spark, sf)
    o = t.oracle(p)
    top = scored(spark, sf).orderBy(F.desc(F.round("a", 9)), "pos").limit(600).select("pos")
    return ledger.discovery(o.join(top, "pos", "left_semi"), t.class_groups(t.image_counts(o))).withColumn("proposals_per_object", F.round("proposals_per_object", 6))


@query(nms_sql(f", g AS (SELECT pos, image_id, a, row_number() OVER (ORDER BY round(a, 9) DESC, pos) AS rn, count(*) OVER () AS n FROM scored JOIN kept USING (pos)), gated AS (SELECT * FROM g WHERE rn <= greatest(CAST(round_even(n * CAST(0.3 AS DOUBLE), 0) AS BIGINT), 1)), f AS (SELECT image_id, min(rn) AS rn, arg_min(pos, rn) AS pos FROM gated GROUP BY image_id), r AS (SELECT f.*, sum(cost) OVER (ORDER BY rn) AS cum FROM f JOIN image_cost USING (image_id)), picks AS (SELECT gated.pos FROM gated JOIN r ON gated.image_id = r.image_id WHERE cum <= 600) SELECT {DISCOVERY} FROM oracle o JOIN picks USING (pos) LEFT JOIN class_groups g2 ON g2.class_name = o.class_name"), base=False)
def flagship(spark, sf):
    """Suppression, gate, ranking, ledger and discovery: what a budget of 600 buys and what it holds."""
    p = written(t.proposals(spark, sf))
    d = scored(spark, sf, p).select("pos", "image_id", "cx", "cy", "w", "h", "objectness", F.round("a", 9).alias("a"))
    gated = gates.suppress_then_gate(d, "a", share=0.3, suppress_key="objectness").where("in_gate").select("pos", "image_id", "a")
    o = t.oracle(p)
    counts = written(t.image_counts(o))
    bought = ledger.spend(gated, "a", t.image_cost(d, counts), budget=600)
    picks = gated.join(bought.select("image_id"), "image_id", "left_semi").select("pos")
    return ledger.discovery(o.join(picks, "pos", "left_semi"), t.class_groups(counts)).withColumn("proposals_per_object", F.round("proposals_per_object", 6))


@query(LEDGER + """, d AS (SELECT o.image_id, c.class_name, c.n, grp, c.class_name IN ('C0', 'C1', 'C2', 'C3') AS told FROM opened o LEFT JOIN image_counts c ON o.image_id = c.image_id LEFT JOIN class_groups g ON g.class_name = c.class_name)
, per AS (SELECT image_id, max(CASE WHEN told THEN 1 ELSE 0 END) AS usable, coalesce(sum(n), 0) AS labelled, coalesce(sum(CASE WHEN told THEN n END), 0) AS supervised, coalesce(sum(CASE WHEN told AND grp = 'head' THEN n END), 0) AS head, coalesce(sum(CASE WHEN told AND grp = 'medium' THEN n END), 0) AS medium, coalesce(sum(CASE WHEN told AND grp = 'tail' THEN n END), 0) AS tail FROM d GROUP BY image_id)
 SELECT count(*) AS images, count(CASE WHEN usable = 0 THEN 1 END) AS images_barren, CAST(sum(labelled) AS BIGINT) AS boxes_labelled, CAST(sum(supervised) AS BIGINT) AS boxes_supervised, CAST(sum(head) AS BIGINT) AS boxes_head, CAST(sum(medium) AS BIGINT) AS boxes_medium, CAST(sum(tail) AS BIGINT) AS boxes_tail, CAST(sum(labelled) - sum(supervised) AS BIGINT) AS boxes_banked, round(CAST(sum(supervised) AS DOUBLE) / nullif(sum(labelled), 0), 6) AS supervised_share FROM per""")
def supervision_ledger(spark, sf):
    p = written(t.proposals(spark, sf))
    c = written(t.image_counts(t.oracle(p)))
    told = spark.createDataFrame([(f"C{i}",) for i in range(4)], "class_name string")
    return ledger.supervision(c, opened(spark, sf, p, c), told, t.class_groups(c)).withColumn("supervised_share", F.round("supervised_share", 6))


@query(LEDGER + """, tasks AS (SELECT class_name, CASE WHEN class_pos < 8 THEN 0 ELSE class_pos - 7 END AS task FROM classes WHERE class_pos < 13)
 SELECT CASE WHEN task < 2 THEN 'known' WHEN task = 2 THEN 'new' WHEN task > 2 THEN 'later' ELSE 'never' END AS fate, CAST(sum(n) AS BIGINT) AS boxes, count(DISTINCT c.class_name) AS classes FROM opened o JOIN image_counts c ON o.image_id = c.image_id LEFT JOIN tasks k ON k.class_name = c.class_name GROUP BY 1""")
def acquisition_ledger(spark, sf):
    p = t.proposals(spark, sf)
    tasks = t.classes(p).where("class_pos < 13").select("class_name", F.when(F.col("class_pos") < 8, 0).otherwise(F.col("class_pos") - 7).alias("task"))
    return ledger.acquisition(t.image_counts(t.oracle(p)), opened(spark, sf), tasks, 2)


@query(", s AS (SELECT image_id, pos, round(a, 9) AS a FROM scored), i AS (SELECT image_id, round(sum(a), 9) AS s FROM s GROUP BY image_id) SELECT pos, row_number() OVER (ORDER BY i.s DESC, s.image_id, a DESC, pos) AS rn FROM s JOIN i ON s.image_id = i.image_id")
def cost_aware_order(spark, sf):
    return ledger.cost_aware(scored(spark, sf).withColumn("a", F.round("a", 9)), "a").select("pos", "rn")


@query(LEDGER + "SELECT p.pos FROM proposals p WHERE image_id IN (SELECT image_id FROM opened)")
def opened_semi(spark, sf):
    return t.proposals(spark, sf).join(opened(spark, sf), "image_id", "left_semi").select("pos")


@query(LEDGER + "SELECT count(*) AS rows, count(DISTINCT image_id) AS images FROM proposals p WHERE image_id NOT IN (SELECT image_id FROM opened)")
def excluded_anti(spark, sf):
    return t.proposals(spark, sf).join(opened(spark, sf), "image_id", "left_anti").agg(F.count("*").alias("rows"), F.countDistinct("image_id").alias("images"))
