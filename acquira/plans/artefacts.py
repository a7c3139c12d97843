"""Artefacts there and back: written in their formats, read again, and held against the tables that they came from."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from acquira.functions import boxes
from acquira.plans.analytics import _RUNS, _TRUTH, runs, truths_and_detections
from acquira.plans.registry import query
from acquira.sources import readers, writers
from acquira.sources import tables as t
from acquira.sources.shared import checkpoint_folder


def _place(spark, name: str) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _counts(spark, sf):
    c = t.image_counts(t.oracle(t.proposals(spark, sf)))
    return c.withColumn("image_id", F.lpad(F.col("image_id").cast("string"), 12, "0"))


@query("SELECT lpad(CAST(image_id AS VARCHAR), 12, '0') AS image_id, lower(class_name) AS class_name, CAST(n AS INT) AS n FROM image_counts")
def counts_scan(spark, sf):
    path = _place(spark, "counts")
    writers.write_counts(_counts(spark, sf).withColumn("class_name", F.lower("class_name")), path)
    return readers.read_counts(spark, path)


@query("SELECT DISTINCT CAST(image_id AS VARCHAR) AS id FROM proposals WHERE image_id % 3 = 0")
def image_set_scan(spark, sf):
    path = _place(spark, "set")
    writers.write_image_set(t.proposals(spark, sf).where("image_id % 3 = 0"), path, "shared_test")
    return readers.read_list(spark, path).select("id")


@query(_RUNS + "SELECT arm, task, CASE WHEN task % 2 = 0 THEN users END AS users, asked, 'a' AS part FROM c WHERE arm = 'view' UNION ALL SELECT arm, task, users, NULL, NULL FROM c WHERE arm = 'click'", base=False)
def results_scan(spark, sf):
    path, c = _place(spark, "results"), runs(spark, sf)
    view = c.where("arm = 'view'").select("arm", "task", F.when(F.col("task") % 2 == 0, F.col("users").cast("string")).otherwise("\u2014").alias("users"), "asked", F.lit("a").alias("part"))
    writers.write_csv([view, c.where("arm = 'click'").select("arm", "task", F.col("users").cast("string").alias("users"))], path)
    return readers.read_results(spark, path)


@query(_RUNS + "SELECT arm, task, users FROM c WHERE task % 3 > 0", base=False)
def trajectory_scan(spark, sf):
    path = _place(spark, "trajectory")
    status = F.when(F.col("task") % 3 > 0, "complete").otherwise("running")
    writers.write_csv([runs(spark, sf).select("arm", "task", "users", status.alias("status"))], path)
    return readers.read_trajectory(spark, path, ["arm", "task"]).drop("status")


@query("SELECT lower(class_name) AS class_name, grp, n FROM class_groups")
def groups_scan(spark, sf):
    path = _place(spark, "groups")
    g = t.class_groups(t.image_counts(t.oracle(t.proposals(spark, sf)))).select(F.lower("class_name").alias("class_name"), "grp", "n")
    writers.write_csv([g], path)
    return readers.read_groups(spark, path)


@query(_TRUTH + "SELECT 'truth' AS kind, CAST(image_id AS VARCHAR) AS image_id, class_name, CAST(NULL AS DOUBLE) AS score, round(x1, 6) AS x1, round(y2, 6) AS y2 FROM tr UNION ALL SELECT 'found', CAST(image_id AS VARCHAR), 'C' || class_id, score, round(x1, 6), round(y2, 6) FROM dt")
def detections_scan(spark, sf):
    path = _place(spark, "detections")
    truth, found = truths_and_detections(spark, sf)
    image = F.col("image_id").cast("string").alias("image_id")
    writers.write_detections(truth.select(image, "class_name", "box"), found.select(image, F.concat(F.lit("C"), F.col("class_id").cast("string")).alias("class_name"), "score", "box"), path, "detections_v1")
    a, b = readers.read_detections(spark, path, "detections_v1")
    row = lambda d, kind, score: d.select(F.lit(kind).alias("kind"), "image_id", "class_name", score.alias("score"), F.round("box.x1", 6).alias("x1"), F.round("box.y2", 6).alias("y2"))
    return row(a, "truth", F.lit(None).cast("double")).unionByName(row(b, "found", F.col("score")))


def _annotated(spark, sf):
    truth, _ = truths_and_detections(spark, sf)
    px = lambda c, n: F.round(F.col(f"box.{c}") * n).alias
    return truth.select(F.lpad(F.col("image_id").cast("string"), 12, "0").alias("image_id"), F.lit(500).alias("width"), F.lit(400).alias("height"), F.col("pos").alias("place"), F.lower("class_name").alias("class_name"),
                        px("x1", 500)("xmin"), px("y1", 400)("ymin"), px("x2", 500)("xmax"), px("y2", 400)("ymax"))


_PIXELS = _TRUTH + ", px AS (SELECT lpad(CAST(image_id AS VARCHAR), 12, '0') AS image_id, pos, lower(class_name) AS class_name, round(x1 * 500) AS xmin, round(y1 * 400) AS ymin, round(x2 * 500) AS xmax, round(y2 * 400) AS ymax FROM tr) "


@query(_PIXELS + "SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY pos) - 1 AS INT) AS place, class_name, CAST(row_number() OVER (PARTITION BY image_id, class_name ORDER BY pos) - 1 AS INT) AS ordinal, xmin, ymax, round((xmin + xmax) / 2 / 500, 6) AS cx, round((ymax - ymin) / 400, 6) AS h FROM px")
def annotations_scan(spark, sf):
    d = readers.relative_boxes(readers.parse_annotations(writers.annotation_xml(_annotated(spark, sf))))
    return d.select("image_id", "place", "class_name", "ordinal", "xmin", "ymax", F.round("cx", 6).alias("cx"), F.round("h", 6).alias("h"))


@query(_PIXELS + "SELECT '9' || substr(image_id, 2) AS image_id, string_agg(DISTINCT class_name, ';' ORDER BY class_name) AS classes FROM px WHERE pos % 2 = 0 GROUP BY 1")
def filtered_annotations(spark, sf):
    a = _annotated(spark, sf)
    d = readers.parse_annotations(writers.filtered_annotations(a, a.where("place % 2 = 0"), alias=True))
    return readers.image_classes(d).select("image_id", F.array_join("classes", ";").alias("classes"))


@query(_PIXELS + "SELECT image_id, class_name, count(*) AS n FROM px WHERE class_name IN ('c0', 'c2', 'c4') GROUP BY 1, 2")
def kept_class_counts(spark, sf):
    return readers.annotation_counts(readers.parse_annotations(writers.annotation_xml(_annotated(spark, sf))), ["c0", "c2", "c4"])


@query("SELECT vec_id, vec_id % 4 AS task, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings WHERE vec_id % 4 < 2 AND vec_id % 3 = 1", base=False)
def reference_scan(spark, sf):
    path = _place(spark, "reference")
    e = t.read(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 4).alias("task"), F.concat(F.lit("r"), (F.col("vec_id") % 3).cast("string")).alias("run"), "embedding")
    e.write.parquet(path)
    d = readers.reference_blocks(spark.read.parquet(path), task=2, run="r1")
    return d.select("vec_id", "task", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("SELECT class_name, CASE WHEN n > 0 THEN CAST(n AS DOUBLE) / 2 END AS ap50 FROM class_groups UNION ALL SELECT 'unknown', 9.5")
def metrics_scan(spark, sf):
    path = _place(spark, "metrics")
    g = t.class_groups(t.image_counts(t.oracle(t.proposals(spark, sf))))
    row = g.agg(F.array_sort(F.collect_list(F.struct("class_name", "n"))).alias("c"))  # one row a class
    vector = F.concat(F.array(F.lit(0.0), F.lit(0.0)), F.transform("c", lambda s: s["n"] / 2), F.array_repeat(F.lit(0.0), F.lit(80) - F.size("c")), F.array(F.lit(9.5)))
    row.select(F.to_json(F.struct(vector.alias("coco_eval_bbox"))).alias("value")).coalesce(1).write.text(path)
    order = [r.class_name for r in g.select("class_name").orderBy("class_name").collect()]
    return readers.read_metrics(spark, path, order)


@query(_RUNS + "SELECT round(max(metric) / 7.0, 4) AS u, round(max(cost), 3) AS wi, CAST(NULL AS DOUBLE) AS missing FROM c WHERE arm = 'view'", base=False)
def log_scan(spark, sf):
    path = _place(spark, "log")
    top = runs(spark, sf).where("arm = 'view'").agg(F.round(F.max("metric") / 7, 4).cast("string").alias("u"), F.round(F.max("cost"), 3).cast("string").alias("wi"))
    text = F.concat(F.lit("U_Recall: np.float64(1.0)\nU_Recall: tensor("), F.col("u"), F.lit(")\nWI = "), F.col("wi"))
    top.select(text.alias("value")).coalesce(1).write.text(path)
    return readers.parse_log(spark, path, {"u": "U_Recall", "wi": "WI", "missing": "A_OSE"})


@query(_RUNS + "SELECT arm, CAST(row_number() OVER (PARTITION BY arm ORDER BY cost, metric) - 1 AS INT) AS place, cost AS x, CAST(metric AS BIGINT) AS y FROM c", base=False)
def curve_series(spark, sf):
    return writers.curve_series(runs(spark, sf), "arm", "cost", "metric")


@query("SELECT pos, CASE WHEN n > 0 THEN round(i / n, 6) ELSE 0 END AS strict, round(i / greatest(n, 1e-9), 6) AS guarded FROM (SELECT pos, greatest(least(x2, 0.7) - greatest(x1, 0.2), 0) * greatest(least(y2, 0.7) - greatest(y1, 0.2), 0) AS i, greatest(x2 - x1, 0) * greatest(y2 - y1, 0) + 0.25 - greatest(least(x2, 0.7) - greatest(x1, 0.2), 0) * greatest(least(y2, 0.7) - greatest(y1, 0.2), 0) AS n FROM scored) z")
def overlap_variants(spark, sf):
    p = t.proposals(spark, sf)
    a, b = boxes.corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("h")), tuple(map(F.lit, (0.2, 0.2, 0.7, 0.7)))
    return p.select("pos", F.round(boxes.iou(a, b, guard=None), 6).alias("strict"), F.round(boxes.iou(a, b), 6).alias("guarded"))
