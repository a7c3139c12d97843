"""Report rows: tasks, purchases, forgetting, replay, costs and overlaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from acquira.operators import audit, sampling
from acquira.plans.analytics import _RUNS, runs
from acquira.plans.core import LEDGER, by_admissibility, opened, r6
from acquira.plans.registry import query
from acquira.sources import tables as t


def _groups(spark, sf):
    return t.class_groups(t.image_counts(t.oracle(t.proposals(spark, sf))))


@query("SELECT g.grp, coalesce(string_agg(class_name, ';' ORDER BY class_name), '') AS members FROM (SELECT unnest(['head', 'medium', 'tail']) AS grp) g LEFT JOIN class_groups c ON c.grp = g.grp AND n % 2 = 0 GROUP BY g.grp")
def group_members(spark, sf):
    return audit.membership(_groups(spark, sf).where("n % 2 = 0"))


@query(_RUNS + ", b AS (SELECT task, metric FROM c WHERE arm = 'view'), a AS (SELECT task, metric FROM c WHERE arm = 'click' AND task % 4 > 0) SELECT coalesce(b.task, a.task) AS task, CAST(b.metric - a.metric AS BIGINT) AS forgetting FROM b FULL JOIN a ON a.task = b.task", base=False)
def forgetting(spark, sf):
    c = runs(spark, sf)
    return audit.forgetting(c.where("arm = 'view'"), c.where("arm = 'click' AND task % 4 > 0"), "task", "metric")


_AP = ", ap AS (SELECT k.task, class_name, round(40 + 30 * sin(n * (k.task + 1)), 6) AS ap FROM class_groups, (SELECT unnest(range(4)) AS task) k WHERE n % 5 > 0 OR k.task < 2) "


def _ap(spark, sf):
    tasks = spark.range(4).withColumnRenamed("id", "task")
    d = _groups(spark, sf).crossJoin(F.broadcast(tasks)).where("n % 5 > 0 OR task < 2")  # four tasks
    return d.select("task", "class_name", F.round(40 + 30 * F.sin(F.col("n") * (F.col("task") + 1)), 6).alias("ap"))


@query(_AP + ", s AS (SELECT task, 'C' || CAST(task * 4 AS VARCHAR) AS new_class, avg(ap) AS known, avg(CASE WHEN class_name < 'C2' THEN ap END) AS previous FROM ap GROUP BY task), g AS (SELECT task, " + ", ".join(f"round(avg(CASE WHEN grp = '{g}' THEN ap END), 3) AS map_{g}" for g in audit.GROUPS) + " FROM ap JOIN class_groups USING (class_name) GROUP BY task) SELECT s.task, new_class, round(known, 3) AS known, round(previous, 3) AS previous, round(ap.ap, 3) AS new_ap, map_head, map_medium, map_tail, round(lag(known) OVER (ORDER BY s.task) - previous, 3) AS forgetting, round(60 - known, 3) AS drop_from_anchor FROM s JOIN g ON g.task = s.task LEFT JOIN ap ON ap.task = s.task AND ap.class_name = s.new_class")
def task_rows(spark, sf):
    ap = _ap(spark, sf)
    s = ap.groupBy("task").agg(F.avg("ap").alias("known"), F.avg(F.when(F.col("class_name") < "C2", F.col("ap"))).alias("previous")).withColumn("new_class", F.concat(F.lit("C"), (F.col("task") * 4).cast("string")))
    d = audit.task_rows(ap, s, _groups(spark, sf), anchor=60.0)
    return d.select("task", "new_class", *[F.round(c, 3).alias(c) for c in ("known", "previous", "new_ap", "map_head", "map_medium", "map_tail", "forgetting", "drop_from_anchor")])


@query(LEDGER + ", h AS (SELECT c.* , grp FROM opened o JOIN image_counts c ON c.image_id = o.image_id JOIN class_groups g ON g.class_name = c.class_name), held AS (SELECT CAST(sum(n) AS BIGINT) AS b FROM image_counts WHERE class_name = 'C12' AND image_id % 50 = 0) SELECT (SELECT count(*) FROM opened) AS images_opened, round((SELECT count(*) FROM opened WHERE image_id NOT IN (SELECT image_id FROM image_counts)) / CAST((SELECT count(*) FROM opened) AS DOUBLE), 4) AS barren_share, count(DISTINCT CASE WHEN class_name NOT IN ('C0', 'C1') THEN class_name END) AS class_breadth, CAST(sum(n) AS BIGINT) AS objects_total, CAST(coalesce(sum(CASE WHEN class_name = 'C12' THEN n END), 0) AS BIGINT) AS new_objects, any_value(b) AS banked, CAST(coalesce(sum(CASE WHEN class_name = 'C12' THEN n END), 0) + any_value(b) AS BIGINT) AS held_at_declaration, CAST(coalesce(sum(CASE WHEN class_name IN ('C20', 'C25') THEN n END), 0) AS BIGINT) AS future_objects, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN grp = '{g}' THEN n END), 0) AS BIGINT) AS {g}_objects" for g in audit.GROUPS) + ", CAST(coalesce(sum(CASE WHEN class_name NOT IN ('C0', 'C1') THEN n END), 0) AS BIGINT) AS unknown_objects FROM h, held")
def purchase_row(spark, sf):
    counts = t.image_counts(t.oracle(t.proposals(spark, sf)))
    held = counts.where("image_id % 50 = 0").select("class_name", "n")
    return audit.purchase_row(opened(spark, sf), counts, _groups(spark, sf), held, known=["C0", "C1"], new="C12", future=["C20", "C25"])


_CORR = "SELECT '{0}' AS statistic, (CASE WHEN count(*) >= 3 THEN corr(rx, ry) END) AS value FROM (SELECT rank() OVER (ORDER BY {1}) + (count(*) OVER (PARTITION BY {1}) - 1) / 2.0 AS rx, rank() OVER (ORDER BY {2}) + (count(*) OVER (PARTITION BY {2}) - 1) / 2.0 AS ry FROM v WHERE {3}) z"


@query(_AP + ", v AS (SELECT x.class_name, grp, ln(n) AS f, CAST(x.ap AS DOUBLE) AS anchor, CAST(x.ap - y.ap AS DOUBLE) AS d, CASE WHEN x.ap >= 1 THEN (x.ap - y.ap) / x.ap END AS r FROM ap x JOIN ap y ON y.class_name = x.class_name AND y.task = 3 JOIN class_groups g ON g.class_name = x.class_name WHERE x.task = 0), u AS (SELECT 'classes' AS statistic, CAST(count(*) AS DOUBLE) AS value FROM v UNION ALL " + " UNION ALL ".join([_CORR.format("rho_frequency", "f", "d", "true"), _CORR.format("rho_anchor", "anchor", "d", "true"), _CORR.format("rho_relative", "f", "r", "r IS NOT NULL")]) + " UNION ALL SELECT 'r2_frequency', regr_r2(d, f) FROM v UNION ALL SELECT 'r2_anchor', regr_r2(d, anchor) FROM v UNION ALL SELECT 'r2_both', (pow(corr(d, f), 2) + pow(corr(d, anchor), 2) - 2 * corr(d, f) * corr(d, anchor) * corr(f, anchor)) / (1 - pow(corr(f, anchor), 2)) FROM v UNION ALL SELECT 'mean_' || grp, avg(d) FROM v GROUP BY grp) SELECT statistic, round(value, 5) AS value FROM u")
def vulnerability(spark, sf):
    ap = _ap(spark, sf)
    at = lambda k, n: ap.where(F.col("task") == k).select("class_name", F.col("ap").alias(n))
    d = _groups(spark, sf).join(at(0, "anchor"), "class_name").join(at(3, "final"), "class_name").select("class_name", F.xxhash64("class_name").alias("pos"), "grp", F.col("n").alias("frequency"), "anchor", "final")
    return audit.vulnerability(d).select("statistic", F.round("value", 5).alias("value"))


@query(_AP + ", b AS (SELECT class_name, ap FROM ap WHERE task = 1) SELECT 'run' || x.task AS run, x.class_name, x.ap AS final, round(x.ap / 2 + 10, 5) AS recall, round(a.ap - x.ap, 5) AS forgetting, CASE WHEN a.ap >= 1 THEN round((a.ap - x.ap) / a.ap, 5) END AS relative, CASE WHEN x.task <> 1 THEN round(x.ap - b.ap, 5) END AS gain FROM ap x JOIN ap a ON a.class_name = x.class_name AND a.task = 0 LEFT JOIN b ON b.class_name = x.class_name WHERE x.task > 0")
def table_per_class(spark, sf):
    ap = _ap(spark, sf).withColumn("run", F.concat(F.lit("run"), F.col("task").cast("string")))
    d = ap.where("task > 0").select("run", "class_name", F.col("ap").alias("final")).join(ap.where("task = 0").select("class_name", F.col("ap").alias("anchor")), "class_name")
    recall = ap.select("run", "class_name", (F.col("ap") / 2 + 10).alias("recall"))
    out = audit.per_class(d, recall, "run1")
    return out.select("run", "class_name", "final", *[F.round(c, 5).alias(c) for c in ("recall", "forgetting", "relative", "gain")])


@query(_AP + "SELECT coalesce(x.class_name, y.class_name) AS class_name, x.ap, y.ap AS recall, coalesce(abs(x.ap - y.ap) > 20, true) AS disagree FROM (SELECT * FROM ap WHERE task = 0) x FULL JOIN (SELECT * FROM ap WHERE task = 3) y ON y.class_name = x.class_name")
def recall_check(spark, sf):
    ap = _ap(spark, sf)
    return audit.recall_check(ap.where("task = 0").select("class_name", "ap"), ap.where("task = 3").select("class_name", F.col("ap").alias("recall")), apart=20.0)


@query(_AP + ", q AS (SELECT 'run' || task AS run, class_name, CAST(floor(ap) AS BIGINT) AS quota FROM ap), k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY quota DESC, class_name) AS rn FROM q) SELECT k.run, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN grp = '{g}' THEN quota END), 0) AS BIGINT) AS {g}_objects" for g in audit.GROUPS) + ", min(quota) AS quota_min, CAST(median(quota) AS DOUBLE) AS quota_median, max(quota) AS quota_max, string_agg(CASE WHEN rn <= 3 THEN k.class_name || ':' || quota END, ', ' ORDER BY rn) AS most_represented FROM k LEFT JOIN class_groups g ON g.class_name = k.class_name GROUP BY k.run")
def table_replay_composition(spark, sf):
    d = _ap(spark, sf).select(F.concat(F.lit("run"), F.col("task").cast("string")).alias("run"), "class_name", F.floor("ap").alias("quota"))
    return audit.replay_composition(d, _groups(spark, sf))


_BASIS = {"predict_per_1000": 3.967, "train_fixed": 2.053, "train_seconds": 0.9, "evaluate_fixed": 0.3, "evaluate_per_1000": 6.462, "crops_per_minute": 6000.0}


@query("SELECT c_custkey, round(c_custkey / 1000.0 * 3.967, 6) AS predict, round(2.053 + (c_custkey // 2) * 5 * 0.9 / 60, 6) AS train, round(0.3 + 2 * (c_nationkey / 1000.0 * 6.462), 6) AS evaluate, round(c_custkey / 6000.0, 6) AS embed, CAST((c_custkey // 2) * 5 AS DOUBLE) AS iterations, round(c_custkey / 1000.0 * 3.967 + 2.053 + (c_custkey // 2) * 5 * 0.9 / 60 + 0.3 + 2 * (c_nationkey / 1000.0 * 6.462) + c_custkey / 6000.0, 6) AS total FROM customer", base=False)
def cost_minutes(spark, sf):
    c, k, n = t.read(spark, sf, "customer"), F.col("c_custkey").cast("double"), F.col("c_nationkey").cast("double")
    m = audit.minutes(candidates=k, train=k, evaluated=n, crops=k, epochs=5, batch=2, basis=_BASIS)
    return c.select("c_custkey", *[r6(v, name) for name, v in m.items()])


@query(", r AS (SELECT pos, image_id, row_number() OVER (ORDER BY round(a, 9) DESC, pos) AS ra, row_number() OVER (ORDER BY round(u, 9) DESC, pos) AS ru FROM scored), m AS (SELECT CAST(unnest([50, 200, 600]) AS INT) AS mark), d AS (SELECT mark, image_id, ra <= mark AS x, ru <= mark AS y FROM r, m WHERE ra <= mark OR ru <= mark), i AS (SELECT mark, image_id, bool_or(x) AS x, bool_or(y) AS y FROM d GROUP BY 1, 2), k AS (SELECT mark, count(CASE WHEN x AND y THEN 1 END) AS images_both, round(count(CASE WHEN x AND y THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS images_jaccard FROM i GROUP BY mark) SELECT d.mark, count(CASE WHEN x AND y THEN 1 END) AS both, count(CASE WHEN y AND NOT x THEN 1 END) AS entering, count(CASE WHEN x AND NOT y THEN 1 END) AS leaving, round(count(CASE WHEN x AND y THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS jaccard, any_value(images_both) AS images_both, any_value(images_jaccard) AS images_jaccard FROM d JOIN k ON k.mark = d.mark GROUP BY d.mark")
def prefix_overlap(spark, sf):
    d = by_admissibility(spark, sf).withColumn("u", F.round("u", 9))
    return audit.prefix_overlap(d, "a", "u", [50, 200, 600]).withColumns({"jaccard": F.round("jaccard", 6), "images_jaccard": F.round("images_jaccard", 6)})


@query(_RUNS + ", s AS (SELECT * FROM c WHERE NOT (arm = 'click' AND task % 3 = 0)), d AS (SELECT arm, count(*) AS tasks, arg_max(cost, task) AS oracle_cost, max(task) AS last_task FROM s GROUP BY arm) SELECT arm, tasks, oracle_cost, last_task, tasks - min(tasks) OVER () AS dropped FROM d", base=False)
def depth_report(spark, sf):
    return audit.depth(runs(spark, sf).where("NOT (arm = 'click' AND task % 3 = 0)"), "arm", "task", "cost")


@query(_RUNS + "SELECT arm, round(avg(CASE WHEN task % 7 IN (3, 4) THEN users / CAST(greatest(task % 5, 1) AS DOUBLE) END), 5) AS tail_per_image, round(avg(users), 5) AS mean_held FROM c GROUP BY arm", base=False)
def tail_per_image(spark, sf):
    d = runs(spark, sf).select("arm", (F.col("task") % 7).alias("task"), "users", (F.col("task") % 5).alias("images"))
    return audit.held_per_image(d, "arm", "users", "images", [3, 4]).withColumns({"tail_per_image": F.round("tail_per_image", 5), "mean_held": F.round("mean_held", 5)})


@query(", a AS (SELECT vec_id, count(*) AS n FROM proposals GROUP BY vec_id) SELECT 'x' AS arm, vec_id AS seed, n AS first_at_2, n % 7 AS second_at_2, n % 3 AS second_at_3, n + n % 7 + n % 3 AS bought_early FROM a")
def early_purchases(spark, sf):
    n = t.proposals(spark, sf).groupBy("vec_id").agg(F.count("*").alias("n"))
    task = F.explode(F.array(*[F.struct(F.lit(k).alias("task"), b.cast("long").alias("banked"), f.cast("long").alias("future")) for k, b, f in [
        (2, F.lit(0), F.col("n") + F.col("n") % 7), (3, F.col("n"), F.col("n") % 3), (4, F.col("n") % 7 + F.col("n") % 3, F.lit(0))]]))
    return audit.early_purchases(n.select(F.lit("x").alias("arm"), F.col("vec_id").alias("seed"), task.alias("r")).select("arm", "seed", "r.*"))


@query("SELECT image_id, min(pos) AS pos, CASE WHEN bool_or(l_linestatus = 'F') THEN 'F' ELSE 'O' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END, pos) AS rn FROM proposals) z WHERE rn = 1 GROUP BY image_id")
def union_first_seen(spark, sf):
    p = t.proposals(spark, sf)
    part = lambda s: p.where(F.col("l_linestatus") == s).select("image_id", "pos", F.lit(s).alias("part"))
    return audit.first_seen([part("F"), part("O")], "image_id")


@query(", w AS (SELECT class_name, n, row_number() OVER (ORDER BY n DESC, class_name) - 1 AS rank, count(*) OVER () AS c FROM class_groups), x AS (SELECT rho, n / pow(rho, -CAST(rank AS DOUBLE) / (c - 1)) AS q, pow(rho, -CAST(rank AS DOUBLE) / (c - 1)) AS w FROM w, (SELECT CAST(unnest([10, 50, 100]) AS DOUBLE) AS rho) r), f AS (SELECT rho, floor(min(q) * sum(w)) AS total FROM x GROUP BY rho) SELECT rho, CAST(total AS BIGINT) AS feasible, CAST(min(total) OVER () AS BIGINT) AS matched FROM f")
def matched_total(spark, sf):
    return sampling.matched_total(_groups(spark, sf), [10.0, 50.0, 100.0])


@query(", a AS (SELECT class_name, class_pos, CASE WHEN class_pos < 8 THEN 'known' WHEN class_pos < 10 THEN 'declared' ELSE 'unknown' END AS state FROM classes) SELECT a.class_name, state, coalesce(state = 'unknown' AND grp = 'tail', false) AS tail_band FROM a LEFT JOIN class_groups g ON g.class_name = a.class_name")
def class_states(spark, sf):
    p = t.proposals(spark, sf)
    return sampling.class_states(t.classes(p), _groups(spark, sf), known=8, declared=2)
