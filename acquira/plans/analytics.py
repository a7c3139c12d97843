"""Statistics, curves, labelling and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acquira.functions import boxes, numbers, ranking, vec
from acquira.operators import curves, labels, match, stats
from acquira.plans.core import by_admissibility, opened, r6, scored
from acquira.plans.registry import query
from acquira.sources import tables as t


def corners(d: DataFrame) -> DataFrame:
    return d.withColumn("box", F.struct(*[c.alias(n) for c, n in zip(boxes.corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("h")), ("x1", "y1", "x2", "y2"))]))


def with_oracle(spark, sf) -> DataFrame:
    return by_admissibility(spark, sf).join(t.oracle(t.proposals(spark, sf)).drop("image_id"), "pos")


# ---- aggregates


@query("SELECT count(*) AS rows, count(DISTINCT image_id) AS images, count(CASE WHEN kind='known' THEN 1 END) AS known, count(CASE WHEN kind='unknown' THEN 1 END) AS unknown, count(CASE WHEN kind='background' THEN 1 END) AS background FROM oracle")
def describe(spark, sf):
    k = lambda x: F.count(F.when(F.col("kind") == x, 1)).alias(x)
    return t.oracle(t.proposals(spark, sf)).agg(F.count("*").alias("rows"), F.countDistinct("image_id").alias("images"), k("known"), k("unknown"), k("background"))


@query(""", c AS (SELECT p.vec_id % 40 AS cluster, kind FROM proposals p JOIN oracle o ON p.pos = o.pos), per AS (SELECT cluster, count(*) AS n, count(CASE WHEN kind='known' THEN 1 END) AS k, count(CASE WHEN kind='unknown' THEN 1 END) AS u FROM c GROUP BY cluster)
, w AS (SELECT *, CAST(k AS DOUBLE)/n > CAST(sum(k) OVER () AS DOUBLE)/sum(n) OVER () AS owned FROM per)
 SELECT count(*) AS clusters, count(CASE WHEN owned THEN 1 END) AS known_clusters, round(CAST(sum(CASE WHEN owned THEN u END) AS DOUBLE)/sum(CASE WHEN owned THEN n END), 6) AS contamination, round(CAST(sum(CASE WHEN NOT owned THEN u END) AS DOUBLE)/sum(u), 6) AS unknown_recall FROM w""")
def contamination(spark, sf):
    d = with_oracle(spark, sf)
    return stats.contamination(d.select((F.col("vec_id") % 40).alias("cluster"), (F.col("kind") == "known").alias("known"), (F.col("kind") == "unknown").alias("unknown")))


@query(""", r AS (SELECT kind, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0) AS rk FROM (SELECT kind, round(a, 9) AS s FROM scored JOIN oracle o USING (pos) WHERE kind <> 'known') x)
 SELECT round(CAST((sum(CASE WHEN kind='unknown' THEN rk END) - count(CASE WHEN kind='unknown' THEN 1 END) * (count(CASE WHEN kind='unknown' THEN 1 END) + 1) / 2.0) AS DOUBLE) / (count(CASE WHEN kind='unknown' THEN 1 END) * count(CASE WHEN kind<>'unknown' THEN 1 END)), 6) AS auc, count(CASE WHEN kind='unknown' THEN 1 END) AS p, count(CASE WHEN kind<>'unknown' THEN 1 END) AS n FROM r""")
def roc_auc(spark, sf):
    d = with_oracle(spark, sf).where("kind <> 'known'")
    return stats.roc_auc(d, "a", F.col("kind") == "unknown").withColumn("auc", F.round("auc", 6))


_LABELS = "(SELECT l.doc_id, quality, toxic, n_chars, lang, source FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def labelled_docs(spark, sf) -> DataFrame:
    return t.read(spark, sf, "labels").join(t.read(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")


@query(f"SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rx, rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0 AS ry FROM {_LABELS} x WHERE quality IS NOT NULL AND n_chars IS NOT NULL) z", base=False)
def spearman_average(spark, sf):
    return stats.spearman(labelled_docs(spark, sf).where("quality IS NOT NULL AND n_chars IS NOT NULL"), "n_chars", "quality").withColumn("rho", F.round("rho", 6))


@query("SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY round(a, 9), pos) AS rx, row_number() OVER (ORDER BY round(u, 9), pos) AS ry FROM scored) z")
def spearman_ordinal(spark, sf):
    return stats.spearman(scored(spark, sf).withColumns({"a": F.round("a", 9), "u": F.round("u", 9)}), "a", "u", ties="ordinal").withColumn("rho", F.round("rho", 6))


@query("SELECT round(regr_intercept(a, u), 6) AS intercept, round(regr_slope(a, u), 6) AS slope1, round(regr_r2(a, u), 6) AS r2 FROM scored")
def ols_r2(spark, sf):
    d = stats.least_squares(scored(spark, sf), "a", "u")
    return d.select(*[F.round(c, 6).alias(c) for c in d.columns])


@query("""SELECT round(s1, 5) AS slope1, round(s2, 5) AS slope2, round((s1*d + s2*e)/v, 6) AS r2 FROM (SELECT (d*c - e*b)/(a*c - b*b) AS s1, (e*a - d*b)/(a*c - b*b) AS s2, d, e, v FROM
 (SELECT var_pop(objectness) AS a, covar_pop(objectness, w) AS b, var_pop(w) AS c, covar_pop(objectness, y) AS d, covar_pop(w, y) AS e, var_pop(y) AS v FROM (SELECT *, a AS y FROM scored) q) z) s""")
def ols_two(spark, sf):
    return stats.least_squares(scored(spark, sf), "a", "objectness", "w").select(F.round("slope1", 5).alias("slope1"), F.round("slope2", 5).alias("slope2"), r6(F.col("r2"), "r2"))


@query(f""", x AS (SELECT lang AS l, source AS c, count(*) AS n FROM {_LABELS} q GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY l) AS a, sum(n) OVER (PARTITION BY c) AS b, sum(n) OVER () AS t FROM x)
, la AS (SELECT l, max(a) AS a, max(t) AS t FROM w GROUP BY l), lb AS (SELECT c, max(b) AS b, max(t) AS t, max(n) AS m FROM w GROUP BY c)
, s AS (SELECT (SELECT sum(n/t*ln(n*t/(a*b))) FROM (SELECT CAST(n AS DOUBLE) AS n, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(t AS DOUBLE) AS t FROM w) y) AS mi, (SELECT -sum(CAST(a AS DOUBLE)/t*ln(CAST(a AS DOUBLE)/t)) FROM la) AS ha, (SELECT -sum(CAST(b AS DOUBLE)/t*ln(CAST(b AS DOUBLE)/t)) FROM lb) AS hb,
 (SELECT sum(n*(n-1)/2.0) FROM w) AS sn, (SELECT sum(a*(a-1)/2.0) FROM la) AS sa, (SELECT sum(b*(b-1)/2.0) FROM lb) AS sb, (SELECT max(t*(t-1)/2.0) FROM w) AS st, (SELECT CAST(sum(m) AS DOUBLE)/max(t) FROM lb) AS purity)
 SELECT round(mi/((ha+hb)/2), 6) AS nmi, round(CAST((sn - sa*sb/st)/((sa+sb)/2 - sa*sb/st) AS DOUBLE), 6) AS ari, round(purity, 6) AS purity FROM s""")
def cluster_quality(spark, sf):
    return stats.cluster_quality(labelled_docs(spark, sf), "lang", "source")


@query("""WITH d AS (SELECT label, unnest(range(1, 65)) AS i, embedding FROM embeddings), x AS (SELECT label, i, CAST(embedding[i] AS DOUBLE) AS v FROM d)
, per AS (SELECT label, i, count(*) AS n, sum(v) AS s, sum(v*v) AS q FROM x GROUP BY 1, 2 HAVING count(*) >= 2), k AS (SELECT i, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s*s/n) AS g FROM per GROUP BY i) SELECT round(sum(g - s*s/n)/sum(q - s*s/n), 6) AS eta2 FROM k""", base=False)
def eta_squared(spark, sf):
    return stats.eta_squared(t.read(spark, sf, "embeddings"), "label", "embedding").withColumn("eta2", F.round("eta2", 6))


@query("""WITH d AS (SELECT label, unnest(range(1, 65)) AS i, embedding FROM embeddings), per AS (SELECT label, i, count(*) AS n, sum(CAST(embedding[i] AS DOUBLE)) AS s, sum(CAST(embedding[i] AS DOUBLE)*embedding[i]) AS q FROM d GROUP BY 1, 2)
 SELECT label, max(n) AS n, round((sum(s*s) - sum(q))/(max(n)*(max(n)-1)), 6) AS similarity FROM per GROUP BY label""", base=False)
def batch_similarity(spark, sf):
    return stats.batch_similarity(t.read(spark, sf, "embeddings"), "label", "embedding").withColumn("similarity", F.round("similarity", 6))


@query(" ".join(["SELECT stratum, count(*) AS n, round(quantile_cont(a, 0.25), 6) AS q25, round(quantile_cont(a, 0.5), 6) AS q50, round(quantile_cont(a, 0.75), 6) AS q75 FROM (SELECT unnest(list_filter([CASE WHEN kind='known' THEN 'known' END, CASE WHEN kind='unknown' THEN 'unknown' END, CASE WHEN kind<>'background' THEN 'object' END, 'all'], lambda x: x IS NOT NULL)) AS stratum, round(a, 9) AS a FROM scored JOIN oracle o USING (pos)) z GROUP BY stratum"]))
def strata_quartiles(spark, sf):
    k = F.col("kind")
    return stats.strata(with_oracle(spark, sf), {"known": k == "known", "unknown": k == "unknown", "object": k != "background", "all": F.lit(True)}, "a")


@query(", r AS (SELECT o.*, row_number() OVER (ORDER BY round(a, 9) DESC, pos) AS rn, count(*) OVER () AS n FROM scored JOIN oracle o USING (pos)), f AS (SELECT unnest([0.01, 0.05, 0.1, 0.3]) AS fraction) SELECT CAST(fraction AS DOUBLE) AS fraction, count(*) AS rows, count(CASE WHEN kind='unknown' THEN 1 END) AS unknown_proposals, count(DISTINCT CASE WHEN kind='unknown' THEN object_id END) AS unknown_objects FROM r JOIN f ON rn <= greatest(round_even(n*CAST(fraction AS DOUBLE), 0), 1) GROUP BY fraction")
def topfraction_table(spark, sf):
    return stats.top_fractions(with_oracle(spark, sf), "a", [0.01, 0.05, 0.1, 0.3])


@query("SELECT coalesce(grp, 'all') AS grp, round(avg(n), 6) AS mean, count(n) AS n FROM class_groups GROUP BY GROUPING SETS ((grp), ())")
def grouped_map(spark, sf):
    g = t.class_groups(t.image_counts(t.oracle(t.proposals(spark, sf)))).withColumnRenamed("n", "v")
    return stats.grouped_mean(g, "grp", "v").withColumn("mean", F.round("mean", 6))


# ---- windows and curves


@query(", v AS (SELECT pos, round(a, 9) AS a FROM scored) SELECT pos, round(CAST((rank() OVER (ORDER BY a) - 1 + (count(*) OVER (PARTITION BY a) - 1) / 2.0) AS DOUBLE) / (count(*) OVER () - 1), 6) AS r FROM v")
def rank_normalise(spark, sf):
    return ranking.rank_normalised(by_admissibility(spark, sf), "a", "r").select("pos", r6(F.col("r"), "r"))


_RUNS = """WITH runs AS (SELECT event_type AS arm, CAST(epoch(date_trunc('day', ts)) / 86400 AS BIGINT) AS task, round(sum(value), 6) AS asked, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2)
, c AS (SELECT *, round(sum(asked) OVER (PARTITION BY arm ORDER BY task), 4) AS cost, sum(users) OVER (PARTITION BY arm ORDER BY task) AS metric FROM runs) """


def runs(spark, sf) -> DataFrame:
    """arm, task (day), asked, users, running cost and metric."""
    e = t.read(spark, sf, "events")
    d = e.groupBy(F.col("event_type").alias("arm"), F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long").alias("task")).agg(F.round(F.sum("value"), 6).alias("asked"), F.countDistinct("user_id").alias("users"))
    d = curves.cumulative_cost(curves.cumulative_cost(d, "arm", "task", "asked"), "arm", "task", "users", "metric")
    return d.withColumn("cost", F.round("cost", 4))


@query(_RUNS + "SELECT arm, task, cost, CAST(metric AS BIGINT) AS metric FROM c", base=False)
def cumulative_cost(spark, sf):
    return runs(spark, sf).select("arm", "task", "cost", "metric")


@query(_RUNS + "SELECT arm, task, round(cost + (task % 3 = 0)::INT * 0.5 - cost, 4) AS drift FROM c WHERE task % 3 = 0", base=False)
def cost_discrepancy(spark, sf):
    d = runs(spark, sf).withColumn("recorded", F.col("cost") + F.when(F.col("task") % 3 == 0, 0.5).otherwise(0.0))
    return curves.cost_discrepancy(d, "arm", "recorded", "cost").select("arm", "task", F.round("drift", 4).alias("drift"))


@query(_RUNS + """, l AS (SELECT *, lag(cost) OVER w AS pc, lag(metric) OVER w AS pm FROM c WINDOW w AS (PARTITION BY arm ORDER BY cost)), f AS (SELECT arm, cost, CASE WHEN pm IS NULL OR metric = pm THEN cost ELSE pc + (cost - pc) * (100 - pm) / (metric - pm) END AS pt FROM l WHERE metric >= 100)
 SELECT arm, round(arg_min(pt, cost), 4) AS cost_to_reach FROM f GROUP BY arm UNION ALL SELECT arm, NULL FROM (SELECT DISTINCT arm FROM c) z WHERE arm NOT IN (SELECT arm FROM f)""", base=False)
def cost_to_reach(spark, sf):
    return curves.cost_to_reach(runs(spark, sf), "arm", "cost", "metric", F.lit(100)).withColumn("cost_to_reach", F.round("cost_to_reach", 4))


@query(_RUNS + ", k AS (SELECT min(n) AS d FROM (SELECT count(*) AS n FROM c GROUP BY arm) z) SELECT arm, task FROM (SELECT arm, task, row_number() OVER (PARTITION BY arm ORDER BY task) AS rn FROM c) y, k WHERE rn <= d", base=False)
def truncated_comparison(spark, sf):
    return curves.truncated(runs(spark, sf), "arm", "task").select("arm", "task")


@query(_RUNS + ", l AS (SELECT *, lag(cost) OVER w AS pc, lag(metric) OVER w AS pm FROM c WINDOW w AS (PARTITION BY arm ORDER BY cost)) SELECT arm, round(sum((cost - pc) * (metric + pm) / 2) / (max(cost) - min(cost)), 4) AS area FROM l GROUP BY arm", base=False)
def aulc(spark, sf):
    return stats.area_under_curve(runs(spark, sf), "arm", "cost", "metric").withColumn("area", F.round("area", 4))


@query(_RUNS + ", b AS (SELECT task, users AS b FROM c WHERE arm = (SELECT min(arm) FROM c)) SELECT arm, count(*) AS seeds, round(avg(users - b), 6) AS delta, round(stddev_samp(users - b), 6) AS sd, count(CASE WHEN users > b THEN 1 END) AS improving FROM c JOIN b USING (task) WHERE arm <> (SELECT min(arm) FROM c) GROUP BY arm", base=False)
def paired_contrast(spark, sf):
    d = runs(spark, sf)
    base = d.agg(F.min("arm")).first()[0]
    return stats.paired_contrast(d, "arm", base, "task", "users").withColumns({"delta": F.round("delta", 6), "sd": F.round("sd", 6)})


@query(""", picks AS (SELECT CAST((row_number() OVER (ORDER BY round(a, 9) DESC, pos) - 1) / 100 AS INT) AS round, object_id, pos FROM scored JOIN oracle o USING (pos) QUALIFY row_number() OVER (ORDER BY round(a, 9) DESC, pos) <= 600)
 SELECT CAST(r AS INT) AS round, (SELECT count(DISTINCT object_id) FROM (SELECT object_id, (row_number() OVER (ORDER BY round(a, 9) DESC, pos) - 1) // 100 AS rd FROM scored JOIN oracle o USING (pos) QUALIFY row_number() OVER (ORDER BY round(a, 9) DESC, pos) <= 600) p WHERE object_id >= 0 AND rd <= r) AS objects FROM (SELECT unnest(range(6)) AS r) z""")
def cumulative_discovery(spark, sf):
    top = with_oracle(spark, sf).orderBy(F.desc("a"), "pos").limit(600)
    picks = top.withColumn("round", F.floor((F.row_number().over(Window.orderBy(F.desc("a"), "pos")) - 1) / 100).cast("int"))
    return curves.cumulative_discovery(picks, 6)


@query("SELECT class_name, n, row_number() OVER (ORDER BY n DESC, class_name) - 1 AS rank, grp FROM class_groups")
def rank_thirds(spark, sf):
    g = t.class_groups(t.image_counts(t.oracle(t.proposals(spark, sf))))
    return g.select("class_name", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "class_name")) - 1).alias("rank"), "grp")


# ---- labelling and matching

_PICKS = ", picks AS (SELECT pos FROM scored ORDER BY round(a, 9) DESC, pos LIMIT 600), onimg AS (SELECT o.*, pk.pos IS NOT NULL AS chosen, coalesce(o.class_pos < 8 AND o.kind <> 'background', false) AS is_known FROM oracle o LEFT JOIN picks pk ON pk.pos = o.pos WHERE image_id IN (SELECT image_id FROM oracle JOIN picks USING (pos)))"
_ROLE = {
    "box_only": "CASE WHEN chosen AND kind <> 'background' THEN 'labelled' ELSE 'background' END",
    "full_image": "CASE WHEN kind <> 'background' THEN 'labelled' ELSE 'background' END",
    "known_plus_selected": "CASE WHEN kind <> 'background' AND (is_known OR chosen) THEN 'labelled' WHEN kind <> 'background' THEN 'ignored' ELSE 'background' END",
}


def _region(policy: str):
    cost = "count(CASE WHEN chosen THEN 1 END)" if policy != "full_image" else "count(DISTINCT CASE WHEN object_id >= 0 THEN object_id END) + count(CASE WHEN chosen AND kind = 'background' THEN 1 END)"
    sql = _PICKS + f", r AS (SELECT *, {_ROLE[policy]} AS role FROM onimg) SELECT {cost} AS cost, count(CASE WHEN role='labelled' THEN 1 END) AS labelled, count(CASE WHEN role='background' THEN 1 END) AS background, count(CASE WHEN role='ignored' THEN 1 END) AS ignored, round(coalesce(CAST(count(CASE WHEN role='background' AND kind<>'background' THEN 1 END) AS DOUBLE)/nullif(count(CASE WHEN role='background' THEN 1 END), 0), 0), 6) AS half_labelled FROM r"

    def plan(spark, sf):
        o = t.oracle(t.proposals(spark, sf))
        picks = by_admissibility(spark, sf).orderBy(F.desc("a"), "pos").limit(600).select("pos")
        known = t.classes(t.proposals(spark, sf)).where("class_pos < 8")
        return labels.annotation_cost(labels.annotate(o, picks, policy=policy, known=known), policy).withColumn("half_labelled", F.round("half_labelled", 6))

    plan.__name__ = f"region_{policy}"
    query(sql)(plan)


for _p in labels.REGION_POLICIES:
    _region(_p)

_TRUTH = """, tr AS (SELECT s.image_id, s.pos, x1, y1, x2, y2, o.class_name, o.class_pos FROM scored s JOIN oracle o USING (pos) WHERE l_linestatus = 'F' AND o.object_id >= 0)
, dt AS (SELECT image_id, pos, x1, y1, x2, y2, objectness AS score, class_id FROM scored WHERE l_linestatus = 'O')
, pairs AS (SELECT tr.pos AS tp, dt.pos AS dp, dt.score, tr.image_id, greatest(least(tr.x2, dt.x2)-greatest(tr.x1, dt.x1), 0)*greatest(least(tr.y2, dt.y2)-greatest(tr.y1, dt.y1), 0) AS i, (tr.x2-tr.x1)*(tr.y2-tr.y1)+(dt.x2-dt.x1)*(dt.y2-dt.y1) AS s FROM tr JOIN dt ON tr.image_id = dt.image_id)
, hits AS (SELECT DISTINCT tp FROM pairs WHERE i / greatest(s - i, 1e-9) >= 0.5) """
_OBJECT_ROLE = {
    "selected_box_only": ("CASE WHEN m AND d THEN 'supervised' WHEN m THEN 'banked' ELSE 'ignored' END", "NOT m"),
    "full_image": ("CASE WHEN d THEN 'supervised' ELSE 'banked' END", "NOT m"),
    "known_plus_selected_ignore_rest": ("CASE WHEN k OR (m AND d) THEN 'supervised' WHEN m THEN 'banked' ELSE 'ignored' END", "k OR NOT m"),
}


def truths_and_detections(spark, sf) -> tuple[DataFrame, DataFrame]:
    p = corners(t.proposals(spark, sf))
    truth = p.where("l_linestatus = 'F'").select("pos", "image_id", "box").join(t.oracle(t.proposals(spark, sf)).drop("image_id"), "pos").where("object_id >= 0")
    return truth, p.where("l_linestatus = 'O'").select("pos", "image_id", "box", F.col("objectness").alias("score"), "class_id")


def _objects(policy: str):
    role, free = _OBJECT_ROLE[policy]
    sql = _TRUTH + f"SELECT pos, {role} AS role, {free} AS free FROM (SELECT tr.pos, hits.tp IS NOT NULL AS m, class_pos < 11 AS d, class_pos < 8 AS k FROM tr LEFT JOIN hits ON hits.tp = tr.pos) z"

    def plan(spark, sf):
        truth, found = truths_and_detections(spark, sf)
        return labels.roles(labels.matched(truth, found), policy=policy, known=F.col("class_pos") < 8, declared=F.col("class_pos") < 11).select("pos", "role", "free")

    plan.__name__ = f"objects_{policy}"
    query(sql)(plan)


for _p in labels.OBJECT_POLICIES:
    _objects(_p)


@query(_TRUTH + "SELECT pos, CASE WHEN class_pos < 10 AND class_pos >= 8 THEN class_name END AS train, CASE WHEN class_pos < 10 THEN class_name ELSE 'unknown' END AS test, CASE WHEN class_pos < 10 THEN class_name END AS ft FROM tr")
def target_filter(spark, sf):
    d, _ = truths_and_detections(spark, sf)
    for m in ("train", "test", "ft"):
        d = labels.training_target(d, marker=m, position=F.col("class_pos"), previous=8, current=2).withColumnRenamed("target", m)
    return d.select("pos", "train", "test", "ft")


@query(_TRUTH + "SELECT pos FROM tr WHERE pos NOT IN (SELECT tp FROM hits)")
def false_background(spark, sf):
    truth, found = truths_and_detections(spark, sf)
    return labels.false_background(truth, found).select("pos")


_MATCH = """, ds AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, pos) AS r FROM dt WHERE image_id IN (SELECT image_id FROM tr)), tl AS (SELECT image_id, list(struct_pack(pos := pos, x1 := x1, y1 := y1, x2 := x2, y2 := y2)) AS ts FROM tr GROUP BY image_id)
, walk AS (SELECT image_id, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS c FROM tl UNION ALL SELECT q.image_id, q.r, CASE WHEN q.best.v >= 0.5 THEN list_append(q.c, q.best.p) ELSE q.c END FROM (SELECT w.image_id, d.r, w.c, list_reduce(list_transform(list_filter(ts, lambda x: NOT list_contains(w.c, x.pos)), lambda x: struct_pack(v := greatest(least(x.x2, d.x2)-greatest(x.x1, d.x1), 0)*greatest(least(x.y2, d.y2)-greatest(x.y1, d.y1), 0) / greatest((x.x2-x.x1)*(x.y2-x.y1)+(d.x2-d.x1)*(d.y2-d.y1)-greatest(least(x.x2, d.x2)-greatest(x.x1, d.x1), 0)*greatest(least(x.y2, d.y2)-greatest(x.y1, d.y1), 0), 1e-9), p := x.pos)), lambda a, b: CASE WHEN a.v > b.v OR (a.v = b.v AND a.p < b.p) THEN a ELSE b END, struct_pack(v := CAST(-1 AS DOUBLE), p := CAST(-1 AS BIGINT))) AS best
 FROM walk w JOIN tl ON tl.image_id = w.image_id JOIN ds d ON d.image_id = w.image_id AND d.r = w.r + 1) q)
, won AS (SELECT DISTINCT unnest(c) AS pos FROM walk) """


@query((t.BASE + _TRUTH + _MATCH + "SELECT coalesce(grp, 'all') AS grp, count(*) AS truths, count(w.pos) AS recalled, round(CAST(count(w.pos) AS DOUBLE)/count(*), 6) AS recall FROM tr JOIN class_groups g ON g.class_name = tr.class_name LEFT JOIN won w ON w.pos = tr.pos GROUP BY GROUPING SETS ((grp), ())").replace("WITH ", "WITH RECURSIVE ", 1), base=False)
def recall_by_group(spark, sf):
    truth, found = truths_and_detections(spark, sf)
    groups = t.class_groups(t.image_counts(t.oracle(t.proposals(spark, sf))))
    m = match.greedy(found, truth.select("pos", "image_id", "box"), ["image_id"])
    named = m.join(truth.select("pos", "class_name"), "pos").join(F.broadcast(groups.select("class_name", "grp")), "class_name")
    return match.recall(named, "grp")


@query(", e AS (SELECT vec_id, embedding, label FROM embeddings) SELECT c.vec_id, round(1 - max(list_dot_product(list_transform(c.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(r.embedding, lambda x: CAST(x AS DOUBLE)))), 5) AS novelty FROM e c, e r WHERE c.label >= 3 AND r.label < 3 GROUP BY c.vec_id")
def max_cosine_novelty(spark, sf):
    from acquira.operators import neighbours

    e = t.read(spark, sf, "embeddings")
    d = neighbours.nearest(e.where("label >= 3"), e.where("label < 3"), k=1)
    return d.select("vec_id", F.round(1 - F.col("near")[0], 5).alias("novelty"))


@query(", e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT vec_id, round(1 - s, 5) AS distance FROM (SELECT a.vec_id, list_dot_product(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC) AS rn FROM e a, e b) z WHERE rn = 6")
def kth_distance(spark, sf):
    from acquira.operators import neighbours

    e = t.read(spark, sf, "embeddings")
    return neighbours.nearest(e, e, k=6).select("vec_id", F.round(1 - F.col("near")[5], 5).alias("distance"))
