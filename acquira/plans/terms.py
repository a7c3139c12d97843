"""Terms of research scores, partitions held against known content, ceilings."""

from __future__ import annotations

from pyspark.sql import functions as F

from acquira.functions import ranking, vec
from acquira.operators import audit, ceiling, gates, terms
from acquira.plans.core import nms_sql, r6, scored
from acquira.plans.registry import query
from acquira.sources import tables as t

_U = "WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings) "


def unit(spark, sf):
    return t.read(spark, sf, "embeddings").select("vec_id", "label", vec.unit(F.col("embedding")).alias("embedding"))


@query("SELECT pos, round(u + 0.5 * 0 + 2 * objectness * w, 6) AS s_none, round(u + 0.5 * cx + 2 * objectness * w, 6) AS s_labelled, round(u + 0.5 * cy + 2 * objectness * w, 6) AS s_batch, round(u + 0.25 * (cx + cy) + 2 * objectness * w, 6) AS s_combined FROM scored")
def research_scores(spark, sf):
    d = scored(spark, sf).withColumns({"d_labelled": F.col("cx"), "d_batch": F.col("cy"), "r": F.col("objectness"), "g": F.col("w")})
    return d.select("pos", *[r6(terms.research_score(m, diversity=0.5, rarity=2.0), f"s_{m}") for m in terms.DIVERSITY])


@query(_U + ", x AS (SELECT b.vec_id, b.label, list_dot_product(b.v, c.v) AS sa, list_dot_product(b.v, d.v) AS sb FROM u b JOIN u c ON c.vec_id = b.vec_id + 1 JOIN u d ON d.vec_id = b.vec_id + 2) SELECT vec_id, round(sa, 6) AS sim_a, round(sb, 6) AS sim_b, round(least(sa, sb), 6) AS consistency, round((sa + sb) / 2, 6) AS consistency_mean, round(label * least(sa, sb), 6) AS score FROM x", base=False)
def view_consistency(spark, sf):
    u = unit(spark, sf)
    shifted = lambda k, n: u.select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias(n))
    d = u.join(shifted(1, "a"), "vec_id").join(shifted(2, "b"), "vec_id")
    c = terms.consistency(F.col("embedding"), F.col("a"), F.col("b"))
    return d.select("vec_id", *[r6(v, k) for k, v in c.items()], r6(F.col("label") * c["consistency"], "score"))


@query("SELECT DISTINCT image_id, dense_rank() OVER (ORDER BY image_id) - 1 AS place FROM proposals")
def image_index(spark, sf):
    images = t.proposals(spark, sf).select("image_id").distinct()
    return ranking.row_numbers(images, ["image_id"], "rn").select("image_id", (F.col("rn") - 1).alias("place"))


@query("SELECT c_custkey, round(c_acctbal * 2, 4) AS wi, CAST(c_nationkey AS DOUBLE) AS aose FROM customer", base=False)
def nested_lookup(spark, sf):
    one = lambda k, v: F.create_map(F.lit(k), v)
    d = t.read(spark, sf, "customer").withColumns({"m": one("0.8", one("50", F.col("c_acctbal") * 2)), "o": one("50", F.col("c_nationkey").cast("double"))})
    return d.select("c_custkey", F.round(audit.looked_up(F.col("m"), "0.8", "50"), 4).alias("wi"), audit.looked_up(F.col("o"), "50").alias("aose"))


@query("SELECT pos FROM (SELECT pos, row_number() OVER (ORDER BY objectness, pos) AS rn, count(*) OVER () AS n FROM proposals) x WHERE rn <= greatest(CAST(round_even(n * CAST(0.2 AS DOUBLE), 0) AS BIGINT), 1)")
def objectness_keep(spark, sf):
    """The share with the *least* objectness, which is what the original's order of negated values takes."""
    return gates.admissible(t.proposals(spark, sf).withColumn("k", -F.col("objectness")), "k", 0.2).where("in_gate").select("pos")


@query(nms_sql("SELECT pos FROM kept WHERE pos IN (SELECT pos FROM proposals WHERE greatest(q0, q1) >= greatest(q2, q3))"), base=False)
def pseudo_reference(spark, sf):
    return gates.suppress(t.proposals(spark, sf), F.col("objectness")).where(F.col("kept") & vec.predicted_known(F.col("q"), 2)).select("pos")


@query(nms_sql(", g AS (SELECT pos, row_number() OVER (ORDER BY objectness DESC, pos) AS rn, count(*) OVER () AS n FROM scored) SELECT 'pool' AS population, count(*) AS rows FROM scored UNION ALL SELECT 'gate', count(*) FROM g WHERE rn <= greatest(CAST(round_even(n * CAST(0.3 AS DOUBLE), 0) AS BIGINT), 1) UNION ALL SELECT 'gate_nms', count(*) FROM kept UNION ALL SELECT 'known_reject', count(*) FROM kept JOIN proposals p USING (pos) WHERE round((q0+q1-q3)/(q0+q1+q2+q3), 9) < (SELECT quantile_cont(round((q0+q1-q3)/(q0+q1+q2+q3), 9), 0.5) FROM kept JOIN proposals USING (pos))", where="WHERE pos IN (SELECT pos FROM (SELECT pos, row_number() OVER (ORDER BY objectness DESC, pos) AS rn, count(*) OVER () AS n FROM scored) q WHERE rn <= greatest(CAST(round_even(n * CAST(0.3 AS DOUBLE), 0) AS BIGINT), 1))"), base=False)
def population_ladder(spark, sf):
    """The populations that one pool narrows to: all, the gate, its survivors of suppression, and those of them that known classes don't claim."""
    from acquira.sources.shared import written

    p = t.proposals(spark, sf)
    kept = written(gates.gate_then_suppress(p, "objectness", share=0.3))
    q = F.col("q")
    margin = F.round((q[0] + q[1] - q[3]) / (q[0] + q[1] + q[2] + q[3]), 9)
    size = lambda d, n: d.agg(F.count("*").alias("rows")).select(F.lit(n).alias("population"), "rows")
    out = [size(p, "pool"), size(kept.where("in_gate"), "gate"), size(kept.where("kept"), "gate_nms"), size(gates.below_quantile(kept, margin, 0.5, candidate=F.col("kept")), "known_reject")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(_U + ", m AS (SELECT label, i, avg(v[i]) AS x FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM u) z GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label), n AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS c FROM c), d AS (SELECT a.label, 1 - max(list_dot_product(a.c, b.c)) AS novelty FROM n a, n b WHERE b.label < 3 GROUP BY a.label) SELECT vec_id, round(novelty, 6) + 0.0 AS novelty FROM u JOIN d USING (label)", base=False)
def cluster_novelty(spark, sf):
    a = unit(spark, sf).withColumnRenamed("label", "cluster")
    known = a.where("cluster < 3").select("cluster")
    return terms.cluster_novelty(a, known).select("vec_id", (F.round("novelty", 6) + 0.0).alias("novelty"))


_KTH = ", o AS (SELECT a.vec_id, sqrt(greatest(2 - 2 * list_dot_product(a.v, b.v), 0)) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC) AS rn FROM u a JOIN u b ON a.vec_id <> b.vec_id) "


@query(_U + _KTH + "SELECT vec_id, round(d, 5) AS rarity FROM o WHERE rn = 5", base=False)
def rarity_isolation(spark, sf):
    u = unit(spark, sf)
    return terms.kth_distance(u, u, k=5, itself=True).select("vec_id", F.round("distance", 5).alias("rarity"))


@query(_U + _KTH + ", l AS (SELECT a.vec_id, sqrt(greatest(2 - 2 * list_dot_product(a.v, b.v), 0)) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC) AS rn FROM u a JOIN u b ON b.label >= 7 AND a.label < 7), c AS (SELECT a.vec_id, sqrt(greatest(2 - 2 * list_dot_product(a.v, b.v), 0)) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC) AS rn FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.label < 7 AND b.label < 7) SELECT c.vec_id, round(ln((1e-8 + l.d) / (1e-8 + c.d)), 4) AS rarity FROM c JOIN l USING (vec_id) WHERE c.rn = 5 AND l.rn = 5", base=False)
def rarity_coverage(spark, sf):
    u = unit(spark, sf)
    return terms.coverage_deficit(u.where("label < 7"), u.where("label >= 7"), k=5).select("vec_id", F.round("rarity", 4).alias("rarity"))


@query("WITH c AS (SELECT label, ln((1.0 + count(CASE WHEN vec_id % 3 > 0 THEN 1 END)) / (1.0 + count(CASE WHEN vec_id % 3 = 0 THEN 1 END))) AS r FROM embeddings GROUP BY label) SELECT vec_id, round(r, 6) AS rarity FROM embeddings JOIN c USING (label)", base=False)
def rarity_partition(spark, sf):
    a = t.read(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cluster"), (F.col("vec_id") % 3 == 0).alias("labelled"))
    return terms.partition_deficit(a).select("vec_id", r6(F.col("rarity"), "rarity"))


@query(_U + _KTH + "SELECT round(quantile_cont(d, 0.9), 5) AS eps FROM o WHERE rn = 5", base=False)
def density_radius(spark, sf):
    return spark.createDataFrame([(round(terms.density_radius(unit(spark, sf), minimum=5, quantile=0.9), 5),)], "eps double")


_STATUS = ", p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a, u b WHERE 1 - list_dot_product(a.v, b.v) <= 0.5 + 1e-9 OR a.vec_id = b.vec_id), core AS (SELECT a FROM p GROUP BY a HAVING count(*) >= 5), st AS (SELECT vec_id, CASE WHEN vec_id IN (SELECT a FROM core) THEN 'core' WHEN vec_id IN (SELECT p.a FROM p JOIN core c ON c.a = p.b) THEN 'border' ELSE 'noise' END AS status FROM embeddings) "


@query((_U + _STATUS + ", e AS (SELECT a, b FROM p WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)), w(a, l) AS (SELECT a, a FROM core UNION SELECT e.b, w.l FROM w JOIN e ON e.a = w.a), l AS (SELECT a, min(l) AS l FROM w GROUP BY a), bd AS (SELECT vec_id AS a, arg_min(l.l, p.b) AS l FROM st JOIN p ON p.a = st.vec_id JOIN l ON l.a = p.b WHERE status = 'border' GROUP BY vec_id), c AS (SELECT l, count(*) AS n FROM (SELECT * FROM l UNION ALL SELECT * FROM bd) x GROUP BY l), k AS (SELECT count(*) AS clusters, coalesce(avg(n), 0) AS mean_size, CAST(coalesce(min(n), 0) AS BIGINT) AS smallest, CAST(coalesce(max(n), 0) AS BIGINT) AS largest FROM c) SELECT count(*) AS candidates, count(CASE WHEN status = 'noise' THEN 1 END) AS noise, count(CASE WHEN status = 'core' THEN 1 END) AS core, count(CASE WHEN status = 'border' THEN 1 END) AS border, count(CASE WHEN status <> 'noise' THEN 1 END) AS accepted, any_value(clusters) AS clusters, round(any_value(mean_size), 6) AS mean_size, any_value(smallest) AS smallest, any_value(largest) AS largest, round(count(CASE WHEN status = 'noise' THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS noise_rate FROM st, k").replace("WITH ", "WITH RECURSIVE ", 1), base=False)
def gate_summary(spark, sf):
    from acquira.operators import clusters

    s = clusters.dbscan(t.read(spark, sf, "embeddings"), eps=0.5, minimum=5)
    d = terms.gate_summary(s)
    return d.withColumns({"mean_size": F.round("mean_size", 6), "noise_rate": F.round("noise_rate", 6)})


@query("WITH a AS (SELECT vec_id, CASE WHEN label = 9 THEN -1 ELSE label * 10 + CASE WHEN vec_id % 7 < 3 THEN vec_id % 7 ELSE 9 END END AS cluster, vec_id % 7 = 1 OR vec_id % 11 = 0 AS known FROM embeddings), per AS (SELECT cluster, count(CASE WHEN known THEN 1 END) AS k, count(CASE WHEN NOT known THEN 1 END) AS c FROM a WHERE cluster >= 0 GROUP BY cluster), p AS (SELECT count(*) AS clusters, count(CASE WHEN k = 0 THEN 1 END) AS candidate_only, count(CASE WHEN c = 0 THEN 1 END) AS known_only, count(CASE WHEN k > 0 AND c > 0 THEN 1 END) AS mixed, CAST(coalesce(sum(CASE WHEN c > 0 THEN k END), 0) AS BIGINT) AS leaked, avg(CAST(k AS DOUBLE) / (k + c)) AS purity FROM per), r AS (SELECT count(CASE WHEN known THEN 1 END) AS known_rows, count(CASE WHEN NOT known THEN 1 END) AS candidate_rows, count(CASE WHEN known AND cluster < 0 THEN 1 END) AS kn, count(CASE WHEN NOT known AND cluster < 0 THEN 1 END) AS cn FROM a) SELECT known_rows, candidate_rows, clusters, candidate_only, known_only, mixed, leaked, round(leaked / CAST(greatest(known_rows, 1) AS DOUBLE), 6) AS contamination, round(kn / CAST(greatest(known_rows, 1) AS DOUBLE), 6) AS known_noise_rate, round(cn / CAST(greatest(candidate_rows, 1) AS DOUBLE), 6) AS candidate_noise_rate, round(purity, 6) AS purity FROM p, r", base=False)
def known_contamination(spark, sf):
    m = F.col("vec_id") % 7
    a = t.read(spark, sf, "embeddings").select(F.when(F.col("label") == 9, -1).otherwise(F.col("label") * 10 + F.when(m < 3, m).otherwise(9)).alias("cluster"), ((m == 1) | (F.col("vec_id") % 11 == 0)).alias("known"))
    d = terms.known_contamination(a)
    return d.select(*[F.round(c, 6).alias(c) if c in ("contamination", "known_noise_rate", "candidate_noise_rate", "purity") else c for c in d.columns])


_SETTINGS = (5, 20, 80)


@query(", c AS (SELECT k, p.pos % k AS cluster, kind FROM proposals p JOIN oracle o ON p.pos = o.pos, (SELECT unnest([5, 20, 80]) AS k) s), per AS (SELECT k, cluster, count(*) AS n, count(CASE WHEN kind='known' THEN 1 END) AS kn, count(CASE WHEN kind='unknown' THEN 1 END) AS u FROM c GROUP BY 1, 2), w AS (SELECT *, CAST(kn AS DOUBLE)/n > CAST(sum(kn) OVER (PARTITION BY k) AS DOUBLE)/sum(n) OVER (PARTITION BY k) AS owned FROM per), s AS (SELECT k AS setting, round(CAST(sum(CASE WHEN owned THEN u END) AS DOUBLE)/sum(CASE WHEN owned THEN n END), 6) AS contamination, round(CAST(sum(CASE WHEN NOT owned THEN u END) AS DOUBLE)/sum(u), 6) AS unknown_recall, round(avg(n), 6) AS mean_size FROM w GROUP BY k), e AS (SELECT *, coalesce(unknown_recall >= 0.3 AND mean_size >= 25, false) AS eligible FROM s) SELECT CAST(setting AS INT) AS setting, contamination, unknown_recall, mean_size, eligible, eligible AND row_number() OVER (ORDER BY eligible DESC, contamination, setting) = 1 AS chosen FROM e")
def partition_sweep(spark, sf):
    from acquira.operators import stats

    p = t.proposals(spark, sf)
    base = p.select("pos").join(t.oracle(p).select("pos", "kind"), "pos")
    rows = None
    for k in _SETTINGS:
        a = base.select((F.col("pos") % k).alias("cluster"), (F.col("kind") == "known").alias("known"), (F.col("kind") == "unknown").alias("unknown"))
        mean = a.groupBy("cluster").agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 6).alias("mean_size"))
        one = stats.contamination(a).crossJoin(mean).select(F.lit(k).alias("setting"), F.round("contamination", 6).alias("contamination"), F.round("unknown_recall", 6).alias("unknown_recall"), "mean_size")  # one row each
        rows = one if rows is None else rows.unionByName(one)
    return terms.least_contaminated(rows, min_recall=0.3, min_size=25)


@query(_U + ", a AS (SELECT *, CASE WHEN vec_id % 5 < 3 THEN vec_id % 5 END AS c FROM u), m AS (SELECT c, i, avg(v[i]) AS x FROM (SELECT c, v, unnest(range(1, 65)) AS i FROM a WHERE c IS NOT NULL) z GROUP BY 1, 2), l AS (SELECT c, list(x ORDER BY i) AS l FROM m GROUP BY c) SELECT c AS class_pos, (SELECT count(*) FROM a WHERE a.c = l.c) AS n, round(l[1] / sqrt(list_sum(list_transform(l, lambda y: y * y))), 6) AS first FROM l", base=False)
def class_prototypes(spark, sf):
    hot = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i == F.col("vec_id") % 5, 0.9).otherwise(0.02))
    d = terms.prototypes(unit(spark, sf).withColumn("q", hot), known=3)
    return d.select("class_pos", "n", r6(F.col("prototype")[0], "first"))


@query(", e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings), b AS (SELECT o.pos, object_id, o.class_name, v, sha256('2|' || o.pos) AS h FROM oracle o JOIN proposals p ON o.pos = p.pos JOIN e ON e.vec_id = p.vec_id WHERE kind = 'unknown'), w AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY pos) AS rn, lead(v) OVER (PARTITION BY object_id ORDER BY pos) AS vo, lead(v) OVER (PARTITION BY class_name, substr(h, 1, 1) ORDER BY h, pos) AS vc, lead(object_id) OVER (PARTITION BY class_name, substr(h, 1, 1) ORDER BY h, pos) AS oc, lead(v) OVER (PARTITION BY substr(h, 1, 2) ORDER BY h, pos) AS vd, lead(class_name) OVER (PARTITION BY substr(h, 1, 2) ORDER BY h, pos) AS cd FROM b), r AS (SELECT 'same_object' AS relation, list_dot_product(v, vo) AS s FROM w WHERE rn = 1 AND vo IS NOT NULL UNION ALL SELECT 'same_class', list_dot_product(v, vc) FROM w WHERE oc <> object_id UNION ALL SELECT 'different_class', list_dot_product(v, vd) FROM w WHERE cd <> class_name) SELECT relation, count(*) AS pairs, round(avg(s), 6) AS similarity FROM r GROUP BY relation")
def pair_similarity(spark, sf):
    p = t.proposals(spark, sf)
    d = t.oracle(p).where("kind = 'unknown'").select("pos", "object_id", "class_name").join(p.select("pos", "vec_id"), "pos").join(unit(spark, sf), "vec_id")
    return terms.relation_similarity(d, seed=2).withColumn("similarity", F.round("similarity", 6))


@query("SELECT count(*) AS rows, count(DISTINCT vec_id) AS keys, count(CASE WHEN len(embedding) <> 64 THEN 1 END) AS other_length, count(CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 1 END) AS not_finite, count(CASE WHEN abs(sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))) - 1) > 0.001 THEN 1 END) AS not_unit FROM embeddings", base=False)
def export_check(spark, sf):
    return terms.check_vectors(t.read(spark, sf, "embeddings"), key="vec_id", vector="embedding", dims=64)


@query(", d AS (SELECT p.pos, objectness >= 0.7 AS in_scope, objectness >= 0.7 AND p.vec_id % 3 > 0 AS open, objectness >= 0.7 AND p.vec_id % 3 = 0 AS noise, kind, object_id, grp FROM proposals p JOIN oracle o ON o.pos = p.pos LEFT JOIN class_groups g ON g.class_name = o.class_name), r AS (SELECT count(CASE WHEN in_scope THEN 1 END) AS scope, round(count(CASE WHEN noise THEN 1 END) / CAST(greatest(count(CASE WHEN in_scope THEN 1 END), 1) AS DOUBLE), 6) AS noise_share, " + ", ".join(f"round(count(CASE WHEN {m} AND kind = '{k}' THEN 1 END) / CAST(nullif(count(CASE WHEN {m} THEN 1 END), 0) AS DOUBLE), 6) AS {k}_{m}" for k, m in (("unknown", "open"), ("unknown", "noise"), ("background", "open"), ("background", "noise"), ("known", "open"))) + ", count(DISTINCT CASE WHEN in_scope AND kind = 'unknown' THEN object_id END) AS objects_scope, count(DISTINCT CASE WHEN open AND kind = 'unknown' THEN object_id END) AS objects_kept, count(DISTINCT CASE WHEN in_scope AND kind = 'unknown' AND grp = 'tail' THEN object_id END) AS tail_scope, count(DISTINCT CASE WHEN open AND kind = 'unknown' AND grp = 'tail' THEN object_id END) AS tail_kept, round(count(CASE WHEN open AND kind = 'known' THEN 1 END) / CAST(nullif(count(CASE WHEN in_scope AND kind = 'known' THEN 1 END), 0) AS DOUBLE), 6) AS known_kept FROM d), x AS (SELECT *, round(tail_kept / CAST(nullif(tail_scope, 0) AS DOUBLE), 6) AS tail_retained FROM r) SELECT *, coalesce(unknown_open > unknown_noise, false) AS c1, coalesce(background_noise > background_open, false) AS c2, coalesce(tail_retained >= 0.6, false) AS c3, coalesce(noise_share >= 0.05, false) AS c4, coalesce(unknown_open > unknown_noise AND background_noise > background_open AND tail_retained >= 0.6 AND noise_share >= 0.05, false) AS accepted FROM x")
def density_gate_report(spark, sf):
    p = t.proposals(spark, sf)
    o = t.oracle(p)
    s = F.col("objectness") >= 0.7
    d = o.select("pos", "kind", "object_id", "class_name").join(p.select("pos", s.alias("in_scope"), (s & (F.col("vec_id") % 3 > 0)).alias("open"), (s & (F.col("vec_id") % 3 == 0)).alias("noise")), "pos")
    d = d.join(F.broadcast(t.class_groups(t.image_counts(o)).select("class_name", "grp")), "class_name", "left")
    r = terms.density_gate_report(d, least_tail=0.6)
    doubles = {f.name for f in r.schema if f.dataType.typeName() == "double"}
    return r.select(*[F.round(c, 6).alias(c) if c in doubles else c for c in r.columns])


# ---- ceilings


def _world(spark, sf):
    p = t.proposals(spark, sf)
    c = t.image_counts(t.oracle(p))
    return c, t.image_cost(p, c)


def _bought(spark, rows):
    return spark.createDataFrame(rows, "image_id long, cost long")


@query(", o AS (SELECT image_id, cost, sum(cost) OVER (ORDER BY sha256('4|' || image_id), image_id) AS cum FROM image_cost) SELECT image_id, cost FROM o WHERE cum <= 400")
def ceiling_random(spark, sf):
    return _bought(spark, ceiling.purchase("random", *_world(spark, sf), budget=400, seed=4))


@query(", n AS (SELECT i.image_id, cost, coalesce(c.n, 0) AS n FROM image_cost i LEFT JOIN image_counts c ON c.image_id = i.image_id AND c.class_name = 'C12'), o AS (SELECT image_id, cost, sum(cost) OVER (ORDER BY round(n / CAST(cost AS DOUBLE), 9) DESC, image_id) AS cum FROM n) SELECT image_id, cost FROM o WHERE cum <= 400")
def ceiling_class_greedy(spark, sf):
    return _bought(spark, ceiling.purchase("class_greedy", *_world(spark, sf), budget=400, target="C12"))


@query()
def ceiling_stratified(spark, sf):
    return _bought(spark, ceiling.purchase("stratified", *_world(spark, sf), budget=400, known=["C0", "C1", "C2", "C3"], seed=4))


@query()
def ceiling_stratified_cheapest(spark, sf):
    return _bought(spark, ceiling.purchase("stratified_cheapest", *_world(spark, sf), budget=400, known=["C0", "C1", "C2", "C3"], seed=4))


@query(", a AS (SELECT image_id, cost, sum(cost) OVER (ORDER BY cost, image_id) AS cum FROM image_cost), one AS (SELECT image_id, cost FROM a WHERE cum <= 300), b AS (SELECT image_id, cost, sum(cost) OVER (ORDER BY cost, image_id) AS cum FROM image_cost WHERE image_id NOT IN (SELECT image_id FROM one)), two AS (SELECT image_id, cost FROM b WHERE cum <= 300), c AS (SELECT 1 AS k, c.* FROM image_counts c WHERE image_id IN (SELECT image_id FROM one) UNION ALL SELECT 2, c.* FROM image_counts c WHERE image_id IN (SELECT image_id FROM two)) SELECT 'cheapest' AS policy, 'C12' AS class_name, (SELECT count(*) FROM one) AS images, CAST((SELECT sum(cost) FROM one) AS BIGINT) AS spent, CAST(coalesce(sum(CASE WHEN k = 1 AND class_name = 'C12' THEN n END), 0) AS BIGINT) AS acquired, CAST(0 AS BIGINT) AS banked, CAST(coalesce(sum(CASE WHEN k = 1 AND class_name = 'C12' THEN n END), 0) AS BIGINT) AS held, CAST(coalesce(sum(CASE WHEN k = 1 AND class_name NOT IN ('C0', 'C1') THEN n END), 0) AS BIGINT) AS unknown FROM c UNION ALL SELECT 'cheapest', 'C20', (SELECT count(*) FROM two), CAST((SELECT sum(cost) FROM two) AS BIGINT), CAST(coalesce(sum(CASE WHEN k = 2 AND class_name = 'C20' THEN n END), 0) AS BIGINT), CAST(coalesce(sum(CASE WHEN k = 1 AND class_name = 'C20' THEN n END), 0) AS BIGINT), CAST(coalesce(sum(CASE WHEN class_name = 'C20' THEN n END), 0) AS BIGINT), CAST(coalesce(sum(CASE WHEN k = 2 AND class_name NOT IN ('C0', 'C1') THEN n END), 0) AS BIGINT) FROM c")
def ceiling_trajectory(spark, sf):
    counts, cost = _world(spark, sf)
    return ceiling.trajectory("cheapest", counts, cost, ["C12", "C20"], known=["C0", "C1"], budget=300)


@query()
def stratified_cut(spark, sf):
    counts, _ = _world(spark, sf)
    return spark.createDataFrame([(i,) for i in ceiling.stratified_cut(counts, limit=200, seed=6)], "image_id long")


@query(", pool AS (SELECT image_id, class_name, CAST(unnest(range(n)) AS BIGINT) AS ordinal FROM image_counts), r AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY sha256('8|' || class_name || '|' || image_id || '|' || ordinal), image_id, ordinal) AS rn, count(*) OVER (PARTITION BY class_name) AS have FROM pool) SELECT image_id, class_name, ordinal, rn, have >= 50 AS balanced FROM r WHERE rn <= 50")
def balanced_reference(spark, sf):
    from acquira.operators import sampling

    counts, _ = _world(spark, sf)
    return sampling.balanced(sampling.objects(counts), cap=50, seed=8)
