"""Grouped statistics; ratios without a denominator are NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acquira.functions import ranking
from acquira.functions.numbers import ratio
from acquira.sources.shared import written


def contamination(assign: DataFrame) -> DataFrame:
    """One row from (cluster, known, unknown): clusters, those the known own (a share above the pool's), how much unknown they hold, and purity.

    A cluster is owned by the known if its share of them exceeds the pool's; contamination is the unknown share of owned clusters.
    """
    n = lambda c: F.sum(F.col(c).cast("long"))
    per = assign.groupBy("cluster").agg(F.count("*").alias("n"), n("known").alias("k"), n("unknown").alias("u"))
    pool = Window.partitionBy()
    per = per.withColumn("owned", ratio(F.col("k"), F.col("n")) > F.sum("k").over(pool) / F.sum("n").over(pool))
    own = lambda c, x=True: F.sum(F.when(F.col("owned") == x, F.col(c)))
    return per.agg(
        F.count("*").alias("clusters"), F.count(F.when(F.col("owned"), 1)).alias("known_clusters"), F.round(ratio(own("u"), own("n")), 6).alias("contamination"),
        F.round(ratio(own("u", False), F.sum("u")), 6).alias("unknown_recall"),
    )


def roc_auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """auc by average ranks; NULL under two rows of either kind."""
    r = ranking.average_ranks(df.withColumn("_pos", positive), score, "_rank")
    a = r.agg(F.sum(F.when(F.col("_pos"), F.col("_rank"))).alias("s"), F.count(F.when(F.col("_pos"), 1)).alias("p"), F.count(F.when(~F.col("_pos"), 1)).alias("n"))
    return a.select(F.when((F.col("p") >= 2) & (F.col("n") >= 2), (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n"))).alias("auc"), "p", "n")


def spearman(df: DataFrame, x: str, y: str, *, ties: str = "average", order: str = "pos") -> DataFrame:
    """rho over ranks; with ties "ordinal", equal values are ranked by ``order``. NULL under three rows."""
    if ties == "average":
        d = ranking.average_ranks(ranking.average_ranks(df, x, "_rx"), y, "_ry")
    else:
        d = ranking.row_numbers(ranking.row_numbers(df, [x, order], "_rx"), [y, order], "_ry")
    return d.agg(F.when(F.count("*") >= 3, F.corr(F.col("_rx").cast("double"), F.col("_ry").cast("double"))).alias("rho"), F.count("*").alias("n"))


def least_squares(df: DataFrame, y: str, x1: str, x2: str | None = None) -> DataFrame:
    """Intercept, slopes and r2 of a fit with one or two regressors; NULL if rows don't exceed the terms."""
    if x2 is None:
        ok = F.count("*") > 2
        return df.agg(F.when(ok, F.regr_intercept(y, x1)).alias("intercept"), F.when(ok, F.regr_slope(y, x1)).alias("slope1"), F.when(ok, F.regr_r2(y, x1)).alias("r2"))
    cov = lambda a, b: F.covar_pop(a, b)
    m = df.agg(cov(x1, x1).alias("a"), cov(x1, x2).alias("b"), cov(x2, x2).alias("c"), cov(x1, y).alias("d"), cov(x2, y).alias("e"), cov(y, y).alias("v"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("my"), F.count("*").alias("n"))
    det = F.nullif(F.col("a") * F.col("c") - F.col("b") * F.col("b"), F.lit(0.0))
    m = m.withColumns({"slope1": (F.col("d") * F.col("c") - F.col("e") * F.col("b")) / det, "slope2": (F.col("e") * F.col("a") - F.col("d") * F.col("b")) / det})
    ok = F.col("n") > 3
    return m.select(
        F.when(ok, F.col("my") - F.col("slope1") * F.col("m1") - F.col("slope2") * F.col("m2")).alias("intercept"), F.when(ok, F.col("slope1")).alias("slope1"), F.when(ok, F.col("slope2")).alias("slope2"),
        F.when(ok, (F.col("slope1") * F.col("d") + F.col("slope2") * F.col("e")) / F.nullif(F.col("v"), F.lit(0.0))).alias("r2"),
    )


def cluster_quality(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """nmi (arithmetic mean), ari, purity from the contingency of label and cluster."""
    cells = df.groupBy(label, cluster).agg(F.count("*").alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy(*c))
    c = cells.withColumns({"a": over(label), "b": over(cluster), "t": over()})
    c = c.withColumns({"ra": F.row_number().over(Window.partitionBy(label).orderBy(cluster)), "rb": F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("n"), label))})
    two = lambda x: F.col(x) * (F.col(x) - 1) / 2.0
    h = lambda x, first: -F.sum(F.when(F.col(first) == 1, F.col(x) / F.col("t") * F.ln(F.col(x) / F.col("t"))))
    s = c.agg(
        F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"), h("a", "ra").alias("ha"), h("b", "rb").alias("hb"), F.sum(two("n")).alias("sn"),
        F.sum(F.when(F.col("ra") == 1, two("a"))).alias("sa"), F.sum(F.when(F.col("rb") == 1, two("b"))).alias("sb"), F.max(two("t")).alias("st"), (F.sum(F.when(F.col("rb") == 1, F.col("n"))) / F.max("t")).alias("purity"),
    )
    expected = F.col("sa") * F.col("sb") / F.nullif(F.col("st"), F.lit(0.0))
    return s.select(F.round(F.col("mi") / F.nullif((F.col("ha") + F.col("hb")) / 2, F.lit(0.0)), 6).alias("nmi"), F.round((F.col("sn") - expected) / F.nullif((F.col("sa") + F.col("sb")) / 2 - expected, F.lit(0.0)), 6).alias("ari"), F.round("purity", 6).alias("purity"))


def eta_squared(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Share of the variance that lies between groups of two or more rows, over all components."""
    d = df.select(group, F.posexplode(F.transform(vector, lambda x: x.cast("double"))).alias("d", "x"))
    per = d.groupBy(group, "d").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).where("n >= 2")
    by_dim = per.groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("g"))
    mean = F.col("s") * F.col("s") / F.col("n")
    return by_dim.agg(ratio(F.sum(F.col("g") - mean), F.sum(F.col("q") - mean)).alias("eta2"))


def batch_similarity(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean similarity of different rows of a group: (|sum v|^2 - sum |v|^2) / (n (n - 1)), without pairs."""
    d = df.select(group, F.posexplode(F.transform(vector, lambda x: x.cast("double"))).alias("d", "x"))
    per = d.groupBy(group, "d").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    return per.groupBy(group).agg(F.max("n").alias("n"), ((F.sum(F.col("s") * F.col("s")) - F.sum("q")) / F.nullif(F.max("n") * (F.max("n") - 1), F.lit(0))).alias("similarity"))


def strata(df: DataFrame, memberships: dict[str, Column], value: str) -> DataFrame:
    """Quartiles of value for each stratum that has rows; strata may overlap. Values are found by rank, no stratum is held in one place."""
    d = written(df.select(F.col(value).alias("_v"), *[F.coalesce(c, F.lit(False)).alias(f"_in{i}") for i, c in enumerate(memberships.values())]))
    sizes, rows = d.agg(*[F.count(F.when(F.col(f"_in{i}"), 1)) for i in range(len(memberships))]).first(), []
    for i, name in enumerate(memberships):
        if sizes[i]:
            q = [ranking.quantile(d.where(f"_in{i}"), "_v", x) for x in (0.25, 0.5, 0.75)]
            rows.append((name, sizes[i], *[None if x is None else float(x) for x in q]))
    out = df.sparkSession.createDataFrame(rows, "stratum string, n long, q25 double, q50 double, q75 double")
    return out.select("stratum", "n", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")])


def top_fractions(df: DataFrame, key: str, fractions: list[float]) -> DataFrame:
    """For each fraction of the ranking by key: rows, unknown proposals and distinct unknown objects in it."""
    d = ranking.row_numbers(df, [key, "pos"], "_rn", descending=True)
    d = d.crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))
    cut = lambda f: F.greatest(F.bround(F.col("_n") * F.lit(f)), F.lit(1))
    d = d.withColumn("fraction", F.explode(F.filter(F.array(*[F.when(F.col("_rn") <= cut(f), F.lit(f)) for f in fractions]), lambda x: x.isNotNull())))
    u = F.col("kind") == "unknown"
    return d.groupBy("fraction").agg(F.count("*").alias("rows"), F.count(F.when(u, 1)).alias("unknown_proposals"), F.count_distinct(F.when(u, F.col("object_id"))).alias("unknown_objects"))


def area_under_curve(df: DataFrame, arm: str, x: str, y: str) -> DataFrame:
    """Trapezoids under y by x for each arm, over the span of x; NULL without a span."""
    w = Window.partitionBy(arm).orderBy(x)
    d = df.withColumns({"_dx": F.col(x) - F.lag(x).over(w), "_my": (F.col(y) + F.lag(y).over(w)) / 2})
    return d.groupBy(arm).agg(ratio(F.sum(F.col("_dx") * F.col("_my")), F.max(x) - F.min(x)).alias("area"))


def paired_contrast(df: DataFrame, arm: str, baseline: str, seed: str, value: str) -> DataFrame:
    """Each arm against the baseline over the seeds that both have: mean and sample deviation of the differences, seeds that improve."""
    base = df.where(F.col(arm) == baseline).select(seed, F.col(value).alias("_b"))
    d = df.where(F.col(arm) != baseline).join(base, seed).withColumn("_d", F.col(value) - F.col("_b"))
    return d.groupBy(arm).agg(F.count("*").alias("seeds"), F.avg("_d").alias("delta"), F.stddev_samp("_d").alias("sd"), F.count(F.when(F.col("_d") > 0, 1)).alias("improving"))


def grouped_mean(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean of the values that there are by group, and over all."""
    return df.groupingSets([[group], []], group).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).withColumn(group, F.coalesce(group, F.lit("all")))
