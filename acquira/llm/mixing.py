"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acquira.llm.shared import Scratch, scratched

#: Slices of a source's documents by hash; a slice's words are summed before any document is ordered.
SLICES = 4096


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(core == "", F.lit(0)).otherwise(F.size(F.split(core, "[\\x20\\x09-\\x0D]+"))).cast("long")


def targets(sizes: DataFrame, *, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """source, source_size -> also target: the weights' shares of ``share`` of all sizes, none above ``cap`` times its size.

    Water rises to a level at which sources hold min(cap, weight * level). Sorted by the level that fills them, the sources that
    are full come first, so running sums give the level; it is what resharing the excess by weight ends at. One row a source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights) + 1)
    s = sizes.withColumn("weight", w).withColumn("limit", F.col("source_size") * float(cap))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    every, before = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "total": F.sum("source_size").over(every) * float(share),
        "full": F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
        "open_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    level = (F.col("total") - F.col("full")) / F.col("open_weight")
    s = s.withColumn("own_level", level)
    # this rises while the sources are full and falls from the first that isn't: its greatest value is the level of all
    s = s.withColumn("level", F.max("own_level").over(every))
    return s.select("source", "source_size", F.least("limit", F.col("level") * F.col("weight")).alias("target"))


@scratched
def mix(df: DataFrame, *, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] = (), scratch: Scratch) -> DataFrame:
    """id, source, size, source_size, target, taken of every row, then the columns named in ``carry``.

    Every document is taken target / source_size times: the whole part for all, the rest for those first by a seeded hash until
    the source's target is met, where the last one gives only the words that are missing. Sums by slices of the hash decide for
    nearly all rows; only a source's slice at the edge is ordered, so no source is brought to one task.
    Null texts have size 0 and take nothing; null sources are one source, the last. Repeated rows count each. An empty table stays empty.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    d = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)))
    d = scratch.write(d.withColumn("h", h).withColumn("slice", (F.col("h") % SLICES).cast("int")))
    sums = d.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    goal = targets(sums.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights=weights, share=share, cap=cap)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    # a target that rounds up to a multiple of the size leaves a rest of the whole size, which no slice holds
    full = (F.col("source_size") > 0) & (F.col("rest") == F.col("source_size"))
    goal = goal.withColumns({"whole": F.col("whole") + full.cast("long"), "rest": F.when(full, F.lit(0)).otherwise(F.col("rest"))})
    run = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    edge = sums.withColumn("before", F.coalesce(F.sum("slice_size").over(run), F.lit(0)))
    edge = scratch.write(_by_source(edge, goal).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("slice_size"))))
    goal = scratch.write(_by_source(goal, edge.select("source", F.col("slice").alias("edge")), "left"))
    names = ["id", "source", "size", "source_size", "target", "whole", *(f"carried_{i}" for i in range(len(carry)))]
    rows = _by_source(d, goal, "left").where(~F.coalesce(F.col("slice") == F.col("edge"), F.lit(False)))
    plain = rows.select(*names, F.when(F.col("slice") < F.col("edge"), F.col("size")).otherwise(F.lit(0)).alias("extra"))
    at_edge = _by_source(d, edge.drop("slice_size"), "inner", "slice")
    in_order = Window.partitionBy("source").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(in_order), F.lit(0))
    cut = at_edge.select(*names, F.greatest(F.lit(0), F.least("size", left)).alias("extra"))
    return plain.unionByName(cut).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"), *(F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)),
    )


def draw(mixed: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The mix itself: a row for each whole repetition of a document, and one with the first words of a document cut at the edge."""
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    rest = F.col("taken") - copies * F.col("size")
    whole = mixed.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("copy")
    core = F.split(F.btrim(F.col(text_col), F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+")
    cut = mixed.where((F.col("size") > 0) & (rest > 0)).withColumn(text_col, F.array_join(F.slice(core, F.lit(1), rest.cast("int")), " "))
    return whole.unionByName(cut)


def _by_source(left: DataFrame, right: DataFrame, how: str = "inner", *more: str) -> DataFrame:
    """Joined on source, where null equals null, and on the columns ``more``; right's other columns are added."""
    key = lambda s: F.struct(s.isNull().alias("none"), F.coalesce(s, F.lit("")).alias("name"))
    return left.withColumn("_key", key(F.col("source"))).join(right.withColumn("_key", key(F.col("source"))).drop("source"), ["_key", *more], how).drop("_key")


def oracle(weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 0) -> str:
    """The query's rows in DuckDB's SQL."""
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
   CAST('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
 p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
 w AS (SELECT *, source_size * {float(cap)} AS lim, CAST(([{", ".join(map(str, weights))}])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} AS INT) + 1] AS DOUBLE) AS weight FROM p),
 l AS (SELECT *, (sum(source_size) OVER () * {float(share)} - coalesce(sum(lim) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS own
   FROM w WINDOW o AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t AS (SELECT *, least(lim, max(own) OVER () * weight) AS target FROM l),
 g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
 x AS (SELECT d.*, source_size, target, whole, CAST(round(target) AS BIGINT) - whole * source_size AS rest,
   coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h % {SLICES}, h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
   FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM x"""
