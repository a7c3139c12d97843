"""The relations as derived from a scale-factor folder: proposals, oracle, counts, costs, groups, detections, references.

A proposal's position orders rows by image and then by all its other columns; it is numbered within the image, so no table is
sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
POSITIONS = 1_000_000

#: The same relations in SQL, as common table expressions.
BASE = f"""WITH proposals AS (
 SELECT l_orderkey * {POSITIONS} + row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) - 1 AS pos, l_orderkey AS image_id,
  CAST(l_partkey % 97 AS DOUBLE) / 97 AS cx, CAST(l_suppkey % 89 AS DOUBLE) / 89 AS cy, CAST(0.05 AS DOUBLE) + l_quantity / 100 AS w, CAST(0.05 AS DOUBLE) + l_tax * 5 AS h,
  CAST(0.5 AS DOUBLE) + l_discount * 5 AS objectness, CAST((l_partkey % 13) + 1 AS DOUBLE) AS q0, CAST((l_partkey * 2 % 13) + 1 AS DOUBLE) AS q1,
  CAST((l_partkey * 3 % 13) + 1 AS DOUBLE) AS q2, CAST((l_partkey * 5 % 13) + 1 AS DOUBLE) AS q3, l_partkey % (SELECT count(*) FROM embeddings) AS vec_id, (l_partkey % 6) * (l_suppkey % 6) AS class_id,
  l_returnflag, l_linestatus, l_shipdate FROM lineitem),
 scored AS (SELECT *, objectness * sqrt(greatest(w * h, 0)) AS a, -(q0/(q0+q1+q2+q3)*ln(q0/(q0+q1+q2+q3)) + q1/(q0+q1+q2+q3)*ln(q1/(q0+q1+q2+q3)) + q2/(q0+q1+q2+q3)*ln(q2/(q0+q1+q2+q3)) + q3/(q0+q1+q2+q3)*ln(q3/(q0+q1+q2+q3))) / ln(4) AS u,
  cx - w/2 AS x1, cy - h/2 AS y1, cx + w/2 AS x2, cy + h/2 AS y2 FROM proposals),
 classes AS (SELECT class_id, row_number() OVER (ORDER BY class_id) - 1 AS class_pos, 'C' || CAST(class_id AS VARCHAR) AS class_name FROM (SELECT DISTINCT class_id FROM proposals) c),
 oracle AS (SELECT p.pos, p.image_id, CASE WHEN l_returnflag = 'N' THEN 'background' WHEN class_pos < 8 THEN 'known' ELSE 'unknown' END AS kind,
  CASE WHEN l_returnflag = 'N' THEN '' ELSE class_name END AS class_name, CASE WHEN l_returnflag = 'N' THEN -1 ELSE p.image_id * 100 + p.class_id END AS object_id, class_pos
  FROM proposals p JOIN classes c ON p.class_id = c.class_id),
 image_counts AS (SELECT image_id, class_name, count(DISTINCT object_id) AS n FROM oracle WHERE object_id >= 0 GROUP BY 1, 2),
 class_groups AS (SELECT class_name, n, CASE ntile(3) OVER (ORDER BY n DESC, class_name) WHEN 1 THEN 'head' WHEN 2 THEN 'medium' ELSE 'tail' END AS grp
  FROM (SELECT class_name, CAST(sum(n) AS BIGINT) AS n FROM image_counts GROUP BY class_name) x),
 image_cost AS (SELECT i.image_id, CAST(greatest(1, coalesce(sum(c.n), 0)) AS BIGINT) AS cost FROM (SELECT DISTINCT image_id FROM proposals) i LEFT JOIN image_counts c ON c.image_id = i.image_id GROUP BY i.image_id)
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, image_id, box (cx, cy, w, h), objectness, q (posterior weights), vec_id, class_id, returnflag, linestatus."""
    p = read(spark, sf_dir, "lineitem")
    vectors = max(read(spark, sf_dir, "embeddings").count(), 1)
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER))
    mod = lambda c, k: (F.col("l_partkey") * c % k + 1).cast("double")
    return p.select(
        (F.col("l_orderkey") * POSITIONS + number - 1).alias("pos"), F.col("l_orderkey").alias("image_id"),
        ((F.col("l_partkey") % 97).cast("double") / 97).alias("cx"), ((F.col("l_suppkey") % 89).cast("double") / 89).alias("cy"),
        (F.lit(0.05) + F.col("l_quantity") / 100).alias("w"), (F.lit(0.05) + F.col("l_tax") * 5).alias("h"), (F.lit(0.5) + F.col("l_discount") * 5).alias("objectness"),
        F.array(mod(1, 13), mod(2, 13), mod(3, 13), mod(5, 13)).alias("q"), (F.col("l_partkey") % vectors).alias("vec_id"),
        ((F.col("l_partkey") % 6) * (F.col("l_suppkey") % 6)).alias("class_id"), "l_returnflag", "l_linestatus", "l_shipdate",
    )


def classes(p: DataFrame) -> DataFrame:
    """class_id, class_pos, class_name: at most 36 rows."""
    return p.select("class_id").distinct().select("class_id", (F.row_number().over(Window.orderBy("class_id")) - 1).alias("class_pos"), F.concat(F.lit("C"), F.col("class_id").cast("string")).alias("class_name"))


def oracle(p: DataFrame) -> DataFrame:
    """pos, image_id, kind, class_name, object_id, class_pos: what selectors never see."""
    background = F.col("l_returnflag") == "N"
    return p.join(F.broadcast(classes(p)), "class_id").select(
        "pos", "image_id", F.when(background, "background").when(F.col("class_pos") < 8, "known").otherwise("unknown").alias("kind"),
        F.when(background, "").otherwise(F.col("class_name")).alias("class_name"), F.when(background, F.lit(-1).cast("long")).otherwise(F.col("image_id") * 100 + F.col("class_id")).alias("object_id"), "class_pos",
    )


def image_counts(o: DataFrame) -> DataFrame:
    return o.where("object_id >= 0").groupBy("image_id", "class_name").agg(F.countDistinct("object_id").alias("n"))


def class_groups(counts: DataFrame) -> DataFrame:
    """class_name, n, grp: thirds of the classes by count; one row a class."""
    c = counts.groupBy("class_name").agg(F.sum("n").alias("n"))
    third = F.ntile(3).over(Window.orderBy(F.desc("n"), "class_name"))
    return c.select("class_name", "n", F.when(third == 1, "head").when(third == 2, "medium").otherwise("tail").alias("grp"))


def image_cost(p: DataFrame, counts: DataFrame) -> DataFrame:
    priced = counts.groupBy("image_id").agg(F.sum("n").alias("n"))
    return p.select("image_id").distinct().join(priced, "image_id", "left").select("image_id", F.greatest(F.lit(1).cast("long"), F.coalesce("n", F.lit(0))).alias("cost"))
