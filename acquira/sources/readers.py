"""Readers of the artefacts that a campaign produces: pools, counts, annotations, lists, results, metrics, logs, detections."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acquira.functions import boxes, vec
from acquira.functions.text import canonical_name
from acquira.sources import archives

#: Cells of a result file that hold nothing.
MISSING = ["", "—", "None", "nan", "NaN"]
_XML = "size struct<width:int,height:int,depth:int>, object array<struct<name:string,difficult:int,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"


def pool_to_parquet(spark: SparkSession, archive: str, out: str, version: str | None = None) -> None:
    """Pools of named arrays (.npz) as a table: one row a candidate, vectors as arrays, ``query`` the row's place.

    Half floats become floats; archives of another version are refused. Tasks read ranges of rows.
    """
    d = archives.read_vectors(spark, archive, version=version)
    (d.drop("row") if "query" in d.columns else d.withColumnRenamed("row", "query")).write.parquet(out)


def read_pool(spark: SparkSession, path: str, *, split: str | None = None) -> DataFrame:
    """Candidates of a split: posterior of shares from its bytes, unit embedding; an empty split raises when it is read."""
    d = spark.read.parquet(path)
    if split is not None:
        d = d.where(F.col("split") == split)
    if "posterior_q" in d.columns:
        d = d.withColumn("posterior", vec.dequantise(F.col("posterior_q"))).drop("posterior_q")
    if "embedding" in d.columns:
        d = d.withColumn("embedding", vec.unit(F.col("embedding")))
    if d.isEmpty():
        raise ValueError(f"no rows of split {split!r} in {path}")
    return d


def unique_keys(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """df, refused if a key occurs twice or the number of rows isn't as stated."""
    n, d = df.agg(F.count("*"), F.count_distinct(key)).first()
    if n != d or (rows is not None and n != rows):
        raise ValueError(f"{n} rows with {d} keys, {rows if rows is not None else n} expected")
    return df


def align(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """target's rows with source's columns; a key that source lacks raises."""
    d = target.join(source.withColumn("_there", F.lit(True)), key, "left")
    return d.withColumn("_there", F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("missing key: "), F.col(key).cast("string")))).otherwise(F.col("_there"))).where("_there").drop("_there")


def read_counts(spark: SparkSession, path: str, *, classes: list[str] | None = None) -> DataFrame:
    """image_id, class_name, n from JSON {image: {class: n}} (gzip too); wrong ids, classes and counts raise."""
    text = spark.read.text(path, wholetext=True)
    d = text.select(F.explode(F.from_json("value", "map<string,map<string,int>>")).alias("image_id", "c")).select("image_id", F.explode("c").alias("class_name", "n"))
    d = d.withColumn("class_name", canonical_name(F.col("class_name")))
    good = F.col("image_id").rlike("^[0-9]{12}$") & (F.col("n") > 0)
    if classes is not None:
        good &= F.col("class_name").isin(classes)
    return d.withColumn("n", F.when(good, F.col("n")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("bad count:"), "image_id", "class_name", F.col("n").cast("string")))))


def _objects(d: DataFrame) -> DataFrame:
    x = d.withColumn("x", F.from_xml("content", _XML)).select("image_id", "x.size.width", "x.size.height", F.posexplode("x.object").alias("place", "o"))
    x = x.select("image_id", "width", "height", "place", canonical_name(F.col("o.name")).alias("class_name"), *[F.col(f"o.bndbox.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    return x.withColumn("ordinal", F.row_number().over(Window.partitionBy("image_id", "class_name").orderBy("place")) - 1)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Objects of XML annotations in document order, numbered by image and class."""
    d = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), "^(.*)\\.xml$", 1).alias("image_id"), F.col("value").alias("content"))
    return _objects(d)


def parse_annotations(df: DataFrame) -> DataFrame:
    """Objects of (image_id, content): XML annotations that are in a table already."""
    return _objects(df.select("image_id", "content"))


def relative_boxes(objects: DataFrame) -> DataFrame:
    """objects with cx, cy, w, h as shares of the image."""
    x1, y1, x2, y2 = (F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    return objects.withColumns(dict(zip(("cx", "cy", "w", "h"), boxes.centred(x1, y1, x2, y2, F.col("width"), F.col("height")), strict=True)))


def image_classes(objects: DataFrame, total: int | None = None) -> DataFrame:
    """image_id, classes: the names on each image, in order; another number of objects than stated raises."""
    if total is not None and (n := objects.count()) != total:
        raise ValueError(f"{n} objects, {total} expected")
    return objects.groupBy("image_id").agg(F.array_sort(F.collect_set("class_name")).alias("classes"))


def read_annotation_archive(spark: SparkSession, path: str) -> DataFrame:
    """The same from tar archives of XML files; an archive's headers are read first, then ranges of its members by tasks of their own."""
    members = archives.tar_members(archives.tar_index(spark, path, ".xml"))
    return _objects(members.select(F.regexp_extract("name", "([^/]*)\\.xml$", 1).alias("image_id"), F.decode("content", "UTF-8").alias("content")))


def annotation_counts(objects: DataFrame, keep: list[str] | None = None) -> DataFrame:
    d = objects if keep is None else objects.where(F.col("class_name").isin(keep))
    return d.groupBy("image_id", "class_name").agg(F.count("*").alias("n"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-blank lines, trimmed, with the place of their first occurrence."""
    d = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("place", "id")).select(F.trim("id").alias("id"), "place")
    return d.where("id <> ''").groupBy("id").agg(F.min("place").alias("place"))


def _typed(d: DataFrame) -> DataFrame:
    return d.select(*[F.when(F.trim(c).isin(MISSING), None).otherwise(F.trim(c)).alias(c) if t == "string" else F.col(c) for c, t in d.dtypes])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A result file: empty marks are NULL, a column of numbers is numeric; no rows raise."""
    raw = _typed(spark.read.csv(path, header=True))
    if raw.isEmpty():
        raise ValueError(f"no rows in {path}")
    kinds = raw.agg(*[F.struct(F.bool_and(F.col(c).rlike("^[+-]?[0-9]+$")).alias("i"), F.bool_and(F.try_to_number(F.col(c), F.lit("S999999999999999D999999999999")).isNotNull() | F.col(c).rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$")).alias("f")).alias(c) for c in raw.columns]).first()
    cast = lambda c: F.col(c).cast("long") if kinds[c].i else F.col(c).cast("double") if kinds[c].f else F.col(c)
    return raw.select(*[cast(c).alias(c) for c in raw.columns])


def read_arms(spark: SparkSession, root: str, pattern: str = "results_*.csv") -> DataFrame:
    """All result files below root; the arm is named by the file, columns that a file lacks are NULL."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path").collect()
    out, seen = None, set()
    for r in sorted(names):
        arm = r.path.rsplit("/", 1)[-1].removeprefix("results_").removesuffix(".csv")
        if arm in seen:
            raise ValueError(f"two files of arm {arm}")
        seen.add(arm)
        d = read_results(spark, r.path).withColumn("arm", F.lit(arm))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no result files below {root}")
    return out


def read_metrics(spark: SparkSession, path: str, class_order: list[str]) -> DataFrame:
    """class_name, ap50 of evaluator JSON: entries 3 to 82 of its 83 are the classes, the last is unknown; other lengths give no rows."""
    d = spark.read.json(path, multiLine=True).select(F.col("coco_eval_bbox").alias("v")).where(F.size("v") == 83)
    names = F.array(*[F.lit(c) for c in class_order])
    known = d.select(F.explode(F.arrays_zip(names.alias("class_name"), F.slice("v", 3, len(class_order)).alias("ap50"))).alias("x")).select("x.class_name", "x.ap50")
    return known.unionByName(d.select(F.lit("unknown").alias("class_name"), F.element_at("v", -1).alias("ap50")))


def parse_log(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """One row: each field's last number in an evaluator's log, wrappers like np.float64(..) and tensor(..) taken off; else NULL."""
    plain = F.regexp_replace("value", r"(?:np\.float64|tensor|float)\(([^()]*)\)", "$1")
    number = r"\s*[:=]\s*([+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?)"
    last = lambda p: F.try_element_at(F.regexp_extract_all("v", F.lit(f"(?m){p}{number}"), 1), F.lit(-1)).cast("double")
    return spark.read.text(path, wholetext=True).select(plain.alias("v")).select(*[last(p).alias(n) for n, p in fields.items()])


def read_detections(spark: SparkSession, path: str, schema_name: str) -> tuple[DataFrame, DataFrame]:
    """Truths and detections of an artefact with boxes as structs; another schema raises."""
    item = "image_id string, class_name string, box array<double>"
    d = spark.read.schema(f"schema string, unknown_class_name string, ground_truth array<struct<{item.replace(' string', ':string').replace('box array', 'box:array')}>>, detections array<struct<image_id:string,class_name:string,score:double,box:array<double>>>").json(path, multiLine=True)
    d = d.withColumn("schema", F.when(F.col("schema") == schema_name, F.col("schema")).otherwise(F.raise_error(F.concat(F.lit("unknown schema "), F.coalesce("schema", F.lit("none"))))))
    box = F.struct(*[F.col("o.box")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]).alias("box")
    rows = lambda c, *more: d.where("schema IS NOT NULL").select(F.posexplode(c).alias("pos", "o")).select("pos", "o.image_id", "o.class_name", *more, box)
    return rows("ground_truth"), rows("detections", "o.score")


def tagged_block(text: str, tag: str) -> dict:
    """The one JSON block of a Markdown text under a tag; none or several raise."""
    parts = text.split(f"```json {tag}\n")
    if len(parts) != 2:
        raise ValueError(f"{len(parts) - 1} blocks tagged {tag}")
    return json.loads(parts[1].split("```", 1)[0])


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """class_name, grp, n of a CSV of classes; a class that occurs twice and a group that isn't known raise."""
    d = spark.read.csv(path, header=True, schema="class_name string, grp string, n long").withColumn("class_name", canonical_name(F.col("class_name")))
    rows, names = d.agg(F.count("*"), F.count_distinct("class_name")).first()
    if rows != names:
        raise ValueError(f"{rows} rows for {names} classes")
    return d.withColumn("grp", F.when(F.col("grp").isin("head", "medium", "tail"), F.col("grp")).otherwise(F.raise_error(F.concat(F.lit("no group "), F.coalesce("grp", F.lit("none"))))))


def read_trajectory(spark: SparkSession, path: str, keys: list[str], *, status: str = "complete") -> DataFrame:
    """Rows of a trajectory's CSV with the status (all, without such a column); a key that occurs twice raises."""
    d = read_results(spark, path)
    if "status" in d.columns:
        d = d.where(F.col("status") == status)
    twice = d.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"more than one row of {twice[0].asDict()}")
    return d


def reference_blocks(df: DataFrame, *, task: int, run: str, vector: str = "embedding") -> DataFrame:
    """Vectors that earlier tasks of a run have left, the latest task first; empty ones are dropped."""
    return df.where((F.col("task") < task) & (F.col("run") == run) & (F.size(vector) > 0))


def read_runs(spark: SparkSession, root: str, class_order: list[str], *, include: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Results (run, columns of any file) and values (run, task, class_name, ap50) of all runs below root, a folder a run.

    A run is a folder with a results_*.csv of one row or more; its tasks' metrics.json lie in folders named after the task, and may
    be missing. Files are listed by their names alone; there are few runs.
    """
    at = lambda pattern: sorted(r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path").collect())
    rows, values = None, None
    for path in at("results_*.csv"):
        name = path.rsplit("/", 2)[-2]
        if include is None or name in include:
            d = read_results(spark, path).withColumn("run", F.lit(name))
            rows = d if rows is None else rows.unionByName(d, allowMissingColumns=True)
    if rows is None:
        raise ValueError(f"no runs below {root}")
    known = {r.run for r in rows.select("run").distinct().collect()}
    for path in at("metrics.json"):
        run, folder = path.rsplit("/", 3)[-3:-1]
        if run in known:
            d = read_metrics(spark, path, class_order).select(F.lit(run).alias("run"), F.lit(folder.partition("_")[0]).alias("task"), "class_name", "ap50")
            values = d if values is None else values.unionByName(d)
    return rows, values if values is not None else spark.createDataFrame([], "run string, task string, class_name string, ap50 double")
