"""Writers of results: tables, reports, lists and canonical JSON."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acquira.sources.shared import written

MARKERS = ("train", "ft", "val", "test")


def write_csv(parts: Iterable[DataFrame], path: str) -> None:
    """All parts in one file with the columns that any of them has, in the order of first sight."""
    out = None
    for d in parts:
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    out.coalesce(1).write.mode("overwrite").csv(path, header=True)


def _rows(df: DataFrame, limit: int) -> list:
    """All rows; more than ``limit`` raise."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report table holds {limit} rows at most")
    return rows


def _cell(v: object, digits: int) -> str:
    return "—" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)


def to_markdown(df: DataFrame, *, digits: int = 2, limit: int = 1000) -> str:
    """A report table as Markdown; missing is a dash. More than ``limit`` rows raise."""
    rows = [[_cell(v, digits) for v in r] for r in _rows(df, limit)]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows]) + "\n"


def to_latex(df: DataFrame, *, digits: int = 2, limit: int = 1000) -> str:
    safe = lambda s: "".join("\\" + c if c in "&%$#_{}" else c for c in s)
    rows = [[safe(_cell(v, digits)) for v in r] for r in _rows(df, limit)]
    body = [" & ".join(map(safe, df.columns)) + r" \\", r"\midrule", *(" & ".join(r) + r" \\" for r in rows)]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", r"\toprule", *body, r"\bottomrule", r"\end{tabular}", ""])


def to_text(df: DataFrame, *, digits: int = 2, limit: int = 1000) -> str:
    """A report table as plain text: columns padded to their widest cell, two spaces between."""
    rows = [df.columns, *[[_cell(v, digits) for v in r] for r in _rows(df, limit)]]
    wide = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)).rstrip() for r in rows) + "\n"


def canonical_json(value: object) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def write_json(value: Mapping, path: str) -> str:
    """Writes beside and renames, so that a reader never sees half; returns the SHA-256 of the canonical form."""
    beside = f"{path}.new"
    with open(beside, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True, ensure_ascii=False)
    os.replace(beside, path)
    return hashlib.sha256(canonical_json(value)).hexdigest()


def write_once(value: Mapping, path: str) -> str:
    """write_json where nothing is; what is there already has to have the same canonical form, else this raises."""
    digest = hashlib.sha256(canonical_json(value)).hexdigest()
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if hashlib.sha256(canonical_json(json.load(f))).hexdigest() != digest:
                raise ValueError(f"{path} holds something else")
        return digest
    return write_json(value, path)


def write_compressed(value: Mapping, path: str) -> str:
    """Canonical JSON in gzip without a time or a name, so that equal values make equal files; returns the digest of the JSON."""
    raw = canonical_json(value)
    with open(f"{path}.new", "wb") as f:
        f.write(gzip.compress(raw, mtime=0))
    os.replace(f"{path}.new", path)
    return hashlib.sha256(raw).hexdigest()


def read_compressed(path: str, digest: str | None = None) -> object:
    """What write_compressed wrote; another digest than the one named raises."""
    with gzip.open(path, "rb") as f:
        raw = f.read()
    if digest is not None and hashlib.sha256(raw).hexdigest() != digest:
        raise ValueError(f"{path} has another digest")
    return json.loads(raw)


def check_split_name(name: str, purpose: str = "test") -> str:
    """The name, if the marker of its purpose is the only one that it holds; readers go by the markers, so all else raises."""
    if purpose not in MARKERS:
        raise ValueError(f"{purpose!r} isn't one of {MARKERS}")
    found = [m for m in MARKERS if m in name]
    if found != [purpose]:
        raise ValueError(f"{name!r} holds {found}, not only {purpose!r}")
    return name


def write_image_set(images: DataFrame, path: str, name: str, purpose: str = "test") -> None:
    check_split_name(name, purpose)
    images.select(F.col("image_id").cast("string").alias("value")).distinct().orderBy("value").coalesce(1).write.mode("overwrite").text(path)


#: Images, or boxes, of a JSON file that a task makes in memory.
FILE_IMAGES, FILE_BOXES = 20_000, 100_000


def _one_file_each(documents: DataFrame, path: str) -> None:
    """Documents (part, value) as text, each in a file of its own: readers take a file for one JSON document."""
    documents.write.mode("overwrite").partitionBy("part").text(path)


def write_counts(counts: DataFrame, path: str, *, files: int | None = None) -> None:
    """image_id, class_name, n as JSON {image: {class: n}}, the images dealt over files by hash (8, or more for many images)."""
    images = written(counts.groupBy("image_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_name", "n")))).alias("c")))
    files = files or max(8, -(-images.count() // FILE_IMAGES))
    part = images.groupBy(F.pmod(F.xxhash64("image_id"), F.lit(files)).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct("image_id", "c"))).alias("m"))
    _one_file_each(part.select("part", F.to_json("m").alias("value")), path)


def write_detections(truths: DataFrame, found: DataFrame, path: str, schema_name: str, *, files: int | None = None) -> None:
    """Truths (image_id, class_name, box) and detections (also score) as artefacts, the images dealt over files by hash (8, or more for many boxes)."""
    corners = lambda d: written(d.withColumn("box", F.array(*[F.col("box")[c] for c in ("x1", "y1", "x2", "y2")])))
    truths, found = corners(truths), corners(found)
    files = files or max(8, -(-(truths.count() + found.count()) // FILE_BOXES))
    part = F.pmod(F.xxhash64("image_id"), F.lit(files)).alias("part")
    a = truths.groupBy(part).agg(F.collect_list(F.struct("image_id", "class_name", "box")).alias("ground_truth"))
    b = found.groupBy(part).agg(F.collect_list(F.struct("image_id", "class_name", "score", "box")).alias("detections"))
    d = a.join(b, "part", "full").select("part", F.lit(schema_name).alias("schema"), F.lit("unknown").alias("unknown_class_name"), "ground_truth", "detections")
    _one_file_each(d.select("part", F.to_json(F.struct("schema", "unknown_class_name", "ground_truth", "detections")).alias("value")), path)


def annotation_xml(objects: DataFrame) -> DataFrame:
    """image_id, content: an annotation's XML from (image_id, width, height, place, class_name, xmin, ymin, xmax, ymax).

    Objects stand in the order of place; an image without any has an empty annotation if it has a row with a null class.
    """
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), c.cast("string"), F.lit(f"</{n}>"))
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    one = F.concat(F.lit("<object>"), tag("name", safe(F.col("class_name"))), F.lit("<difficult>0</difficult><bndbox>"), *[tag(c, F.col(c)) for c in ("xmin", "ymin", "xmax", "ymax")], F.lit("</bndbox></object>"))
    listed = F.array_sort(F.collect_list(F.when(F.col("class_name").isNotNull(), F.struct("place", one.alias("x")))))
    d = objects.groupBy("image_id", "width", "height").agg(F.array_join(F.transform(listed, lambda s: s["x"]), "").alias("o"))
    size = F.concat(F.lit("<annotation><size>"), tag("width", F.col("width")), tag("height", F.col("height")), F.lit("<depth>3</depth></size>"))
    return d.select("image_id", F.concat(size, F.col("o"), F.lit("</annotation>")).alias("content"))


def filtered_annotations(objects: DataFrame, keep: DataFrame, *, alias: bool = False) -> DataFrame:
    """XML of the objects whose (image_id, place) are kept; with ``alias`` under the images' alias ids. An image without any goes."""
    from acquira.functions.text import alias_id

    d = objects.join(keep.select("image_id", "place").distinct(), ["image_id", "place"], "left_semi")
    return annotation_xml(d.withColumn("image_id", alias_id(F.col("image_id"))) if alias else d)


def curve_series(df: DataFrame, arm: str, x: str, y: str) -> DataFrame:
    """What a plot of curves draws: arm, place, x, y in the order of x; the arms' points aren't thinned."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(arm).orderBy(x, y)) - 1
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(arm).alias("arm"), place.alias("place"), F.col(x).alias("x"), F.col(y).alias("y"))
