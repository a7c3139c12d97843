"""Exact deduplication by a content sort.

A text's content is its bytes without white space. Rows are range-partitioned by a key of bounded length that starts with the
content's first characters and goes on with a hash, at splitters that Spark samples; the ranges are sorted on disk by key and whole
content, so equal contents are neighbours, the row that stays first. Each row is compared, byte for byte, with the one before it.

The sort key ends with the order of preference, so the splitters cut a large group of copies too, wherever it is larger than a
range: no range holds more than its share. The pieces of a group that was cut touch their range's first or last row; these, two a
range at most, are joined by their contents afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acquira.llm.shared import Scratch, batch_rows, column_bytes, scratched, shuffle_partitions

#: The characters that don't count, in SQL's and regular expressions' terms ``[\\x20\\x09-\\x0D]``.
SPACE = " \t\n\x0b\x0c\r"
#: Characters of content in the key that ranges are cut by.
HEAD = 32
#: Rows of a batch of sorted rows: few, as single texts may be long.
BATCH_ROWS = 500

_FOUND = T.StructType([
    T.StructField("rng", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("id", T.LongType()), T.StructField("first", T.BooleanType()), T.StructField("keep_id", T.LongType()),
    T.StructField("chars", T.LongType()), T.StructField("size", T.LongType()), T.StructField("sha", T.BinaryType()), T.StructField("edge", T.BooleanType()), T.StructField("edge_content", T.BinaryType()),
])


def content(text: Column) -> Column:
    """A text without white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


class _Run:
    """Rows of one content: what their first row says, and how many there are so far."""

    def __init__(self, number: int, data: bytes, keep_id: int | None, chars: int):
        self.number, self.data, self.keep_id, self.chars, self.size = number, data, keep_id, chars, 0
        self.parts: list[pa.Table] = []


def same_as_before(raw: np.ndarray, offsets: np.ndarray, before: bytes | None) -> np.ndarray:
    """Whether each row's bytes are those of the row before it, the first one's those of ``before``."""
    size = np.diff(offsets)
    same = np.zeros(len(size), bool)
    maybe = np.flatnonzero(size[1:] == size[:-1]) + 1
    for i in maybe:
        same[i] = np.array_equal(raw[offsets[i]:offsets[i + 1]], raw[offsets[i - 1]:offsets[i]])
    if len(size) and before is not None:
        same[0] = raw[offsets[0]:offsets[1]].tobytes() == before
    return same


def sorted_runs(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted range (content, chars, id, carried columns) with what is known of their runs.

    Of a run's rows, all but content are kept until its end; a content is kept once.
    """
    run: _Run | None = None
    number = 0

    def close(r: _Run, last: bool) -> Iterator[pa.RecordBatch]:
        edge, head = r.number == 0 or last, True
        sha = hashlib.sha256(r.data).digest()
        for t in r.parts:
            n = len(t)
            put = lambda v, kind: pa.repeat(pa.scalar(v, kind), n)  # noqa: B023, E731
            first = np.zeros(n, bool)
            first[0] = head
            shown = pa.array([r.data if edge and head else None, *[None] * (n - 1)], pa.binary())
            head = False
            cols = [put(place, pa.int32()), put(r.number, pa.int64()), t["id"].combine_chunks(), pa.array(first), put(r.keep_id, pa.int64()), put(r.chars, pa.int64()), put(r.size, pa.int64()), put(sha, pa.binary()), put(edge, pa.bool_()), shown]
            rest = [t[c].combine_chunks() for c in t.column_names if c not in ("id", "chars")]
            yield from pa.table([*cols, *rest], [*_FOUND.names, *(c for c in t.column_names if c not in ("id", "chars"))]).to_batches()

    for b in batches:
        if not b.num_rows:
            continue
        raw, offsets = column_bytes(b.column(0))
        rest = pa.Table.from_batches([b]).drop_columns(["content"])
        new = ~same_as_before(raw, offsets, run.data if run else None)
        cuts = sorted({0, *np.flatnonzero(new).tolist(), b.num_rows})
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if new[lo]:
                if run:
                    yield from close(run, False)
                run = _Run(number, raw[offsets[lo]:offsets[lo + 1]].tobytes(), rest["id"][lo].as_py(), rest["chars"][lo].as_py())
                number += 1
            run.parts.append(rest.slice(lo, hi - lo))
            run.size += hi - lo
    if run:
        yield from close(run, True)


@scratched
def content_groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), scratch: Scratch) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 of every row, then the columns named in ``carry``.

    Rows whose texts have the same content are a group; the one with the most code points in its text stays, of several the one with
    the smallest id, null last. Null texts are empty ones; all rows without content are one group. Of rows that tie in everything, one
    stays. ids are read as long. An empty table stays empty; columns that aren't named are not read. A single text has to fit in a
    batch of the executor's Python worker.
    """
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    text = F.col(text_col)
    carried = [f"carried_{i}" for i in range(len(carry))]
    rows = df.select(content(text).alias("content"), F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("chars"), F.col(id_col).cast("long").alias("id"), *(F.col(c).alias(a) for c, a in zip(carry, carried, strict=True)))
    rows = rows.withColumns({"head": F.substring("content", 1, HEAD), "hash": F.xxhash64("content")})
    prefer = [F.desc("chars"), F.asc_nulls_last("id")]
    ranges = rows.repartitionByRange(n, "head", "hash", *prefer)
    ordered = ranges.sortWithinPartitions("head", "hash", "content", *prefer).select("content", "chars", "id", *carried)
    schema = T.StructType([*_FOUND.fields, *(ordered.schema[c] for c in carried)])

    def compare(batches):
        for b in sorted_runs(batches, TaskContext.get().partitionId()):
            yield b.cast(target) if b.schema != target else b

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    with batch_rows(spark, BATCH_ROWS):
        found = scratch.write(ordered.mapInArrow(compare, schema))
    # runs that touch an end of their range, a row each
    ends = found.where("edge_content IS NOT NULL").select("rng", "run", "keep_id", "chars", "size", "edge_content")
    group = Window.partitionBy("edge_content")
    best = F.min(F.struct(-F.col("chars"), F.col("keep_id").isNull(), "keep_id", F.col("rng"))).over(group)
    joined = ends.select("rng", "run", F.sum("size").over(group).alias("whole"), best.alias("best")).select("rng", "run", "whole", F.col("best.keep_id").alias("best_id"), F.col("best.rng").alias("best_rng"), F.lit(True).alias("edge"))
    joined = scratch.write(joined)  # two rows a range at most: broadcast
    out = found.drop("edge_content").join(F.broadcast(joined), ["rng", "run", "edge"], "left")
    at_edge = F.col("edge")
    out = out.select(
        F.col("id").alias(id_col), F.when(at_edge, F.col("best_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(at_edge, F.col("whole")).otherwise(F.col("size")).alias("group_size"),
        (F.col("first") & (~at_edge | (F.col("best_rng") == F.col("rng")))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), *(F.col(a).alias(c) for c, a in zip(carry, carried, strict=True)),
    )
    return out


def drop_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns."""
    names = {f"c{i}": c for i, c in enumerate(df.columns)}  # carried under names that meet no others
    rows = df.select(F.col(id_col).alias("row"), F.col(text_col).alias("body"), *(F.col(c).alias(a) for a, c in names.items()))
    out = content_groups(rows, id_col="row", text_col="body", carry=list(names))
    return out.where("kept").select(*(F.col(a).alias(c) for a, c in names.items()))


def oracle() -> str:
    """The result in DuckDB's SQL."""
    return """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS content FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY content) AS group_size, row_number() OVER w = 1 AS kept, sha256(content) AS text_sha256
FROM d WINDOW w AS (PARTITION BY content ORDER BY chars DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
