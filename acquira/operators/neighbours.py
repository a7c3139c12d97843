"""Nearest rows by cosine against a reference, and rows within a radius."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acquira.operators.cells import knn
from acquira.operators.cells import unit as _unit


def nearest_rows(df: DataFrame, reference: DataFrame, *, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and near: (similarity, id) of the k nearest reference rows, similarity rounded to nine places, ties to the smaller id."""
    found, _ = knn(df, reference, k=k, id_col=id_col, vector_col=vector_col)
    return found.select(id_col, F.transform("near", lambda r: F.struct((-r["far"]).alias("similarity"), r["id"].alias("id"))).alias("near"))


def nearest(df: DataFrame, reference: DataFrame, *, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and near: the k greatest cosines to reference rows, descending (fewer, if the reference is smaller).

    A row that is in the reference too meets itself.
    """
    found, _ = knn(df, reference, k=k, id_col=id_col, vector_col=vector_col)
    return found.select(id_col, F.transform("near", lambda r: r["cosine"]).alias("near"))


#: Pivots of a range search, rows of a cell that one task compares, and rows that it compares them with.
PIVOTS, CELL_ROWS = 256, 4096


def within(df: DataFrame, *, eps: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """a, b of rows within eps in cosine distance, both ways, each with itself.

    Rows live in the cell of their nearest pivot (of PIVOTS rows, by hash); a row visits the cells whose ball it can reach, by the
    triangle inequality on unit vectors, so no row is compared with all and no pair is lost. Cells larger than CELL_ROWS are cut.
    """
    spark = df.sparkSession
    reach = float(np.sqrt(2 * max(eps, 0.0))) + 1e-6
    kind = df.schema[key].dataType
    rows = df.select(F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    pivots = _unit(rows.orderBy(F.xxhash64("k"), "k").limit(PIVOTS).select("v").toArrow().column(0))
    shared = spark.sparkContext.broadcast(pivots)
    homed = T.StructType([T.StructField("k", kind), rows.schema["v"], T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])

    def away(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (x @ shared.value.T), 0))

    def house(batches):
        for b in batches:
            d = away(_unit(b.column(1)))
            cell = d.argmin(1) if len(d) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], homed.names)

    from acquira.sources.shared import written

    homes = written(rows.mapInArrow(house, homed))
    balls = {r.cell: (r.far, -(-r.n // CELL_ROWS)) for r in homes.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}  # one row a pivot
    radius = np.array([balls.get(i, (-np.inf, 0))[0] for i in range(len(pivots))])
    visit = T.StructType([T.StructField("k", kind), rows.schema["v"], T.StructField("cell", T.IntegerType())])

    def call(batches):
        for b in batches:
            who, cell = np.nonzero(away(_unit(b.column(1))) <= radius + reach)
            take = pa.array(who)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(cell.astype(np.int32))], visit.names)

    cuts = F.create_map(*[F.lit(x) for c, (_, m) in balls.items() for x in (c, m)]) if balls else F.create_map().cast("map<int,int>")
    part = F.pmod(F.xxhash64("k"), F.element_at(cuts, F.col("cell"))).cast("int")
    visitors = homes.select("k", "v").mapInArrow(call, visit).withColumn("part", F.explode(F.sequence(F.lit(0), F.element_at(cuts, F.col("cell")) - 1)))
    visitors = visitors.withColumn("share", F.pmod(F.xxhash64("k", F.lit(1)), F.element_at(cuts, F.col("cell"))).cast("int"))
    there = homes.select("k", "v", "cell", part.alias("part")).withColumn("share", F.explode(F.sequence(F.lit(0), F.element_at(cuts, F.col("cell")) - 1)))
    pairs = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table([left["k"].slice(0, 0), left["k"].slice(0, 0)], pairs.names)
        x, y, ka, kb, out = _unit(left["v"]), _unit(right["v"]), left["k"].combine_chunks(), right["k"].combine_chunks(), []
        same = ka.to_numpy(zero_copy_only=False)
        for lo in range(0, len(x), 512):
            i, j = np.nonzero((1 - x[lo:lo + 512] @ y.T <= eps + 1e-9) | (same[lo:lo + 512, None] == kb.to_numpy(zero_copy_only=False)[None, :]))
            out.append(pa.table([ka.take(pa.array(i + lo)), kb.take(pa.array(j))], pairs.names))
        return pa.concat_tables(out)

    by = ["cell", "part", "share"]
    return visitors.groupBy(*by).cogroup(there.groupBy(*by)).applyInArrow(compare, pairs)
