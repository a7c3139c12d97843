"""Whitening of vectors by column aggregates of the upper triangle.

Each entry becomes a whole number; the fit list holds each distinct vector once. One aggregation gives its size and the sums of the
dimensions, a second one the sum of centred products for every pair of dimensions, by generated expressions: dimensions are taken in
blocks of TILE, a vector is dealt to the pairs of blocks of the upper triangle, and TILE * TILE sums for each pair of blocks cover its
pairs of dimensions. So the generated code has one size for any number of dimensions; one expression for each of 2,080 pairs (of 64
dimensions) took the JVM's compiler 142 CPU seconds before any row. The covariance is assembled from these sums, a row for each pair
of blocks, and decomposed by LAPACK on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acquira.llm.shared import Scratch, scratched

#: Dimensions of a block.
TILE = 8


@dataclass
class Model:
    """What the fit list says: its size, each dimension's sum, and the components by falling eigenvalue (a row of ``vectors`` each)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def means(self) -> list[float]:
        return [s / self.n for s in self.sums]

    @property
    def explained(self) -> list[float]:
        return (self.values / self.trace).tolist()


def number(x: float) -> str:
    return f"({float(x)!r}D)"


def whole(df: DataFrame, *, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, x (array of long): floor(scale * entry) of every vector that isn't null, empty or holding null or non-finite entries.

    Where lengths differ, those of the most frequent length (of two, the shorter) take part.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (length[0].n if length else 0)).select("id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale))) + F.lit(0).cast("long")).alias("x"))


def doubles(values) -> str:
    return f"array({', '.join(map(number, values))})"


def centred(column: str, means: list[float]) -> str:
    """SQL: the entries of an array less their means, unrounded."""
    return f"zip_with({column}, {doubles(means)}, (c, m) -> c - m)"


def products(vectors: DataFrame, column: str, means: list[float]) -> np.ndarray:
    """Sums of the centred products of every pair of the column's d dimensions: a symmetric matrix."""
    d = len(means)
    blocks = -(-d // TILE)
    pairs = ", ".join(f"named_struct('i', {i}, 'j', {j})" for i in range(blocks) for j in range(i, blocks))
    dealt = vectors.selectExpr(f"{centred(column, means)} AS c", f"explode(array({pairs})) AS at")
    side = lambda name, at: [f"coalesce(get(c, at.{at} * {TILE} + {p}), 0D) AS {name}{p}" for p in range(TILE)]
    dealt = dealt.selectExpr("at.i AS i", "at.j AS j", *side("u", "i"), *side("v", "j"))
    sums = dealt.groupBy("i", "j").agg(*(F.expr(f"sum(u{p} * v{q})").alias(f"s{p}_{q}") for p in range(TILE) for q in range(TILE)))
    out = np.zeros((blocks * TILE, blocks * TILE))
    for r in sums.collect():  # a row for each pair of blocks
        block = np.array([[r[f"s{p}_{q}"] for q in range(TILE)] for p in range(TILE)])
        out[r.i * TILE:(r.i + 1) * TILE, r.j * TILE:(r.j + 1) * TILE] = block
        out[r.j * TILE:(r.j + 1) * TILE, r.i * TILE:(r.i + 1) * TILE] = block.T
    return out[:d, :d]


def projected(column: str, model: Model) -> str:
    """SQL: the whitened components of an array of whole numbers."""
    scaled = model.vectors / np.sqrt(model.values)[:, None]
    one = [f"aggregate(zip_with(c, {doubles(v)}, (x, y) -> x * y), 0D, (a, t) -> a + t)" for v in scaled]
    return f"transform(array({centred(column, model.means)}), c -> array({', '.join(one)}))[0]"


def fit(vectors: DataFrame, *, components: int) -> Model | None:
    """The model of distinct vectors x; None without any. Components whose eigenvalue is nought, to rounding, are left out."""
    first = vectors.limit(1).collect()
    if not first:
        return None
    d = len(first[0].x)
    head = vectors.selectExpr("count(*) AS n", *(f"sum(x[{i}]) AS s{i}" for i in range(d))).first()
    n, sums = int(head.n), [int(head[f"s{i}"]) for i in range(d)]
    covariance = products(vectors, "x", [s / n for s in sums]) / n
    values, basis = np.linalg.eigh(covariance)
    values, basis, trace = values[::-1], basis[:, ::-1].T, float(np.trace(covariance))
    held = min(components, int((values > trace * d * np.finfo(float).eps).sum()))
    values, basis = values[:held], basis[:held]
    sign = np.sign(basis[np.arange(held), np.abs(basis).argmax(1)])
    model = Model(n, sums, values, basis * sign[:, None], trace)
    if held:
        w = vectors.selectExpr(f"{projected('x', model)} AS w")
        mean = w.selectExpr(*(f"avg(w[{k}]) AS m{k}" for k in range(held))).first()
        model.identity_error = float(np.abs(products(w, "w", list(mean)) / n - np.eye(held)).max())
    return model


@scratched
def whiten(df: DataFrame, *, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", scratch: Scratch) -> DataFrame:
    """id, n, deviation, whitened and explained (arrays by component), identity_error of every vector that takes part (see ``whole``).

    Rows that repeat an id or a vector each come back; the fit counts a vector once. Null ids stay null. Fewer components come back
    than asked for where there are fewer dimensions or the vectors span fewer; none, with empty arrays, where all vectors are the same.
    deviation is exact, or the query fails with an overflow. An empty table, or one without usable vectors, gives no rows.
    """
    rows = scratch.write(whole(df, scale=scale, id_col=id_col, vector_col=vector_col))
    vectors = scratch.write(rows.select("x").distinct())
    model = fit(vectors, components=components)
    if model is None:
        out = rows.select(F.col("id").alias(id_col), *(F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("deviation", "long"), ("whitened", "array<double>"), ("explained", "array<double>"), ("identity_error", "double"))))
        return out
    off = f"zip_with(x, array({', '.join(f'({s}L)' for s in model.sums)}), (c, s) -> c * {model.n}L - s)"
    whitened = projected("x", model) if len(model.values) else "CAST(array() AS array<double>)"
    return rows.selectExpr(f"id AS `{id_col}`", f"{model.n}L AS n", f"aggregate({off}, 0L, (a, e) -> a + e * e) AS deviation", f"{whitened} AS whitened").select(
        "*", F.array(*(F.lit(e) for e in model.explained)).cast("array<double>").alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def by_component(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """A row for each vector and component, numbered from 1."""
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    return whitened.select(id_col, "n", "deviation", "identity_error", pairs).select(id_col, (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
