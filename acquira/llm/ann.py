"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first until calibrated recall."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acquira.llm.shared import Scratch, scratched

#: Rows of the sample that fits the tree (all, if there are fewer), its branching, and the sample rows at which a node stays a leaf.
FIT_ROWS, BRANCH, LEAF_ROWS = 20_000, 8, 32
#: Rows that calibrate the number of leaf visits, held against all rows, and the recall that they have to reach.
CALIBRATION_ROWS, TARGET_RECALL = 400, 0.97
#: Rows and queries that one task compares: leaves are packed into bins of so many rows, larger leaves are cut.
BIN_ROWS, BIN_QUERIES = 4096, 32_768


@dataclass
class Tree:
    """children[i]: numbers and centres of node i's children (none: a leaf); leaf[i]: its leaf number, else -1."""

    children: list[tuple[np.ndarray, np.ndarray] | None]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return sum(x >= 0 for x in self.leaf)

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = 11) -> Tree:
        """Splits unit vectors by spherical k-means, again and again; equal vectors count once."""
        x, rng, tree = np.unique(x, axis=0), np.random.default_rng(seed), cls([], [])

        def grow(rows: np.ndarray) -> int:
            me = len(tree.children)
            tree.children.append(None)
            tree.leaf.append(-1)
            if len(rows) > LEAF_ROWS:
                own = _kmeans(x[rows], BRANCH, rng)
                parts = [rows[own == j] for j in range(BRANCH)]
                parts = [p for p in parts if len(p)]
                if len(parts) > 1:
                    numbers = np.array([grow(p) for p in parts])
                    tree.children[me] = numbers, np.array([_unit(x[p].mean(0)[None])[0] for p in parts])
                    return me
            tree.leaf[me] = tree.leaves
            return me

        grow(np.arange(len(x)))
        return tree

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf at which each unit vector arrives by going to the nearest centre."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.children[node] is None:
                out[rows] = self.leaf[node]
                continue
            numbers, centres = self.children[node]
            own = (x[rows] @ centres.T).argmax(1)
            todo += [(int(c), rows[own == j]) for j, c in enumerate(numbers)]
        return out

    def visits(self, q: np.ndarray, enough) -> list[int]:
        """Leaves in best-bin-first order, until enough(leaves so far) holds or all are visited."""
        heap, found = [(0.0, 0)], []
        while heap and not (found and enough(found)):
            _, node = heapq.heappop(heap)
            if self.children[node] is None:
                found.append(self.leaf[node])
                continue
            numbers, centres = self.children[node]
            for near, c in zip((centres @ q).tolist(), numbers.tolist(), strict=True):
                heapq.heappush(heap, (-near, c))
        return found


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.integers(len(x))][None]
    for _ in range(k - 1):
        far = np.maximum(1 - (x @ centres.T).max(1), 0) ** 2
        if far.sum() <= 0:
            break
        centres = np.vstack([centres, x[rng.choice(len(x), p=far / far.sum())]])
    own = np.zeros(len(x), int)
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        centres = np.array([_unit(x[own == j].mean(0)[None])[0] if (own == j).any() else c for j, c in enumerate(centres)])
    return own


def visits_for(tree: Tree, queries: np.ndarray, neighbours: list[list[int]], recall: float) -> int:
    """Leaf visits at which the leaves of the queries' neighbours are found in the share ``recall``."""
    ranks = []
    for q, leaves in zip(queries, neighbours, strict=True):
        order = {leaf: n + 1 for n, leaf in enumerate(tree.visits(q, lambda f: False))}
        ranks += [order[leaf] for leaf in leaves]
    return int(np.quantile(ranks, recall, method="higher")) if ranks else 1


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores and of what ties with the last of them within 1e-9."""
    edge = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else -np.inf
    return np.flatnonzero((scores >= edge - 1e-9) & (scores > -np.inf))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v double array) of rows that take part: an id, and a vector that isn't null or zero, of finite components.

    Where lengths differ, those of the most frequent length (of two, the shorter) take part.
    """
    v = F.col(vector_col).cast("array<double>")
    df = df.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = df.where(fine & F.exists("v", lambda x: x != 0))
    length = df.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return df.where(F.size("v") == (length[0].n if length else 0))


@scratched
def search(df: DataFrame, *, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scratch: Scratch) -> DataFrame:
    """query_id, rank, id, score: for each row for which ``queries`` holds, its k nearest of all other rows by cosine, as found.

    ``queries`` is a condition on the column ``id``. Ties go to the smaller id. Rows with a query's id aren't its candidates;
    repeated rows under other ids each are, and enough leaves are opened to find k of those. An empty table gives no rows. The tree is fitted on FIT_ROWS rows that a hash picks,
    every row is indexed.
    """
    rows = scratch.write(usable(df, id_col, vector_col))
    id_type = rows.schema["id"].dataType
    out_schema = T.StructType([T.StructField("query_id", id_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])
    sample = rows.select("v").orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toArrow()
    x = _unit(_matrix(sample.column("v")))
    spark = df.sparkSession
    if not len(x):
        return spark.createDataFrame([], out_schema).selectExpr("query_id", "CAST(1 AS INT) AS rank", f"id AS {id_col}", "score")
    tree = Tree.fit(x)
    shared = spark.sparkContext.broadcast(tree)  # at most FIT_ROWS centres
    leaf_field, bin_field = T.StructField("leaf", T.IntegerType()), T.StructField("bin", T.IntegerType())

    def assign(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.assign(_unit(_matrix(b.column(1)))), pa.int32())], ["id", "v", "leaf"])

    index = scratch.write(rows.mapInArrow(assign, T.StructType([*rows.schema.fields, leaf_field])))
    sizes = {r.leaf: r["count"] for r in index.groupBy("leaf").count().collect()}  # at most FIT_ROWS leaves

    # how many leaves are enough, by brute force of a bounded set of rows against all
    probe = rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATION_ROWS).toArrow()
    names, vectors = probe.column("id").to_numpy(), _unit(_matrix(probe.column("v")))
    apart = np.unique(vectors, axis=0, return_index=True)[1]  # copies are found at once and would say that few visits are enough
    probes = spark.sparkContext.broadcast((names[apart], vectors[apart]))
    near_schema = T.StructType([T.StructField("q", T.IntegerType()), leaf_field, T.StructField("score", T.DoubleType())])

    def compare(batches):
        names, q = probes.value
        score, leaf = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
        for b in batches:
            s = q @ _unit(_matrix(b.column(1))).T if b.num_rows else np.zeros((len(q), 0))
            s[names[:, None] == b.column(0).to_numpy()[None, :]] = -np.inf
            every, leaves = np.hstack([score, s]), np.hstack([leaf, np.broadcast_to(b.column(2).to_numpy(), s.shape)])
            top = np.argpartition(-every, k - 1, 1)[:, :k]
            score, leaf = np.take_along_axis(every, top, 1), np.take_along_axis(leaves, top, 1)
        at = np.isfinite(score)
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(at)[0].astype(np.int32)), pa.array(leaf[at].astype(np.int32)), pa.array(score[at])], near_schema.names)

    first = Window.partitionBy("q").orderBy(F.desc("score"))
    held: list[list[int]] = [[] for _ in range(len(apart))]
    for r in index.mapInArrow(compare, near_schema).withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k).collect():
        held[r.q].append(r.leaf)
    n_visits = visits_for(tree, probes.value[1], held, TARGET_RECALL)

    bins: dict[int, tuple[int, int]] = {}  # of each leaf: its first bin and how many it has
    number, filled = 0, 0
    for leaf, n in sorted(sizes.items()):
        if filled and filled + n > BIN_ROWS:
            number, filled = number + 1, 0
        cuts = -(-n // BIN_ROWS)
        bins[leaf] = number, cuts
        number, filled = (number + cuts, 0) if cuts > 1 else (number, filled + n)
    packed = spark.sparkContext.broadcast((bins, sizes))
    asking = rows.where(queries)
    asked_ids = asking.groupBy("id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("copies")).first()
    shares, copies = max(1, -(-asked_ids.rows // BIN_QUERIES)), asked_ids.copies
    visit_schema = T.StructType([bin_field, *rows.schema.fields, T.StructField("leaves", T.ArrayType(T.IntegerType()))])

    def visit(batches):
        tree, (bins, sizes) = shared.value, packed.value
        enough = lambda found: len(found) >= n_visits and sum(sizes.get(f, 0) for f in found) >= max(2 * k + 2, k + copies)
        for b in batches:
            m = _unit(_matrix(b.column(1)))
            where, row, leaves = [], [], []
            for i in range(len(m)):
                own: dict[int, list[int]] = {}
                for f in tree.visits(m[i], enough):
                    if f in bins:
                        for c in range(bins[f][1]):
                            own.setdefault(bins[f][0] + c, []).append(f)
                where += own
                row += [i] * len(own)
                leaves += own.values()
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), b.column(0).take(at), b.column(1).take(at), pa.array(leaves, pa.list_(pa.int32()))], visit_schema.names)

    share = lambda n: F.pmod(F.xxhash64("id", F.lit(2)), F.lit(n)).cast("int").alias("share")
    asked = asking.mapInArrow(visit, visit_schema).select("*", share(shares))
    homes = spark.createDataFrame([(leaf, b, c) for leaf, (b, c) in bins.items()], "leaf int, first int, cuts int")
    there = index.join(F.broadcast(homes), "leaf").select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("cuts"))).cast("int").alias("bin"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "id", "v", "leaf")

    def nearest(bin_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        if not len(bin_rows) or not len(query_rows):
            return pa.table({"query_id": pa.array([], bin_rows["id"].type if len(bin_rows) else query_rows["id"].type), "id": pa.array([], query_rows["id"].type), "score": pa.array([], pa.float64())})
        bin_rows = bin_rows.sort_by("leaf")
        c, q, leaf = _matrix(bin_rows["v"]), _matrix(query_rows["v"]), bin_rows["leaf"].to_numpy()
        ids, names = bin_rows["id"].to_numpy(), query_rows["id"].to_numpy()
        c_norm, q_norm = np.sqrt((c * c).sum(1)), np.sqrt((q * q).sum(1))
        lists, out = query_rows["leaves"].combine_chunks(), []
        offsets, opened = lists.offsets.to_numpy(), lists.values.to_numpy()
        for lo in range(0, len(q), 256):
            hi = min(len(q), lo + 256)
            near = np.full((hi - lo, len(c)), -np.inf)
            who, what = np.repeat(np.arange(hi - lo), np.diff(offsets[lo:hi + 1])), opened[offsets[lo]:offsets[hi]]
            for f in np.unique(what):  # only opened leaves are compared
                rows_of, a, b = who[what == f], *np.searchsorted(leaf, [f, f + 1])
                near[rows_of, a:b] = (q[lo + rows_of] @ c[a:b].T) / q_norm[lo + rows_of, None] / c_norm[a:b]
            for i, s in enumerate(near):
                s[ids == names[lo + i]] = -np.inf
                best = _best(s, ids, k)
                exact = (c[best] * q[lo + i]).sum(1) / (c_norm[best] * q_norm[lo + i])
                best, exact = best[o := np.lexsort((ids[best], -exact))][:k], exact[o][:k]
                out.append((np.full(len(best), names[lo + i]), ids[best], exact))
        return pa.table({n: pa.array(np.concatenate([o[j] for o in out])) for j, n in enumerate(("query_id", "id", "score"))}).cast(pa.schema([("query_id", query_rows["id"].type), ("id", query_rows["id"].type), ("score", pa.float64())]))

    found = there.groupBy("bin", "share").cogroup(asked.groupBy("bin", "share")).applyInArrow(nearest, out_schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
