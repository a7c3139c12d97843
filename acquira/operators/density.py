"""Hierarchical density clustering: core distances, a minimum spanning tree by Boruvka's rounds, the condensed tree and its stabilities.

The distance of two rows is the greatest of their own and of both core distances; a row's core distance is that within which ``size``
rows lie, itself included. Equal vectors are one point with a weight. Searches go by cells around pivots; in each round every
component finds its least link to another one, first in its rows' own cells, then in those that this bounds. The tree's links are
brought to the driver in ascending order, PASS at a time, with what the components are that they join; clusters are few beside rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acquira.operators.cells import HELD, SLACK, Cells, Mask, allowed, by_vector, directions, masked, meeting, numbers
from acquira.operators.graph import components
from acquira.sources.shared import written

#: Links of the spanning tree that the driver merges at a time.
PASS = 100_000
#: Distances below count as this.
LEAST = 1e-9
#: Rows that a core distance lists at most, on average; beyond that they are counted in BINS first, between bounds that SAMPLE points give.
LISTED, SAMPLE, BINS = 256, 4096, 64
#: Bounds of all distances, and what the edges of bins may be off.
LOW, HIGH, EDGE = -1e-9, 2.1, 1e-9

_LONG, _DOUBLE = T.LongType(), T.DoubleType()
_NEAR = T.ArrayType(T.StructType([T.StructField("d", _DOUBLE), T.StructField("w", _LONG)]))
_LINK = T.StructType([T.StructField("comp", _LONG), T.StructField("w", _DOUBLE), T.StructField("lo", _LONG), T.StructField("hi", _LONG), T.StructField("other", _LONG)])


def distances(cosines: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit rows; cosines count to twelve places, so that the order of a sum changes nothing."""
    return np.sqrt(np.maximum(2 - 2 * np.round(cosines, 12), 0))


def core_distances(points: DataFrame, cells: Cells, size: int) -> DataFrame:
    """k, core of points (k, v, weight), whose cells hold their weights too; the last distance where all weigh less than size."""
    total = points.agg(F.sum("weight")).first()[0] or 0
    if size > total or size * cells.n <= LISTED * total:
        return _listed(points, cells, size)
    return _counted(points, cells, size, total)


def _reached(near, size: int, start=None):
    """sum, d: how much the nearest weigh up to the one that reaches size, with what weighs ``start`` before them, and its distance."""
    step = lambda a, x: F.struct((a["sum"] + x["w"]).alias("sum"), F.when(a["sum"] < size, x["d"]).otherwise(a["d"]).alias("d"))
    return F.aggregate(F.array_sort(near), F.struct((F.lit(0).cast("long") if start is None else start).alias("sum"), F.lit(0.0).alias("d")), step)


def _lists(who: np.ndarray, d: np.ndarray, w: np.ndarray, n: int) -> pa.ListArray:
    """For each of n askers its (d, w), equal d as one."""
    order = np.lexsort((d, who))
    who, d, w = who[order], d[order], w[order].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (d[1:] != d[:-1])])) if len(who) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(np.bincount(who[new], minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(d[new]), pa.array(np.add.reduceat(w, new) if len(new) else w)], ["d", "w"]))


def _within(cosines: np.ndarray, hi: np.ndarray, mask: Mask) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Askers, rows and distances of what lies within each asker's hi: of most pairs the cosine tells that they don't."""
    who, row = allowed(cosines >= (1 - hi * hi / 2 - EDGE)[:, None], mask)
    d = distances(cosines[who, row])
    near = d <= hi[who]
    return who[near], row[near], d[near]


def _counted(points: DataFrame, cells: Cells, size: int, total: int) -> DataFrame:
    """core_distances where lists would be long: bounds from a sample, then the bin between them where the weight reaches size, then that bin's rows.

    A bound that doesn't hold is found out by the count, and the asker counts again between wider ones.
    """
    radius, count = cells.radius, cells.count
    some = points.orderBy(F.xxhash64("k"), "k").limit(SAMPLE).select("v", "weight").toArrow()
    heavy = numbers(some["weight"]).astype(np.float64)
    share, whole = size / total, cells.n <= len(heavy)
    error = 4 * math.sqrt(share * (1 - share) * float((heavy * heavy).sum())) / heavy.sum() + 2 / len(heavy)
    shared = points.sparkSession.sparkContext.broadcast((directions(some["v"], False).T, heavy))

    def bracket(batches):
        y, w = shared.value
        step = max(1, HELD // len(w))
        for b in (b.slice(lo, step) for b in batches for lo in range(0, b.num_rows, step)):
            d = distances(directions(b.column(1), True) @ y)
            order = np.argsort(d, 1)
            far, run = np.take_along_axis(d, order, 1), np.cumsum(w[order], 1)
            who = np.arange(len(d))
            if whole:
                lo = hi = far[who, (run < size).sum(1)]
            else:
                a, z = (run < (share - error) * run[0, -1]).sum(1) - 1, (run < (share + error) * run[0, -1]).sum(1)
                lo, hi = np.where(a >= 0, far[who, np.maximum(a, 0)], LOW), np.where(z < len(w), far[who, np.minimum(z, len(w) - 1)], HIGH)
                hi = np.maximum(hi, lo + EDGE)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lo), pa.array(hi)], ["q", "v", "lo", "hi"])

    askers = points.select(F.col("k").alias("q"), "v")
    todo = written(askers.mapInArrow(bracket, T.StructType([*askers.schema.fields, T.StructField("lo", _DOUBLE), T.StructField("hi", _DOUBLE)])))
    if whole:
        return todo.select(F.col("q").alias("k"), F.col("hi").alias("core"))
    touched = lambda d, b: (d - radius[None, :] <= b.column(3).to_numpy()[:, None] + SLACK) & (count > 0)[None, :]

    def tally(a, b, cosines, mask):
        lo, hi = numbers(a["lo"]), numbers(a["hi"])
        who, row, d = _within(cosines, hi, mask)
        place = np.clip(np.ceil((d - lo[who]) / (hi - lo)[who] * BINS), 0, BINS).astype(np.int64)
        n = np.bincount(who * (BINS + 1) + place, numbers(b["weight"])[row], len(a) * (BINS + 1)).astype(np.int64)
        return [a["q"], pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) + 1, BINS + 1).astype(np.int32)), pa.array(n))]

    def narrow(batches):
        for b in batches:
            lo, hi = b.column(1).to_numpy(), b.column(2).to_numpy()
            run = np.cumsum(b.column(3).flatten().to_numpy().reshape(-1, BINS + 1), 1)
            at, width = (run < size).sum(1), (hi - lo) / BINS
            low, high = lo + (at - 1) * width - EDGE, lo + at * width + EDGE
            ready = (at > 0) & (at <= BINS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.where(ready, low, np.where(at == 0, LOW, lo))), pa.array(np.where(ready, high, np.where(at == 0, np.maximum(lo, LOW) + EDGE, HIGH))), pa.array(ready)], ["q", "lo", "hi", "ready"])

    def look(a, b, cosines, mask):
        lo = numbers(a["lo"])
        who, row, d = _within(cosines, numbers(a["hi"]), mask)
        w, inside = numbers(b["weight"])[row], d > lo[who]
        under = np.bincount(who[~inside], w[~inside], len(a)).astype(np.int64)
        return [a["q"], under, _lists(who[inside], d[inside], w[inside], len(a))]

    bins = T.StructType([T.StructField("q", _LONG), T.StructField("bins", T.ArrayType(_LONG))])
    found = T.StructType([T.StructField("q", _LONG), T.StructField("under", _LONG), T.StructField("near", _NEAR)])
    none = F.array_repeat(F.lit(0).cast("long"), BINS + 1)
    added = lambda d: d.groupBy("q").agg(F.collect_list("bins").alias("bins")).select("q", F.aggregate("bins", none, lambda a, x: F.zip_with(a, x, lambda y, z: y + z)).alias("bins"))
    done = None
    while True:
        seen = todo.select("q", "lo", "hi").join(added(cells.meet(todo, touched, tally, bins)), "q", "left").select("q", "lo", "hi", F.coalesce("bins", none).alias("bins"))
        now = written(todo.select("q", "v").join(seen.mapInArrow(narrow, "q long, lo double, hi double, ready boolean"), "q"))
        ready = written(now.where("ready").drop("ready"))
        got = cells.meet(ready, touched, look, found).groupBy("q").agg(F.sum("under").alias("under"), F.flatten(F.collect_list("near")).alias("near"))
        got = written(got.select("q", "under", _reached(F.col("near"), size, F.col("under")).alias("r")).select("q", F.col("r.d").alias("core"), ((F.col("under") < size) & (F.col("r.sum") >= size)).alias("holds")))
        held = got.where("holds").select(F.col("q").alias("k"), "core")
        done = held if done is None else done.unionByName(held)
        again = ready.join(got.where("holds").select("q"), "q", "left_anti").withColumns({"lo": F.lit(LOW), "hi": F.lit(HIGH)})
        todo = written(now.where("NOT ready").drop("ready").unionByName(again))
        if todo.isEmpty():
            return done


def _listed(points: DataFrame, cells: Cells, size: int) -> DataFrame:
    """core_distances by lists: of the nearest cells that weigh enough, then of what lies within the bound that these give."""
    weight = np.zeros(len(cells.pivots), np.int64)
    for r in cells.homes.groupBy("cell").agg(F.sum("weight").alias("w")).collect():  # a row a pivot
        weight[r.cell] = r.w
    radius = cells.radius

    def home(d, b):  # the nearest cells that weigh enough
        order = np.argsort(d, 1, kind="stable")
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, (np.cumsum(weight[order], 1) - weight[order] < size) & (weight[order] > 0), 1)
        return out

    def compare(a, b, cosines, mask):
        if "d" in a.column_names:  # what lies beyond the bound isn't listed
            who, row, d = _within(cosines, numbers(a["d"]), mask)
            return [a["q"], _lists(who, d, numbers(b["weight"])[row], len(a))]
        d, w = masked(distances(cosines), mask, np.inf), numbers(b["weight"])
        order = np.argsort(d, 1, kind="stable")
        far, heavy = np.take_along_axis(d, order, 1), w[order]
        keep = (np.cumsum(heavy, 1) - heavy < size) & np.isfinite(far)
        ends = pa.array(np.concatenate([[0], np.cumsum(keep.sum(1))]).astype(np.int32))
        return [a["q"], pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(far[keep]), pa.array(heavy[keep].astype(np.int64))], ["d", "w"]))]

    found = T.StructType([T.StructField("q", _LONG), T.StructField("near", _NEAR)])
    merged = lambda d: d.groupBy("q").agg(F.flatten(F.collect_list("near")).alias("near")).withColumn("r", _reached(F.col("near"), size))
    askers = points.select(F.col("k").alias("q"), "v")
    first = written(merged(cells.meet(askers, home, compare, found)))
    bound = first.select("q", F.when(F.col("r.sum") >= size, F.col("r.d")).otherwise(3.0).alias("d"))
    further = lambda d, b: (d - radius[None, :] <= b.column(2).to_numpy()[:, None] + SLACK) & (weight > 0)[None, :] & ~home(d, b)
    second = cells.meet(written(askers.join(bound, "q")), further, compare, found)
    return merged(first.select("q", "near").unionByName(second)).select(F.col("q").alias("k"), F.col("r.d").alias("core"))


def least_links(d: np.ndarray, a, b, mask: Mask = None) -> list:
    """Of each asker the least link (w, then ends) to a row of another component, by mutual reachability; those that have one."""
    w = np.maximum(np.maximum(d, numbers(a["core"])[:, None]), numbers(b["core"])[None, :])
    comp, other, ka, kb = numbers(a["comp"]), numbers(b["comp"]), numbers(a["q"]), numbers(b["k"])
    w = masked(np.where(comp[:, None] == other[None, :], np.inf, w), mask, np.inf)
    least = w.min(1, initial=np.inf)
    has = np.flatnonzero(np.isfinite(least))
    w, ka, comp, least = w[has], ka[has], comp[has], least[has]
    tied = w == least[:, None]
    top = np.iinfo(np.int64).max
    lo = np.where(tied, np.minimum(ka[:, None], kb[None, :]), top)
    tied &= lo == lo.min(1, initial=top)[:, None]
    hi = np.where(tied, np.maximum(ka[:, None], kb[None, :]), top)
    at = hi.argmin(1) if len(has) else np.zeros(0, np.int64)
    return [comp, least, np.minimum(ka, kb[at]), np.maximum(ka, kb[at]), other[at]]


def spanning_tree(points: DataFrame, cells: Cells, core: DataFrame) -> DataFrame:
    """w, lo, hi: the links of the least spanning tree of points (k, v) by mutual reachability, ties by the ends."""
    state = written(core.select("k", "core", F.col("k").alias("comp")))
    links = None
    best = lambda d: d.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("l")).select("comp", "l.*")
    while True:
        now = cells.only(state)
        lowest, highest = np.full(len(cells.pivots), -1), np.full(len(cells.pivots), -2)
        for r in now.homes.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).collect():  # a row a pivot
            lowest[r.cell], highest[r.cell] = r.lo, r.hi
        if len({*lowest[now.count > 0], *highest[now.count > 0]}) <= 1:
            break
        radius, there = now.radius, now.count > 0
        askers = written(points.select("k", "v").join(state, "k").select(F.col("k").alias("q"), "v", "core", "comp"))

        def own(d, b, there=there):
            out = np.zeros(d.shape, bool)
            out[np.arange(len(d)), np.where(there[None, :], d, np.inf).argmin(1)] = True
            return out

        def others(d, b, there=there, radius=radius, lowest=lowest, highest=highest, own=own):
            core, comp, w = (b.column(i).to_numpy() for i in (2, 3, 4))
            one = (lowest == highest)[None, :] & (lowest[None, :] == comp[:, None])
            return (np.maximum(d - radius[None, :] - SLACK, core[:, None]) <= w[:, None]) & there[None, :] & ~one & ~own(d, b)

        look = lambda a, b, cosines, mask: least_links(distances(cosines), a, b, mask)
        first = written(best(now.meet(askers, own, look, _LINK)))
        bounded = written(askers.join(first.select("comp", "w"), "comp", "left").select("q", "v", "core", "comp", F.coalesce("w", F.lit(3.0)).alias("w")).where("core <= w"))
        chosen = written(best(first.unionByName(now.meet(bounded, others, look, _LINK))))
        links = chosen.select("w", "lo", "hi") if links is None else links.unionByName(chosen.select("w", "lo", "hi"))
        joined = components(chosen.select(F.col("comp").alias("u"), F.col("other").alias("v")))
        state = written(state.join(joined.withColumnRenamed("node", "comp"), "comp").select("k", "core", F.col("label").alias("comp")))
    empty = points.sparkSession.createDataFrame([], "w double, lo long, hi long")
    return empty if links is None else written(links.distinct())


@dataclass
class Condensed:
    """Clusters of ``size`` rows and more as links merge components, numbered upwards: children come before their parents.

    A cluster's ``total`` is the sum over its rows of the density (1 over the distance) at which they leave it.
    """

    size: int
    weight: list[int] = field(default_factory=list)
    total: list[float] = field(default_factory=list)
    birth: list[float] = field(default_factory=list)
    children: list[tuple[int, ...]] = field(default_factory=list)

    def add(self, weight: int, density: float, children: tuple[int, ...] = ()) -> int:
        self.weight.append(weight)
        self.total.append(weight * density)
        self.birth.append(0.0)
        self.children.append(children)
        for c in children:
            self.birth[c] = density
        return len(self.weight) - 1

    def merge(self, a: list, b: list, w: float) -> None:
        """Components are [weight, cluster or None, the parts whose rows have no cluster yet]; b goes into a. Parts are told their cluster."""
        density = 1 / max(w, LEAST)
        if a[1] is not None and b[1] is not None:
            a[0], a[1] = a[0] + b[0], self.add(a[0] + b[0], density, (a[1], b[1]))
            return
        big, small = (a, b) if a[1] is not None else (b, a)
        if big[1] is not None:
            self.total[big[1]] += small[0] * density
            self.weight[big[1]] += small[0]
            joined, cluster = small[2], big[1]
        else:
            joined, cluster = a[2] + b[2], self.add(a[0] + b[0], density) if a[0] + b[0] >= self.size else None
        if cluster is not None:
            for p in joined:
                p[1] = cluster
            joined = []
        a[:] = [a[0] + b[0], cluster, joined]

    def chosen(self) -> dict[int, int]:
        """For each cluster the one chosen of it and those above it, if any: by excess of mass, never the whole."""
        n = len(self.weight)
        best, take = [0.0] * n, [False] * n
        for i in range(n):
            below = sum(best[c] for c in self.children[i])
            own = self.total[i] - self.birth[i] * self.weight[i]
            take[i] = not self.children[i] or own >= below
            best[i] = own if take[i] else below
        out: dict[int, int] = {}
        for i in reversed(range(n)):
            if i == n - 1:
                take[i] = False
            if i not in out and take[i]:
                out[i] = i
            for c in self.children[i]:
                if i in out:
                    out[c] = out[i]
        return out


def hdbscan(df: DataFrame, *, size: int, key: str = "pos", vector: str = "embedding", weight: str | None = None) -> DataFrame:
    """key, cluster: the smallest key of its cluster, -1 for noise.

    Vectors are compared as unit vectors; null ones are noise. Where no more than ``size`` rows take part, all are noise; one cluster of
    all rows is none. Keys differ and are read as long. With ``weight`` a row of df stands for so many with its vector, the least key of
    which is its own.
    """
    spark = df.sparkSession
    rows = by_vector(df, key, vector, weight).where("v IS NOT NULL").withColumn("k", F.col("k").cast("long"))
    n = rows.count() if weight is None else rows.agg(F.sum("w")).first()[0] or 0
    out = lambda found: df.select(F.col(key).alias("_k")).join(found, F.col("_k") == F.col("k"), "left").select(F.col("_k").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    if n <= size:
        return df.select(key, F.lit(-1).cast("long").alias("cluster"))
    points = written(rows.groupBy("h", "v").agg(F.min("k").alias("k"), (F.count("*") if weight is None else F.sum("w")).alias("weight")))
    on = meeting(points)
    cells = Cells(points.drop("h"))
    core = written(core_distances(points, cells, size))
    links = spanning_tree(points, cells, core)

    tree = Condensed(size)
    heavy = points.where(F.col("weight") >= size).select("k", "weight").orderBy("k").collect()  # n / size rows at most
    of_point = {r.k: tree.add(r.weight, 1 / LEAST) for r in heavy}
    told = "k long, cluster long"
    state = points.select("k", F.col("k").alias("root"), "weight").join(spark.createDataFrame([(k, c) for k, c in of_point.items()], told).withColumnRenamed("cluster", "node"), "k", "left")
    state = written(state.withColumn("open", F.col("node")))  # node: the cluster of the point's rows; open: that of its component now
    last = None
    while True:
        rest = links
        if last is not None:
            w, lo, hi = last
            rest = links.where((F.col("w") > w) | ((F.col("w") == w) & ((F.col("lo") > lo) | ((F.col("lo") == lo) & (F.col("hi") > hi)))))
        step = rest.orderBy("w", "lo", "hi").limit(PASS)
        side = lambda c: state.select(F.col("k").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        batch = step.join(side("lo"), "lo").join(side("hi"), "hi").orderBy("w", "lo", "hi").collect()  # PASS rows
        if not batch:
            break
        last = (batch[-1].w, batch[-1].lo, batch[-1].hi)
        roots = spark.createDataFrame([(r,) for r in {x for b in batch for x in (b.lo_root, b.hi_root)}], "root long")
        comps = {r.root: [r.weight, r.open, [] if r.open is not None else [[r.root, None]]] for r in state.join(F.broadcast(roots), "root").groupBy("root").agg(F.sum("weight").alias("weight"), F.max("open").alias("open")).collect()}
        parts = {r: c[2][0] for r, c in comps.items() if c[2]}
        up = {r: r for r in comps}

        def find(x, up=up):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for b in batch:
            x, y = sorted((find(b.lo_root), find(b.hi_root)))
            tree.merge(comps[x], comps[y], b.w)
            up[y] = x
        moved = spark.createDataFrame([(r, find(r), parts[r][1] if r in parts else None, comps[find(r)][1]) for r in up], "root long, top long, fell long, now long")  # 2 * PASS rows
        state = written(state.join(moved, "root", "left").select("k", F.coalesce("top", "root").alias("root"), "weight", F.coalesce("node", "fell").alias("node"), F.when(F.col("top").isNotNull(), F.col("now")).otherwise(F.col("open")).alias("open")))
        if len(batch) < PASS:
            break
    names = spark.createDataFrame(list(tree.chosen().items()), "node long, chosen long")  # clusters, n / size of the leaves among them
    named = points.select(*on, F.col("k").alias("point")).join(state.select(F.col("k").alias("point"), "node"), "point").join(names, "node").select(*on, "chosen")
    found = written(rows.select("k", *on).join(named, on).select("k", "chosen"))
    first = found.groupBy("chosen").agg(F.min("k").alias("cluster"))
    return out(found.join(F.broadcast(first), "chosen").select("k", "cluster"))
