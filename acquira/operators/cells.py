"""Exact searches among vectors by cells around pivots.

A row lives in the cell of its nearest pivot. A cell is a ball around its pivot that holds its rows, so by the triangle inequality on
unit vectors an asker may leave out the cells whose ball it can't reach, and knows all of a ball that lies within its reach without
looking. What is left meets in slots of bounded numbers of rows: cells are cut, and their askers shared out.

A zero vector stands at right angles to everything, to other zero vectors too: its cosine is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acquira.sources.shared import written

#: Pivots of a search at most (their vectors are broadcast); rows of a cell, and askers of it, that one task compares.
MOST_PIVOTS, PART_ROWS, ASKERS = 2048, 1024, 4096
#: How many times more rows a shelf has where askers want all cells; numbers of one matrix that a task holds; rows sent in one batch.
LARGER, HELD, SENT = 16, 2**20, 8192
#: Numbers in single precision of one matrix that a task sifts pairs by.
SIFTED = 2**22
#: What rounding may do to a distance.
SLACK = 1e-6


def unit(col) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = x.reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def directions(col, asks: bool) -> np.ndarray:
    """Unit rows, of two dimensions more: zero vectors of askers lie along the one, those of cells along the other."""
    x = unit(col)
    zero = (~x.any(1)).astype(np.float64)[:, None]
    return np.hstack([x, zero * asks, zero * (not asks)])


def numbers(col) -> np.ndarray:
    return (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).to_numpy(zero_copy_only=False)


class Cells:
    """The cells of rows (k, v and others, a written table), and how far and how many the rows of each are.

    ``compared`` counts the pairs that searches looked at.
    """

    def __init__(self, rows: DataFrame, pivots: np.ndarray | None = None):
        self.spark, self.compared = rows.sparkSession, 0
        self.n = rows.count()
        if pivots is None:
            number = min(MOST_PIVOTS, int(np.ceil(np.sqrt(self.n)))) if self.n > PART_ROWS else 1  # what one task compares is one cell
            pivots = directions(rows.orderBy(F.xxhash64("k"), "k").limit(max(number, 1)).select("v").toArrow().column(0), False)
        self.pivots = pivots
        self.shared = shared = self.spark.sparkContext.broadcast(pivots)
        schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])
        at = rows.columns.index("v")

        def house(batches):
            step = max(1, HELD // max(len(shared.value), 1))
            for b in (b.slice(lo, step) for b in batches for lo in range(0, b.num_rows, step)):
                x = directions(b.column(at), False)
                d = np.sqrt(np.maximum(2 - 2 * (x @ shared.value.T), 0))
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], schema.names)

        self.homes = written(rows.mapInArrow(house, schema)) if len(pivots) else rows.withColumns({"cell": F.lit(0), "far": F.lit(0.0)})
        self._measure()

    def _measure(self) -> None:
        self.count, self.radius = np.zeros(len(self.pivots), np.int64), np.full(len(self.pivots), -np.inf)
        for r in self.homes.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row a pivot
            self.count[r.cell], self.radius[r.cell] = r.n, r.far

    def only(self, keys: DataFrame) -> Cells:
        """The same cells with the rows alone whose k is in keys, and with the columns of keys."""
        out = object.__new__(Cells)
        out.spark, out.compared, out.pivots, out.shared = self.spark, 0, self.pivots, self.shared
        more = [c for c in keys.columns if c == "k" or c not in self.homes.columns]
        out.homes = written(self.homes.join(keys.select(*more), "k"))
        out.n = out.homes.count()
        out._measure()
        return out

    def meet(self, askers: DataFrame, choose: Callable, compare: Callable, schema: T.StructType, least: Callable | None = None, most: int | None = None) -> DataFrame:
        """compare(askers, rows, cosines, mask) for every slot of the cells that askers choose; askers (q, v and others) come from a written table.

        choose(distances to the pivots, batch) gives which cells each asker wants; it has to say the same each time. A slot holds a shelf,
        which is a part of a cell or some cells, and a share of its askers, each with the cells of the shelf that it wants: ``mask`` says
        which rows these are (None: all). The more cells askers want of all, the larger are the shelves, so that an asker is sent to
        few of them. What compare returns starts with the askers' columns or is for each asker; it is called for some askers at a time.
        A mask is over (askers, cells) with each row's cell: ``masked``, ``spread`` and ``allowed`` read it.

        least(askers) gives each asker the least cosine that counts: it is then compare(askers, rows, which asker, which row, cosines)
        of the pairs that reach it and are wanted, some at a time, and no matrix is held in double precision. Of an asker's pairs in a slot
        those may be left out that aren't among its ``most`` nearest by nine places, if that is told.
        """
        shared, at, n = self.shared, askers.columns.index("v"), len(self.pivots)
        columns = len(askers.columns)

        def wanted(b):
            """Which (asker, cell), some askers at a time: distances to all pivots are held."""
            parts = []
            for lo in range(0, b.num_rows, step):
                some = b.slice(lo, step)
                d = np.sqrt(np.maximum(2 - 2 * (directions(some.column(at), True) @ shared.value.T), 0))
                who, cell = np.nonzero(choose(d, some))
                parts.append((who + lo, cell))
            return [np.concatenate(x) for x in zip(*parts, strict=True)]

        step = max(1, HELD // max(n, 1))

        def tally(batches):
            calls, rows = np.zeros(n, np.int64), 0
            for b in batches:
                if b.num_rows:
                    calls += np.bincount(wanted(b)[1], minlength=n)
                    rows += b.num_rows
            which = np.flatnonzero(calls)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(which, -1).astype(np.int32)), pa.array(np.append(calls[which], rows))], ["cell", "n"])

        calls, asking = np.zeros(n, np.int64), 0
        for r in askers.mapInArrow(tally, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row a pivot
            if r.cell < 0:
                asking = r.n
            else:
                calls[r.cell] = r.n
        self.compared += int((calls * self.count).sum())
        share_wanted = float((calls * self.count).sum()) / max(asking * int(self.count.sum()), 1)
        larger = min(max(LARGER * share_wanted**2, 1.0), LARGER)
        part_rows, asker_rows = int(PART_ROWS * larger), int(ASKERS * max(larger / 4, 1.0))
        # cells are cut into parts, and these fill shelves in their order
        cuts = np.where(calls > 0, -(-self.count // part_rows), 0)
        first_part = np.concatenate([[0], np.cumsum(cuts)])
        shelf, filled, number = np.zeros(int(first_part[-1]), np.int64), 0.0, 0
        for c in np.flatnonzero(cuts):
            rows = self.count[c] / cuts[c]
            for i in range(first_part[c], first_part[c + 1]):
                if filled and filled + rows > part_rows:
                    number, filled = number + 1, 0.0
                shelf[i], filled = number, filled + rows
        of_part = np.repeat(np.arange(n), cuts)
        shelves = number + 1
        asked_of = np.minimum(np.bincount(shelf, weights=calls[of_part], minlength=shelves), asking).astype(np.int64)
        shares = np.maximum(-(-asked_of // asker_rows), 1)
        first = np.concatenate([[0], np.cumsum(shares)])
        slot = T.StructField("slot", T.LongType())

        def sent(b, who, more, names):
            """Rows who of a batch without its last column, with the columns ``more``, in batches of bounded size."""
            for lo in range(0, len(who), SENT):
                take = pa.array(who[lo:lo + SENT])
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns[:-1]), *(m.slice(lo, SENT) for m in more)], names)

        def call(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                h = b.columns[-1].to_numpy()
                for lo in range(0, b.num_rows, step):
                    some, hs = b.slice(lo, step), h[lo:lo + step]
                    who, cell = wanted(some)
                    keep = cuts[cell] > 0
                    who, cell = who[keep], cell[keep]
                    times = cuts[cell]
                    part = np.repeat(first_part[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    who, cell, on = np.repeat(who, times), np.repeat(cell, times), shelf[part]  # in the order of askers and shelves
                    new = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (on[1:] != on[:-1])])) if len(who) else np.zeros(0, np.int64)
                    wants = pa.ListArray.from_arrays(pa.array(np.append(new, len(who)).astype(np.int32)), pa.array(cell.astype(np.int32)))
                    yield from sent(some, who[new], [wants, pa.array(first[on[new]] + hs[who[new]] % shares[on[new]])], asked.names)

        def host(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                cell = b.column(b.schema.get_field_index("cell")).to_numpy().astype(np.int64)
                who = np.flatnonzero(cuts[cell] > 0)
                cell, h = cell[who], b.columns[-1].to_numpy()[who]
                on = shelf[first_part[cell] + h % np.maximum(cuts[cell], 1)]
                times = shares[on]
                again = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                yield from sent(b, np.repeat(who, times), [pa.array(np.repeat(first[on], times) + again)], hosted.names)

        hashed = lambda d, c: d.withColumn("h", F.pmod(F.xxhash64(F.col(c), F.lit(5)), F.lit(2**31)))
        asked, hosted = T.StructType([*askers.schema.fields, T.StructField("wants", T.ArrayType(T.IntegerType())), slot]), T.StructType([*self.homes.schema.fields, slot])
        left = hashed(askers, "q").mapInArrow(call, asked).groupBy("slot")
        right = hashed(self.homes, "k").mapInArrow(host, hosted).groupBy("slot")
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)

        def both(a: pa.Table, b: pa.Table) -> pa.Table:
            out, some = [], max(1, (HELD if least is None else SIFTED) // max(len(b), 1))
            here, column = np.unique(numbers(b["cell"]), return_inverse=True) if len(b) else (None, None)
            y = directions(b["v"], False).T if len(a) and len(b) else None
            small = None if least is None or y is None else y.astype(np.float32)
            for lo in range(0, len(a) if len(b) else 0, some):
                few = a.slice(lo, some).combine_chunks()
                wants = few["wants"].combine_chunks()
                who, cell = np.repeat(np.arange(len(few)), wants.value_lengths().to_numpy()), wants.flatten().to_numpy()
                place = np.minimum(np.searchsorted(here, cell), len(here) - 1)
                there = here[place] == cell
                mask = np.zeros((len(few), len(here)), bool)
                mask[who[there], place[there]] = True
                few, x, mask = few.select(range(columns)), directions(few["v"], True), None if mask.all() else (mask, column)
                for found in [compare(few, b, x @ y, mask)] if least is None else (compare(few.slice(at, n), b, *pairs) for at, n, pairs in reaching(x, y, small, least(few), mask, most)):
                    out.append(pa.table([pa.array(c) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else c for c in found], target.names).cast(target))
            return pa.concat_tables(out) if out else target.empty_table()

        return left.cogroup(right).applyInArrow(both, schema)


_NEAR = T.ArrayType(T.StructType([T.StructField("far", T.DoubleType()), T.StructField("id", T.LongType()), T.StructField("cosine", T.DoubleType())]))


#: Which cells askers may see, and the cell of each row.
Mask = tuple[np.ndarray, np.ndarray] | None


def spread(mask: Mask) -> np.ndarray:
    """The mask over (askers, rows)."""
    return mask[0][:, mask[1]]


def masked(values: np.ndarray, mask: Mask, other: float) -> np.ndarray:
    return values if mask is None else np.where(spread(mask), values, other)


def allowed(hit: np.ndarray, mask: Mask) -> tuple[np.ndarray, np.ndarray]:
    """Askers and rows of the hits that the mask allows, in order: few of many, so the mask isn't spread."""
    who, row = np.divmod(np.flatnonzero(hit), max(hit.shape[1], 1))
    if mask is None:
        return who, row
    keep = mask[0][who, mask[1][row]]
    return who[keep], row[keep]


def best_of(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of cosines the k greatest by nine places, ties to the smaller id: sizes, -rounded, ids, cosines. Cosines of -inf don't count."""
    order = np.argsort(ids, kind="stable")
    s, ids = s[:, order], ids[order]
    far = -np.round(s, 9) + 0.0
    k = min(k, s.shape[1])
    if k < s.shape[1]:
        edge = np.partition(far, k - 1, 1)[:, k - 1:k]
        near = far <= edge
        width = int(near.sum(1).max())  # ties at the edge included
        top = np.sort(np.argpartition(far, width - 1, 1)[:, :width], 1) if width < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)
    else:
        top = np.broadcast_to(np.arange(s.shape[1]), s.shape)
    f = np.take_along_axis(far, top, 1)
    top = np.take_along_axis(top, np.argsort(f, 1, kind="stable")[:, :k], 1)
    far = np.take_along_axis(far, top, 1)
    return np.isfinite(far).sum(1), far, ids[top], np.take_along_axis(s, top, 1)


def reaching(x: np.ndarray, y: np.ndarray, small: np.ndarray, least: np.ndarray, mask: Mask, most: int | None = None) -> Iterator[tuple[int, int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """From which asker, how many askers, and (asker, row, cosine) of their pairs that reach ``least`` and that the mask allows.

    Single precision (``small`` is y in it) leaves out what is too far by more than its error on unit vectors; the cosines of the rest
    are found in double precision, and so is what reaches. Pairs that can't be among their asker's ``most`` nearest go the same way.
    """
    error = (len(y) + 8) * 2.0**-23
    s = x.astype(np.float32) @ small
    hit = s >= (least - error).astype(np.float32)[:, None]
    some = HELD // 4  # pairs at a time
    step = len(x) if np.count_nonzero(hit) <= some else max(1, some // hit.shape[1])
    for at in range(0, len(x), step):
        who, row = allowed(hit[at:at + step], None if mask is None else (mask[0][at:at + step], mask[1]))
        sizes = np.bincount(who, minlength=1)
        if most is not None and sizes.max() > most:
            seen = s[at + who, row]
            table = np.full((len(sizes), sizes.max()), -np.inf, np.float32)
            table[who, np.arange(len(who)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = seen
            edge = np.partition(table, table.shape[1] - most, 1)[:, -most] - (2 * error + 2e-9)  # what ties by nine places stays
            near = seen >= edge[who]
            who, row = who[near], row[near]
        cosine, few = np.empty(len(who)), max(1, HELD // len(y))
        for lo in range(0, len(who), few):
            cosine[lo:lo + few] = np.einsum("ij,ij->i", x[at + who[lo:lo + few]], y.T[row[lo:lo + few]])
        keep = cosine >= least[at + who]
        yield at, min(step, len(x) - at), (who[keep], row[keep], cosine[keep])


def best_above(who: np.ndarray, cosine: np.ndarray, ids: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, -rounded, ids, cosines as best_of gives them, one after another, for n askers of pairs with the asker ``who`` each."""
    far = -np.round(cosine, 9) + 0.0
    order = np.lexsort((ids, far, who))
    sizes = np.bincount(who, minlength=n)
    top = order[np.arange(len(who)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < k]
    return np.minimum(sizes, k), far[top], ids[top], cosine[top]


def by_vector(df: DataFrame, key: str, vector: str, weight: str | None = None) -> DataFrame:
    """k and v of df's rows with vectors as doubles (no -0.0), and h, a hash of v by which equal ones meet; w, how many rows each stands for, if told."""
    more = [] if weight is None else [F.col(weight).cast("long").alias("w")]
    d = df.select(F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double") + 0.0).alias("v"), *more)
    return d.withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("v")))


def meeting(points: DataFrame) -> list[str]:
    """Columns by which rows meet their vectors among points (h, v): the hash alone, where it tells all of them apart."""
    return ["h"] if points.groupBy("h").count().where("count > 1").isEmpty() else ["h", "v"]


def knn(df: DataFrame, reference: DataFrame, *, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Cells]:
    """id_col and near (far: minus the cosine to nine places; id; cosine) of the k nearest reference rows of each row; and the cells.

    An asker first meets the nearest cells that hold k rows; the k-th of these bounds the cells that it meets next. Equal vectors ask
    once, and of equal reference vectors the k smallest ids take part. Null vectors have no neighbours and are none. Rows and ids may
    repeat. A reference without the column id_col is numbered.
    """
    asked = by_vector(df, id_col, vector_col)
    told = by_vector(reference if id_col in reference.columns else reference.withColumn(id_col, F.monotonically_increasing_id()), id_col, vector_col).where("v IS NOT NULL")
    least = F.row_number().over(Window.partitionBy("h", "v").orderBy("k"))
    rows = written(told.select(F.col("k").cast("long").alias("k"), "h", "v").withColumn("_rn", least).where(F.col("_rn") <= k).select("k", "v"))
    cells = Cells(rows)
    count, radius = cells.count, cells.radius

    def home(d, b):
        order = np.argsort(d, 1, kind="stable")
        before = np.cumsum(count[order], 1) - count[order]
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, (before < k) & (count[order] > 0), 1)
        return out

    def further(d, b):
        reach = np.sqrt(np.maximum(2 + 2 * b.column(2).to_numpy(), 0)) + SLACK  # of the k-th, whose far is minus its cosine
        return (d - radius[None, :] <= reach[:, None]) & (count > 0)[None, :] & ~home(d, b)

    def lists(q, sizes, parts):
        parts = [pa.array(x.astype(t)) for x, t in zip(parts, (np.float64, np.int64, np.float64), strict=True)]
        return [q, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.StructArray.from_arrays(parts, ["far", "id", "cosine"]))]

    def compare(a, b, cosines, mask):
        sizes, *parts = best_of(masked(cosines, mask, -np.inf), numbers(b["k"]), k)
        some = np.arange(parts[0].shape[1])[None, :] < sizes[:, None]
        return lists(a["q"], sizes, [x[some] for x in parts])

    def later(a, b, who, row, cosine):
        sizes, *parts = best_above(who, cosine, numbers(b["k"])[row], k, len(a))
        return lists(numbers(a["q"])[sizes > 0], sizes[sizes > 0], parts)

    found = T.StructType([T.StructField("q", T.LongType()), T.StructField("near", _NEAR)])
    merged = lambda d: d.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    if not cells.n:
        return asked.select(F.col("k").alias(id_col), F.array().cast(_NEAR).alias("near")), cells
    points = written(asked.where("v IS NOT NULL").groupBy("h", "v").agg(F.count("*").alias("n")).select("h", "v").withColumn("q", F.monotonically_increasing_id()))
    on = meeting(points)

    def out(near):
        whose = points.select("q", *on).join(near, "q").drop("q")
        return asked.select("k", *on).join(whose, on, "left").select(F.col("k").alias(id_col), F.coalesce("near", F.array().cast(_NEAR)).alias("near"))

    askers = points.select("q", "v")
    first = written(merged(cells.meet(askers, home, compare, found)))
    if len(cells.pivots) == 1:
        return out(first), cells
    bound = first.select("q", F.when(F.size("near") >= k, F.element_at("near", -1)["far"]).otherwise(1.0).alias("far"))
    reached = lambda a: -numbers(a["far"]) - 1e-9  # what doesn't reach the k-th found already can't be among the nearest
    second = cells.meet(written(askers.join(bound, "q")), further, later, found, reached, k)
    return out(written(merged(first.unionByName(second)))), cells
