"""Ranks, running sums and quantiles over whole tables, without bringing them to one task.

Running sums deal rows into ranges of all their keys, so ties of the first key are split too; there are as many ranges as shuffle
partitions, and each range's total is added to the ranges after it. A share or a quantile needs no order of the table at all: the
value at one rank is found by narrowing a bracket of approximate quantiles, each step a scan of one column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acquira.functions.numbers import share_count
from acquira.sources.shared import written

#: Distinct values among which the driver looks for the one at a rank.
FEW = 20_000
#: Accuracy of a bracket: it holds a share of about four of these parts.
PARTS = 10_000


def running_sums(df: DataFrame, values: dict[str, Column], keys: list[str], *, descending: bool = False) -> DataFrame:
    """Adds, by name, the sum of each value up to each row in the order of keys (the first descending, if so); keys have to be total."""
    order = [F.desc(keys[0]) if descending else F.asc(keys[0]), *map(F.asc, keys[1:])]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, as the sampled ranges have to be the same in both uses
    d = written(df.withColumns({f"_value_{n}": v for n, v in values.items()}).repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    far = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = d.groupBy("_range").agg(*[F.sum(f"_value_{n}").alias(f"_sum_{n}") for n in values]).select("_range", *[F.coalesce(F.sum(f"_sum_{n}").over(far), F.lit(0)).alias(f"_before_{n}") for n in values])
    near = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = d.withColumns({n: F.sum(f"_value_{n}").over(near) for n in values}).join(F.broadcast(before), "_range")
    return out.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in values}).drop("_range", *[f"{k}_{n}" for n in values for k in ("_value", "_before")])


def running_sum(df: DataFrame, value: Column, keys: list[str], name: str, *, descending: bool = False) -> DataFrame:
    return running_sums(df, {name: value}, keys, descending=descending)


def row_numbers(df: DataFrame, keys: list[str], name: str = "rn", *, descending: bool = False) -> DataFrame:
    return running_sum(df, F.lit(1).cast("long"), keys, name, descending=descending)


def _rows(weight: str | None) -> Column:
    return F.count("*") if weight is None else F.sum(weight)


def average_ranks(df: DataFrame, key: str, name: str, *, weight: str | None = None) -> DataFrame:
    """Adds the 1-based ascending rank of key, ties sharing the mean of theirs; NULLs have none. A row is ``weight`` rows, if told."""
    values = written(df.where(F.col(key).isNotNull()).groupBy(key).agg(_rows(weight).alias("_ties")))
    few = values.count() <= FEW
    ranks = running_sum(values, F.col("_ties"), [key], "_upto").select(key, (F.col("_upto") - (F.col("_ties") - 1) / 2).alias(name))
    return df.join(F.broadcast(ranks) if few else ranks, key, "left")  # by few values no row moves


def rank_normalised(df: DataFrame, key: str, name: str, *, weight: str | None = None) -> DataFrame:
    """Adds the average-tie rank from 0 over n - 1."""
    n = df.agg(_rows(weight).alias("_n"))
    return average_ranks(df, key, "_rank", weight=weight).crossJoin(F.broadcast(n)).withColumn(name, (F.col("_rank") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))).drop("_rank", "_n")


def value_at(df: DataFrame, key: str, place: int, *, descending: bool = False, size: int | None = None):
    """The value of the place-th row (from 1) in the order of key, and how many rows come before that value; NULLs take no part.

    Rows outside the bracket are counted, not kept; each step's bracket is a small part of the one before, or one value.
    """
    d = df.select(F.col(key).alias("v")).where("v IS NOT NULL")
    n, passed = d.count() if size is None else size, 0
    if not 0 < place <= n:
        raise ValueError(f"{n} rows have no place {place}")
    while n > FEW:
        at = (place - 0.5) / n
        at = 1 - at if descending else at
        lo, hi = d.agg(F.percentile_approx("v", [max(at - 2 / PARTS, 0.0), min(at + 2 / PARTS, 1.0)], PARTS)).first()[0]
        v = F.col("v")
        parts = [v < lo, v == lo, (v > lo) & (v < hi), v == hi, v > hi] if lo != hi else [v < lo, v == lo, v > lo]
        sizes = list(d.agg(*[F.count(F.when(c, 1)).alias(f"n{i}") for i, c in enumerate(parts)]).first())
        for i in reversed(range(len(parts))) if descending else range(len(parts)):
            if place <= sizes[i]:
                break
            place, passed = place - sizes[i], passed + sizes[i]
        if i in (1, 3):
            return (lo if i == 1 else hi), passed
        d, n = d.where(parts[i]), sizes[i]
    for value, ties in sorted(map(tuple, d.groupBy("v").count().collect()), reverse=descending):
        if place <= ties:
            return value, passed
        place, passed = place - ties, passed + ties
    raise RuntimeError("the table changed between scans")


def quantile(df: DataFrame, key: str, q: float, *, weight: str | None = None) -> float | None:
    """The exact quantile of key, between the two values at its place in proportion; None without values. A row is ``weight`` rows, if told."""
    if weight is not None:
        d = written(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(weight).alias("_n")))
        d = written(running_sum(d, F.col("_n"), [key], "_upto"))
        n = d.agg(F.max("_upto")).first()[0]
        if not n:
            return None
        place = (n - 1) * q
        at = lambda p: F.min(F.when(F.col("_upto") >= p, F.col(key)))
        low, high = d.agg(at(int(place) + 1), at(min(int(place) + 2, n))).first()
        return float(low + (high - low) * (place - int(place)))
    n = df.where(F.col(key).isNotNull()).count()
    if not n:
        return None
    place = (n - 1) * q
    low = value_at(df, key, int(place) + 1, size=n)[0]
    part = place - int(place)
    return float(low) if not part else low + (value_at(df, key, int(place) + 2, size=n)[0] - low) * part


def top_share(df: DataFrame, key: str, tie: str, share: float, name: str) -> DataFrame:
    """Adds whether a row is among the share with the greatest key, ties by the smaller ``tie``; a share of 1 takes all.

    The last row that is in is found first; then the answer is one comparison, and no row moves.
    """
    if share >= 1:
        return df.withColumn(name, F.lit(True))
    n = df.where(F.col(key).isNotNull()).count()
    if not n:
        return df.withColumn(name, F.lit(False))
    places = int(df.sparkSession.range(1).select(share_count(F.lit(n), share)).first()[0])
    last, before = value_at(df, key, places, descending=True, size=n)
    k = F.col(key)
    end = value_at(df.where(k == last), tie, places - before)[0]
    return df.withColumn(name, F.coalesce((k > last) | ((k == last) & (F.col(tie) <= end)), F.lit(False)))
