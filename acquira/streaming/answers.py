"""The annotation ledger over a stream of answers: running cost and objects by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answers_by_window(stream: DataFrame, *, every: str = "1 hour", late: str = "10 minutes", time: str = "ts", arm: str = "event_type", cost: str = "value") -> DataFrame:
    """Answers, cost and distinct users (approximate, so that state is bounded) of each arm in each window; later rows than ``late`` are dropped."""
    d = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return d.groupBy(F.window(time, every), F.col(arm).alias("arm")).agg(F.count("*").alias("answers"), F.sum(cost).alias("cost"), F.approx_count_distinct("user_id").alias("users"))
