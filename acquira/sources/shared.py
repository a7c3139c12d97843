"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(4)
def _local_root(application: str) -> str:
    root = tempfile.mkdtemp(prefix="acquira-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return "file://" + root


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session's own folder, which goes with the process. A cluster has to set it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the executors share")
    return _local_root(spark.sparkContext.applicationId)


def written(df: DataFrame) -> DataFrame:
    """df as a written table: later uses don't repeat its plan, see the same rows, and survive lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
