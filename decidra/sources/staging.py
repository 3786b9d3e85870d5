"""Intermediate tables in the folder that the cluster's machines share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a folder of our own on a local master, deleted at the end; an error on a cluster."""
    base = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{KEY} must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="decidra-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set(KEY, base)
    return base.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: several uses read it, and rows numbered by place stay as they are."""
    path = f"{shared_dir(df.sparkSession)}/decidra/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
