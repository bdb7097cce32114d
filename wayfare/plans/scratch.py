"""Shared scratch space: where iterative operators cut their lineage.

Everything goes below ``spark.checkpoint.dir``, which driver and executors share.  Only a local session without such a
setting (a test) gets a temporary folder; on a cluster that is an error, since executors would not see it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local temporary one is set where there is none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        jsc = spark.sparkContext._jsc.sc()
        path = jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else ""
    if not path and (spark.sparkContext.master + "[").split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="spark-wayfare-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return it as read from there (lineage ends here)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in as many tasks as a shuffle has, also where it is small: for rows that take long."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
