"""Tables in a shared folder, for results that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Where that setting is absent, a local session, as in tests, gets a folder of
    this machine; on a cluster that is an error, since each executor would write
    to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-work-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/work-{uuid.uuid4().hex}"


def written(df: DataFrame, where: str | None = None, name: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the work folder, a new one unless given: later jobs start from it."""
    spark = df.sparkSession
    path = f"{where or work_dir(spark)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
