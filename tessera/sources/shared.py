"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it. Only a session on this machine alone, as in tests, may leave it
    unset: then it's a temporary folder."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def cut(rows: DataFrame) -> DataFrame:
    """rows written to the shared folder and read back: they are then fixed, whichever executor is lost."""
    path = f"{shared_dir(rows.sparkSession)}/tessera-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
