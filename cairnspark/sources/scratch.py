"""Tables that cut a plan's lineage, in the cluster's shared folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT = "/tmp/checkpoints"


def scratch_path(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a cluster without that setting raises, as its executors share no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = DEFAULT
    return f"{root.rstrip('/')}/cairnspark/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write once, read back: files outlive any executor."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
