"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, in a folder of the application, which can go when the application has
    ended. Where the setting is empty and all runs in one process, as in tests, a new local folder becomes the setting;
    on a cluster it must be set, to a folder that driver and executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top}/treescan-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df written as Parquet into the shared folder and read again: cuts the lineage and survives lost executors. codec:
    how the files are compressed, where it shall not be the session's way."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, codec: str | None = None, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """df written, with counts taken while it is."""
    seen = Observation()
    out = written(df.observe(seen, *[c.alias(k) for k, c in counts.items()]), name, codec)
    return out, {k: v or 0 for k, v in seen.get.items()}
