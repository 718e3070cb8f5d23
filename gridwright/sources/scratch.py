"""Tables written in the middle of a plan, so that what comes after reads them instead of computing them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where that is unset one of our own on a single machine, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="gridwright-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/gridwright-{spark.sparkContext.applicationId}"


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` as a table of the application's folder: its lineage ends here, and a lost executor costs what it was reading."""
    path = f"{folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
