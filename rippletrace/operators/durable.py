"""Cuts of lineage that survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only in local mode a folder of our own serves if none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt"))
    return sc.getCheckpointDir()


class Grown:
    """Rows that a loop adds to: a durable table a round, put together every few rounds, so that neither the plan nor what is written again grows with the rounds."""

    def __init__(self, first: DataFrame, most: int = 8):
        self.parts, self.most = [first], most

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)

    def add(self, more: DataFrame) -> None:
        self.parts.append(more)
        if len(self.parts) > self.most:
            self.parts = [durable(self.rows())]


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder by columns, for rows of which each reader takes some columns."""
    at = f"{shared_folder(df.sparkSession)}/saved_{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
