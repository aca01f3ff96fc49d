"""A folder for tables of one run, where driver and executors can both reach it, and parts of bounded size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Parts for each part of a shuffle where what follows holds a whole part in memory, several times.
HELD = 4


def folder(spark: SparkSession, tag: str) -> str:
    """A new name under ``spark.checkpoint.dir``; only where that is unset on one machine, under a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            where = held.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            where = tempfile.mkdtemp(prefix="evigraph-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{where.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """df in HELD times as many parts as a shuffle has, which are not put together again, as what follows holds a whole part in memory."""
    return df.repartition(HELD * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
