"""Work that every executor can see: tables in the folder named by ``spark.checkpoint.dir``.

The folder is read from the session. Only where it is unset on one machine (as in tests) is a
temporary folder made and set as the checkpoint folder; on a cluster its absence is an error.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the filter of keys; its size does not grow with the data.
FILTER_BITS = 1 << 23


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="evigraph-"))
        where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return where.rstrip("/")


class Scratch:
    """Tables of one operator call, each written once and then read without its lineage."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return it as a table without history."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later read needs."""
        for name in names:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


@lru_cache(1)
def _c_library():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # not on glibc: nothing to trim
        return None


def trim() -> None:
    """Give memory that a worker no longer uses back to the system, for the worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    if hasattr(_c_library(), "malloc_trim"):
        _c_library().malloc_trim(0)


def likely(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key may be in the column ``key`` of wanted; some others pass too, so a join must follow.

    A filter of FILTER_BITS bits keeps most rows that no join will ask for out of its shuffle.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)).cast("int")
    words = wanted.select(place.alias("p")).select(F.shiftright("p", 3).alias("w"), F.pow(F.lit(2), F.col("p") % 8).cast("int").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))
    held = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in words.collect():
        held[r["w"]] = r["v"]
    bits = held.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bits, np.uint8)
        for batch in batches:
            p = batch.column(batch.num_columns - 1).to_numpy()
            ok = pa.array((held[p >> 3] >> (p & 7)) & 1 == 1)
            yield pa.RecordBatch.from_arrays([c.filter(ok) for c in batch.columns[:-1]], names=batch.schema.names[:-1])

    return rows.filter(F.col(key).isNotNull()).withColumn("_place", place).mapInArrow(run, rows.schema)


def parted(rows: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is not in the column ``key`` of wanted, and the others, among which are some more; a join of the latter must follow.

    The filter is that of likely(), as words of 64 bits that every task gets. Rows without a key are among the first.
    """
    place = F.pmod(F.xxhash64(F.col(key).cast(wanted.schema[key].dataType)), F.lit(FILTER_BITS)).cast("int")
    bits = wanted.filter(F.col(key).isNotNull()).select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("_w")).agg(F.expr("bit_or(shiftleft(1L, p % 64))").alias("_v"))
    marked = rows.withColumn("_p", F.when(F.col(key).isNotNull(), place)).withColumn("_w", F.shiftright("_p", 6)).join(F.broadcast(bits), "_w", "left")
    held = F.coalesce(F.expr("shiftright(_v, _p % 64) & 1L"), F.lit(0)) == 1
    return marked.filter(~held).select(rows.columns), marked.filter(held).select(rows.columns)
