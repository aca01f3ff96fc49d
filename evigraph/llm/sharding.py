"""Sharding by weighted rendezvous hashing, as DataFrame expressions only.

Each row scores every shard with a hash of its own key and that shard's number, scaled by the
shard's weight; the best score owns the row. A score depends on no other shard, so when shards
are added a row either stays or goes to a new shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one shard that one task numbers.
RUN_ROWS = 100_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The owning shard (0-based) of a key; weights must be positive.

    Weighted rendezvous: the shard with the greatest -weight / ln(u), u uniform in (0, 1) from the
    hash of (key, shard). Ties go to the smaller shard. A null key is hashed as the string "null".
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive and not empty")
    held = F.coalesce(key.cast("string"), F.lit("null"))
    scores = []
    for shard, weight in enumerate(weights):
        high = F.shiftrightunsigned(F.xxhash64(held, F.lit(shard)), 11).cast("double")
        u = (high + F.lit(0.5)) / F.lit(float(2**53))
        scores.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("shard")))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["shard"]).cast("int")


def gapless(df: DataFrame, group: str, order: Sequence[str], run: str, out: str) -> DataFrame:
    """Number the rows of each group from 0 without putting a group into one task.

    ``run`` names a column that splits each group; runs are numbered apart and shifted by the
    running total of the runs before them. Equal rows get different numbers.
    """
    from pyspark.sql import Window

    sizes = df.groupBy(group, run).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn(
        "_base", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_n")
    own = F.row_number().over(Window.partitionBy(group, run).orderBy(*order)) - 1
    return df.withColumn("_own", own).join(before, [group, run]).withColumn(out, (F.col("_base") + F.col("_own")).cast("long")).drop("_own", "_base")


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], more: Sequence[float] = (), payload: str | None = None) -> DataFrame:
    """Columns key, payload_size, payload_crc32, shard, grown_shard, slot for every row of df.

    ``more`` are the weights of shards to be added: grown_shard is the owner once they are there
    (null without them). ``payload``: a string column; its size is its UTF-8 bytes plus 1 (null
    counts no bytes). slot is gapless from 0 in each shard. Null keys form one key; repeated rows
    share a shard and get slots of their own; an empty table gives no rows; other columns of df
    are not read, so clashing names do no harm.
    """
    raw = F.coalesce(F.col(payload), F.lit("")).cast("binary") if payload else F.lit("").cast("binary")
    rows = df.select(F.col(key).alias("_key"), (F.octet_length(raw) + 1).cast("long").alias("payload_size"), F.crc32(raw).alias("payload_crc32"))
    rows = rows.withColumn("shard", rendezvous(F.col("_key"), weights)).withColumn(
        "grown_shard", rendezvous(F.col("_key"), [*weights, *more]) if more else F.lit(None).cast("int")
    )
    total = df.select(F.count(F.lit(1)).alias("n")).first()["n"]
    runs = max(1, -(-total // (RUN_ROWS * len(weights))) * 2)
    rows = rows.withColumn("_run", F.pmod(F.xxhash64("_key", "payload_crc32"), F.lit(runs)).cast("int"))
    return gapless(rows, "shard", ["_key", "payload_crc32"], "_run", "slot").drop("_run").withColumnRenamed("_key", key)
