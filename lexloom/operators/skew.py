"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds at least one row in this many; so there are at most as many hot keys as this number.
HOT_SHARE = 1000


def join_back(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, columns: list[str]) -> DataFrame:
    """Left-join per-group values back onto the rows of the groups.

    ``groups`` has one row per key with its row count. The hot keys, those with at least ``total / HOT_SHARE`` rows, are
    at most ``HOT_SHARE`` and are broadcast; the rest meet in a shuffled join in which no key is large. Rows of hot and of
    NULL keys are spread over that shuffle by a hash of the whole row, so ``rows`` is read once. ``groups`` is read
    twice, so give it cut or cheap. Keys must be strings or binary.
    """
    least = max(1, total // HOT_SHARE)
    side = groups.select(F.col(key).alias("_k"), F.col(count).alias("_n"), F.struct(*columns).alias("_v"))
    hot = side.filter(F.col("_n") > least).select("_k", F.col("_v").alias("_hot"))
    cold = side.filter(F.col("_n") <= least).select(F.struct(F.lit(0).cast("bigint").alias("s"), F.col("_k").alias("k")).alias("_ck"), F.col("_v").alias("_cold"))
    kind = rows.schema[key].dataType
    spread = F.struct(F.xxhash64(*rows.columns).alias("s"), F.lit(None).cast(kind).alias("k"))
    marked = rows.join(F.broadcast(hot), rows[key] == F.col("_k"), "left").drop("_k")
    alone = F.col("_hot").isNotNull() | F.col(key).isNull()
    marked = marked.withColumn("_rk", F.when(alone, spread).otherwise(F.struct(F.lit(0).cast("bigint").alias("s"), F.col(key).alias("k"))))
    both = marked.join(cold, F.col("_rk") == F.col("_ck"), "left").withColumn("_v", F.coalesce("_hot", "_cold"))
    return both.select(*rows.columns, *[F.col("_v")[c].alias(c) for c in columns])
