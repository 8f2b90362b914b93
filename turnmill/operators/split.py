"""Reproducible splits, samples and limits by hash, without a sort of all rows on one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def train_test(df: DataFrame, key: str, share: float = 0.05, seed: int = 42) -> DataFrame:
    """``df`` with ``is_test``: exactly ``ceil(n * share)`` rows, those with the least md5 of seed and key.

    The rank is that of hash ranges whose sizes the driver adds up (65,536 numbers at most) and of a window within one
    range. Equal keys are told apart by nothing, so keys should be unique; a null key counts as "".
    """
    h = df.withColumn("__h", _hash(F.coalesce(F.col(key).cast("string"), F.lit("")), seed)).withColumn("__b", F.substring("__h", 1, 4))
    sizes = sorted((r["__b"], r["n"]) for r in h.groupBy("__b").agg(F.count(F.lit(1)).alias("n")).collect())
    take = math.ceil(sum(n for _, n in sizes) * share)
    inside, left = {}, take
    for b, n in sizes:
        inside[b] = min(n, left)
        left -= inside[b]
    full = [b for b, n in sizes if inside[b] == n]
    part = [b for b, n in sizes if 0 < inside[b] < n]
    if not part:
        return h.withColumn("is_test", F.col("__b").isin(full)).drop("__h", "__b")
    # only the one range in which the cut lies is ranked
    cut = h.filter(F.col("__b") == part[0])
    ranked = cut.withColumn("is_test", F.row_number().over(Window.orderBy("__h")) <= inside[part[0]])
    rest = h.filter(F.col("__b") != part[0]).withColumn("is_test", F.col("__b").isin(full))
    return rest.unionByName(ranked).drop("__h", "__b")


def first(df: DataFrame, key: str, is_test: bool) -> DataFrame:
    """The row with the least key of one side of a split, or none."""
    return df.filter(F.col("is_test") == is_test).orderBy(key).limit(1)


def sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """``k`` rows without replacement, those with the least md5; a distributed top-k."""
    return df.orderBy(_hash(F.col(key), seed)).limit(k)
