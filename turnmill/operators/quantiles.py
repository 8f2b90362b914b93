"""Exact quantiles of real values without a buffer of all of them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnmill.session import checkpointed

#: Accuracy of the approximate quantiles between which the exact ones are looked for.
ACCURACY = 10_000


def exact_quantiles(long: DataFrame, by: str, value: str, at: dict[str, float]) -> DataFrame:
    """(``by``, and a column for each of ``at``): interpolated quantiles of ``value`` per group, of which there are few.

    Approximate quantiles on either side bracket each one. Values below the bracket are counted, those within,
    a few ten-thousandths of all, are counted by value and ranked; both with map-side combining. Nulls and NaN
    are left out, a group without any value has no row. The values are written once and read three times.
    """
    stored = checkpointed(long.select(by, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")))
    names = list(at)
    edge = 2 / ACCURACY
    bounds = [min(1.0, max(0.0, at[k] + s * edge)) for k in names for s in (-1, 1)]
    near = stored.groupBy(by).agg(F.percentile_approx("v", bounds, F.lit(ACCURACY)).alias("b"), F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    # at the ends the approximation may miss the outermost values, and in small groups the neighbour
    small = F.col("n") <= ACCURACY
    lows = [F.when(small | F.lit(at[k] <= edge), F.col("least")).otherwise(F.col("b")[2 * i]) for i, k in enumerate(names)]
    highs = [F.when(small | F.lit(at[k] >= 1 - edge), F.col("most")).otherwise(F.col("b")[2 * i + 1]) for i, k in enumerate(names)]
    brackets = checkpointed(near.select(by, "n", F.array(*lows).alias("lo"), F.array(*highs).alias("hi")))
    placed = stored.join(F.broadcast(brackets), by)
    below = placed.groupBy(by).agg(*[F.count_if(F.col("v") < F.col("lo")[i]).alias(f"b{i}") for i in range(len(names))])
    below = below.select(by, F.posexplode(F.array(*[F.col(f"b{i}") for i in range(len(names))])).alias("i", "below"))
    inside = F.filter(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: (F.col("v") >= F.col("lo")[i]) & (F.col("v") <= F.col("hi")[i]))
    values = placed.select(by, "v", "n", F.explode(inside).alias("i")).groupBy(by, "i", "v", "n").agg(F.count(F.lit(1)).alias("k"))
    ranked = values.join(F.broadcast(below), [by, "i"]).withColumn("upto", F.col("below") + F.sum("k").over(Window.partitionBy(by, "i").orderBy("v")))
    share = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(names) for x in (i, at[k])]), F.col("i"))
    ranked = ranked.withColumn("rank", share * (F.col("n") - 1))
    covers = lambda r: (F.col("upto") - F.col("k") <= r) & (r < F.col("upto"))
    low, high = F.floor("rank"), F.ceil("rank")
    ends = ranked.groupBy(by, "i", "rank").agg(F.max(F.when(covers(low), F.col("v"))).alias("a"), F.max(F.when(covers(high), F.col("v"))).alias("z"))
    q = ends.select(by, "i", (F.col("a") + (F.col("z") - F.col("a")) * (F.col("rank") - F.floor("rank"))).alias("q"))
    return q.groupBy(by).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(k) for i, k in enumerate(names)])


def exact(values: list[float], share: float) -> float:
    """The same of a few values, for tests."""
    own = sorted(values)
    r = share * (len(own) - 1)
    a, z = own[math.floor(r)], own[math.ceil(r)]
    return a + (z - a) * (r - math.floor(r))
