"""Loss weights of turns and pairs: three modes, normalised by global statistics and clamped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def turn_weight(turn: Column, beta: float = 0.3, mode: str = "gate_amplify", floor: float = 0.1) -> Column:
    """Weight of one turn; 0 unless its role is assistant.

    A missing attunement is 0.5, NaN is the floor. A missing or null score is 0, a negative one too.
    Modes: ``attunement_only``, ``additive``, any other is ``gate_amplify``. Floor 0 is the older variant.
    """
    att = turn["attunement_score"]
    a = F.when(att.isNull(), F.lit(0.5)).when(F.isnan(att), F.lit(float(floor))).otherwise(F.greatest(F.lit(float(floor)), att))
    g = F.log1p(F.greatest(F.lit(0.0), F.coalesce(turn["score"], F.lit(0.0))))
    w = {"attunement_only": a, "additive": a + beta * g}.get(mode, a * (1 + beta * g))
    return F.when(turn["role"] == "assistant", w).otherwise(F.lit(0.0))


def turn_weights(turns: Column, beta: float = 0.3, mode: str = "gate_amplify", floor: float = 0.1) -> Column:
    return F.transform(turns, lambda t: turn_weight(t, beta, mode, floor))


def example_weight(turns: Column, **how) -> Column:
    """Mean of the positive turn weights; 1 where there is none."""
    w = F.filter(turn_weights(turns, **how), lambda x: x > 0)
    return F.coalesce(F.aggregate(w, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(w), F.lit(0)), F.lit(1.0))


def _statistics(weights: DataFrame) -> DataFrame:
    return weights.filter("w > 0").agg(F.avg("w").alias("__mean"), F.stddev_pop("w").alias("__std"))


def _scaled(w: Column, most: float | None) -> Column:
    flat = F.coalesce(F.col("__std"), F.lit(0.0)) <= 1e-8
    out = F.when(flat, F.lit(1.0)).otherwise(w / F.col("__mean"))
    return out if most is None else F.least(out, F.lit(float(most)))


def normalise_turn_weights(df: DataFrame, column: str = "turn_weights", most: float | None = 3.0) -> DataFrame:
    """Positive weights of all rows divided by their mean and clamped to ``most``; zeros stay.

    One aggregate of a single row, broadcast; weights that do not vary become 1.
    """
    stats = _statistics(df.select(F.explode(column).alias("w")))
    scaled = F.transform(F.col(column), lambda w: F.when(w > 0, _scaled(w, most)).otherwise(F.lit(0.0)))
    return df.crossJoin(F.broadcast(stats)).withColumn(column, scaled).drop("__mean", "__std")


def normalise_weight(df: DataFrame, column: str = "chosen_weight", most: float | None = 2.0) -> DataFrame:
    """The same for a scalar column; values that are not positive become 1."""
    stats = _statistics(df.select(F.col(column).alias("w")))
    scaled = F.when(F.col(column) > 0, _scaled(F.col(column), most)).otherwise(F.lit(1.0))
    return df.crossJoin(F.broadcast(stats)).withColumn(column, scaled).drop("__mean", "__std")


def weight_statistics(df: DataFrame, column: str = "turn_weights") -> DataFrame:
    """Number, mean, standard deviation, least and largest positive weight, of an array or a number per row.

    Of the rows as they are: loaders report them after normalising and clamping.
    """
    each = F.explode(column) if df.schema[column].dataType.typeName() == "array" else F.col(column)
    w = df.select(each.alias("w")).filter("w > 0")
    return w.agg(F.count("w").alias("n"), F.avg("w").alias("mean"), F.stddev_pop("w").alias("std"), F.min("w").alias("least"), F.max("w").alias("largest"))
