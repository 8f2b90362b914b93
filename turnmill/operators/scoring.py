"""Style alignment of a reply with the turn before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions import text, turns
from turnmill.session import checkpointed

N = len(text.FEATURES)


def exploded_pairs(df: DataFrame, key: str, conversation: Column) -> DataFrame:
    """(key, turn_no, user, assistant): one row per assistant turn that follows a user turn."""
    return df.select(key, F.explode(turns.adjacent_pairs(conversation)).alias("p")).select(key, "p.turn_no", "p.user", "p.assistant")


def pair_features(pairs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the feature vectors u and a of both sides."""
    return pairs.select(*keep, text.features(text.counts(F.col("user"))).alias("u"), text.features(text.counts(F.col("assistant"))).alias("a"))


def feature_statistics(vectors: DataFrame) -> DataFrame:
    """One row: mean and population standard deviation of each feature over both sides."""
    both = vectors.select(F.explode(F.array("u", "a")).alias("v"))
    return both.agg(F.array(*[F.avg(F.col("v")[i]) for i in range(N)]).alias("mean"), F.array(*[F.stddev_pop(F.col("v")[i]) for i in range(N)]).alias("std"))


def _normal(v: str) -> Column:
    return F.transform(F.col(v), lambda x, i: (x - F.col("mean")[i]) / F.when(F.col("std")[i] < 1e-8, F.lit(1.0)).otherwise(F.col("std")[i]))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def turn_alignment(df: DataFrame, key: str, conversation: Column) -> DataFrame:
    """(key, turn_no, alignment): cosine of the pooled z-scores of both sides.

    The vectors are written once, as both the statistics and the scores need them; the statistics are one
    row and broadcast. Rows without a pair, and null or broken conversations, have no row.
    """
    vectors = checkpointed(pair_features(exploded_pairs(df, key, conversation), key, "turn_no"))
    z = vectors.crossJoin(F.broadcast(feature_statistics(vectors))).select(key, "turn_no", _normal("u").alias("u"), _normal("a").alias("a"))
    size = F.sqrt(_dot(F.col("u"), F.col("u"))) * F.sqrt(_dot(F.col("a"), F.col("a")))
    return z.select(key, "turn_no", (_dot(F.col("u"), F.col("a")) / F.when(size < 1e-8, F.lit(1.0)).otherwise(size)).alias("alignment"))


def chain_alignment(df: DataFrame, key: str, scores: DataFrame) -> DataFrame:
    """(key, attunement_score float) of every row of ``df``: the mean of its pairs, 0 where it has none."""
    means = scores.groupBy(key).agg(F.avg("alignment").alias("m"))
    return df.select(key).join(means, key, "left").select(key, F.coalesce("m", F.lit(0.0)).cast("float").alias("attunement_score"))


def embed_alignment(df: DataFrame, key: str, scores: DataFrame, column: str | None = "turns") -> DataFrame:
    """``df`` with the scores written into the turns of the JSON ``column``, if one is named, and the chain score appended.

    Turns keep all their keys; rows without a score keep their string byte for byte.
    """
    per = scores.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("turn_no", "alignment"))).alias("__s"), F.avg("alignment").alias("__m"))
    out = df.join(per, key, "left")
    if column:
        embedded = turns.encode(turns.embed_scores(turns.decode_whole(column), F.col("__s")))
        out = out.withColumn(column, F.when(F.col("__s").isNull(), F.col(column)).otherwise(embedded))
    return out.withColumn("attunement_score", F.coalesce("__m", F.lit(0.0)).cast("float")).drop("__s", "__m")


def boundary_pairs(prompt: Column, chosen: Column) -> Column:
    """The conversation of an older row: ``prompt`` and ``chosen`` (JSON) as one, so that a pair may straddle the boundary."""
    none = F.array().cast(turns.TURNS)
    whole = F.concat(F.coalesce(turns.decode(prompt), none), F.coalesce(turns.decode(chosen), none))
    return F.when(F.size(whole) > 0, whole)
