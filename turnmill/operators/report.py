"""Descriptive statistics of preference pairs. Percentiles are exact: of counts by a hash of their values, of real numbers by ``quantiles``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions import turns
from turnmill.operators.pairs import display_subreddit, length_matched, touched
from turnmill.operators.quantiles import exact_quantiles
from turnmill.session import checkpointed


def _stats(df: DataFrame, columns: dict[str, Column], *names: str, real: bool = False) -> DataFrame:
    """One row per measure with the named statistics; null values are left out. ``real`` measures may have very many different values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), c.cast("double").alias("v")) for k, c in columns.items()])).alias("x")).select("x.*")
    how = {
        "mean": F.avg("v"), "std": F.stddev_pop("v"), "least": F.min("v"), "most": F.max("v"), "median": F.percentile("v", F.lit(0.5)),
        **{f"p{p}": F.percentile("v", F.lit(p / 100)) for p in (10, 25, 75, 90)},
    }
    long = long.filter(~F.isnan("v"))
    ranks = {n: 0.5 if n == "median" else int(n[1:]) / 100 for n in names if n == "median" or n[1:].isdigit()}
    if not real:
        return long.groupBy("measure").agg(*[how[n].alias(n) for n in names])
    long = checkpointed(long)
    rest = long.groupBy("measure").agg(*[how[n].alias(n) for n in names if n not in ranks])
    return rest.join(exact_quantiles(long, "measure", "v", ranks), "measure").select("measure", *names)


def counts_by(df: DataFrame, column: Column, name: str) -> DataFrame:
    """Rows and share per value."""
    n = df.groupBy(column.alias(name)).agg(F.count(F.lit(1)).alias("rows"))
    return n.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("__n")))).select(name, "rows", (F.col("rows") * 100 / F.col("__n")).alias("percent"))


def top_subreddits(df: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most frequent, ties by name."""
    c = counts_by(df, display_subreddit(), "subreddit")
    return c.orderBy(F.col("rows").desc(), "subreddit").limit(k)


def pairs_per_post(df: DataFrame) -> DataFrame:
    """Posts and the distribution of their pairs; a null post is one post."""
    n = df.groupBy("post_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("posts"), F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"), F.percentile("n", F.lit(0.9)).alias("p90"))


def depth_statistics(df: DataFrame) -> DataFrame:
    depth = {"fork": F.col("fork_depth"), "chosen": F.col("chosen_depth"), "rejected": F.size("rejected_branch")}
    return _stats(df, depth, "mean", "median", "least", "most")


def depth_distribution(df: DataFrame) -> DataFrame:
    """Pairs by fork depth; depths above 10 only from a hundredth of the rows on."""
    n = df.groupBy("fork_depth").agg(F.count(F.lit(1)).alias("rows"))
    return n.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("__n")))).filter("rows >= 0.01 * __n or fork_depth <= 10").drop("__n")


def score_statistics(df: DataFrame) -> DataFrame:
    return _stats(df, {c: F.col(c) for c in ("chosen_score", "rejected_score", "score_delta")}, "mean", "median", "p10", "p90", real=True)


def char_statistics(df: DataFrame) -> DataFrame:
    return _stats(df, {c: turns.chars(F.col(f"{c}_branch")) for c in ("chosen", "rejected")}, "mean", "median", "p90", "most")


def length_balance(df: DataFrame, matched_only: bool = False) -> DataFrame:
    """How far the branch lengths of a pair lie apart."""
    df = df.filter(length_matched(df)) if matched_only else df
    x = df.select(turns.chars(F.col("chosen_branch")).alias("c"), turns.chars(F.col("rejected_branch")).alias("r"))
    x = x.withColumn("ratio", turns.length_ratio(F.col("c"), F.col("r")))
    within = [F.count_if(F.col("ratio") <= t).alias(f"within_{int(t * 100)}") for t in (0.1, 0.2, 0.3, 0.5)]
    x = checkpointed(x)
    counted = x.agg(F.count(F.lit(1)).alias("pairs"), F.avg("ratio").alias("mean"), *within, F.count_if(F.col("c") > F.col("r")).alias("chosen_longer"), F.count_if(F.col("r") > F.col("c")).alias("rejected_longer"))
    ranks = exact_quantiles(x.withColumn("all", F.lit(1)), "all", "ratio", {"median": 0.5, "p90": 0.9})
    return counted.withColumn("all", F.lit(1)).join(ranks, "all", "left").drop("all")


def synthesis_statistics(df: DataFrame) -> DataFrame:
    a, u = (F.coalesce(F.col(c), F.lit(0)) > 0 for c in ("asst_replacements", "user_replacements"))
    return df.agg(
        F.count_if(~touched(df)).alias("untouched"), F.count_if(touched(df)).alias("touched"), F.count_if(a & ~u).alias("asst_only"), F.count_if(u & ~a).alias("user_only"), F.count_if(a & u).alias("both")
    )


def _replacements(df: DataFrame) -> DataFrame:
    """(role, replacements) of pairs in which turns of a role were replaced."""
    own = [F.struct(F.lit(k).alias("role"), (F.col(c) if c in df.columns else F.lit(0)).cast("long").alias("replacements")) for k, c in (("assistant", "asst_replacements"), ("user", "user_replacements"))]
    return df.select(F.explode(F.array(*own)).alias("x")).select("x.*").filter("replacements > 0")


def replacement_distribution(df: DataFrame) -> DataFrame:
    """Pairs by the number of their replaced turns, of the assistant and of the user."""
    return _replacements(df).groupBy("role", "replacements").agg(F.count(F.lit(1)).alias("rows"))


def replacement_statistics(df: DataFrame) -> DataFrame:
    """Pairs with replaced turns of a role, and mean, median and most of their numbers."""
    n = F.col("replacements")
    return _replacements(df).groupBy("role").agg(F.count(F.lit(1)).alias("pairs"), F.avg(n).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"), F.max(n).alias("most"))


def community_count(df: DataFrame) -> DataFrame:
    """Number of different communities, as they are shown."""
    return df.agg(F.countDistinct(display_subreddit()).alias("communities"))


def synthetic_flags(df: DataFrame) -> DataFrame:
    """Synthetic turns of the rejected branches: of the assistant, and all others."""
    t = df.select(F.explode("rejected_branch").alias("t")).filter("t.synthetic")
    return t.agg(F.count_if(F.col("t.role") == "assistant").alias("assistant"), F.count_if(~F.coalesce(F.col("t.role") == "assistant", F.lit(False))).alias("user"))


def token_estimate(df: DataFrame) -> DataFrame:
    """A quarter of the characters of forks and both branches, in all and per pair, rounded down."""
    chars = turns.chars(F.col("fork")) + turns.chars(F.col("chosen_branch")) + turns.chars(F.col("rejected_branch"))
    x = df.agg(F.floor(F.coalesce(F.sum(chars), F.lit(0)) / 4).alias("tokens"), F.count(F.lit(1)).alias("n"))
    return x.select("tokens", F.floor(F.col("tokens") / F.greatest("n", F.lit(1))).alias("tokens_per_pair"))


def histogram(df: DataFrame, value: Column, bins: int = 10) -> DataFrame:
    """(bin, start, rows): integer steps of at least 1, the overflow in the last bin; nothing where all values are equal."""
    x = df.select(value.cast("long").alias("v")).filter("v is not null")
    edge = x.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("step", F.greatest(F.floor((F.col("hi") - F.col("lo")) / bins), F.lit(1)))
    b = x.crossJoin(F.broadcast(edge)).filter("hi > lo").withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) / F.col("step")), F.lit(bins - 1)))
    return b.groupBy("bin").agg((F.first("lo") + F.col("bin") * F.first("step")).alias("start"), F.count(F.lit(1)).alias("rows"))


def score_summary(scores: DataFrame, column: str = "attunement_score") -> DataFrame:
    return _stats(scores, {column: F.col(column)}, "mean", "std", "least", "most", "median", "p10", "p25", "p75", "p90", real=True)
