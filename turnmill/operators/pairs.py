"""Preference pairs: projections, filters, role repair and the two training-row shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions import turns
from turnmill.operators.weights import example_weight, turn_weights
from turnmill.schemas import PAIR
from turnmill.sources.tables import with_optional


def sft_rows(df: DataFrame, min_chain_depth: int = 3, min_total_score: float = 0.0, **weighting) -> DataFrame:
    """Chains deep and good enough, as ``messages`` and ``turn_weights``; other columns stay.

    The scalar filters come before the JSON is decoded and reach the scan. Null depth or score drops the row,
    and so does an unreadable conversation.
    """
    kept = df.filter((F.col("chain_depth") >= min_chain_depth) & (F.col("total_score") >= min_total_score))
    typed = kept.withColumn("turns", turns.decode("turns")).filter(F.col("turns").isNotNull())
    return typed.withColumn("messages", turns.strip(F.col("turns"))).withColumn("turn_weights", turn_weights(F.col("turns"), **weighting)).drop("turns")


def length_matched(df: DataFrame) -> Column:
    """Kept where the column is absent, dropped where it is null."""
    return F.coalesce(F.col("length_matched"), F.lit(False)) if "length_matched" in df.columns else F.lit(True)


def dpo_rows(df: DataFrame, min_score_delta: float = 0.0, matched_only: bool = True, chosen_weighting: bool = False, **weighting) -> DataFrame:
    """Pairs as ``prompt``, ``chosen``, ``rejected``, with ``chosen_weight`` only if weighting is on; other columns stay."""
    kept = df.filter(F.col("score_delta") >= min_score_delta)
    kept = kept.filter(length_matched(df)) if matched_only else kept
    names = {"prompt": "fork", "chosen": "chosen_branch", "rejected": "rejected_branch"}
    out = kept
    if chosen_weighting:
        out = out.withColumn("chosen_weight", example_weight(turns.decode("chosen_branch"), **weighting))
    for new, old in names.items():
        out = out.withColumn(new, turns.strip(turns.decode(old)))
    return out.drop(*names.values())


def typed(df: DataFrame) -> DataFrame:
    """The three JSON columns of a pair as arrays of turns; null or broken ones stay null."""
    return df.withColumns({c: turns.decode(c) for c in ("fork", "chosen_branch", "rejected_branch")})


def touched(df: DataFrame) -> Column:
    """Whether any turn was rewritten; absent or null counters are 0."""
    n = [F.coalesce(F.col(c), F.lit(0)) if c in df.columns else F.lit(0) for c in ("asst_replacements", "user_replacements")]
    return (n[0] > 0) | (n[1] > 0)


def select_pairs(df: DataFrame, source: str = "", subreddit: str = "", post_id: str = "", synthetic_only: bool = False, untouched_only: bool = False, limit: int = 0, order: str | list[str] | None = None) -> DataFrame:
    """Pairs by equality on source, subreddit and post, by rewriting, and at most ``limit``. Empty arguments filter nothing.

    The limit takes the first rows by ``order``; without one, by a hash of the whole row, so that every run takes the same.
    """
    for c, v in (("source", source), ("subreddit", subreddit)):
        df = df.filter(F.col(c) == v) if v else df
    df = df.filter(F.col("post_id").cast("string") == str(post_id)) if post_id else df
    df = df.filter(touched(df)) if synthetic_only else df
    df = df.filter(~touched(df)) if untouched_only else df
    first = [order] if isinstance(order, str) else list(order) if order else [F.xxhash64(*df.columns), *df.columns]
    return df.orderBy(*first).limit(limit) if limit else df


def swap_where_needed(df: DataFrame) -> DataFrame:
    """Typed pairs with the roles of all three arrays exchanged where the fork ends on the assistant; ``swapped`` says where."""
    swap = turns.ends_on_assistant(F.col("fork"))
    out = df.withColumn("swapped", swap)
    return out.withColumns({c: F.when(F.col("swapped"), turns.swap_roles(F.col(c))).otherwise(F.col(c)) for c in ("fork", "chosen_branch", "rejected_branch")})


def swap_statistics(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("pairs"), F.count_if("swapped").alias("swapped"), F.count_if(~F.col("swapped")).alias("already_ok"))


def assemble(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the 19 columns of a rewritten pair, in order and typed; all other columns are dropped.

    Branches are JSON, and stay as they are written; unreadable ones become null. ``rejected_depth`` is the length of the array.
    """
    chosen, rejected = turns.decode("chosen_branch"), turns.decode("rejected_branch")
    out = df.withColumn("rejected_depth", F.coalesce(F.size(rejected), F.lit(0)))
    out = out.withColumn("chosen_chars", turns.chars(chosen)).withColumn("rejected_chars", turns.chars(rejected))
    for c in ("asst_replacements", "user_replacements"):
        out = with_optional(out, c, F.lit(0))
    out = with_optional(out, "length_matched", F.lit(True))
    json = {"fork", "chosen_branch", "rejected_branch"}
    return out.select(*keep, *[(F.when(turns.decode(f.name).isNotNull(), F.col(f.name)) if f.name in json else F.col(f.name).cast(f.dataType)).alias(f.name) for f in PAIR.fields])


def display_subreddit(c: str = "subreddit") -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(none)"))


