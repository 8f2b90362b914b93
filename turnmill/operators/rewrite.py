"""Rewriting rejected branches through a pluggable generator, and matching their length to the chosen ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions import turns
from turnmill.functions.text import truncate_overlong
from turnmill.operators.pairs import typed
from turnmill.session import checkpointed

#: Told to a generator that writes a user turn.
ROLE_PLAY = "Write the next message of the user in this conversation, in their voice."
#: Maps batches (prompt array<struct<role,content>>, min_tokens, max_new_tokens), each of equal limits, to texts.
Generator = Callable[[Iterator[pd.DataFrame]], Iterator[pd.Series]]
#: Parts into which the requests of one pair of limits are spread.
SPREAD = 64


def needs_no_rewrite(chosen_chars: Column, rejected_chars: Column, rejected: Column, threshold: float = 5.0, tolerance: float = 0.30) -> Column:
    """Lengths within the tolerance, and every assistant turn of the rejected branch below the threshold (vacuously too)."""
    low = F.forall(F.filter(rejected, lambda t: t["role"] == "assistant"), lambda t: F.coalesce(t["score"], F.lit(0.0)) < threshold)
    return (turns.length_ratio(chosen_chars, rejected_chars) <= tolerance) & F.coalesce(low, F.lit(True))


def token_limits(n: Column) -> tuple[Column, Column]:
    """(least, most new) tokens for a text of ``n`` characters."""
    return F.greatest(F.lit(1), (n * 0.7 / 4).cast("int")), F.greatest(F.lit(32), (n * 1.3 / 3).cast("int"))


def _requests(df: DataFrame, key: str, slots: Column, extra: Column | None = None) -> DataFrame:
    """A request per slot; its target is the length of the turn, or with ``extra`` that much more and at least 20."""
    e = df.select(key, "fork", "rejected_branch", *([extra.alias("__extra")] if extra is not None else []), F.explode(slots).alias("turn_no"))
    t = F.get("rejected_branch", F.col("turn_no"))
    size = F.coalesce(F.length(t["content"]), F.lit(0))
    asked = e.withColumn("role", t["role"]).withColumn("target", size if extra is None else F.greatest(F.lit(20), size + F.col("__extra")))
    before = F.concat(turns.strip(F.coalesce(F.col("fork"), F.array().cast(df.schema["fork"].dataType))), turns.strip(F.slice("rejected_branch", F.lit(1), F.col("turn_no"))))
    lead = F.array(F.struct(F.lit("system").alias("role"), F.lit(ROLE_PLAY).alias("content")))
    least, most = token_limits(F.col("target"))
    return asked.select(key, "turn_no", "role", "target", F.when(F.col("role") == "user", F.concat(lead, before)).otherwise(before).alias("prompt"), least.alias("min_tokens"), most.alias("max_new_tokens"))


def assistant_requests(df: DataFrame, key: str, threshold: float = 5.0) -> DataFrame:
    """A request per rejected assistant turn scored at the threshold or above, in the context as first written. Pairs are typed."""
    marked = F.transform("rejected_branch", lambda t, i: F.struct(i.alias("i"), ((t["role"] == "assistant") & (F.coalesce(t["score"], F.lit(0.0)) >= threshold)).alias("s")))
    slots = F.transform(F.filter(marked, lambda m: m["s"]), lambda m: m["i"])
    return _requests(df, key, slots)


def adjustable(rejected: Column) -> Column:
    """Numbers of the turns whose length may be changed: user turns and synthetic ones."""
    marked = F.transform(rejected, lambda t, i: F.struct(i.alias("i"), ((t["role"] == "user") | F.coalesce(t["synthetic"], F.lit(False))).alias("s")))
    return F.transform(F.filter(marked, lambda m: m["s"]), lambda m: m["i"])


def length_requests(df: DataFrame, key: str, tolerance: float = 0.30) -> DataFrame:
    """For typed pairs outside the tolerance a request per adjustable turn, each taking its floored part of the difference, at least 20."""
    c, r = turns.chars(F.col("chosen_branch")), turns.chars(F.col("rejected_branch"))
    off = df.withColumn("__c", c).withColumn("__r", r).withColumn("__slots", adjustable(F.col("rejected_branch")))
    off = off.filter((turns.length_ratio(F.col("__c"), F.col("__r")) > tolerance) & (F.size("__slots") > 0))
    return _requests(off, key, F.col("__slots"), F.floor((F.col("__c") - F.col("__r")) / F.size("__slots")))


def generate(requests: DataFrame, key: str, generator: Generator) -> DataFrame:
    """(key, turn_no, text): texts are stripped, and cut where overlong.

    Requests of equal limits come together, spread over ``SPREAD`` parts by a hash of their key, as most turns
    are short and share the least limits. The generator is called once per task, so that it loads its model
    once, with an iterator of batches each of which has one pair of limits.
    """
    schema = requests.select(key, "turn_no", "target").schema.add("text", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []

        def seen() -> Iterator[pd.DataFrame]:
            for b in batches:
                for _, g in b.groupby(["min_tokens", "max_new_tokens"], sort=False):
                    kept.append(g)
                    yield g

        for texts in generator(seen()):
            b = kept.pop(0)
            yield b[[key, "turn_no", "target"]].assign(text=list(texts))

    limits = ["min_tokens", "max_new_tokens"]
    part = F.pmod(F.xxhash64(key, "turn_no"), F.lit(SPREAD))
    grouped = requests.repartition(*limits, part).sortWithinPartitions(*limits)
    return grouped.mapInPandas(run, schema).select(key, "turn_no", truncate_overlong(F.col("text"), F.col("target")).alias("text"))


def apply_texts(df: DataFrame, key: str, texts: DataFrame, count: str) -> DataFrame:
    """``df`` with the contents of the given turns of the JSON ``rejected_branch`` replaced and marked synthetic, and their number.

    Texts join as one map per pair. Turns keep all their other keys; branches without a new text keep their string.
    """
    per = texts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("turn_no", "text"))).alias("__t"))
    new = turns.encode(turns.replace_texts(turns.decode_whole("rejected_branch"), F.col("__t")))
    out = df.drop(count).join(per, key, "left").withColumn("rejected_branch", F.when(F.col("__t").isNull(), F.col("rejected_branch")).otherwise(new))
    return out.withColumn(count, F.coalesce(F.size("__t"), F.lit(0)).cast("long")).drop("__t")


def rewrite_all(df: DataFrame, key: str, generator: Generator, threshold: float = 5.0, tolerance: float = 0.30, skip_matched: bool = True) -> DataFrame:
    """All phases for pairs with JSON branches: skip, rewrite assistant turns, match lengths, recount. No pair is dropped.

    ``skipped`` marks pairs that needed nothing. What a generator wrote is stored in the shared folder before it
    is used, as a second run of a sampling model would write other texts.
    """
    fine = needs_no_rewrite(turns.chars(F.col("__c")), turns.chars(F.col("__r")), F.col("__r"), threshold, tolerance) if skip_matched else F.lit(False)
    marked = df.withColumns({"__c": turns.decode("chosen_branch"), "__r": turns.decode("rejected_branch")}).withColumn("skipped", fine).drop("__c", "__r")
    todo = marked.filter(~F.col("skipped"))
    first = checkpointed(generate(assistant_requests(typed(todo), key, threshold), key, generator))
    once = checkpointed(apply_texts(todo, key, first, "asst_replacements"))
    second = checkpointed(generate(length_requests(typed(once), key, tolerance), key, generator))
    twice = apply_texts(once, key, second, "user_replacements")
    c, r = turns.chars(turns.decode("chosen_branch")), turns.chars(turns.decode("rejected_branch"))
    twice = twice.withColumn("length_matched", turns.length_ratio(c, r) <= tolerance)
    none = {k: F.lit(0).cast("long") for k in ("asst_replacements", "user_replacements")}
    return marked.filter("skipped").withColumns(none).withColumn("length_matched", F.lit(True)).unionByName(twice, allowMissingColumns=True)


def rewrite_pairs(df: DataFrame, key: str, generator: Generator, threshold: float = 5.0, tolerance: float = 0.30, skip_matched: bool = True, keep_unmatched: bool = False) -> DataFrame:
    """``rewrite_all`` without the pairs whose lengths still do not match, unless ``keep_unmatched``."""
    out = rewrite_all(df, key, generator, threshold, tolerance, skip_matched)
    return out if keep_unmatched else out.filter("length_matched")


def run_summary(rewritten: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    """One row about ``rewrite_all``: pairs read, kept, skipped, generated, dropped, turns replaced, and pairs that match."""
    kept = F.lit(True) if keep_unmatched else F.col("length_matched")
    of = lambda c: F.coalesce(F.sum(F.when(kept, F.col(c))), F.lit(0))
    return rewritten.agg(
        F.count(F.lit(1)).alias("input"), F.count_if(kept).alias("kept"), F.count_if(kept & F.col("skipped")).alias("skipped"), F.count_if(kept & ~F.col("skipped")).alias("generated"),
        F.count_if(~kept).alias("dropped"), of("asst_replacements").alias("asst_replaced"), of("user_replacements").alias("user_replaced"), F.count_if(kept & F.col("length_matched")).alias("matched"),
    )


def echo_generator(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    """A stand-in for tests: repeats a word up to the least length of the request."""
    for b in batches:
        yield pd.Series(["word " * max(1, int(n)) for n in b["min_tokens"]])
