"""At most so many records per contributor, the best-scored ones, by parallel bisection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnmill.session import checkpointed

#: Interior points per round and contributor: evenly spaced in the value, and in its logarithm.
FRACTIONS = tuple(i / 12 for i in range(1, 12))
#: Contributors over the cap whose bounds are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 100_000


def _midpoints(lo: Column, hi: Column, integer: bool) -> Column:
    """Points in ``[lo, hi)``. ``lo`` is among them, so that each round splits off a row at least."""
    if integer:
        a, b = lo.cast("decimal(30,0)"), hi.cast("decimal(30,0)")
        inner = [(a + F.floor((b - a) * F.lit(i) / F.lit(24))).cast("long") for i in range(1, 24)]
        return F.array(lo, *inner)
    squash = lambda x: F.signum(x) * F.log1p(F.abs(x))
    grow = lambda y: F.signum(y) * F.expm1(F.abs(y))
    even = [lo * F.lit(1 - f) + hi * F.lit(f) for f in FRACTIONS]
    logs = [grow(squash(lo) * F.lit(1 - f) + squash(hi) * F.lit(f)) for f in FRACTIONS]
    return F.array(lo, *even, *logs)


def _narrowed(rows: DataFrame, bounds: DataFrame, integer: bool, hint) -> DataFrame:
    """One round for all contributors: count the rows above every midpoint, keep the bracket of the cutoff.

    ``rows`` (who, v, n); ``bounds`` (who, need, lo, hi). The new bounds are values that occur.
    """
    points = bounds.withColumn("mid", _midpoints(F.col("lo"), F.col("hi"), integer))
    placed = rows.join(hint(points), "who").filter(F.col("v").between(F.col("lo"), F.col("hi")))
    above = F.size(F.filter("mid", lambda m: F.col("v") > m))
    counted = (
        placed.groupBy("who", above.alias("bin"))
        .agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("need").alias("need"))
    )
    down = Window.partitionBy("who").orderBy(F.col("bin").desc())
    cum = counted.withColumn("upto", F.sum("n").over(down))
    return cum.filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need"))).select(
        "who", (F.col("need") - F.col("upto") + F.col("n")).alias("need"), "lo", "hi", "n"
    )


def _cutoffs(rows: DataFrame, bounds: DataFrame, integer: bool, hint) -> DataFrame:
    """(who, need, cut, n): the value at which ``need`` is reached, what is left to take of it, its rows."""
    done: list[DataFrame] = []
    while True:
        found = checkpointed(_narrowed(rows, bounds, integer, hint))
        done.append(found.filter(F.col("lo") == F.col("hi")).select("who", "need", F.col("lo").alias("cut"), "n"))
        bounds = found.filter(F.col("lo") < F.col("hi")).select("who", "need", "lo", "hi")
        if bounds.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def mark_capped(
    df: DataFrame,
    contributor: Column,
    score: Column,
    ident: Column,
    *,
    max_share: float | None = None,
    max_count: int | None = None,
    flag: str = "kept",
) -> DataFrame:
    """``df`` with the boolean ``flag``: whether a row is among its contributor's best ``cap`` rows.

    ``cap`` is ``max_count``, or ``floor(rows * max_share)``. Rows rank by ``score`` from high to low,
    null, NaN and -Infinity last, then by the integer ``ident`` from low to high. All rows count, also
    repeated ones. Rows of one contributor with one score and one ident stand or fall together: where
    they lie across the cap all of them go. A null contributor is a contributor; a null ident is the
    largest. An empty table gives an empty one. Existing columns stay, whatever their names, but one
    named ``flag`` is replaced.

    Work: one pass for the counts, then one narrow pass (contributor, score, ident of contributors over
    the cap) per round. A round counts above all midpoints of all contributors with map-side combining,
    so a hot contributor is a few counters per task. With a share, fewer than 1/share contributors can
    be over the cap; their bounds are broadcast. With a count they are counted first, and joined by a
    shuffle if there are more than ``BROADCAST_ROWS``.
    """
    if (max_share is None) == (max_count is None):
        raise ValueError("give either max_share or max_count")
    low = F.lit(float("-inf"))
    s = score.cast("double")
    # minus zero is zero
    value = F.when(s.isNull() | F.isnan(s), low).otherwise(s + F.lit(0.0))
    own = df.select(F.coalesce(contributor.cast("string"), F.lit("\x00")).alias("who"), value.alias("v"), F.coalesce(ident.cast("long"), F.lit(2**63 - 1)).alias("id"))
    per = checkpointed(own.groupBy("who").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    total = per.agg(F.sum("n")).first()[0] or 0
    cap = max_count if max_count is not None else int(total * max_share + 1e-9)
    over = per.filter(F.col("n") > cap)
    hint = F.broadcast if max_share is not None and max_share * BROADCAST_ROWS >= 1 or over.count() <= BROADCAST_ROWS else (lambda d: d)
    if cap <= 0:
        cuts = over.select("who", F.lit(float("inf")).alias("cut"), F.lit(-(2**63)).alias("cut_id"))
        return _flagged(df, contributor, value, ident, cuts, hint, flag)
    rows = own.join(hint(over.select("who")), "who").persist()
    try:
        bounds = over.select("who", F.lit(cap).cast("long").alias("need"), "lo", "hi")
        if bounds.isEmpty():
            return df.withColumn(flag, F.lit(True))
        cut = checkpointed(_cutoffs(rows.select("who", "v", F.lit(1).cast("long").alias("n")), bounds, False, hint))
        # ties at the cutoff: the same over the negated identifier; ~id cannot overflow
        tied = cut.filter(F.col("n") > F.col("need"))
        ties = rows.join(hint(tied.select("who", "cut")), "who").filter(F.col("v") == F.col("cut")).select("who", F.bitwise_not("id").alias("v"), F.lit(1).cast("long").alias("n"))
        ends = checkpointed(ties.groupBy("who").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).join(tied.select("who", "need"), "who").select("who", "need", "lo", "hi"))
        last = F.lit(2**63 - 1)
        if ends.isEmpty():
            cuts = cut.select("who", "cut", last.alias("cut_id"))
        else:
            by_id = _cutoffs(ties, ends, True, hint)
            # copies of one ident across the cap: the cutoff is just before them
            ids = by_id.select("who", F.when(F.col("n") > F.col("need"), F.bitwise_not("cut") - 1).otherwise(F.bitwise_not("cut")).alias("cut_id"))
            cuts = cut.join(ids, "who", "left").select("who", "cut", F.coalesce("cut_id", last).alias("cut_id"))
        cuts = checkpointed(cuts)
    finally:
        rows.unpersist()
    return _flagged(df, contributor, value, ident, cuts, hint, flag)


def _flagged(df: DataFrame, contributor: Column, value: Column, ident: Column, cuts: DataFrame, hint, flag: str) -> DataFrame:
    names = df.columns
    inner = df.select(
        F.struct(*[df[f"`{c}`"] for c in names]).alias("row") if names else F.lit(None).alias("row"),
        F.coalesce(contributor.cast("string"), F.lit("\x00")).alias("who"),
        value.alias("v"),
        F.coalesce(ident.cast("long"), F.lit(2**63 - 1)).alias("id"),
    )
    joined = inner.join(hint(cuts), "who", "left")
    kept = F.col("cut").isNull() | (F.col("v") > F.col("cut")) | ((F.col("v") == F.col("cut")) & (F.col("id") <= F.col("cut_id")))
    return joined.select("row.*", kept.alias("__kept")).drop(flag).withColumnRenamed("__kept", flag)
