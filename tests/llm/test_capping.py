import math
import random

import pytest
from pyspark.sql import functions as F

from turnmill.llm.capping import mark_capped


def brute(rows, cap):
    """Kept (who, score, ident) rows by sorting; copies across the cap all go."""
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    kept = []
    for own in by.values():
        rank = lambda r: (-(r[1] if r[1] is not None and not math.isnan(r[1]) else -math.inf), math.inf if r[2] is None else r[2])
        own.sort(key=rank)
        n = min(cap, len(own))
        while 0 < n < len(own) and rank(own[n - 1]) == rank(own[n]):
            n -= 1
        kept += own[:n]
    return sorted(map(str, kept))


@pytest.mark.parametrize("cap", [0, 1, 3, 20, 1000])
def test_against_sorting(spark, cap):
    rng = random.Random(cap)
    who = ["big"] * 8 + ["mid", "mid", "small", None]
    rows = [(rng.choice(who), rng.choice([None, math.nan, 0.0, -0.0, 1.5, -3.0, 1e300, -1e300, rng.random(), float("inf")]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "who string, score double, kept long").withColumnRenamed("kept", "id")
    got = mark_capped(df, F.col("who"), F.col("score"), F.col("id"), max_count=cap).filter("kept")
    assert sorted(str(r.id) for r in got.collect()) == sorted(x.rsplit(", ", 1)[1][:-1] for x in brute(rows, cap))


def test_ties_copies_and_clashing_names(spark):
    rows = [("a", 1.0, 1, "x"), ("a", 1.0, 1, "y"), ("a", 1.0, 2, "z"), ("a", 2.0, 9, "t"), ("b", None, None, "n")]
    df = spark.createDataFrame(rows, "who string, v double, id long, kept string")
    got = mark_capped(df, F.col("who"), F.col("v"), F.col("id"), max_count=2)
    assert got.columns == ["who", "v", "id", "kept"]
    assert sorted((r.v, r.id) for r in got.filter("kept").collect() if r.v) == [(2.0, 9)]  # both copies lie across the cap
    assert got.filter("kept").count() == 2 and got.count() == 5


def test_empty_and_share(spark):
    df = spark.createDataFrame([("a", float(i), i) for i in range(100)], "who string, v double, id long")
    assert mark_capped(df.limit(0), F.col("who"), F.col("v"), F.col("id"), max_share=0.1).count() == 0
    got = mark_capped(df, F.col("who"), F.col("v"), F.col("id"), max_share=0.1).filter("kept")
    assert sorted(r.id for r in got.collect()) == list(range(90, 100))
    with pytest.raises(ValueError):
        mark_capped(df, F.col("who"), F.col("v"), F.col("id"))
