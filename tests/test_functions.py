import json

import pytest
from pyspark.sql import functions as F

from turnmill.functions import keys, text, turns
from turnmill.schemas import TURNS

GOLDEN = [
    ("I'm not sure, tbh. Kind of weird?", [2, 7, 24, 1, 1, 1, 0, 2, 1, 4, 33]),
    ("You're gonna love it! IMO, it's cool.", [2, 7, 28, 3, 1, 0, 1, 1, 3, 5, 37]),
    ("The committee was established in 1923.", [1, 5, 28, 0, 0, 0, 0, 0, 0, 1, 38]),
    ("", [0] * 11),
    ("   ", [0] * 10 + [3]),
    ("Really?!  ok... tl;dr: no\nWhy?", [3, 6, 17, 0, 0, 1, 1, 0, 2, 8, 30]),
    ("don’t you’re éi", [1, 5, 10, 0, 1, 0, 0, 0, 0, 0, 15]),
    ("i think I think maybe", [1, 5, 17, 0, 2, 0, 0, 3, 0, 0, 21]),
    ('Hi? \tYes! "Sure." Go', [3, 4, 11, 0, 0, 1, 1, 0, 0, 5, 20]),
]


def test_golden_counts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "i int, t string")
    got = df.select("i", *[c.alias(k) for k, c in text.counts(F.col("t")).items()]).orderBy("i").collect()
    assert [list(r)[1:] for r in got] == [n for _, n in GOLDEN]


def test_features_of_empty_and_null_text(spark):
    df = spark.createDataFrame([("",), (None,)], "t string").select(text.features(text.counts(F.col("t"))).alias("v"))
    assert [r.v for r in df.collect()] == [[1.0] + [0.0] * 8] * 2


@pytest.mark.parametrize(("given", "want"), [("abcde.fghij", "abcde."), ("abc.efghij", "abc."), ("ab.defghij", "ab.de"), ("abcdefghij", "abcde"), ("abc", "abc")])
def test_truncation(spark, given, want):
    df = spark.createDataFrame([(given,)], "t string").select(text.truncate_at_boundary(F.col("t"), F.lit(5)).alias("x"))
    assert df.first().x == want


def test_keys(spark):
    rows = [(" R/Cobalt Radio/", "t3_K1 ", "Hacker News", "pt-PT"), ("/r/cobaltradio", "k1", "hacker-news", "PT"), ("", "  ", None, "?"), (None, None, "", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string").select(keys.community_key("a"), keys.post_key("b"), keys.source_key("c"), keys.language_key("d"))
    got = [tuple(r) for r in df.collect()]
    assert got[0] == got[1] == ("cobaltradio", "k1", "hackernews", "pt") and got[2:] == [(None,) * 4] * 2


def _typed(spark, lists):
    return spark.createDataFrame([(i, json.dumps(x) if not isinstance(x, str | None) else x) for i, x in enumerate(lists)], "i int, j string").withColumn("t", F.from_json("j", TURNS)).orderBy("i")


def test_turn_arrays(spark):
    u, a = {"role": "user", "content": "hé"}, {"role": "assistant", "content": None}
    df = _typed(spark, [[u, a, u], [u], [], None, [a, a], "broken"])
    got = df.select(turns.chars(F.col("t")), turns.last_role(F.col("t")), turns.alternates(F.col("t")), turns.ends_on_assistant(F.col("t")), F.coalesce(F.size(turns.adjacent_pairs(F.col("t"))), F.lit(0)))
    assert [tuple(r) for r in got.collect()] == [(4, "user", True, False, 1), (2, "user", True, False, 0), (0, "?", True, False, 0), (0, "?", True, False, 0), (0, "assistant", False, True, 0), (0, "?", True, False, 0)]


def test_swap_twice_is_identity(spark):
    df = _typed(spark, [[{"role": r, "content": "x"} for r in ("system", "user", "assistant", "tool")]])
    once, twice = turns.swap_roles(F.col("t")), turns.swap_roles(turns.swap_roles(F.col("t")))
    r = df.select(once.alias("o"), (twice == F.col("t")).alias("same")).first()
    assert [t.role for t in r.o] == ["system", "assistant", "user", "tool"] and r.same
