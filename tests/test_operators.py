import json
import math

import pytest
from pyspark.sql import functions as F

from turnmill.config import load_from_config, overlaid
from turnmill.operators import pairs, report, rewrite, split, tokens, weights
from turnmill.schemas import TURN, TURNS
from turnmill.sources import sinks, tables


@pytest.mark.parametrize(
    ("att", "score", "gate", "additive", "old_gate", "old_additive"),
    [(0.5, 3.0, 0.707944, 0.915888, 0.707944, 0.915888), (None, 3.0, 0.707944, 0.915888, 0.707944, 0.915888), (-0.4, 10.0, 0.171937, 0.819369, 0, 0.719369), (0.8, -7.0, 0.8, 0.8, 0.8, 0.8), (None, None, 0.5, 0.5, 0.5, 0.5), (math.nan, 0.0, 0.1, 0.1, 0, 0)],
)
def test_weights(spark, att, score, gate, additive, old_gate, old_additive):
    df = spark.createDataFrame([(("assistant", "x", score, att, None), ("user", "x", score, att, None))], f"a {TURN.simpleString()}, u {TURN.simpleString()}")
    how = [("gate_amplify", 0.1), ("additive", 0.1), ("gate_amplify", 0.0), ("additive", 0.0)]
    r = df.select(*[weights.turn_weight(F.col("a"), 0.3, m, f) for m, f in how], weights.turn_weight(F.col("u"))).first()
    assert list(r) == pytest.approx([gate, additive, old_gate, old_additive, 0], abs=1e-6)


def test_normalise_and_clamp(spark):
    df = spark.createDataFrame([([0.5, 0.0],), ([1.0, 4.5],)], "turn_weights array<double>")
    assert sorted(x for r in weights.normalise_turn_weights(df, most=2).collect() for x in r[0]) == [0, 0.25, 0.5, 2]
    flat = spark.createDataFrame([(3.0,), (3.0,)], "chosen_weight double")
    assert [r[0] for r in weights.normalise_weight(flat).collect()] == [1, 1]


def test_split_is_exact_and_disjoint(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    got = split.train_test(df, "k", 0.05)
    assert got.count() == 1003 and got.filter("is_test").count() == 51
    again = split.train_test(df.orderBy(F.desc("k")), "k", 0.05)
    assert {r.k for r in got.filter("is_test").collect()} == {r.k for r in again.filter("is_test").collect()}
    assert split.sample(df, "k", 7).count() == 7 and split.train_test(df.limit(0), "k").count() == 0


def test_histogram(spark):
    df = spark.createDataFrame([(v,) for v in (3, 5, 9, 14, 27, 27, None)], "v int")
    got = {r.bin: r.rows for r in report.histogram(df, F.col("v")).collect()}
    assert got == {0: 1, 1: 1, 3: 1, 5: 1, 9: 2}
    assert report.histogram(spark.createDataFrame([(1,), (1,)], "v int"), F.col("v")).count() == 0


def test_exact_quantiles(spark):
    import random

    from turnmill.operators.quantiles import exact, exact_quantiles

    rng = random.Random(5)
    groups = {"a": [rng.gauss(0, 1) for _ in range(30_001)], "b": [rng.choice([1.5, 2.5, 2.5, -7.0]) for _ in range(1000)], "c": [3.25], "d": [1.0, 2.0]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("a", None), ("a", math.nan), ("e", None)]
    at = {"least": 0.0, "p10": 0.1, "median": 0.5, "p90": 0.9, "p999": 0.999, "most": 1.0}
    got = {r.g: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", at).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        for name, p in at.items():
            assert got[g][name] == pytest.approx(exact(xs, p), abs=1e-12), (g, name)


def test_token_weights(spark):
    df = spark.createDataFrame([(1, [-100, 7, 7, -100, 7, -100, 7], [0.0, 0.5, 0.0, 1.5])], "k int, l array<int>, w array<double>")
    assert [r.weight for r in tokens.token_weights(df, "k", "l", "w").orderBy("pos").collect()] == [0, 0.5, 0.5, 0, 1.5, 0, 1]


def _pairs(spark):
    def t(*roles, n=10, score=0):
        return [{"role": r, "content": "x" * n, "score": score} for r in roles]

    rows = [
        (1, t("user", "assistant"), t("user", n=10), t("user", n=47), 1.0),
        (2, t("user"), t("assistant", n=10), t("assistant", n=10, score=9), 2.0),
        (3, t("user"), t("assistant", n=10), t("assistant", n=10), None),
        (4, None, None, [], math.nan),
    ]
    cols = "pair_id long, fork string, chosen_branch string, rejected_branch string, score_delta double"
    df = spark.createDataFrame([(i, *(None if x is None else json.dumps(x) for x in (f, c, r)), s) for i, f, c, r, s in rows], cols)
    for c, k in (("source", "string"), ("subreddit", "string"), ("post_id", "string"), ("post_url", "string"), ("post_score", "long"), ("fork_depth", "long"), ("chosen_depth", "long"), ("chosen_score", "double"), ("rejected_score", "double")):
        df = df.withColumn(c, F.lit(None).cast(k))
    return df.withColumn("asst_replacements", F.lit(0).cast("long")).withColumn("user_replacements", F.lit(0).cast("long")).withColumn("length_matched", F.lit(True))


def test_swap_and_rewrite(spark):
    df = pairs.typed(_pairs(spark))
    s = {r.pair_id: r.swapped for r in pairs.swap_where_needed(df).collect()}
    assert s == {1: True, 2: False, 3: False, 4: False}
    assert [(r.turn_no, r.target) for r in rewrite.length_requests(df, "pair_id").collect()] == [(0, 20)]
    raw = _pairs(spark).withColumn("rejected_branch", F.regexp_replace("rejected_branch", r'"score"', '"kept": {"x": null}, "score"'))
    rewritten = rewrite.rewrite_all(raw, "pair_id", rewrite.echo_generator)
    out = {r.pair_id: r for r in rewritten.collect()}
    assert set(out) == {1, 2, 3, 4} and out[2].asst_replacements == 1 and out[1].user_replacements == 1 and out[3].asst_replacements == 0
    turn = json.loads(out[2].rejected_branch)[0]
    assert turn["synthetic"] and turn["kept"] == {"x": None} and turn["score"] == 9
    assert {r.pair_id for r in rewrite.rewrite_pairs(raw, "pair_id", rewrite.echo_generator).collect()} == {i for i, r in out.items() if r.length_matched}
    summary = rewrite.run_summary(rewritten).first()
    assert (summary.input, summary.kept + summary.dropped, summary.skipped) == (4, 4, 2)
    assert pairs.assemble(rewritten).columns == pairs.PAIR.fieldNames()


def test_batches_have_equal_limits(spark):
    rows = [(i, i % 3, 10 + i % 5, [("user", "x")], 1 + i % 4, 32 + i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, turn_no int, target int, prompt array<struct<role:string,content:string>>, min_tokens int, max_new_tokens int")

    def generator(batches):
        for b in batches:
            assert b[["min_tokens", "max_new_tokens"]].drop_duplicates().shape[0] == 1
            yield b["k"].astype(str) + "\t \n"

    got = rewrite.generate(df, "k", generator).collect()
    assert sorted((r.k, r.text) for r in got) == [(i, str(i)) for i in range(300)]


def test_limit_takes_the_same_rows(spark):
    df = spark.createDataFrame([(i, f"s{i % 2}", None) for i in range(200)], "k int, source string, subreddit string")
    want = {r.k for r in pairs.select_pairs(df, source="s1", limit=20).collect()}
    assert len(want) == 20 and want == {r.k for r in pairs.select_pairs(df.repartition(7).orderBy(F.desc("k")), source="s1", limit=20).collect()}
    assert [r.k for r in pairs.select_pairs(df, source="s1", limit=3, order="k").orderBy("k").collect()] == [1, 3, 5]


def test_checkpoint_folder(spark):
    from types import SimpleNamespace

    from turnmill.session import shared_folder

    conf = SimpleNamespace(get=lambda *a: None)
    far = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://far:7077")
    with pytest.raises(ValueError):
        shared_folder(SimpleNamespace(sparkContext=far))


def test_two_slots_share_the_difference(spark):
    df = spark.createDataFrame([(1, [], [("assistant", "x" * 10, None, None, None)], [("user", "x" * 40, None, None, None), ("user", "x" * 7, None, None, None)])], f"k int, fork {TURNS.simpleString()}, chosen_branch {TURNS.simpleString()}, rejected_branch {TURNS.simpleString()}")
    assert sorted((r.turn_no, r.target) for r in rewrite.length_requests(df, "k").collect()) == [(0, 21), (1, 20)]


def test_filters_and_optional_columns(spark):
    df = _pairs(spark)
    assert pairs.dpo_rows(df).count() == 3  # NaN is above 0 in Spark's order, null is dropped
    assert "chosen_weight" in pairs.dpo_rows(df.drop("length_matched"), chosen_weighting=True).columns
    assert pairs.select_pairs(df, synthetic_only=True, untouched_only=True).count() == 0
    with pytest.raises(ValueError):
        tables.detect_format(df)


def test_branch_checks(spark):
    got = tokens.branch_checks(pairs.typed(_pairs(spark)), "pair_id")
    assert got.count() == 4 * 2 * 7
    # the prompt for an answer is no prefix of a branch that starts on the user, nor of an empty one
    assert sorted((r.pair_id, r.branch) for r in got.filter("check = 'prefix' and status = 'FAIL'").collect()) == [(1, "chosen"), (1, "rejected"), (4, "chosen"), (4, "rejected")]
    assert {r.pair_id for r in got.filter("check = 'response' and status = 'FAIL'").collect()} == {4}
    assert {r.pair_id for r in tokens.branch_checks(pairs.typed(_pairs(spark)), "pair_id", max_length=3).filter("check = 'response' and status = 'FAIL'").collect()} == {1, 2, 3, 4}


def test_sinks_and_loaders(spark, tmp_path):
    path = str(tmp_path / "x.parquet")
    df = _pairs(spark)
    sinks.write(df, path)
    sinks.replace(sinks.with_schema(tables.scan(spark, path).filter("pair_id < 4"), df.schema), path)
    assert tables.scan(spark, path).count() == 3 and tables.scan(spark, str(tmp_path)).count() == 3
    with pytest.raises(FileNotFoundError):
        tables.scan(spark, str(tmp_path / "none"))
    config = overlaid({"data": {"data_path": path, "test_split": 0.5}, "profiles": {"small": {"data": {"seed": 1}}}}, "small")
    assert config["data"]["seed"] == 1
    got = load_from_config(spark, config | {"dpo": {"chosen_weighting": True}}, "pair_id", pair=True)
    assert got.filter("is_test").count() == 1 and "chosen_weight" in got.columns
    with pytest.raises(ValueError):
        tables.non_empty(df.limit(0))


def test_exact_role_swap(spark):
    v = '[{"role": "user", "content": "é", "x": null}]'
    df = spark.createDataFrame([(v, True), (v, False), ("broken", True), (None, True)], "j string, w boolean")
    got = [r[0] for r in df.select(sinks.swap_roles_exact("j", F.col("w"))).collect()]
    assert got == [v.replace("user", "assistant"), v, "broken", None]
