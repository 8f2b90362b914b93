import random

from turnmill.llm.grouping import assign_splits, components, group_components


def brute(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def test_against_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randint(0, 150)}", f"n{rng.randint(0, 150)}") for _ in range(90)] + [(f"p{i}", f"p{i + 1}") for i in range(40)] + [("hub", f"h{i}") for i in range(60)] + [(None, "x"), ("y", None), ("z", "z"), ("n1", "n2"), ("n1", "n2")]
    df = spark.createDataFrame(edges, "a string, b string")
    assert {r.node: r.component for r in components(df, "a", "b", hops=2).collect()} == brute(edges)


def test_empty_and_nulls(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert components(df, "a", "b").count() == 0
    keys = spark.createDataFrame([("c", None), (None, "p"), (None, None), ("d", "p")], "community string, post string")
    assert {r.node: r.component for r in group_components(keys).collect()} == {"c:c": "c:c", "c:d": "c:d", "p:p": "c:d"}


def test_proportions(spark):
    rng = random.Random(1)
    sizes = [(f"c{i}", rng.randint(1, 9)) for i in range(3000)] + [("giant", 9000)]
    df = spark.createDataFrame(sizes, "component string, n long")
    got = {r.component: r.split for r in assign_splits(df, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()}
    assert len(got) == len(sizes) and got["giant"] == "train"
    total = sum(n for _, n in sizes)
    for name, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(sum(n for c, n in sizes if got[c] == name) / total - share) < 0.01
    assert assign_splits(df.limit(0), {"train": 1.0}).count() == 0
