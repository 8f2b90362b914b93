"""Splits that never divide a group: components by frontier search from many seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnmill.session import checkpointed

#: Hops of a search before the nodes that it has not reached become seeds of their own.
HOPS = 6


def _search(adjacent: DataFrame, hops: int) -> DataFrame:
    """(node, label): every node with the least seed that reached it first.

    ``adjacent`` holds both directions of each edge as (node, peer). Seeds are the nodes that come
    before all their neighbours by degree and hash, so each component has one and all expand at once.
    """
    rank = adjacent.groupBy("node").agg((-F.count(F.lit(1))).alias("d")).select("node", F.struct("d", F.xxhash64("node").alias("h"), "node").alias("rank"))
    rank = checkpointed(rank)
    best = adjacent.join(rank.select(F.col("node").alias("peer"), "rank"), "peer").groupBy("node").agg(F.min("rank").alias("m"))
    labels = checkpointed(rank.join(best, "node").select("node", F.when(F.col("rank") < F.col("m"), F.col("node")).alias("label")))
    frontier = labels.filter(F.col("label").isNotNull())
    for _ in range(hops):
        reached = adjacent.join(frontier, "node").groupBy(F.col("peer").alias("node")).agg(F.min("label").alias("seed"))
        grown = labels.join(reached, "node", "left").select("node", F.coalesce("label", "seed").alias("label"), (F.col("label").isNull() & F.col("seed").isNotNull()).alias("new"))
        grown = checkpointed(grown)
        frontier, labels = grown.filter("new").select("node", "label"), grown.select("node", "label")
        if frontier.isEmpty():
            break
    return labels.select("node", F.coalesce("label", "node").alias("label"))


def components(edges: DataFrame, left: str, right: str, hops: int = HOPS) -> DataFrame:
    """(node, component) of every node of the undirected graph; a component is named by its least node.

    Frontier search from many seeds at once over the adjacency list, hash-partitioned by node. Where
    two searches meet, their seeds are an edge of a smaller graph, to which the same is applied until
    no edge is left; each level at least halves the nodes that have edges. All of it stays in
    DataFrames, nothing is gathered on the driver. Null ends link nothing, loops and repeated edges
    change nothing, an empty graph gives an empty result.
    """
    e = edges.select(F.col(left).cast("string").alias("node"), F.col(right).cast("string").alias("peer"))
    e = e.filter(F.col("node").isNotNull() & F.col("peer").isNotNull())
    nodes = e.select("node").unionByName(e.select(F.col("peer").alias("node"))).distinct()
    adjacent = e.unionByName(e.select(F.col("peer").alias("node"), F.col("node").alias("peer"))).filter(F.col("node") != F.col("peer"))
    adjacent = checkpointed(adjacent.distinct())
    levels: list[DataFrame] = []
    while not adjacent.isEmpty():
        labels = checkpointed(_search(adjacent, hops))
        levels.append(labels)
        a, b = labels.select("node", F.col("label").alias("a")), labels.select(F.col("node").alias("peer"), F.col("label").alias("b"))
        met = adjacent.join(a, "node").join(b, "peer").filter(F.col("a") != F.col("b"))
        adjacent = checkpointed(met.select(F.col("a").alias("node"), F.col("b").alias("peer")).distinct())
    out = nodes.select("node", F.col("node").alias("label"))
    for labels in levels:
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        out = out.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"))
    least = out.groupBy("label").agg(F.min("node").alias("component"))
    return checkpointed(out.join(least, "label").select("node", "component"))


def assign_splits(sizes: DataFrame, proportions: dict[str, float], seed: int = 42, buckets: int = 4096) -> DataFrame:
    """(component, split) from (component, n): whole components, in hash order, up to the proportions.

    Components larger than the smallest share of all rows come first, in the first split of
    ``proportions``; the others follow in hash order and fill what each split still lacks. The running
    sum is that of ``buckets`` hash ranges, which the driver adds up, and within each range a window, so
    that no task sees all components. Empty input gives an empty result.
    """
    names, shares = list(proportions), [proportions[k] for k in proportions]
    whole = sum(shares)
    shares = [s / whole for s in shares]
    total = sizes.agg(F.sum("n")).first()[0] or 0
    big = F.col("n") > total * min(shares)
    h = F.pmod(F.xxhash64(F.lit(seed), "component"), F.lit(2**40))
    placed = sizes.select("component", "n", h.alias("h"), big.alias("big")).withColumn("bucket", F.floor(F.col("h") * buckets / 2**40).cast("int"))
    firsts = placed.filter("big").agg(F.sum("n")).first()[0] or 0
    quota = [max(0.0, total * s - (firsts if i == 0 else 0)) for i, s in enumerate(shares)]
    rest = total - firsts
    scale = rest / sum(quota) if sum(quota) else 0.0
    ends, at = [], 0.0
    for x in quota:
        at += x * scale
        ends.append(at)
    starts, run = {}, 0
    for b, n in sorted((r["bucket"], r["n"]) for r in placed.filter(~F.col("big")).groupBy("bucket").agg(F.sum("n").alias("n")).collect()):
        starts[b], run = run, run + n
    start = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("bucket")) if starts else F.lit(0)
    within = Window.partitionBy("big", "bucket").orderBy("h", "component")
    before = start + F.sum("n").over(within) - F.col("n") / 2
    split = F.lit(names[-1])
    for name, end in reversed(list(zip(names[:-1], ends[:-1], strict=True))):
        split = F.when(before < end, F.lit(name)).otherwise(split)
    return placed.select("component", F.when(F.col("big"), F.lit(names[0])).otherwise(split).alias("split"))


def group_components(keys: DataFrame) -> DataFrame:
    """(node, component) from the (community, post) keys of all records: ``c:`` and ``p:`` nodes."""
    pairs = keys.select(F.concat(F.lit("c:"), "community").alias("a"), F.concat(F.lit("p:"), "post").alias("b")).distinct()
    lone = pairs.select(F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b"))
    return components(lone, "a", "b")


def group_node(community: Column, post: Column) -> Column:
    """The node of a record; null where it has neither key."""
    return F.coalesce(F.concat(F.lit("c:"), community), F.concat(F.lit("p:"), post))
