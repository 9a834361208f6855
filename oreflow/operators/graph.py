"""Co-occurrence graphs, communities and edge betweenness on edge tables (a < b)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from oreflow.functions.storage import kept
from oreflow.operators.similarity import co_occurrence, members

MAX_LOCAL_EDGES = 200_000
"""Up to so many edges the graph is sent to the tasks whole; beyond, betweenness runs on joins alone."""


def cooccurrence_graph(df: DataFrame, node: str, item: str, threshold: int = 7) -> DataFrame:
    """(a < b): nodes with at least ``threshold`` common distinct items."""
    pairs = co_occurrence(members(df, node, item)).filter(F.col("shared") >= max(threshold, 1))
    return pairs.select(F.col("id1").alias("a"), F.col("id2").alias("b"))


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node reachable.  Isolated ``nodes`` (column node) are their own.

    Rounds of least neighbour label and pointer jumping, each a table in the shared folder.
    """
    both = kept(symmetric(edges).distinct(), "edges")
    ids = both.select(F.col("a").alias("node")).distinct()
    ids = ids if nodes is None else ids.unionByName(nodes.select("node")).distinct()
    label = kept(ids.select("node", F.col("node").alias("component")), "label")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = label.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("via"))
        jump = label.select(F.col("node").alias("via"), F.col("component").alias("far"))
        after = kept(step.join(jump, "via").select("node", "old", F.least("via", "far").alias("component")), "label")
        if after.filter("component <> old").isEmpty():
            return after.select("node", "component")
        label = after.select("node", "component")


def label_propagation(edges: DataFrame, max_iter: int = 5) -> DataFrame:
    """(node, label) after synchronous rounds; the most frequent neighbour label, ties to the smallest.  Nodes are of any type that has an order."""
    both = kept(symmetric(edges), "edges")
    label = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(max_iter):
        votes = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"), "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("m"))
        label = kept(best.select("node", F.col("m.label").alias("label")), "label")
    return label


def communities(labels: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
    """(size, members): sorted members of each label."""
    sets = labels.groupBy(label).agg(F.array_sort(F.collect_list(node)).alias("members"))
    return sets.select(F.size("members").alias("size"), "members").orderBy("size", F.col("members")[0])


def _shares(neighbours: dict, root, weights: str) -> Iterator[tuple]:
    """Credit of every edge in the shortest-path graph from one root."""
    dist, paths, parents, order = {root: 0}, {root: 1.0}, {root: []}, [root]
    for node in order:
        for other in neighbours[node]:
            if other not in dist:
                dist[other], paths[other], parents[other] = dist[node] + 1, 0.0, []
                order.append(other)
            if dist[other] == dist[node] + 1:
                paths[other] += paths[node]
                parents[other].append(node)
    credit = dict.fromkeys(order, 1.0)
    for node in reversed(order):
        weight = {p: paths[p] if weights == "paths" else max(1, len(parents[p])) for p in parents[node]}
        total = sum(weight.values())
        for p, w in weight.items():
            share = credit[node] * w / total
            credit[p] += share
            yield (min(p, node), max(p, node), share)


def edge_betweenness(edges: DataFrame, weights: str = "paths") -> DataFrame:
    """(a, b, betweenness): half the sum over all roots of the credit each edge carries.

    ``weights``: ``paths`` splits a node's credit by its parents' numbers of shortest paths,
    ``parents`` by their numbers of parents.  A small graph is sent whole and the roots are
    dealt to the tasks; a larger one is searched by joins, all roots at once, level by level.
    """
    edges = kept(edges.select("a", "b").distinct(), "edges")
    if edges.count() > MAX_LOCAL_EDGES:
        return _betweenness_by_joins(edges, weights)
    spark = edges.sparkSession
    neighbours: dict = defaultdict(list)
    for r in edges.collect():
        neighbours[r.a].append(r.b)
        neighbours[r.b].append(r.a)
    shared = spark.sparkContext.broadcast({k: sorted(v) for k, v in neighbours.items()})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = defaultdict(float)
        for frame in frames:
            for root in frame["node"]:
                for a, b, share in _shares(shared.value, root, weights):
                    total[a, b] += share
        yield pd.DataFrame([(a, b, v) for (a, b), v in total.items()], columns=["a", "b", "v"])

    roots = symmetric(edges).select(F.col("a").alias("node")).distinct().repartition(spark.sparkContext.defaultParallelism, "node")
    kind = edges.schema["a"].dataType.simpleString()
    return roots.mapInPandas(run, f"a {kind}, b {kind}, v double").groupBy("a", "b").agg(F.round(F.sum("v") / 2, 9).alias("betweenness"))


def _betweenness_by_joins(edges: DataFrame, weights: str) -> DataFrame:
    both = kept(symmetric(edges), "both")
    level = both.select(F.col("a").alias("root")).distinct().select("root", F.col("root").alias("node"), F.lit(1.0).alias("paths"), F.lit(1).alias("parents"))
    levels = [kept(level, "level")]
    seen = levels[0].select("root", "node")
    while True:
        reached = levels[-1].join(both.withColumnRenamed("a", "node"), "node").select("root", F.col("b").alias("node"), "paths")
        fresh = reached.join(seen, ["root", "node"], "left_anti").groupBy("root", "node").agg(F.sum("paths").alias("paths"), F.count(F.lit(1)).cast("int").alias("parents"))
        fresh = kept(fresh, "level")
        if fresh.isEmpty():
            break
        levels.append(fresh)
        seen = kept(seen.unionByName(fresh.select("root", "node")), "seen")
    weight = F.col("paths") if weights == "paths" else F.greatest(F.col("parents"), F.lit(1)).cast("double")
    shares, credit = None, levels[-1].select("root", "node", F.lit(1.0).alias("credit"))
    for above in reversed(levels[:-1]):
        up = credit.join(both.withColumnRenamed("a", "node"), "node").select("root", "node", "credit", F.col("b").alias("parent"))
        up = up.join(above.select("root", F.col("node").alias("parent"), weight.alias("w")), ["root", "parent"])
        up = kept(up.withColumn("share", F.col("credit") * F.col("w") / F.sum("w").over(W.partitionBy("root", "node"))), "share")
        part = up.select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"), "share")
        shares = part if shares is None else shares.unionByName(part)
        gained = up.groupBy("root", F.col("parent").alias("node")).agg(F.sum("share").alias("s"))
        credit = kept(above.join(gained, ["root", "node"], "left").select("root", "node", (1 + F.coalesce("s", F.lit(0.0))).alias("credit")), "credit")
    return shares.groupBy("a", "b").agg(F.round(F.sum("share") / 2, 9).alias("betweenness"))


def modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(half_sum, modularity) of a partition (node, component) of the graph.

    half_sum takes each pair i < j of a community once, ``(A_ij - k_i k_j / 2m) / 2m``; modularity is the
    textbook value.  Pairs are not formed: their degree products follow from sums per community.
    """
    m = edges.agg(F.count(F.lit(1)).alias("m"))
    k = degrees(edges).join(parts, "node")
    side = parts.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    inside = edges.join(parts.withColumnRenamed("node", "a"), "a").join(side, "b").filter(F.col("component") == F.col("cb")).agg(F.count(F.lit(1)).alias("inside"))
    per = k.groupBy("component").agg(F.sum("degree").cast("double").alias("k"), F.sum(F.col("degree") * F.col("degree")).cast("double").alias("k2"))
    sums = per.agg(F.coalesce(F.sum((F.col("k") * F.col("k") - F.col("k2")) / 2), F.lit(0.0)).alias("pairs"), F.coalesce(F.sum("k2"), F.lit(0.0)).alias("k2"))
    row = sums.crossJoin(F.broadcast(m)).crossJoin(F.broadcast(inside))
    two_m = 2.0 * F.col("m")
    half = F.try_divide(F.col("inside") - F.try_divide(F.col("pairs"), two_m), two_m)
    return row.select(F.round(half, 9).alias("half_sum"), F.round(2 * half - F.try_divide(F.col("k2"), two_m * two_m), 9).alias("modularity"))


def girvan_newman(edges: DataFrame, weights: str = "paths") -> DataFrame:
    """(node, component, modularity): cut all edges of the highest betweenness again and again; the
    partition before the half-sum modularity first falls.  Values are compared after rounding."""
    original = kept(edges.select("a", "b").distinct(), "graph")
    nodes = kept(symmetric(original).select(F.col("a").alias("node")).distinct(), "nodes")
    best, score, rest = connected_components(original, nodes), None, original
    while not rest.isEmpty():
        load = kept(edge_betweenness(rest, weights), "load")
        top = load.agg(F.max("betweenness")).first()[0]
        rest = kept(load.filter(F.col("betweenness") < F.lit(top)).select("a", "b"), "rest")
        parts = kept(connected_components(rest, nodes), "parts")
        now = modularity(original, parts).first().half_sum
        if score is not None and now < score:
            break
        best, score = parts, now
    return best.withColumn("modularity", F.lit(score).cast("double"))
