"""Clustering of scored pairs: components, size-limited splits, communities, checks."""

from __future__ import annotations

import random
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.operators.candidates import range_ranked
from pairweave.operators.graph import connected_components
from pairweave.plans.scratch import Scratch

MAX_SIZE = 100
#: Items of a component that one task splits at most; larger ones are split by joins.
ONE_TASK = 100_000


def edges_at(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.where(F.col("score") >= threshold).select("i", "j", "score")


def components(items: DataFrame, edges: DataFrame) -> DataFrame:
    """item_id, cluster_id (smallest item of the component); items without an edge are clusters of one."""
    found = connected_components(edges, "i", "j").select(F.col("id").alias("item_id"), F.col("component").alias("cluster_id"))
    return items.select("item_id").join(found, "item_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "item_id"))


class _Union:
    """Disjoint sets with their sizes, named by their smallest member."""

    def __init__(self, nodes) -> None:
        self.up = {n: n for n in nodes}
        self.size = dict.fromkeys(self.up, 1)

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            small, large = min(a, b), max(a, b)
            self.up[large] = small
            self.size[small] += self.size[large]
        return a != b

    def parts(self) -> list[list]:
        out = defaultdict(list)
        for n in self.up:
            out[self.find(n)].append(n)
        return [sorted(p) for p in out.values()]


def split_by_tree(nodes: list, edges: list[tuple], max_size: int, keep: str = "min") -> list[list]:
    """Parts of at most max_size: a spanning tree loses its lightest edges, as few as suffice.

    keep="min" builds the tree of smallest total weight, "max"
    the one that holds the strongest links. edges are (u, v, weight); ties by (u, v). Tree
    edges are put back from the strongest down until the next one would make a part too
    large; it and all lighter ones stay out.
    """
    order = sorted(edges, key=lambda e: (e[2] if keep == "min" else -e[2], e[0], e[1]))
    forest = _Union(nodes)
    tree = [e for e in order if forest.join(e[0], e[1])]
    parts = _Union(nodes)
    for a, b, _ in sorted(tree, key=lambda e: (e[2], e[0], e[1]), reverse=True):
        if parts.size[parts.find(a)] + parts.size[parts.find(b)] > max_size:
            break
        parts.join(a, b)
    return parts.parts()


def spanning_tree(edges: DataFrame, keep: str = "min") -> DataFrame:
    """The edges (i, j, score) of the tree that `split_by_tree` builds, for graphs of any size.

    In every round each part takes the first edge that leaves it in the order of the tree;
    parts that such edges join become one, so there are at most as many rounds as the
    number of items has binary digits.
    """
    scratch = Scratch(edges.sparkSession, "tree")
    key = F.struct((F.col("score") if keep == "min" else -F.col("score")).alias("w"), "i", "j")
    now = scratch.table(edges.where("i <> j").select("i", "j", "score").distinct().select("i", "j", "score", F.col("i").alias("a"), F.col("j").alias("b")))
    tree = None
    while not now.isEmpty():
        ends = now.withColumn("k", key).select(F.explode(F.array("a", "b")).alias("part"), F.struct("k", "i", "j", "score", "a", "b").alias("e"))
        chosen = scratch.table(ends.groupBy("part").agg(F.min("e").alias("e")).select("e.i", "e.j", "e.score", "e.a", "e.b").distinct())
        tree = chosen.select("i", "j", "score") if tree is None else tree.union(chosen.select("i", "j", "score"))
        home = scratch.table(connected_components(chosen.select("a", "b"), "a", "b"))
        at = lambda key: home.select(F.col("id").alias(key), F.col("component").alias(f"_{key}"))  # noqa: B023, E731
        moved = now.join(at("a"), "a").join(at("b"), "b").where("_a <> _b").select("i", "j", "score", F.col("_a").alias("a"), F.col("_b").alias("b"))
        after = scratch.table(moved)
        scratch.drop(now, home)
        now = after
    return tree if tree is not None else now.select("i", "j", "score")


def split_giants(members: DataFrame, edges: DataFrame, max_size: int, keep: str = "min") -> DataFrame:
    """item_id, cluster_id: members (item_id, cluster_id) split like `split_by_tree` does, by joins alone.

    The number of tree edges that go back is found by halving, for all clusters at once;
    the driver sees a row a cluster, and clusters that come here are few and large.
    """
    scratch = Scratch(edges.sparkSession, "giants")
    ranked = range_ranked(scratch.table(spanning_tree(edges, keep)), "_at", "score", "i", "j")
    tree = scratch.table(ranked.join(members.withColumnRenamed("item_id", "i"), "i").select("cluster_id", "i", "j", "_at"))
    # edges from `low` on surely fit, those from `high` on are still to be tried
    found = {r["cluster_id"]: [r["n"], 0] for r in tree.groupBy("cluster_id").agg((F.max("_at") + 1).alias("n")).collect()}

    def parts(cuts: dict) -> DataFrame:
        from_ = edges.sparkSession.createDataFrame(list(cuts.items()), f"cluster_id {members.schema['cluster_id'].dataType.simpleString()}, _from long")
        kept = tree.join(F.broadcast(from_), "cluster_id").where(F.col("_at") >= F.col("_from"))
        home = connected_components(kept.select("i", "j"), "i", "j").withColumnRenamed("id", "item_id")
        return members.join(F.broadcast(from_.select("cluster_id")), "cluster_id").join(home, "item_id", "left").select("cluster_id", "item_id", F.coalesce("component", "item_id").alias("part"))

    while any(low > high for low, high in found.values()):
        middle = {c: (low + high) // 2 for c, (low, high) in found.items() if low > high}
        sizes = parts(middle).groupBy("cluster_id", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster_id").agg(F.max("n").alias("n"))
        for r in sizes.collect():
            c, m = r["cluster_id"], middle[r["cluster_id"]]
            if r["n"] <= max_size:
                found[c][0] = m
            else:
                found[c][1] = m + 1
    return parts({c: low for c, (low, _) in found.items()}).select("item_id", F.col("part").alias("cluster_id")) if found else members.select("item_id", "cluster_id")


def split_oversized(clusters: DataFrame, edges: DataFrame, max_size: int = MAX_SIZE, keep: str = "min", one_task: int = ONE_TASK) -> DataFrame:
    """clusters with those above max_size split by a spanning tree; only their edges are grouped.

    One component is one task's work up to one_task items; larger ones are split by joins,
    with the same result. A part is named by its smallest item.
    """
    counted = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_size)
    giant = counted.where(F.col("n") > one_task).select("cluster_id")
    if not giant.isEmpty():
        scratch = Scratch(edges.sparkSession, "giant")
        members = scratch.table(clusters.join(giant, "cluster_id", "left_semi").select("item_id", "cluster_id"))
        inside = scratch.table(edges.join(members.select(F.col("item_id").alias("i")), "i", "left_semi"))
        done = scratch.table(split_giants(members, inside, max_size, keep))
        rest = clusters.join(giant, "cluster_id", "left_anti").select("item_id", "cluster_id")
        return split_oversized(rest, edges, max_size, keep, one_task).unionByName(done)
    sizes = counted.select("cluster_id")
    large = clusters.join(sizes, "cluster_id", "left_semi")
    inner = edges.join(large.withColumnRenamed("item_id", "i"), "i").select("cluster_id", "i", "j", "score")
    kind = clusters.schema["item_id"].dataType.simpleString()

    def parts(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted({*pdf["i"], *pdf["j"]})
        found = split_by_tree(nodes, list(zip(pdf["i"], pdf["j"], pdf["score"], strict=True)), max_size, keep)
        return pd.DataFrame([(n, p[0]) for p in found for n in p], columns=["item_id", "cluster_id"])

    done = inner.groupBy("cluster_id").applyInPandas(parts, f"item_id {kind}, cluster_id {kind}")
    return clusters.join(sizes, "cluster_id", "left_anti").select("item_id", "cluster_id").unionByName(done)


def louvain_parts(nodes: list, edges: list[tuple], seed: int = 42) -> list[list]:
    """Communities of a weighted graph by greedy modularity moves and contraction, in a seeded order."""
    rng = random.Random(seed)
    members = {n: [n] for n in nodes}
    weight: dict = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        weight[a][b] += w
        if a != b:
            weight[b][a] += w
    total = sum(w for a in weight for b, w in weight[a].items()) + sum(weight[a].get(a, 0.0) for a in weight)
    while total > 0:
        degree = {n: sum(weight[n].values()) + weight[n].get(n, 0.0) for n in members}
        home = {n: n for n in members}
        load = dict(degree)
        order = sorted(members)
        rng.shuffle(order)
        moved, any_move = True, False
        while moved:
            moved = False
            for n in order:
                near: dict = defaultdict(float)
                for b, w in weight[n].items():
                    if b != n:
                        near[home[b]] += w
                old = home[n]
                load[old] -= degree[n]
                gain = lambda c: near.get(c, 0.0) - load[c] * degree[n] / total  # noqa: B023, E731
                best = max(sorted({*near, old}), key=lambda c: (gain(c), c == old))
                if gain(best) <= gain(old) + 1e-12:
                    best = old
                load[best] += degree[n]
                if best != old:
                    home[n], moved, any_move = best, True, True
        if not any_move:
            break
        joined: dict = defaultdict(list)
        for n, c in home.items():
            joined[c] += members[n]
        fresh: dict = defaultdict(lambda: defaultdict(float))
        for a in weight:
            for b, w in weight[a].items():
                if a <= b:
                    x, y = home[a], home[b]
                    fresh[x][y] += w
                    if x != y:
                        fresh[y][x] += w
        members, weight = dict(joined), fresh
    return [sorted(m) for m in members.values()]


def louvain(items: DataFrame, edges: DataFrame, max_size: int = MAX_SIZE, seed: int = 42, one_task: int = ONE_TASK) -> DataFrame:
    """item_id, cluster_id: communities within components, those above max_size split by a spanning tree.

    A component of more than one_task items is first split into parts of at most that many,
    and communities are sought within the parts.
    """
    parts_of = Scratch(edges.sparkSession, "louvain").table(split_oversized(components(items, edges), edges, one_task, "max", one_task))
    kind = items.schema["item_id"].dataType.simpleString()
    side = lambda key, out: parts_of.select(F.col("item_id").alias(key), F.col("cluster_id").alias(out))
    inner = edges.join(side("i", "cluster_id"), "i").join(side("j", "_other"), "j").where(F.col("cluster_id") == F.col("_other")).select("cluster_id", "i", "j", "score")

    def parts(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["i"], pdf["j"], pdf["score"], strict=True))
        out = []
        for community in louvain_parts(sorted({*pdf["i"], *pdf["j"]}), rows, seed):
            inside = set(community)
            own = [e for e in rows if e[0] in inside and e[1] in inside]
            out += split_by_tree(community, own, max_size) if len(community) > max_size else [community]
        return pd.DataFrame([(n, p[0]) for p in out for n in p], columns=["item_id", "cluster_id"])

    done = inner.groupBy("cluster_id").applyInPandas(parts, f"item_id {kind}, cluster_id {kind}").withColumnRenamed("cluster_id", "part")
    return items.select("item_id").join(done, "item_id", "left").select("item_id", F.coalesce("part", "item_id").alias("cluster_id"))


def cluster(items: DataFrame, pairs: DataFrame, threshold: float, max_size: int = MAX_SIZE, communities: bool = False) -> DataFrame:
    """item_id, cluster_id of a threshold; no edges at all leave every item alone."""
    edges = edges_at(pairs, threshold)
    if communities:
        return louvain(items, edges, max_size)
    return split_oversized(components(items, edges), edges, max_size)


def violations(clusters: DataFrame, max_size: int = MAX_SIZE) -> DataFrame:
    """kind, key, n: items in several clusters and clusters above the limit; empty for a valid clustering."""
    twice = clusters.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("item").alias("kind"), F.col("item_id").alias("key"), "n")
    large = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_size).select(F.lit("cluster").alias("kind"), F.col("cluster_id").alias("key"), "n")
    return twice.unionByName(large)


def size_histogram(clusters: DataFrame) -> DataFrame:
    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("clusters"))
