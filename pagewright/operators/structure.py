"""Structure of the undirected local graph: components, communities, cut points, bridges, distances.

Components are found by distributed label propagation with pointer jumping.
Cut points and bridges need a depth-first search, which runs in one task for
each connected component; communities run in one task for each wiki, compiled,
as their gain depends on the whole wiki; distances likewise, below a gate. A group over
``most`` edges raises an error; nothing is dropped.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pagewright.operators.compiled import louvain
from pagewright.session import cut_lineage, parallelism

MOST_EDGES = 5_000_000


def undirected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(wiki, a, b) with a < b: distinct local edges without direction."""
    outside = nodes.filter("external").select("wiki", F.col("slug").alias("b"))
    pairs = edges.select("wiki", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a != b").distinct()
    return pairs.join(outside, ["wiki", "b"], "left_anti").join(outside.withColumnRenamed("b", "a"), ["wiki", "a"], "left_anti").select("wiki", "a", "b")


def components(nodes: DataFrame, pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(wiki, slug, component): the smallest slug that a node is connected with; external nodes take no part.

    Each round takes the least label among neighbours and then the label of
    that label, so a path of n nodes takes about log n rounds. Labels of hot
    nodes are pre-aggregated; states are checkpointed.
    """
    local = nodes.filter("not external").select("wiki", "slug").distinct()
    both = cut_lineage(pairs.select("wiki", F.col("a").alias("slug"), F.col("b").alias("other")).unionByName(pairs.select("wiki", F.col("b").alias("slug"), F.col("a").alias("other"))))
    label = cut_lineage(local.withColumn("component", F.col("slug")))
    for _ in range(rounds):
        near = both.join(label.select("wiki", F.col("slug").alias("other"), "component"), ["wiki", "other"]).groupBy("wiki", "slug").agg(F.min("component").alias("near"))
        least = label.join(near, ["wiki", "slug"], "left").select("wiki", "slug", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = least.select("wiki", F.col("slug").alias("component"), F.col("component").alias("far"))
        new = cut_lineage(least.join(jump, ["wiki", "component"], "left").select("wiki", "slug", "old", F.least("component", F.coalesce("far", "component")).alias("component")))
        label = new.drop("old")
        if new.filter("old != component").isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _adjacency(pdf: pd.DataFrame) -> dict[str, list[str]]:
    near: dict[str, set] = {}
    for a, b in zip(pdf["a"], pdf["b"]):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return {k: sorted(v) for k, v in sorted(near.items())}


def cuts_of(near: dict[str, list[str]]) -> tuple[list[str], list[tuple[str, str]]]:
    """Cut points, and bridges as (root side, far side), by an iterative depth-first search from the smallest node."""
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    points: set[str] = set()
    bridges = []
    for start in near:
        if start in order:
            continue
        order[start] = low[start] = len(order)
        stack = [(start, None, iter(near[start]))]
        branches = 0
        while stack:
            v, parent, rest = stack[-1]
            w = next(rest, None)
            if w is None:
                stack.pop()
                if parent is None:
                    continue
                low[parent] = min(low[parent], low[v])
                if low[v] > order[parent]:
                    bridges.append((parent, v))
                if parent == start:
                    branches += 1
                elif low[v] >= order[parent]:
                    points.add(parent)
            elif w not in order:
                order[w] = low[w] = len(order)
                stack.append((w, v, iter(near[w])))
            elif w != parent:
                low[v] = min(low[v], order[w])
        if branches > 1:
            points.add(start)
    return sorted(points), sorted(bridges)


def _guard(groups: DataFrame, by: list[str], most: int) -> None:
    worst = groups.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if worst > most:
        raise ValueError(f"a group has {worst} edges, more than {most}")


def cut_structure(nodes: DataFrame, edges: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """(wiki, kind, a, b): articulation points (b null) and bridges."""
    pairs = cut_lineage(undirected(nodes, edges))
    label = components(nodes, pairs)
    grouped = pairs.join(label.select("wiki", F.col("slug").alias("a"), "component"), ["wiki", "a"])
    _guard(grouped, ["wiki", "component"], most)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        points, bridges = cuts_of(_adjacency(pdf))
        rows = [(key[0], "articulation-point", p, None) for p in points] + [(key[0], "bridge", a, b) for a, b in bridges]
        return pd.DataFrame(rows, columns=["wiki", "kind", "a", "b"])

    return grouped.groupBy("wiki", "component").applyInPandas(run, "wiki string, kind string, a string, b string")


def louvain_of(near: dict[str, list[str]], lone: int = 0) -> dict[str, int]:
    """First phase of Louvain: nodes in name order move to the other community among their neighbours of best gain, if that is above 0; ties to the smallest id.

    The gain is compared with 0 and not with that of staying, so passes are
    bounded: 10 for each node, those without edges (lone) included, and 100.
    communities() runs the same rule compiled.
    """
    nodes = sorted(near)
    m = sum(map(len, near.values())) / 2
    at = {v: k for k, v in enumerate(nodes)}
    total = {k: len(near[v]) for v, k in at.items()}
    moved, passes = m > 0, 0
    while moved and passes < 10 * (len(nodes) + lone) + 100:
        moved, passes = False, passes + 1
        for v in nodes:
            k, mine = len(near[v]), at[v]
            inside: dict[int, int] = {}
            for w in near[v]:
                inside[at[w]] = inside.get(at[w], 0) + 1
            total[mine] -= k
            best, gain = mine, 0.0
            for c in sorted(inside):
                if c == mine:
                    continue
                g = inside[c] / m - total[c] * k / (2 * m * m)
                if g > gain:
                    best, gain = c, g
            total[best] = total.get(best, 0) + k
            if best != mine:
                at[v], moved = best, True
    ids: dict[int, int] = {}
    return {v: ids.setdefault(at[v], len(ids)) for v in nodes}


def communities(nodes: DataFrame, edges: DataFrame, least: int = 30, most: int = MOST_EDGES) -> DataFrame:
    """(wiki, slug, community) of every wiki with at least so many local nodes; a node without edges is a community of its own, id null.

    The rule is that of louvain_of(), compiled, with the passes that all local
    nodes of the wiki allow. Wikis go to tasks by what they cost, the dearest
    first, and the result is kept, so that no reader runs the passes again.
    """
    pairs = cut_lineage(undirected(nodes, edges))
    worst, wikis = pairs.groupBy("wiki").count().agg(F.max("count"), F.count(F.lit(1))).first()
    if (worst or 0) > most:
        raise ValueError(f"a group has {worst} edges, more than {most}")
    local = nodes.filter("not external").select("wiki", "slug")
    own = W.partitionBy("wiki")
    big = local.withColumn("_n", F.count(F.lit(1)).over(own)).filter(F.col("_n") >= least)
    placed = cut_lineage(big.withColumn("_at", F.dense_rank().over(own.orderBy("slug")) - 1).withColumn("_n", F.max("_at").over(own) + 1))
    end = lambda name: placed.select("wiki", F.col("slug").alias(name), F.col("_at").alias(f"_{name}"), "_n").distinct()
    linked = pairs.join(end("a"), ["wiki", "a"]).join(end("b").drop("_n"), ["wiki", "b"])
    link = F.shiftleft(F.col("_a").cast("bigint"), 32) + F.col("_b")
    graphs = linked.groupBy("wiki").agg(F.first("_n").alias("_n"), F.collect_list(link).alias("_links"))
    cost = F.col("_n").cast("bigint") * F.size("_links")
    tasks = max(1, min(wikis, 16 * parallelism(nodes.sparkSession)))
    ordered = graphs.withColumn("_cost", cost).repartitionByRange(tasks, F.desc("_cost"), "wiki")
    found = cut_lineage(ordered.select("wiki", F.posexplode(louvain(nodes.sparkSession, F.col("_n"), F.col("_links"))).alias("_at", "community")))
    return placed.join(found, ["wiki", "_at"], "left").select("wiki", "slug", "community")


def community_stats(found: DataFrame) -> DataFrame:
    """(wiki, communities, largest, smallest, isolated): isolated are the slugs in communities of one or two, in order."""
    key = F.coalesce(F.col("community").cast("string"), F.concat(F.lit("="), "slug"))
    sizes = found.groupBy("wiki", key.alias("c")).agg(F.count(F.lit(1)).alias("n"))
    few = found.withColumn("c", key).join(sizes.filter("n <= 2").select("wiki", "c"), ["wiki", "c"], "left_semi").groupBy("wiki").agg(F.array_sort(F.collect_list("slug")).alias("isolated"))
    out = sizes.groupBy("wiki").agg(F.count(F.lit(1)).alias("communities"), F.max("n").alias("largest"), F.min("n").alias("smallest"))
    return out.join(few, "wiki", "left").withColumn("isolated", F.coalesce("isolated", F.array().cast("array<string>")))


def eccentricity_of(near: dict[str, list[str]]) -> dict[str, int]:
    out = {}
    for start in near:
        dist, todo = {start: 0}, deque([start])
        while todo:
            v = todo.popleft()
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
        out[start] = max(dist.values())
    return out


def eccentricities(nodes: DataFrame, edges: DataFrame, most_nodes: int = 2000) -> DataFrame:
    """(wiki, slug, eccentricity) of every wiki with at most so many local nodes (the gate is the feature); unreachable nodes are ignored, a lone node has 0."""
    local = nodes.filter("not external").select("wiki", "slug")
    small = local.groupBy("wiki").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most_nodes).select("wiki")
    pairs = undirected(nodes, edges).join(small, "wiki", "left_semi")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = eccentricity_of(_adjacency(pdf))
        return pd.DataFrame({"wiki": key[0], "slug": list(found), "eccentricity": list(found.values())})

    found = pairs.groupBy("wiki").applyInPandas(run, "wiki string, slug string, eccentricity int")
    return local.join(small, "wiki", "left_semi").join(found, ["wiki", "slug"], "left").na.fill(0, ["eccentricity"])


def distance_summary(ecc: DataFrame) -> DataFrame:
    """(wiki, diameter, radius, center, periphery): the slugs of least and of greatest eccentricity, in order; the gate of eccentricities() bounds them."""
    ends = ecc.groupBy("wiki").agg(F.max("eccentricity").alias("diameter"), F.min("eccentricity").alias("radius"))
    at = lambda end: F.array_sort(F.collect_list(F.when(F.col("eccentricity") == F.col(end), F.col("slug"))))
    return ecc.join(ends, "wiki").groupBy("wiki", "diameter", "radius").agg(at("radius").alias("center"), at("diameter").alias("periphery"))
