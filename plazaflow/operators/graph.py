"""Graphs as edge tables: components, shortest paths, alias chains, paths as sequences."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Joins of iterations are by shuffles: a broadcast in every round sends its table to the driver each time, whatever its size.
_SHUFFLED = "shuffle_merge"


def path_edges(steps: DataFrame, path: str, order: list[str], node: str) -> DataFrame:
    """Consecutive nodes of each path as (a, b)."""
    after = F.lead(node).over(Window.partitionBy(path).orderBy(*order))
    return steps.select(path, F.col(node).alias("a"), after.alias("b")).where("b is not null and a <> b")


def cheapest(edges: DataFrame) -> DataFrame:
    """One undirected edge for each pair of nodes, the cheapest."""
    return edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("cost").alias("cost"))


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("a", "b")]
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *rest))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node reaches.

    Each round a node takes the smallest label among itself and its neighbours, then its label's own label; so distances
    halve and rounds grow with the logarithm of the longest chain.
    """
    ways = settle(both_ways(edges.select("a", "b")).distinct())
    labels = settle(ways.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).withColumnRenamed("a", "node"))
    while True:
        near = ways.join(labels.select(F.col("node").alias("b"), "comp").hint(_SHUFFLED), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        hooked = labels.join(near.hint(_SHUFFLED), "node").select("node", F.least("comp", "near").alias("c"), F.col("comp").alias("old"))
        jump = hooked.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        new = settle(hooked.join(jump.hint(_SHUFFLED), "c").select("node", F.least("c", "cc").alias("comp"), "old"))
        labels = new.select("node", "comp")
        if new.where("comp <> old").isEmpty():
            return labels


def roots(alias: DataFrame, name: str, to: str) -> DataFrame:
    """(name, root): where each alias chain ends, by pointer jumping; a chain that ends in a cycle has its smallest member.

    After as many doublings as the table's size needs every pointer stands at an end or in a cycle; the members of cycles
    then take the minimum around them, again by doubling. Names are unique; null names are left out.
    """
    known = alias.select(F.col(name).alias("name"), F.col(to).alias("root")).where("name is not null and root is not null")
    current = settle(known)
    doublings = max(1, current.count().bit_length() + 1)
    for _ in range(doublings):
        step = current.select(F.col("name").alias("root"), F.col("root").alias("next"))
        new = settle(current.join(step, "root", "left").select("name", F.coalesce("next", "root").alias("root"), F.col("root").alias("old")))
        current = new.select("name", "root")
        if new.where("root <> old").isEmpty():
            break  # all at their ends, or around cycles whose length the jumps divide
    cycle = settle(known.join(current.select(F.col("root").alias("name")).distinct(), "name", "left_semi").select("name", F.col("root").alias("next"), F.least("name", "root").alias("least")).where("name <> next"))
    if cycle.isEmpty():
        return current
    for _ in range(doublings):
        step = cycle.select(F.col("name").alias("next"), F.col("next").alias("then"), F.col("least").alias("more"))
        cycle = settle(cycle.join(step, "next").select("name", F.col("then").alias("next"), F.least("least", "more").alias("least")))
    return current.join(cycle.select(F.col("name").alias("root"), "least"), "root", "left").select("name", F.coalesce("least", "root").alias("root"))


def hop_distances(edges: DataFrame, sources: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, dist, prev): cheapest distance from any source, with the node before, by relaxing all edges in rounds.

    ``edges`` are directed (a, b, cost >= 0); ``sources`` have ``node``. Only nodes that improved are relaxed again.
    """
    best = settle(sources.select("node", F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("prev")).distinct())
    front, step = best, 0
    while rounds is None or step < rounds:
        step += 1
        reached = front.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node"), (F.col("dist") + F.col("cost")).alias("dist"), F.col("a").alias("prev"))
        least = reached.groupBy("node").agg(F.min(F.struct("dist", "prev")).alias("n"))
        joined = best.join(least, "node", "full")
        better = F.col("n").isNotNull() & (F.col("dist").isNull() | (F.col("n.dist") < F.col("dist")))
        new = settle(joined.select("node", F.when(better, F.col("n.dist")).otherwise(F.col("dist")).alias("dist"), F.when(better, F.col("n.prev")).otherwise(F.col("prev")).alias("prev"), better.alias("moved")))
        best = new.select("node", "dist", "prev")
        front = new.where("moved").select("node", "dist", "prev")
        if front.isEmpty():
            break
    return best


def dijkstra_paths(edges: DataFrame, pairs: DataFrame, *, max_edges: int = 200_000) -> DataFrame:
    """(source, target, dist, nodes) of wanted pairs; of paths of one length that of fewer nodes, and of those the smaller sequence of nodes.

    A graph of at most ``max_edges`` edges is sent to the tasks, each of which searches from its sources by a heap; for a larger one
    :func:`paths_by_rounds` gives the same rows by joins.
    """
    if edges.limit(max_edges + 1).count() > max_edges:
        return paths_by_rounds(edges, pairs)
    near: dict[int, list[tuple[int, float]]] = {}
    for r in edges.select("a", "b", "cost").collect():
        near.setdefault(r.a, []).append((r.b, r.cost))
    held = edges.sparkSession.sparkContext.broadcast(near)

    def search(source: int, targets: set[int]) -> dict[int, tuple[float, list[int]]]:
        done: set[int] = set()
        heap: list[tuple[float, int, tuple[int, ...]]] = [(0.0, 1, (source,))]
        found = {}
        while heap and len(found) < len(targets):
            d, n, path = heapq.heappop(heap)
            node = path[-1]
            if node in done:
                continue
            done.add(node)
            if node in targets:
                found[node] = (d, list(path))
            for other, cost in held.value.get(node, ()):
                if other not in done:
                    heapq.heappush(heap, (d + cost, n + 1, (*path, other)))
        return found

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(s, t, d, p) for s, g in f.groupby("source") for t, (d, p) in search(int(s), set(map(int, g.target))).items()]
            yield pd.DataFrame(rows, columns=["source", "target", "dist", "nodes"])

    wanted = pairs.select("source", "target").distinct().repartition("source").sortWithinPartitions("source")
    return wanted.mapInPandas(work, "source long, target long, dist double, nodes array<long>")


def paths_by_rounds(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, target, dist, nodes) of wanted pairs, as :func:`dijkstra_paths`, by rounds of joins over all sources at once.

    Each round relaxes the edges of the nodes that came nearer to their source, with their paths.
    """
    wanted = settle(pairs.select("source", "target").distinct())
    way = lambda dist, nodes: F.struct(dist.alias("dist"), F.size(nodes).alias("n"), nodes.alias("nodes"))
    start = F.array(F.col("source").cast("long"))
    best = settle(wanted.select("source").distinct().select("source", F.col("source").alias("node"), way(F.lit(0.0), start).alias("w")))
    front = best
    while not front.isEmpty():
        near = front.join(edges.select("a", "b", "cost"), F.col("node") == F.col("a"))
        longer = way(F.col("w.dist") + F.col("cost"), F.concat("w.nodes", F.array(F.col("b").cast("long"))))
        least = near.select("source", F.col("b").alias("node"), longer.alias("w")).groupBy("source", "node").agg(F.min("w").alias("new"))
        better = F.col("new").isNotNull() & (F.col("w").isNull() | (F.col("new") < F.col("w")))
        joined = settle(best.join(least, ["source", "node"], "full").select("source", "node", F.when(better, F.col("new")).otherwise(F.col("w")).alias("w"), better.alias("moved")))
        best, front = joined.drop("moved"), joined.where("moved").drop("moved")
    return wanted.join(best.withColumnRenamed("node", "target"), ["source", "target"]).select("source", "target", "w.dist", "w.nodes")


def ordered_merges(tops: DataFrame, pairs: DataFrame, *, tiny: int, least_reach: float) -> DataFrame:
    """(node, root) after merging candidate pairs (lo, hi, saddle, factor) from the highest saddle down; only nodes that moved.

    ``tops`` gives each node's top (x, y, z), ``height`` and size ``n``. A group joins the one of the higher top if it has fewer
    than ``tiny`` points, or if its top is within ``factor`` times the other's height (``least_reach`` at least) of its top. Each
    merge depends on those before it, but only within a connected part of the candidates: the parts go to tasks.
    """
    parts = components(pairs.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    end = lambda side: tops.select(F.col("node").alias(side), F.struct("x", "y", "z", "height", "n").alias(f"{side}_top")).hint(_SHUFFLED)
    rows = pairs.join(parts.select(F.col("node").alias("lo"), "comp").hint(_SHUFFLED), "lo").join(end("lo"), "lo").join(end("hi"), "hi")
    rows = rows.select("comp", "lo", "hi", "saddle", "factor", *(F.col(f"{s}_top.{c}").alias(f"{s}_{c}") for s in ("lo", "hi") for c in ("x", "y", "z", "height", "n")))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        top: dict[int, list[float]] = {}
        for r in pdf.itertuples():
            top.setdefault(r.lo, [r.lo_x, r.lo_y, r.lo_z, r.lo_height, r.lo_n])
            top.setdefault(r.hi, [r.hi_x, r.hi_y, r.hi_z, r.hi_height, r.hi_n])
        parent = {n: n for n in top}

        def find(n: int) -> int:
            while parent[n] != n:
                parent[n] = parent[parent[n]]
                n = parent[n]
            return n

        for r in pdf.sort_values(["saddle", "lo", "hi"], ascending=[False, True, True]).itertuples():
            low, high = find(r.lo), find(r.hi)
            if low == high:
                continue
            if top[low][2] > top[high][2]:
                low, high = high, low
            apart = ((top[low][0] - top[high][0]) ** 2 + (top[low][1] - top[high][1]) ** 2) ** 0.5
            if top[low][4] < tiny or apart <= max(r.factor * top[high][3], least_reach):
                parent[low] = high
                top[high][4] += top[low][4]
        moved = [(n, find(n)) for n in parent if parent[n] != n]
        return pd.DataFrame(moved, columns=["node", "root"]).astype("int64")

    return rows.groupBy("comp").applyInPandas(walk, "node long, root long")


def merge_crowns(
    points: DataFrame, *, cell: float = 1.0, depth: float = 1.5, flat: float = 0.5, reach: float = 0.5, flat_reach: float = 0.8, tiny: int = 30, least_reach: float = 3.0, passes: int = 8
) -> DataFrame:
    """(node, root) of all groups of ``points`` (node, x, y, z, height): pieces of one crown are merged into that of the highest top.

    Groups touch in cells that are the same or neighbours; their saddle is the highest of the lower of both in such cells. A
    pair is a candidate if the saddle lies less than ``depth`` under the lower top and the tops are near, or if the lower one
    is tiny. Each pass measures the groups anew; passes end when nothing is joined, at ``passes`` at the latest.
    """
    alias = settle(points.select("node").distinct().withColumn("root", F.col("node")))
    steps = F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    for _ in range(passes):
        grouped = points.join(alias.hint(_SHUFFLED), "node").select("root", "x", "y", "z", "height")
        best = F.max(F.struct("z", "x", "y", "height")).alias("t")
        tops = settle(grouped.groupBy("root").agg(best, F.count("*").alias("n")).select(F.col("root").alias("node"), "t.x", "t.y", "t.z", "t.height", "n"))
        cells = grouped.groupBy(F.floor(F.col("x") / cell).alias("i"), F.floor(F.col("y") / cell).alias("j"), "root").agg(F.max("z").alias("z"))
        sent = cells.select("i", "j", F.col("root").alias("other"), F.col("z").alias("oz"), F.explode(steps).alias("d")).select((F.col("i") + F.col("d.di")).alias("i"), (F.col("j") + F.col("d.dj")).alias("j"), "other", "oz")
        touching = cells.join(sent.hint(_SHUFFLED), ["i", "j"]).where("root < other").groupBy(F.col("root").alias("a"), F.col("other").alias("b")).agg(F.max(F.least("z", "oz")).alias("saddle"))
        end = lambda side: tops.select(F.col("node").alias(side), F.struct("x", "y", "z", "height", "n").alias(f"t{side}")).hint(_SHUFFLED)  # noqa: B023, E731
        both = touching.join(end("a"), "a").join(end("b"), "b")
        first = F.col("ta.z") >= F.col("tb.z")
        pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))  # noqa: B023, E731
        both = both.select(pick("b", "a").alias("lo"), pick("a", "b").alias("hi"), pick("tb", "ta").alias("tlo"), pick("ta", "tb").alias("thi"), "saddle")
        dip = F.col("tlo.z") - F.col("saddle")
        apart = F.sqrt(F.pow(F.col("tlo.x") - F.col("thi.x"), 2) + F.pow(F.col("tlo.y") - F.col("thi.y"), 2))
        factor = F.when(dip < flat, flat_reach).otherwise(reach)
        near = (dip < depth) & (apart <= F.greatest(factor * F.col("thi.height"), F.lit(least_reach)))
        pairs = settle(both.where(near | (F.col("tlo.n") < tiny)).select("lo", "hi", "saddle", factor.alias("factor")))
        if pairs.isEmpty():
            break
        moved = settle(ordered_merges(tops, pairs, tiny=tiny, least_reach=least_reach))
        if moved.isEmpty():
            break
        alias = settle(alias.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")).hint(_SHUFFLED), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
    return alias
