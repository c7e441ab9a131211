"""Shortest paths as waves of joins: labels of all queries move together, one edge a wave, and meet in the middle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.rounds import Rounds

#: The turn of a label that no restriction asks about.
FREE = -1


def relax(labels: DataFrame, edges: DataFrame, restrictions: DataFrame | None = None, most: float | None = None) -> DataFrame:
    """Labels (source, node, cost, via) after one more step over edges (edge, a, b, w): the least cost of each node stays.

    A turn from via over edge at a node that restrictions (from_edge, to_edge,
    via_node) name is not taken. With restrictions the least cost of each node and
    last edge stays, where a restriction begins with that edge at that node, so a barred
    turn never hides a longer legal way. Labels over `most` are dropped.
    """
    step = labels.join(edges, labels["node"] == edges["a"])
    if restrictions is not None:
        r = restrictions.select(F.col("from_edge").alias("__f"), F.col("to_edge").alias("__t"), F.col("via_node").alias("__v"))
        step = step.join(r, (F.col("via") == F.col("__f")) & (F.col("edge") == F.col("__t")) & (F.col("node") == F.col("__v")), "left_anti")
    moved = step.select("source", F.col("b").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.col("edge").alias("via"))
    every = labels.select("source", "node", "cost", "via").unionByName(moved)
    if most is not None:
        every = every.where(F.col("cost") <= most)
    turn = []
    if restrictions is not None:
        asked = restrictions.select(F.col("from_edge").alias("via"), F.col("via_node").alias("node"), F.col("from_edge").alias("turn")).distinct()
        every, turn = every.join(asked, ["via", "node"], "left"), ["turn"]
    best = F.min(F.struct("cost", "via")).alias("l")
    return every.groupBy("source", "node", *turn).agg(best).select("source", "node", "l.cost", "l.via")


def k_hop_costs(edges: DataFrame, sources: DataFrame, hops: int, **how) -> DataFrame:
    """(source, node, cost, via): cheapest costs over at most `hops` edges, by legal turns if restrictions are given."""
    labels = sources.select(F.col(sources.columns[0]).alias("source"), F.col(sources.columns[0]).alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast("bigint").alias("via"))
    for _ in range(hops):
        labels = relax(labels, edges, **how)
    if how.get("restrictions") is None:
        return labels
    return labels.groupBy("source", "node").agg(F.min(F.struct("cost", "via")).alias("l")).select("source", "node", "l.cost", "l.via")


#: Codes of the one-way directions along an edge and against it (fixed values).
ALONG, AGAINST = (1, 4), (2, 5)


def needs_search(source_edge, source_offset, target_edge, target_offset, direction) -> Column:
    """Whether a route between two places on edges needs a search: on one edge only where its direction forbids to go straight."""
    against = direction.isin(*ALONG) & (source_offset > target_offset) | direction.isin(*AGAINST) & (source_offset < target_offset)
    return (source_edge != target_edge) | F.coalesce(against, F.lit(False))


METHODS = {"dijkstra": (False, False), "astar": (False, True), "bidirectional": (True, False), "mm": (True, True)}
LABEL = ["query", "side", "node", "turn"]
#: Rows up to which their nodes are sent to all tasks.
FEW = 1_000_000


def _near(table: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """The rows of a graph's table that a wave's (written) rows can meet: where these are few, the table is read but not shuffled."""
    return table.join(F.broadcast(rows.select(*on).distinct()), on, "left_semi") if rows.count() <= FEW else table


def frontier_pairs(forward: DataFrame, backward: DataFrame, estimate: Column) -> DataFrame:
    """(query, x, y, bound): for each pair of open ends (query, x, gx) and (query, y, gy) of one query, the cost of a route over both that an estimate from x to y allows."""
    return forward.join(backward, "query").select("query", "x", "y", (F.col("gx") + F.col("gy") + estimate).alias("bound"))


def _arcs(edges: DataFrame, at: DataFrame, turns: DataFrame | None, both: bool) -> DataFrame:
    """(side, node, edge, to, w, lat, lon, to_turn): edges as each side walks them; to_turn is the edge where a restriction asks for it at its end."""
    side = lambda k, a, b: edges.select(F.lit(k).alias("side"), F.col(a).alias("node"), "edge", F.col(b).alias("to"), "w")
    arcs = side(0, "a", "b").unionByName(side(1, "b", "a")) if both else side(0, "a", "b")
    arcs = arcs.join(at.withColumnRenamed("node", "to"), "to", "left")
    if turns is None:
        return arcs.withColumn("to_turn", F.lit(FREE).cast("bigint"))
    asked = turns.select("side", F.col("node").alias("to"), F.col("last").alias("edge"), F.col("last").alias("asked")).distinct()
    return arcs.join(asked, ["side", "to", "edge"], "left").withColumn("to_turn", F.coalesce("asked", F.lit(FREE))).drop("asked")


def _meets(labels: DataFrame, turns: DataFrame | None, both: bool, rounds: Rounds) -> DataFrame:
    """(query, best): the cheapest meeting of both sides by a legal turn, or arrival where there is one side."""
    ahead = labels.where("side = 0").select("query", "node", F.col("turn").alias("f"), "g", "goal")
    if not both:
        met = ahead.where("node = goal").withColumn("b", F.lit(FREE).cast("bigint"))
    else:
        met = ahead.join(labels.where("side = 1").select("query", "node", F.col("turn").alias("b"), F.col("g").alias("more")), ["query", "node"]).withColumn("g", F.col("g") + F.col("more"))
        if turns is not None:
            met = rounds.keep(met, "met")
            barred = turns.where("side = 0").select("node", F.col("last").alias("f"), F.col("next").alias("b"))
            met = met.join(_near(barred, met, ["node"]), ["node", "f", "b"], "left_anti")
    return met.groupBy("query").agg(F.min(F.struct(F.col("g").alias("cost"), "node", "f", "b")).alias("best"))


def _chains(best: DataFrame, labels: DataFrame, both: bool, rounds: Rounds) -> DataFrame:
    """(query, path): edges from source to target, by doubling the labels' pointers to the labels they came from."""
    pred = labels.where("via is not null").select(*LABEL, F.col("from_node").alias("p"), F.col("from_turn").alias("q"))
    hops = labels.agg(F.max("hops")).first()[0] or 0
    jumps = [rounds.keep(pred, "jump0")] if hops else []
    while hops >> len(jumps):
        j = jumps[-1]
        onward = j.select("query", "side", F.col("node").alias("p"), F.col("turn").alias("q"), F.col("p").alias("pp"), F.col("q").alias("qq"))
        jumps.append(rounds.keep(j.join(onward, ["query", "side", "p", "q"]).select(*LABEL, F.col("pp").alias("p"), F.col("qq").alias("q")), f"jump{len(jumps)}"))
    side = lambda k, turn: best.select("query", F.lit(k).alias("side"), "best.node", F.col(f"best.{turn}").alias("turn"))
    marked = side(0, "f").unionByName(side(1, "b")) if both else side(0, "f")
    for j in reversed(jumps):  # every distance back is a sum of distinct jumps
        marked = marked.unionByName(marked.join(j, LABEL).select("query", "side", F.col("p").alias("node"), F.col("q").alias("turn")))
    edges = marked.join(labels.where("via is not null"), LABEL).select("query", "side", F.when(F.col("side") == 0, F.col("hops")).otherwise(-F.col("hops")).alias("k"), "via")
    return edges.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("side", "k", "via"))), lambda x: x["via"]).alias("path"))


def shortest_paths(queries: DataFrame, edges: DataFrame, nodes: DataFrame, restrictions: DataFrame | None = None, method: str = "mm", factor: float = 0.0, least: float | None = None, most: float | None = None) -> DataFrame:
    """(query, cost, path, steps) of queries (query, source, target) over edges (edge, a, b, w) and nodes (node, lat, lon).

    A label is (query, side, node, turn) with the least cost g yet; the turn is the
    last edge where a restriction (from_edge, to_edge, via_node) begins with it, so a
    barred turn never hides a longer legal way. Each wave all labels that got better step
    over the edges by an equi-join, and one aggregate merges what comes in, so neither
    the graph nor a query is ever in one task. A wave of few labels shuffles only the edges and turns at their nodes. Only labels whose priority
    is under the best route found are worth a step: g + estimate, and twice g
    with two sides, which so stop in the middle. Waves end when no such label is
    left; costs are then the least of the whole graph.

    factor is the least cost of a metre, which keeps the estimate admissible; least is
    the least cost of an edge, which cheaper ones are raised to; most bounds a
    route's cost. A query without a route, or with an end that no edge knows,
    has a null cost and an empty path; ends that nodes lack have no estimate. Weights must not be negative. steps counts labels.
    """
    both, guided = METHODS[method]
    rounds = Rounds(edges.sparkSession, "paths")
    w = F.col("w").cast("double")
    at = nodes.select("node", "lat", "lon").distinct()
    turns = None
    if restrictions is not None:
        r = restrictions.select("from_edge", "to_edge", F.col("via_node").alias("node"))
        ahead = r.select(F.lit(0).alias("side"), "node", F.col("from_edge").alias("last"), F.col("to_edge").alias("next"))
        turns = rounds.keep(ahead.unionByName(r.select(F.lit(1).alias("side"), "node", F.col("to_edge").alias("last"), F.col("from_edge").alias("next"))).distinct(), "turns")
    arcs = rounds.keep(_arcs(edges.select("edge", "a", "b", (w if least is None else F.greatest(w, F.lit(least))).alias("w")), at, turns, both), "arcs")
    asked = rounds.keep(queries.select("query", "source", "target"), "queries")

    def start(k: int, here: str, there: str) -> DataFrame:
        goal = at.select(F.col("node").alias("goal"), F.col("lat").alias("goal_lat"), F.col("lon").alias("goal_lon"))
        none = F.lit(None).cast("bigint")
        own = asked.where(F.col("source").isNotNull() & F.col("target").isNotNull()).select("query", F.lit(k).alias("side"), F.col(here).alias("node"), F.lit(FREE).cast("bigint").alias("turn"), F.lit(0.0).alias("g"), F.lit(0.0).alias("f"), F.lit(0).alias("hops"), none.alias("via"), none.alias("from_node"), none.alias("from_turn"), F.lit(True).alias("fresh"), F.col(there).alias("goal"))
        return own.join(goal, "goal", "left").select(*LABEL, "g", "f", "hops", "via", "from_node", "from_turn", "fresh", "goal", "goal_lat", "goal_lon")

    labels = start(0, "source", "target")
    labels = rounds.keep(labels.unionByName(start(1, "target", "source")) if both else labels, "labels")
    estimate = F.coalesce(F.lit(factor) * geo.haversine(F.col("lat"), F.col("lon"), F.col("goal_lat"), F.col("goal_lon")), F.lit(0.0)) if guided and factor else F.lit(0.0)
    priority = F.greatest(F.col("f"), 2 * F.col("g")) if both else F.col("f")
    bound = F.coalesce("best.cost", F.lit(float("inf")))
    if most is not None:
        bound = F.least(bound, F.lit(float(most)) + 1e-9)
    while True:
        front = labels.where("fresh").join(_meets(labels, turns, both, rounds), "query", "left").where(priority < bound).drop("best")
        front = rounds.keep(front, "front")
        if front.isEmpty():
            break
        step = front.join(_near(arcs, front, ["side", "node"]), ["side", "node"])
        if turns is not None:
            barred = _near(turns, front, ["side", "node"]).select("side", "node", F.col("last").alias("turn"), F.col("next").alias("edge"))
            step = step.join(barred, ["side", "node", "turn", "edge"], "left_anti")
        g = F.col("g") + F.col("w")
        moved = step.select(
            "query", "side", F.col("to").alias("node"), F.col("to_turn").alias("turn"), g.alias("g"), (g + estimate).alias("f"), (F.col("hops") + 1).alias("hops"), F.col("edge").alias("via"), F.col("node").alias("from_node"), F.col("turn").alias("from_turn"),
            F.lit(True).alias("fresh"), "goal", "goal_lat", "goal_lon",
        )
        every = labels.withColumn("fresh", F.lit(False)).unionByName(moved)
        order = F.struct("g", "fresh", "hops", "via", "from_node", "from_turn", "f", "goal", "goal_lat", "goal_lon")  # of equal costs the older label stays
        labels = rounds.keep(every.groupBy(*LABEL).agg(F.min(order).alias("l")).select(*LABEL, "l.g", "l.f", "l.hops", "l.via", "l.from_node", "l.from_turn", "l.fresh", "l.goal", "l.goal_lat", "l.goal_lon"), "labels")
    rounds.drop("arcs", "front")
    best = _meets(labels, turns, both, rounds)
    if most is not None:
        best = best.where(F.col("best.cost") <= most)
    best = rounds.keep(best, "best")
    counted = labels.groupBy("query").agg(F.count(F.lit(1)).alias("steps"))
    found = asked.select("query").distinct().join(best.select("query", "best.cost"), "query", "left").join(_chains(best, labels, both, rounds), "query", "left").join(counted, "query", "left")
    return found.select("query", "cost", F.coalesce("path", F.array().cast("array<bigint>")).alias("path"), F.coalesce("steps", F.lit(0)).alias("steps"))
