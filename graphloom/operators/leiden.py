"""Leiden communities: local moves, refinement and aggregation as joins and aggregates.

Both quality functions are ``sum of inner weight - r / 2 x sum of (community size)^2``: CPM counts
nodes (r is the resolution), modularity counts weighted degrees (r is the resolution by twice the
total weight).  Weights are scaled to integers, so sums do not depend on their order and a run
gives the same communities on any cluster.

Moves of one turn are made together and the quality still never falls.  Communities are parted
into takers and givers, and nodes only go from givers to takers.  All that ask for a taker go if
they gain together, even if all others had left their givers before; else a node goes if its gain
holds even if all others had come and left before, or if it is the best for its taker and its
giver.  Every bound is an aggregate by community, so no community is gathered in a task.

Links stay dealt by their first end while a level lasts, and up to ``MOST_SENT`` nodes what belongs
to a node or community goes to them by broadcast, so a turn shuffles rows of nodes but none of links.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.storage import checkpointed, dropped, file_bytes

SCALE = 1 << 20
EDGE = 1e-6  #: scaled weights are whole, so smaller gains are rounding
RESOLUTION = 0.25
MOVE_TURNS, MERGE_TURNS, MAX_LEVELS = 12, 6, 12  #: what a level leaves open, the next one goes on with
#: Nodes of a level up to which its tables of nodes are broadcast; bytes of written links for each task.
MOST_SENT, LINK_BYTES = 1_000_000, 1 << 20


def undirected(edges: DataFrame, weighted: bool = True) -> DataFrame:
    """``(a, b, w)`` with a < b and scaled weights: self-loops and null ends go, of repeated edges the largest weight holds.

    A null weight counts as 1, one below 0 as 0.
    """
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(1.0)), F.lit(0.0)) if weighted else F.lit(1.0)
    pair = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.round(weight * SCALE).cast("long").alias("w"))
    return pair.groupBy("a", "b").agg(F.max("w").alias("w"))


def _laid(links: DataFrame, nodes: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The links of a level and a link of weight 0 from each node to itself, kept dealt by ``a``; and how tables of nodes are sent to them."""
    sent = F.broadcast if nodes.count() <= MOST_SENT else lambda df: df
    tasks = max(1, -(-file_bytes(links) // LINK_BYTES))
    near = links.unionByName(nodes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).cast("long").alias("w")))
    return near.repartition(tasks, "a").persist(), sent


def _parted(asked: DataFrame, turn: int, own: str, sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The asked moves that go from a giver to a taker.

    Communities are ordered by the gain that asks for them (ties by a hash of the turn).  One
    gives if a node asks to go up in that order and takes otherwise, so the most wanted one always
    takes.  ``free`` targets, empty or settled for good, take from all.
    """
    order = lambda label, flow: F.struct(F.coalesce(flow, F.lit(0.0)), F.xxhash64(label, F.lit(turn)), F.col(label))
    flow = asked.groupBy("target").agg(F.round(F.sum("gain"), 3).alias("flow"))
    up = asked.join(sent(flow), "target").join(sent(flow.select(F.col("target").alias(own), F.col("flow").alias("own_flow"))), own, "left")
    up = up.where(F.col("free") | (order(own, F.col("own_flow")) < order("target", F.col("flow")))).drop("flow", "own_flow")
    givers = up.select(F.col(own).alias("target")).distinct()
    return up.where("free").unionByName(up.where("not free").join(sent(givers), "target", "left_anti"))


def _granted(asked: DataFrame, links: DataFrame, r: float, own: str, sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(id, target)`` of the moves that are made.

    All that ask for a taker go if together they bring more than the best of them alone, the
    links among them counted; else those go whose gain is sure, and the best of a taker that is
    also the best of its giver.
    """
    first = F.max_by("id", F.struct("gain", F.bitwise_not("id")))
    of = asked.groupBy(own).agg(F.sum("size").alias("going"), first.alias("best_out"))
    asked = asked.join(sent(of), own).withColumn("net", F.col("gain") - r * F.col("size") * (F.col("going") - F.col("size")))
    end = lambda name: sent(asked.select(F.col("id").alias(name), F.col("target").alias(f"t{name}")))
    among = links.where("a < b").join(end("a"), "a").join(end("b"), "b").where("ta = tb").groupBy(F.col("ta").alias("target")).agg(F.sum("w").alias("among"))
    to = asked.groupBy("target").agg(F.sum("size").alias("coming"), F.sum(F.col("size") * F.col("size")).alias("squares"), F.sum("net").alias("nets"), F.max("gain").alias("top"), first.alias("best_in"))
    to = to.join(sent(among), "target", "left")
    joint = F.col("nets") + F.coalesce("among", F.lit(0)) - r / 2 * (F.col("coming").cast("double") * F.col("coming") - F.col("squares"))
    sure = F.col("net") - r * F.col("size") * (F.col("coming") - F.col("size")) > EDGE
    best = (F.col("id") == F.col("best_in")) & (F.col("id") == F.col("best_out"))
    return asked.join(sent(to), "target").where((joint > F.col("top") + EDGE) | sure | best).select("id", "target")


def _moved(nodes: DataFrame, links: DataFrame, r: float, max_turns: int, sent: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, bool]:
    """Local moves until none gains or the turns are over: ``nodes`` ``(id, size, comm)`` with new communities, and whether any node moved.

    ``links`` are those of ``_laid``: a node's link to itself votes for its own community and for being alone.
    The first table of nodes, which they are made of, stays.
    """
    any_moved = False
    for turn in range(max_turns):
        sums = nodes.groupBy("comm").agg(F.sum("size").alias("whole"))
        around = links.join(sent(nodes.select(F.col("id").alias("b"), F.col("comm").alias("label"))), "b")
        labels = F.when(F.col("a") == F.col("b"), F.array("label", "a")).otherwise(F.array("label"))
        votes = around.select("a", F.explode(labels).alias("label"), "w").groupBy("a", "label").agg(F.sum("w").alias("w"))
        scored = votes.join(sent(sums.select(F.col("comm").alias("label"), "whole")), "label", "left").join(sent(nodes.withColumnRenamed("id", "a")), "a")
        stays = F.col("label") == F.col("comm")
        whole = F.coalesce("whole", F.lit(0)) - F.when(stays, F.col("size")).otherwise(0)
        scored = scored.withColumn("gain", F.col("w") - r * F.col("size") * whole).withColumn("free", F.col("whole").isNull())
        best = F.max_by(F.struct("label", "gain", "free"), F.when(~stays, F.struct("gain", F.xxhash64("a", "label"), "label")))  # ties spread
        chosen = scored.groupBy(F.col("a").alias("id"), "size", "comm").agg(F.max(F.when(stays, F.col("gain"))).alias("stay"), best.alias("best"))
        asked = chosen.where("best is not null and best.label <> comm").select("id", "size", "comm", F.col("best.label").alias("target"), (F.col("best.gain") - F.col("stay")).alias("gain"), F.col("best.free").alias("free"))
        asked = checkpointed(asked.where(F.col("gain") > EDGE))
        if asked.isEmpty():
            dropped(asked)
            return nodes, any_moved
        gone = _granted(_parted(asked, turn, "comm", sent), links, r, "comm", sent)
        after = checkpointed(nodes.join(sent(gone), "id", "left").select("id", "size", F.coalesce("target", "comm").alias("comm")))
        dropped(asked, *([nodes] if any_moved else []))
        nodes, any_moved = after, True
    return nodes, any_moved


def _refined(nodes: DataFrame, links: DataFrame, r: float, max_turns: int, sent: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, bool]:
    """``(id, size, comm, ref)``: each community parted into connected groups ``ref``, and whether any group has two nodes.

    All start alone.  A node that is well connected with its community joins, once and for good,
    the group of that community with the largest gain, if the group is well connected too.
    """
    com = lambda end: sent(nodes.select(F.col("id").alias(end), F.col("comm").alias(f"c{end}")))
    inner = links.where("a <> b").join(com("a"), "a").join(com("b"), "b").where("ca = cb").select("a", "b", "w").persist()
    sums = nodes.groupBy("comm").agg(F.sum("size").alias("whole"))
    ties = inner.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("tie"))
    state = nodes.join(sent(sums), "comm").join(sent(ties), "id", "left")
    well = F.coalesce("tie", F.lit(0)) >= r * F.col("size") * (F.col("whole") - F.col("size"))
    state = checkpointed(state.select("id", "size", "comm", "whole", well.alias("well"), F.col("id").alias("ref"), F.lit(True).alias("lone")))
    merged = False
    for turn in range(max_turns):
        ref = lambda end: sent(state.select(F.col("id").alias(end), F.col("ref").alias(f"r{end}")))
        votes = inner.join(ref("a"), "a").join(ref("b"), "b").where("ra <> rb").groupBy("a", "ra", "rb").agg(F.sum("w").alias("w")).persist()
        out = votes.groupBy(F.col("ra").alias("ref")).agg(F.sum("w").alias("out"))
        groups = state.groupBy("ref", "whole").agg(F.sum("size").alias("sum"), F.count(F.lit(1)).alias("n")).join(sent(out), "ref")
        groups = groups.where(F.col("out") >= r * F.col("sum") * (F.col("whole") - F.col("sum"))).select(F.col("ref").alias("rb"), "sum", (F.col("n") > 1).alias("free"))
        movers = state.where("lone and well").select(F.col("id").alias("a"), "size")
        scored = votes.join(sent(movers), "a").join(sent(groups), "rb").withColumn("gain", F.col("w") - r * F.col("size") * F.col("sum")).where(F.col("gain") > EDGE)
        asked = scored.groupBy(F.col("a").alias("id"), "size").agg(F.max_by(F.struct("rb", "gain", "free"), F.struct("gain", F.xxhash64("a", "rb"), "rb")).alias("best"))
        asked = checkpointed(asked.select("id", "size", F.col("id").alias("own"), F.col("best.rb").alias("target"), F.col("best.gain").alias("gain"), F.col("best.free").alias("free")))
        if asked.isEmpty():
            dropped(asked)
            votes.unpersist()
            break
        gone = _granted(_parted(asked, turn, "own", sent), inner, r, "own", sent)
        grown = gone.select(F.col("target").alias("id")).distinct().withColumn("grown", F.lit(True))
        after = state.join(sent(gone), "id", "left").join(sent(grown), "id", "left")
        lone = F.col("lone") & F.col("target").isNull() & F.col("grown").isNull()
        after = checkpointed(after.select("id", "size", "comm", "whole", "well", F.coalesce("target", "ref").alias("ref"), lone.alias("lone")))
        votes.unpersist()
        dropped(asked, state)
        state, merged = after, True
    inner.unpersist()
    return state, merged


def leiden(edges: DataFrame, quality: str = "cpm", resolution: float = RESOLUTION, weighted: bool = True, start: DataFrame | None = None, move_turns: int = MOVE_TURNS, merge_turns: int = MERGE_TURNS, max_levels: int = MAX_LEVELS) -> DataFrame:
    """``(node_id, community_id)`` of every node with an edge to another; a community is named by its smallest node.

    ``quality`` is ``cpm`` or ``modularity``; a larger ``resolution`` gives smaller communities.
    ``start`` ``(node_id, community_id)`` carries an earlier partition, whose communities are where
    the first moves begin; nodes it lacks start alone.  Refinement takes the best group instead of
    drawing one (the usual form's randomness at 0).  Communities are connected: at the end each
    one's unconnected parts are named apart, which never lowers the quality.
    """
    if quality not in ("cpm", "modularity"):
        raise ValueError(f"{quality!r} is no quality function")
    one = checkpointed(undirected(edges, weighted))
    links = checkpointed(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    nodes = links.groupBy(F.col("a").alias("id")).agg((F.count(F.lit(1)) * 0 + 1 if quality == "cpm" else F.sum("w")).alias("size"))
    if quality == "cpm":
        r = resolution * SCALE
    else:
        total = links.agg(F.sum("w")).first()[0] or 0
        r = resolution / total if total else 0.0
    comm = F.col("id")
    if start is not None:
        old = start.select(F.col("node_id").alias("id"), "community_id")
        nodes = nodes.join(old, "id", "left")
        first = nodes.groupBy("community_id").agg(F.min("id").alias("named"))  # names among the nodes that are still there
        nodes, comm = nodes.join(first, "community_id", "left"), F.coalesce("named", "id")
    nodes = checkpointed(nodes.select("id", "size", comm.alias("comm")))
    member = checkpointed(nodes.select(F.col("id").alias("node_id"), "id"))
    for _ in range(max_levels):
        first = nodes
        near, sent = _laid(links, first)
        nodes, any_moved = _moved(first, near, r, move_turns, sent)
        state, merged = _refined(nodes, near, r, merge_turns, sent)
        if not merged:
            near.unpersist()
            dropped(state, *([first] if any_moved else []))
            break
        ref = lambda end: sent(state.select(F.col("id").alias(end), F.col("ref").alias(f"r{end}")))
        between = near.join(ref("a"), "a").join(ref("b"), "b").where("ra <> rb").groupBy(F.col("ra").alias("a"), F.col("rb").alias("b")).agg(F.sum("w").alias("w"))
        named = state.groupBy("comm").agg(F.min("ref").alias("name"))
        after = checkpointed(between), checkpointed(state.join(named, "comm").groupBy(F.col("ref").alias("id")).agg(F.sum("size").alias("size"), F.first("name").alias("comm"))), checkpointed(member.join(sent(state.select("id", "ref")), "id").select("node_id", F.col("ref").alias("id")))
        near.unpersist()
        dropped(links, nodes, member, state, *([first] if any_moved else []))
        links, nodes, member = after
    placed = checkpointed(member.join(nodes.select("id", "comm"), "id").select("node_id", "comm"))
    end = lambda name: placed.select(F.col("node_id").alias(name), F.col("comm").alias(f"c{name}"))
    inside = one.join(end("a"), "a").join(end("b"), "b").where("ca = cb").select(F.col("a").alias("source"), F.col("b").alias("target"))
    parts = graph.connected_components(inside).withColumnRenamed("id", "node_id")
    out = checkpointed(placed.select("node_id").join(parts, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("community_id")))
    dropped(one, links, nodes, member, placed)
    return out


def quality_of(edges: DataFrame, placed: DataFrame, quality: str = "cpm", resolution: float = RESOLUTION, weighted: bool = True) -> DataFrame:
    """One row ``quality`` of a partition, in units of edge weight: what ``leiden`` raises."""
    one = undirected(edges, weighted)
    end = lambda name: placed.select(F.col("node_id").alias(name), F.col("community_id").alias(f"c{name}"))
    both = one.join(end("a"), "a").join(end("b"), "b")
    ends = both.select(F.col("ca").alias("c"), F.col("a").alias("n"), "w").unionByName(both.select(F.col("cb").alias("c"), F.col("b").alias("n"), "w"))
    size = F.countDistinct("n").cast("double") if quality == "cpm" else F.sum("w") / SCALE
    sizes = ends.groupBy("c").agg(size.alias("size"))
    inner = both.agg((F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0)) / SCALE).alias("inner"), (F.sum("w") / SCALE).alias("total"))
    alone = F.sum(F.col("size")) if quality == "cpm" else F.lit(0.0)
    sums = sizes.agg(F.sum(F.col("size") * F.col("size")).alias("squares"), alone.alias("alone"))
    r = F.lit(resolution) if quality == "cpm" else resolution / (2 * F.col("total"))
    return inner.crossJoin(sums).select((F.col("inner") - r / 2 * (F.col("squares") - F.col("alone"))).alias("quality"))


def touched(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(id)`` of the nodes of edges that were added, removed or given another weight."""
    a, b = undirected(old), undirected(new)
    away = a.join(b, ["a", "b", "w"], "left_anti").unionByName(b.join(a, ["a", "b", "w"], "left_anti"))
    return away.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def leiden_again(old_edges: DataFrame, new_edges: DataFrame, placed: DataFrame, resolution: float = RESOLUTION, **options) -> DataFrame:
    """The communities of ``new_edges`` under CPM, computed only where edges changed; equal to a full run.

    Under CPM what happens in one connected component depends on it alone, so components that
    no changed edge touches keep the communities of ``placed`` (those of ``old_edges``), and the
    others are computed as a full run would.
    """
    near = checkpointed(touched(old_edges, new_edges))
    parts = checkpointed(graph.connected_components(new_edges))
    again = parts.join(near, "id", "left_semi").select("component").distinct()
    again = checkpointed(parts.join(again, "component", "left_semi").select("id"))
    fresh = leiden(new_edges.join(again, F.col("source") == F.col("id"), "left_semi"), "cpm", resolution, **options)
    here = parts.join(again, "id", "left_anti").select(F.col("id").alias("node_id"))
    out = checkpointed(placed.join(here, "node_id", "left_semi").select("node_id", "community_id").unionByName(fresh))
    dropped(near, parts, again, fresh)
    return out
