"""Graph operators: hops, bounded searches, hybrid scores, paths, induced and incident edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import blocks
from graphloom.storage import checkpointed, dealt, spread


def both_ways(edges: DataFrame) -> DataFrame:
    """``(node, neighbour, edge_type, weight)`` of every edge in both directions."""
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "edge_type", "weight")
    back = edges.select(F.col("target").alias("node"), F.col("source").alias("neighbour"), "edge_type", "weight")
    return out.unionByName(back)


def _linked(edges: DataFrame) -> DataFrame:
    """Distinct ``(node, neighbour)`` in both directions; each link is shuffled and written once, its smaller end first."""
    turned = (F.col("source") > F.col("target")) | F.col("source").isNull()
    one = checkpointed(edges.select(F.when(turned, F.col("target")).otherwise(F.col("source")).alias("node"), F.when(turned, F.col("source")).otherwise(F.col("target")).alias("neighbour")).distinct())
    return one.unionByName(one.where(~F.col("node").eqNullSafe(F.col("neighbour"))).select(F.col("neighbour").alias("node"), F.col("node").alias("neighbour")))


#: A node with more neighbours than this is heavy: searches meet its seeds and its neighbours in blocks, and shuffle no walk through it.
HEAVY = 256
#: Seeds at more heavy nodes than this, and nodes beside more, are left to the plain walk with a distinct.
MOST_HEAVY = 64
BLOCK_NEIGHBOURS, BLOCK_SEEDS, PAIRS_A_TASK = 8_192, 4_096, 4_000_000
#: Starts and goals of a block whose paths are counted at once.
BLOCK_ENDS = 4_096


def search(edges: DataFrame, seeds: DataFrame, hops: int, edge_filter: Column | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """G1, many starts at once: ``(seed, node, depth)``, each node once per seed at its least depth, start included.

    ``edge_filter`` holds before each hop.  A frontier row is joined with distinct neighbours and
    loses what its seed has seen; the last hop, the largest, is ``_last_hop``'s.  From two hops on,
    links and frontiers are written, so that no hop computes the ones before it again.  With
    ``nodes`` ``(id, ...)`` only those are returned, with their columns.
    """
    kept = checkpointed if hops > 1 else lambda df: df
    edges = edges if edge_filter is None else edges.where(edge_filter)
    links = _linked(edges) if hops > 1 else both_ways(edges).select("node", "neighbour").distinct()
    hydrated = lambda df: df if nodes is None else df.join(nodes.withColumnRenamed("id", "node"), "node")
    seen = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("depth")).distinct()
    frontier = seen
    for depth in range(1, hops):
        reached = frontier.select("seed", "node").join(links, "node").select("seed", F.col("neighbour").alias("node")).distinct()
        frontier = kept(reached.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    out = hydrated(seen)
    if hops > 0:
        last = _last_hop(frontier.select("seed", "node"), seen.select("seed", "node"), links, nodes) if hops > 1 else hydrated(_walked(frontier.select("seed", "node"), links, seen))
        out = out.unionByName(last.withColumn("depth", F.lit(hops)).select(*out.columns))
    return out


def _walked(frontier: DataFrame, links: DataFrame, seen: DataFrame) -> DataFrame:
    """Distinct ``(seed, node)`` one hop on that are not yet seen."""
    return frontier.join(links, "node").select("seed", F.col("neighbour").alias("node")).distinct().join(seen.select("seed", "node"), ["seed", "node"], "left_anti")


def _last_hop(frontier: DataFrame, seen: DataFrame, links: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """``_walked`` without a shuffle of the walks through heavy nodes, whose number may be the square of a hub's neighbours.

    A seed carries the heavy nodes it stands at, a neighbour those it is linked with.  A pair of
    both is given at the least node that they share, so no distinct is needed; what light nodes
    reach is left out where a heavy node reaches it too.  Pairs arise from a block of seeds and a
    block of neighbours, each task's share bounded.
    """
    hydrated = lambda df: df if nodes is None else df.join(nodes.withColumnRenamed("id", "node"), "node")
    heavy = spread(checkpointed(links.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HEAVY)))
    at = checkpointed(frontier.join(heavy, "node").select("seed", F.col("node").alias("mid"), "n"))
    total = at.agg(F.sum("n")).first()[0]
    if total is None:
        return hydrated(_walked(frontier, links, seen))

    def few(df, key, name):
        by = df.select(key, "mid").repartition(key)  # counted, joined and gathered as it lies
        return by.groupBy(key).agg(F.count("mid").alias("k")).where(F.col("k") <= MOST_HEAVY).join(by, key).groupBy(key).agg(F.collect_set("mid").alias(name))

    stands = checkpointed(few(at, "seed", "stands"))
    wide = checkpointed(at.select("seed").distinct().join(stands, "seed", "left_anti"))
    from_heavy = links.join(heavy, "node").select(F.col("node").alias("mid"), F.col("neighbour").alias("node"), "n")
    beside = checkpointed(few(from_heavy, "node", "beside"))
    hubs = checkpointed(from_heavy.select("node").distinct().join(beside, "node", "left_anti"))

    # seeds or nodes with very many heavy neighbours: the plain way; mostly there are none, and links are not shuffled for them
    narrow, onward, plain = frontier, links, []
    if not wide.isEmpty():
        narrow = frontier.join(wide, "seed", "left_anti")
        plain.append(frontier.join(wide, "seed", "left_semi").join(links, "node"))
    if not hubs.isEmpty():
        onward = links.join(hubs.select(F.col("node").alias("neighbour")), "neighbour", "left_anti")
        plain.append(narrow.join(links.join(hubs.select(F.col("node").alias("neighbour")), "neighbour", "left_semi"), "node"))
    none = F.array().cast("array<long>")
    light = onward.join(heavy, "node", "left_anti").join(frontier.select("node").distinct(), "node", "left_semi").join(beside.withColumnRenamed("node", "neighbour"), "neighbour", "left")
    light = light if nodes is None else light.join(nodes.select(F.col("id").alias("neighbour")), "neighbour", "left_semi")  # by the key of the join before
    walks = narrow.join(stands, "seed", "left").join(light, "node").where(F.col("stands").isNull() | F.col("beside").isNull() | ~F.arrays_overlap("stands", "beside"))
    walks = walks.select("seed", "neighbour")
    for more in plain:
        walks = walks.unionByName(more.select("seed", "neighbour"))
    walks = walks.select("seed", F.col("neighbour").alias("node")).distinct()
    walks = walks.join(seen, ["seed", "node"], "left_anti")

    # blocks of seeds against blocks of a heavy node's neighbours
    parts = int(min(10_000, max(links.sparkSession.sparkContext.defaultParallelism, total // PAIRS_A_TASK + 1)))
    sizes = spread(checkpointed(at.groupBy("mid", "n").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SEEDS).alias("salts")).withColumn("n_blocks", F.ceil(F.col("n") / BLOCK_NEIGHBOURS))))
    block = F.pmod(F.xxhash64("node"), F.col("n_blocks")).alias("block")
    dealt = onward.withColumnRenamed("node", "mid").withColumnRenamed("neighbour", "node").join(sizes, "mid").join(beside, "node")
    dealt = hydrated(dealt.select("mid", "node", F.filter("beside", lambda other: other < F.col("mid")).alias("beside"), block, "salts"))
    dealt = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    known = seen.join(beside, "node").select("seed", "node", F.explode("beside").alias("mid")).join(at.select("seed", "mid"), ["seed", "mid"], "left_semi")
    known = known.join(sizes, "mid").groupBy("seed", "mid", block).agg(F.collect_list("node").alias("known"))
    sent = at.select("seed", "mid").join(stands, "seed").join(sizes, "mid").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    sent = sent.join(known, ["seed", "mid", "block"], "left")
    below = F.filter("stands", lambda other: other < F.col("mid"))
    sent = sent.select("mid", "block", F.pmod(F.xxhash64("seed"), F.col("salts")).alias("salt"), "seed", below.alias("below"), F.coalesce("known", none).alias("known"))
    keys = ["mid", "block", "salt"]
    met = sent.repartition(parts, *keys).hint("merge").join(dealt.repartition(parts, *keys), keys)
    first = (F.size("below") == 0) | ~F.arrays_overlap("below", "beside")
    met = met.where(first & ((F.size("known") == 0) | ~F.array_contains("known", F.col("node"))))
    columns = ["seed", "node", *([] if nodes is None else [c for c in nodes.columns if c != "id"])]
    return hydrated(walks).select(*columns).unionByName(met.select(*columns))


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int, edge_filter: Column | None = None) -> DataFrame:
    """G1: as ``search`` without the starts."""
    return search(edges, seeds, hops, edge_filter).where("depth > 0")


def traverse(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int, node_filter: Column | None = None, edge_filter: Column | None = None) -> DataFrame:
    """Reached nodes with the starts, hydrated (J1); ``node_filter`` limits what is returned, not where the search goes."""
    return search(edges, seeds, hops, edge_filter, nodes if node_filter is None else nodes.where(node_filter))


def hybrid(edges: DataFrame, seeds: DataFrame, hops: int, decay: float, floor_zero: bool = True) -> DataFrame:
    """``(id, score)``: the largest similarity x decay^depth over scored seeds ``(id, score)``.

    With a decay in (0, 1] no longer walk gives a score of 0 or more a larger value, so each hop
    passes on one score a node, the best that stands ``depth`` steps away, and no pair of seed and
    node is made.  Scores below 0 grow with the walk: unless they are floored, their seeds are searched.
    """
    spread, searched = (seeds, seeds.limit(0)) if floor_zero else (seeds.where("score is null or score >= 0"), seeds.where("score < 0"))
    if not 0 < decay <= 1:
        spread, searched = seeds.limit(0), seeds
    links = both_ways(edges).select("node", "neighbour").distinct()
    links = checkpointed(links) if hops > 1 else links
    best = spread.groupBy(F.col("id").alias("node")).agg(F.max("score").alias("score"))
    found = best.withColumn("depth", F.lit(0))
    for depth in range(1, hops + 1):
        best = best.join(links, "node").groupBy(F.col("neighbour").alias("node")).agg(F.max("score").alias("score"))
        best = checkpointed(best) if depth < hops else best
        found = found.unionByName(best.withColumn("depth", F.lit(depth)))
    if not floor_zero or not 0 < decay <= 1:
        apart = search(edges, searched, hops).join(searched.select(F.col("id").alias("seed"), "score"), "seed")
        found = found.unionByName(apart.select("node", "score", "depth"))
    best = found.groupBy(F.col("node").alias("id")).agg(F.max(F.col("score") * F.pow(F.lit(decay), F.col("depth"))).alias("score"))
    return best.withColumn("score", F.greatest("score", F.lit(0.0))) if floor_zero else best


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 100) -> DataFrame:
    """``(start, goal, path)`` of the pairs that are linked within ``max_depth`` undirected hops; ties go to the least path.

    Searches go from the starts and from the goals, once for each end however many pairs it is in,
    and meet; each turn moves the side with fewer edges ahead of it.  A frontier keeps one least
    path per (end, node) and only ends of open pairs; the loop ends when no open pair has edges ahead.
    """
    links = checkpointed(both_ways(edges).select("node", "neighbour").distinct())
    degree = checkpointed(links.groupBy("node").agg(F.count(F.lit(1)).alias("n")))
    asked = pairs.select("start", "goal").distinct()
    done = asked.where("start = goal").select("start", "goal", F.array("start").alias("path"))
    left = checkpointed(asked.where("start <> goal"))
    front = {side: left.select(F.col(side).alias("end")).distinct().select("end", F.col("end").alias("node"), F.array("end").alias("path")) for side in ("start", "goal")}
    seen = {side: front[side].select("end", "node") for side in front}
    for _ in range(max_depth):
        live = {side: front[side].join(left.select(F.col(side).alias("end")).distinct(), "end", "left_semi") for side in front}
        ahead = [live[side].join(degree, "node").agg(F.lit(side).alias("side"), F.sum("n").alias("n")) for side in live]
        ahead = {r.side: r.n for r in ahead[0].unionByName(ahead[1]).collect()}
        if None in ahead.values():
            break
        side = min(("start", "goal"), key=lambda s: ahead[s])
        path = F.concat("path", F.array("neighbour")) if side == "start" else F.concat(F.array("neighbour"), F.col("path"))
        grown = live[side].join(links, "node").select("end", F.col("neighbour").alias("node"), path.alias("path"))
        front[side] = checkpointed(grown.join(seen[side], ["end", "node"], "left_anti").groupBy("end", "node").agg(F.min("path").alias("path")))
        seen[side] = checkpointed(seen[side].unionByName(front[side].select("end", "node")))
        forth = front["start"].select(F.col("end").alias("start"), "node", "path")
        back = front["goal"].select(F.col("end").alias("goal"), "node", F.slice("path", 2, max_depth + 1).alias("rest"))
        met = left.join(forth, "start").join(back, ["goal", "node"]).groupBy("start", "goal").agg(F.min(F.concat("path", "rest")).alias("path"))
        met = checkpointed(met)
        done = done.unionByName(met)
        ends = [front[s].select(F.col("end").alias(s)).distinct() for s in front]
        left = checkpointed(left.join(met, ["start", "goal"], "left_anti").join(ends[0], "start", "left_semi").join(ends[1], "goal", "left_semi"))
    return done


def _walks(links: DataFrame, starts: DataFrame, hops: int) -> list[DataFrame]:
    """Simple walks ``(end, at, nodes, types)`` of 0 to ``hops`` hops from each of ``starts`` ``(end)``; each hop is written."""
    walks = [starts.select("end", F.col("end").alias("at"), F.array("end").alias("nodes"), F.array().cast("array<string>").alias("types"))]
    for _ in range(hops):
        step = walks[-1].join(links, "at").where(~F.array_contains("nodes", F.col("neighbour")))
        walks.append(checkpointed(step.select("end", F.col("neighbour").alias("at"), F.concat("nodes", F.array("neighbour")).alias("nodes"), F.concat("types", F.array("edge_type")).alias("types"))))
    return walks


def simple_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 4, max_paths: int | None = 100) -> DataFrame:
    """``(start, goal, nodes, types, hops)``: simple undirected paths; parallel edges give paths of their own.

    Walks go from the starts half of the hops and from the goals the other half, once for each end
    however many pairs it is in, and meet by (pair, node): a path of h hops is cut after the first
    half of them, so it is found once, and no walk is longer than half of ``max_hops``.  The last
    walks from the starts only take steps to where a goal's walk stands.  At most ``max_paths`` per
    pair, fewest hops and least nodes first (a limit that is the feature).
    """
    links = both_ways(edges).select(F.col("node").alias("at"), "neighbour", "edge_type")
    pairs = pairs.where("start <> goal").select("start", "goal").distinct()
    if max_hops > 1:
        links, pairs = checkpointed(links), checkpointed(pairs)
    ahead, behind = (max_hops + 1) // 2, max_hops // 2
    back = _walks(links, pairs.select(F.col("goal").alias("end")).distinct(), behind)
    reached = back[0].select("at")
    for walk in back[1:]:
        reached = reached.unionByName(walk.select("at"))
    last = links.join(reached.select(F.col("at").alias("neighbour")).distinct(), "neighbour", "left_semi")
    starts = pairs.select(F.col("start").alias("end")).distinct()
    forth = _walks(links, starts, ahead - 1)
    final = forth[-1].join(last, "at").where(~F.array_contains("nodes", F.col("neighbour")))
    forth.append(final.select("end", F.col("neighbour").alias("at"), F.concat("nodes", F.array("neighbour")).alias("nodes"), F.concat("types", F.array("edge_type")).alias("types")))
    found = None
    for hops in range(1, max_hops + 1):
        f = forth[(hops + 1) // 2].select(F.col("end").alias("start"), "at", "nodes", "types")
        b = back[hops // 2].select(F.col("end").alias("goal"), "at", F.slice(F.reverse("nodes"), 2, max(1, hops)).alias("rest"), F.reverse("types").alias("others"))
        met = f.join(pairs, "start").join(b, ["goal", "at"]).where(~F.arrays_overlap("nodes", "rest"))
        met = met.select("start", "goal", F.concat("nodes", "rest").alias("nodes"), F.concat("types", "others").alias("types"), F.lit(hops).alias("hops"))
        found = met if found is None else found.unionByName(met)
    if max_paths is None:
        return found
    rank = F.row_number().over(Window.partitionBy("start", "goal").orderBy("hops", "nodes", "types"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= max_paths).drop("_rank")


def paths_between(edges: DataFrame, starts: DataFrame, goals: DataFrame, max_hops: int) -> DataFrame:
    """``(start, goal, nodes, types, hops)``: simple paths from any of ``starts`` ``(id)`` to any of ``goals`` ``(goal)`` with no other goal inside.

    As ``simple_paths``, but all starts are asked against all goals, so no table of pairs is made:
    walks meet by node, and the last walks from the starts only take steps to where a goal's walk stands.
    """
    links = checkpointed(both_ways(edges).select(F.col("node").alias("at"), "neighbour", "edge_type"))
    ends = checkpointed(goals.select(F.col("goal").alias("end")).distinct())
    onward = links.join(ends.select(F.col("end").alias("neighbour")), "neighbour", "left_anti")
    ahead, behind = (max_hops + 1) // 2, max_hops // 2
    back = _walks(onward, ends, behind)
    forth = _walks(onward, starts.select(F.col("id").alias("end")).distinct(), ahead - 1)
    if max_hops > 1:  # the last step goes only to where a goal's walk stands
        reached = back[behind].select("at").unionByName(back[ahead - 1].select("at")).distinct()
        final = forth[-1].join(onward.join(reached.select(F.col("at").alias("neighbour")), "neighbour", "left_semi"), "at").where(~F.array_contains("nodes", F.col("neighbour")))
        forth.append(checkpointed(final.select("end", F.col("neighbour").alias("at"), F.concat("nodes", F.array("neighbour")).alias("nodes"), F.concat("types", F.array("edge_type")).alias("types"))))
    into = _walks(links.join(ends.select(F.col("end").alias("neighbour")), "neighbour", "left_semi"), starts.select(F.col("id").alias("end")).distinct(), 1)[1]
    found = into.select(F.col("end").alias("start"), F.col("at").alias("goal"), "nodes", "types", F.lit(1).alias("hops"))
    for hops in range(2, max_hops + 1):
        f = forth[(hops + 1) // 2].select(F.col("end").alias("start"), "at", "nodes", "types")
        b = back[hops // 2].select(F.col("end").alias("goal"), "at", F.slice(F.reverse("nodes"), 2, hops).alias("rest"), F.reverse("types").alias("others"))
        met = f.join(b, "at").where(~F.arrays_overlap("nodes", "rest"))
        found = found.unionByName(met.select("start", "goal", F.concat("nodes", "rest").alias("nodes"), F.concat("types", "others").alias("types"), F.lit(hops).alias("hops")))
    return found


def path_counts(edges: DataFrame, starts: DataFrame, goals: DataFrame, max_hops: int) -> DataFrame:
    """``(start, goal, hops, paths)``: how many paths of each length ``paths_between`` finds.

    Up to three hops no path is made: the walks of a goal are its edges, so a start's walk to a node
    beside a goal is a path unless start and goal are one, and walks are counted by (end, node).
    Longer ones are listed and counted.
    """
    if max_hops > 3:
        return paths_between(edges, starts, goals, max_hops).groupBy("start", "goal", "hops").agg(F.count(F.lit(1)).alias("paths"))
    one_way = checkpointed(edges.select("source", "target"))
    links = one_way.toDF("at", "next").unionByName(one_way.select(F.col("target").alias("at"), F.col("source").alias("next"))).where("at <> next")
    asked, ends = checkpointed(starts.select("id").distinct()), checkpointed(goals.select("goal").distinct())
    as_ = lambda ids, name: spread(ids.toDF(name))
    first = checkpointed(links.join(as_(asked, "at"), "at").groupBy(F.col("at").alias("start"), F.col("next").alias("at")).agg(F.count(F.lit(1)).alias("n")))
    found = first.join(as_(ends, "at"), "at", "left_semi").select("start", F.col("at").alias("goal"), F.lit(1).alias("hops"), F.col("n").alias("paths")).where("start <> goal")
    if max_hops < 2:
        return found
    first = first.join(as_(ends, "at"), "at", "left_anti")
    stands = checkpointed(first.select("at").distinct())
    near = stands
    if max_hops > 2:
        onward = checkpointed(links.join(spread(stands), "at", "left_semi").join(as_(ends, "next"), "next", "left_anti"))
        near = near.unionByName(onward.select(F.col("next").alias("at"))).distinct()
    into = links.join(as_(ends, "next"), "next", "left_semi").join(near, "at", "left_semi")
    into = checkpointed(into.join(as_(ends, "at"), "at", "left_anti").groupBy("at", F.col("next").alias("goal")).agg(F.count(F.lit(1)).alias("k")))
    beside = into.select("at").distinct()
    forth = first.join(beside, "at", "left_semi").select(F.lit(2).alias("hops"), "start", "at", "n")
    if max_hops > 2:
        second = first.join(onward.join(beside.toDF("next"), "next", "left_semi"), "at").where("next <> start")
        forth = forth.unionByName(second.groupBy(F.lit(3).alias("hops"), "start", F.col("next").alias("at")).agg(F.sum("n").alias("n")))
    return found.unionByName(_met_counts(checkpointed(forth), into))


def _met_counts(forth: DataFrame, into: DataFrame) -> DataFrame:
    """``(start, goal, hops, paths)`` of walks ``(hops, start, at, n)`` and ``(at, goal, k)`` that meet.

    A node is heavy where sending its walks to blocks moves fewer rows than the pairs it makes; the
    walks at heavy nodes go to blocks of starts and goals, which sum over the nodes, so their pairs are not shuffled.
    """
    count = F.count(F.lit(1))
    s, g = (F.lit(max(1, -(-df.select(end).distinct().count() // BLOCK_ENDS))) for df, end in ((forth, "start"), (into, "goal")))
    sizes = forth.groupBy("hops", "at").agg(count.alias("f")).join(into.groupBy("at").agg(count.alias("b")), "at")
    heavy = checkpointed(sizes.where(2 * (F.col("f") * F.least(g, "b") + F.col("b") * F.least(s, "f")) < F.col("f") * F.col("b")))
    total = heavy.agg(F.sum(F.col("f") * F.col("b"))).first()[0]
    marked = heavy.select("hops", "at")
    light = forth.join(marked, ["hops", "at"], "left_anti").join(into, "at").where("start <> goal").groupBy("hops", "start", "goal").agg(F.sum(F.col("n") * F.col("k")).alias("paths"))
    if total is None:
        return light.select("start", "goal", "hops", "paths")
    sent = _sent_counts(forth.join(marked, ["hops", "at"]), into.join(marked, "at"), light, s, g)
    parts = int(min(10_000, max(forth.sparkSession.sparkContext.defaultParallelism, total // PAIRS_A_TASK + 1)))
    keys = ["hops", "i", "j"]
    return sent.repartition(parts, *keys).groupBy(*keys).applyInArrow(blocks.summed, "hops int, start long, goal long, paths long").select("start", "goal", "hops", "paths")


def _sent_counts(forth: DataFrame, into: DataFrame, light: DataFrame, s: Column, g: Column) -> DataFrame:
    """Rows for ``blocks.summed``: walks go to the blocks of the other side that stand at their node, counted pairs to their own."""
    i, j = F.pmod(F.xxhash64("start"), s).alias("i"), F.pmod(F.xxhash64("goal"), g).alias("j")
    forth, into = forth.select("*", i), into.select("*", j)
    row = lambda kind, a, b, n: ["hops", "i", "j", F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(n).alias("n")]
    a = forth.join(into.select("hops", "at", "j").distinct(), ["hops", "at"]).select(*row(0, "start", "at", "n"))
    b = into.join(forth.select("hops", "at", "i").distinct(), ["hops", "at"]).select(*row(1, "goal", "at", "k"))
    return a.unionByName(b).unionByName(light.select("*", i, j).select(*row(2, "start", "goal", "paths")))


def paths_from(edges: DataFrame, starts: DataFrame, max_hops: int, goals: DataFrame | None = None, max_paths: int | None = 10) -> DataFrame:
    """Simple paths from many starts at once, every prefix a path to its last node: ``(start, goal, nodes, types, degrees, hops)``.

    ``goals`` limits what is returned: ``(id)``, or ``(start, id)`` where each start has its own.
    One expansion serves all (start, goal) pairs, so no pair of nodes is enumerated beforehand.
    Each hop is written before the next one; the last hop, the largest, only takes edges into a
    goal.  ``degrees``: those of all nodes but the start, carried along for path scores.
    """
    per_start = goals is not None and "start" in goals.columns
    degree = degrees(edges).select(F.col("id").alias("neighbour"), "degree")
    links = both_ways(edges).select(F.col("node").alias("_at"), "neighbour", "edge_type").join(degree, "neighbour")
    wanted = None if goals is None else goals.select(*(["start"] if per_start else []), F.col("id").alias("goal")).distinct()
    if max_hops > 1:
        links, wanted = checkpointed(links), None if wanted is None else checkpointed(wanted)
    grown = starts.select(F.col("id").alias("start"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("types"), F.array().cast("array<long>").alias("degrees")).distinct()
    found = None
    for hop in range(1, max_hops + 1):
        onward = links if wanted is None or hop < max_hops else links.join(wanted.select(F.col("goal").alias("neighbour")), "neighbour", "left_semi")
        grown = grown.withColumn("_at", F.element_at("nodes", -1)).join(onward, "_at").where(~F.array_contains("nodes", F.col("neighbour")))
        grown = grown.select("start", *[F.concat(whole, F.array(last)).alias(whole) for whole, last in (("nodes", "neighbour"), ("types", "edge_type"), ("degrees", "degree"))])
        grown = checkpointed(grown) if hop < max_hops else grown
        found = grown if found is None else found.unionByName(grown)
    found = found.withColumn("goal", F.element_at("nodes", -1)).withColumn("hops", F.size("types"))
    if wanted is not None:
        found = found.join(wanted, ["start", "goal"] if per_start else ["goal"], "left_semi")
    if max_paths is None:
        return found
    rank = F.row_number().over(Window.partitionBy("start", "goal").orderBy("hops", "nodes", "types"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= max_paths).drop("_rank")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose both ends are in ``ids``."""
    left, right = ids.select(F.col("id").alias("source")).distinct(), ids.select(F.col("id").alias("target")).distinct()
    inside = dealt(edges.join(left, "source", "left_semi"), "target")
    return inside.join(right, "target", "left_semi").select(*edges.columns)


def incident(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end in ``ids``."""
    marked = spread(ids.select("id").distinct())
    at_source = edges.join(marked, F.col("source") == F.col("id"), "left_semi")
    rest = edges.join(marked, F.col("source") == F.col("id"), "left_anti")
    return at_source.unionByName(rest.join(marked, F.col("target") == F.col("id"), "left_semi"))


def degrees(edges: DataFrame) -> DataFrame:
    """A5: ``(id, degree)``, in plus out."""
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """Degree divided by the largest degree of the graph."""
    d = degrees(edges)
    top = d.agg(F.max("degree").alias("most"))
    return d.join(F.broadcast(top)).select("id", "degree", (F.col("degree") / F.col("most")).alias("centrality"))


def neighbour_centrality(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Distinct neighbours of each candidate, divided by the most among them; 1 neighbour where there is none."""
    candidates = dealt(candidates.select("id"), "id").distinct()
    near = both_ways(edges).select("node", "neighbour").join(candidates.withColumnRenamed("id", "node"), "node", "left_semi")
    near = dealt(near, "node", "neighbour").distinct().groupBy("node").agg(F.count("neighbour").alias("n"))
    all_ = candidates.join(near, F.col("id") == F.col("node"), "left").select("id", F.coalesce("n", F.lit(1)).alias("n"))
    return all_.join(F.broadcast(all_.agg(F.max("n").alias("most")))).select("id", (F.col("n") / F.col("most")).alias("centrality"))


def remap(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Both ends through ``(old, new)``; edges with an end that is not mapped are dropped."""
    s = ids.select(F.col("old").alias("source"), F.col("new").alias("_s"))
    t = ids.select(F.col("old").alias("target"), F.col("new").alias("_t"))
    rest = [c for c in edges.columns if c not in ("source", "target")]
    inside = induced(edges, ids.select(F.col("old").alias("id")))  # before ids are joined to them, few edges are left
    return inside.join(s, "source").join(t, "target").select(F.col("_s").alias("source"), F.col("_t").alias("target"), *rest)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], sequence: str | None = None) -> DataFrame:
    """Last write wins by key: rows of ``new`` replace those of ``old``.

    Of several rows of ``new`` with one key that of the largest ``sequence`` holds, and without one, or
    among equals, the greatest row, so the result does not depend on the order of a batch.
    """
    order = [F.col(sequence).alias("_sequence")] if sequence else []
    last = new.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max(F.struct(*order, F.struct(*new.columns).alias("row"))).alias("last")).select("last.row.*")
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(last.select(*new.columns))


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hard delete with the edges on either end."""
    gone = ids.select("id").distinct()
    left = edges.join(gone, F.col("source") == F.col("id"), "left_anti").join(gone, F.col("target") == F.col("id"), "left_anti")
    return nodes.join(gone, "id", "left_anti"), left


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` with the least reachable id: minimum labels with pointer jumping, checkpointed each round."""
    links = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a <> b")
    links = checkpointed(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(links.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("id"), F.least("a", "near").alias("label")))
    for _ in range(max_rounds):
        near = links.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, F.col("id") == F.col("a")).select("id", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("id").alias("_at"), F.col("label").alias("_to"))
        moved = stepped.join(jump, F.col("low") == F.col("_at"), "left").select("id", F.col("label").alias("_was"), F.least("low", F.coalesce("_to", "low")).alias("label"))
        moved = checkpointed(moved)
        if moved.where("label <> _was").isEmpty():
            break
        labels = moved.select("id", "label")
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    return labels.withColumnRenamed("label", "component")


def event_nodes(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Event nodes of ``(id, content, timestamp, participants)`` and an edge of weight 1 from each to every participant.

    ``participants``: array of ``struct<node_id, role>``; the role (Actor, Object, Location,
    Companion) is the edge's type.  An event without participants is a node without edges.
    """
    nodes = events.select("id", "content", F.lit("Event").alias("node_type"), "timestamp")
    edges = events.select(F.col("id").alias("source"), F.explode("participants").alias("p")).select("source", F.col("p.node_id").alias("target"), F.col("p.role").alias("edge_type"), F.lit(1.0).alias("weight"))
    return nodes, edges
