"""Graphs as edge tables (src, dst): degrees, reachability, distances, cycles, levels, propagation, lineage.

Loops run on the driver, the rounds are joins; every round is written to reliable storage, so plans stay short and
lost executors cost one round. Each loop ends after at most ``max_rounds`` rounds and says so if it did not converge.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.runtime import cut_lineage, stored


class NotConverged(Exception):
    """A loop used up its rounds with work left."""


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").filter("src is not null and dst is not null").distinct()


def node_report(
    nodes: DataFrame, edges: DataFrame, type_col: str = "type",
    sinks: str = r"^(Put|Log|Publish|Send|Notify|PutEmail|PutSlack)",
    sources: str = r"^(Get|List|Listen|Consume|Generate|TailFile|HandleHttp)",
) -> DataFrame:
    """In and out degree of every node; dead ends and orphans unless their type is meant to be one."""
    outs = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    ins = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    out = nodes.join(outs, "id", "left").join(ins, "id", "left").fillna(0, ["out_degree", "in_degree"])
    return out.withColumns(
        {
            "dead_end": (F.col("out_degree") == 0) & ~F.col(type_col).rlike(sinks),
            "orphan": (F.col("in_degree") == 0) & ~F.col(type_col).rlike(sources),
            "disconnected": (F.col("out_degree") == 0) & (F.col("in_degree") == 0),
        }
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# rounds of a search kept as tables of their own before they are written as one
ROUNDS_KEPT = 8


def _search(seeds: DataFrame, edges: DataFrame, first_hop: int, max_rounds: int) -> DataFrame:
    """Breadth-first rounds from (start, node). What was seen is the union of the rounds; it is written as one table now and then, so
    that a round does not read ever more of them. Rounds are files, which few tasks read together while they are small, and what
    was seen is merged with the new pairs by sorting: neither grows into work or messages for the driver."""
    walk = stored(edges.select(F.col("src").alias("node"), F.col("dst").alias("__to")), "search-edges")
    now = stored(seeds.withColumn("hops", F.lit(first_hop)), "search-round")
    parts = [now]

    def fresh(hop: int) -> DataFrame:
        step = now.hint("merge").join(walk, "node").select("start", F.col("__to").alias("node")).distinct()
        return step.join(_union(parts).hint("merge"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hop))

    for hop in range(first_hop + 1, first_hop + max_rounds + 1):
        now = stored(fresh(hop), "search-round")
        if now.isEmpty():
            return _union(parts)
        parts.append(now)
        if len(parts) > ROUNDS_KEPT:
            parts = [stored(_union(parts), "search-seen")]
    if fresh(first_hop + max_rounds + 1).isEmpty():
        return _union(parts)
    raise NotConverged(f"nodes left to visit after {max_rounds} rounds")


def reach(edges: DataFrame, seeds: DataFrame, max_rounds: int = 100, admit: Column | None = None) -> DataFrame:
    """(start, node, hops): fewest hops from each start; the start itself has 0.

    ``seeds`` has (start, node). ``admit`` filters the edges that may be walked.
    """
    walk = _pairs(edges) if admit is None else _pairs(edges.filter(admit))
    return _search(seeds.select("start", "node").distinct(), walk, 0, max_rounds)


def closure(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(src, dst, hops) for every pair connected by a path of at least one edge; a node on a cycle reaches itself."""
    direct = _pairs(edges)
    seeds = direct.select(F.col("src").alias("start"), F.col("dst").alias("node"))
    found = _search(seeds, direct, 1, max_rounds)
    return found.select(F.col("start").alias("src"), F.col("node").alias("dst"), "hops")


def shortest_hops(edges: DataFrame, start, max_rounds: int = 100) -> DataFrame:
    """(node, hops) from one start node."""
    seeds = edges.sparkSession.range(1).select(F.lit(start).alias("start"), F.lit(start).alias("node"))
    return reach(edges, seeds, max_rounds).select("node", "hops")


def trim(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Edges left after removing, again and again, nodes without incoming or without outgoing edges."""
    rest = cut_lineage(_pairs(edges))
    size = rest.count()
    for _ in range(max_rounds):
        for _ in range(HOPS_PER_ROUND):
            starts = rest.select(F.col("dst").alias("src")).distinct()
            ends = rest.select(F.col("src").alias("dst")).distinct()
            rest = rest.join(starts, "src", "left_semi").join(ends, "dst", "left_semi")
        rest = cut_lineage(rest)
        left = rest.count()
        if left == size:
            break
        size = left
    return rest.select("src", "dst")


# steps taken between two writes to storage
HOPS_PER_ROUND = 2


def _spread_min(edges: DataFrame, max_rounds: int) -> DataFrame:
    """(id, color): the smallest (hash, id) among the nodes that reach a node, itself included. Only nodes whose color
    improved pass it on."""
    ids = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct()
    parts = [cut_lineage(ids.withColumn("color", F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("id"))))]
    for _ in range(max_rounds):
        current = _union(parts).groupBy("id").agg(F.min("color").alias("old"))
        hops = [parts[-1]]
        for _ in range(HOPS_PER_ROUND):
            onward = hops[-1].join(edges, F.col("id") == F.col("src"))
            hops.append(onward.groupBy(F.col("dst").alias("id")).agg(F.min("color").alias("color")))
        offered = _union(hops[1:]).groupBy("id").agg(F.min("color").alias("color"))
        fresh = cut_lineage(offered.join(current, "id").filter("color < old").select("id", "color"))
        if fresh.isEmpty():
            return cut_lineage(_union(parts).groupBy("id").agg(F.min("color").alias("color")))
        parts.append(fresh)
    raise NotConverged(f"colors still spread after {max_rounds} rounds")


def _into_single(edges: DataFrame, salt: int) -> DataFrame:
    """(v, u, a): nodes v with u as their only neighbour on an incoming edge (of weight a), such that no u is a v itself.

    Of a chain of such nodes about a third is chosen, by a hash that changes with ``salt``; a node that hangs on one with other
    incoming edges is chosen at once.
    """
    single = edges.groupBy("dst").agg(F.min("src").alias("u"), F.max("src").alias("__last"), F.max("weight").alias("a")).filter("u = __last and u <> dst")
    single = single.select(F.col("dst").alias("v"), "u", "a")
    h = lambda c: F.xxhash64(F.lit(salt), F.col(c))
    above = single.select(F.col("v").alias("__u"))
    eager = single.join(above, F.col("u") == F.col("__u"), "left").select("v", "u", "a", (F.col("__u").isNull() | (h("v") > h("u"))).alias("eager"))
    before = eager.filter("eager").select(F.col("v").alias("__u"))
    return eager.filter("eager").join(before, F.col("u") == F.col("__u"), "left_anti").select("v", "u", "a")


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def _without(edges: DataFrame, taken: DataFrame) -> DataFrame:
    """Edges after every taken node v went into its u: what left v leaves u, the longest of parallel edges stays."""
    gone = taken.select(F.col("v").alias("__dst"))
    moved = edges.join(gone, F.col("dst") == F.col("__dst"), "left_anti").join(taken, F.col("src") == F.col("v"), "left")
    out = moved.select(F.coalesce("u", "src").alias("src"), "dst", (F.col("weight") + F.coalesce("a", F.lit(0))).alias("weight"))
    return out.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def _weighted(edges: DataFrame) -> DataFrame:
    return _pairs(edges).withColumn("weight", F.lit(1).cast("bigint"))


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for the nodes of undirected edges (src, dst); label = smallest node of the connected part.

    Every round each node goes into its smallest neighbour and the edges are renamed; the sizes of parts do not matter, since
    a task sees one smallest neighbour for each node. Names without order, such as hashes, need few rounds.
    """
    now = stored(_pairs(edges).filter("src <> dst"), "graph-edges")
    names: list[DataFrame] = []
    while not now.isEmpty():
        if len(names) == max_rounds:
            raise NotConverged(f"parts still grow after {max_rounds} rounds")
        seen = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        into = stored(seen.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("to")).select("node", F.least("node", "to").alias("to")), "graph-into")
        names.append(into)
        moved = now.join(into.withColumnsRenamed({"node": "src", "to": "__a"}), "src").join(into.withColumnsRenamed({"node": "dst", "to": "__b"}), "dst")
        now = stored(moved.filter("__a <> __b").select(F.col("__a").alias("src"), F.col("__b").alias("dst")).distinct(), "graph-edges")
    if not names:
        return now.select(F.col("src").alias("node"), F.col("src").alias("label"))
    out = names[0].withColumnRenamed("to", "label")
    for into in names[1:]:
        out = out.join(into.withColumnsRenamed({"node": "label", "to": "__next"}), "label", "left").select("node", F.coalesce("__next", "label").alias("label"))
    return stored(out, "graph-parts")


def cycles(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, component): nodes on a cycle of at least two nodes, component = smallest node of the strongly connected part.

    Nodes with a single neighbour on one side go into it, so that chains and rings of any length shrink by a constant factor a
    round. What is left has branches everywhere; there, every node takes the smallest color that reaches it, and what reaches the owner
    of a color from inside that color is one component. Then the shrunk nodes come back, last ones first: such a node is
    on a cycle with its neighbour exactly if one of its own edges leads into the neighbour's component.
    """
    now = stored(_weighted(edges).filter("src <> dst"), "graph-edges")
    steps: list[tuple[DataFrame, DataFrame]] = []
    # a node gets an edge to itself when a ring has shrunk to it
    rings = [now.limit(0).select(F.col("src").alias("node"))]
    size = now.count()
    for _ in range(max_rounds):
        if not size:
            break
        stage = now
        for _ in range(2):  # nodes with one predecessor, then nodes with one successor
            taken = stored(_into_single(stage, len(steps)), "graph-taken")
            steps.append((stage, taken))
            after = stored(_turned(_without(stage, taken)), "graph-edges")
            rings.append(after.filter("src = dst").select(F.col("src").alias("node")))
            stage = after.filter("src <> dst")
        # edges of nodes without a way in or out lie on no cycle
        now = stored(stage.join(_ends(stage, "dst", "src"), "src", "left_semi").join(_ends(stage, "src", "dst"), "dst", "left_semi").select("src", "dst", "weight"), "graph-edges")
        before, size = size, now.count()
        if size > 0.9 * before:
            break
    parts = _colored(now.select("src", "dst"), max_rounds) if size else now.limit(0).select(F.col("src").alias("node"), F.col("src").alias("component"))
    loops = stored(_union(rings).distinct(), "graph-rings")
    gone = _union([t.select(F.col("v").alias("node")) for _, t in steps]) if steps else loops.limit(0)
    alone = loops.join(parts, "node", "left_anti").join(gone, "node", "left_anti")
    known = stored(parts.unionByName(alone.select("node", F.col("node").alias("component"))), "graph-parts")
    for k, (stage, taken) in reversed(list(enumerate(steps))):
        of_u = known.select(F.col("node").alias("u"), "component")
        of_w = known.select(F.col("node").alias("dst"), F.col("component").alias("__c"))
        back = taken.join(of_u, "u").join(stage.select(F.col("src").alias("v"), "dst"), "v").join(of_w, "dst").filter("component = __c")
        back = back.select(F.col("v").alias("node"), "component").distinct()
        ring = loops.join(taken.select(F.col("v").alias("node")), "node", "left_semi").select("node", F.col("node").alias("component"))
        # of the two answers for a node the one from its neighbour counts
        both = back.withColumn("__own", F.lit(0)).unionByName(ring.withColumn("__own", F.lit(1))).groupBy("node").agg(F.min_by("component", "__own").alias("component"))
        known = known.unionByName(both) if k % 2 else stored(known.unionByName(both), "graph-parts")
    least = known.groupBy("component").agg(F.min("node").alias("__least"))
    return known.join(least, "component").select("node", F.col("__least").alias("component"))


def _ends(edges: DataFrame, side: str, name: str) -> DataFrame:
    return edges.select(F.col(side).alias(name)).distinct()


def _colored(edges: DataFrame, max_rounds: int) -> DataFrame:
    """(node, component) of the strongly connected parts of at least two nodes; ``component`` is one of the nodes."""
    rest = trim(edges, max_rounds)
    members = []
    for _ in range(max_rounds):
        if rest.isEmpty():
            break
        color = _spread_min(rest, max_rounds)
        a = color.select(F.col("id").alias("src"), F.col("color").alias("__a"))
        b = color.select(F.col("id").alias("dst"), F.col("color").alias("__b"))
        inside = cut_lineage(rest.join(a, "src").join(b, "dst").filter("__a = __b").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        owners = color.filter("color.id = id").select(F.col("id").alias("start"), F.col("id").alias("node"))
        part = cut_lineage(_search(owners, inside, 0, max_rounds).select("start", "node"))
        members.append(part)
        gone = part.select(F.col("node").alias("src"))
        left = rest.join(gone, "src", "left_anti").join(gone.select(F.col("src").alias("dst")), "dst", "left_anti")
        rest = trim(left, max_rounds)
    else:
        raise NotConverged(f"components left after {max_rounds} sweeps")
    if not members:
        return rest.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    everyone = _union(members)
    parts = everyone.groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("component")).filter("n > 1")
    return everyone.join(parts, "start").select("node", "component")


def levels(nodes: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(id, level): length of the longest path that ends at the node; NULL for nodes on or behind a cycle.

    ``nodes`` has ``id``. In every round the nodes without incoming edges are done and hand their level on, and nodes with a single
    predecessor go into it, their edges joined to longer ones with weights, so that chains of any length shrink by a constant factor.
    Afterwards these nodes get their levels from their predecessors, last ones first.
    """
    now = stored(_weighted(edges), "graph-edges")
    # base: the level a node has at least, from predecessors already done
    base = stored(nodes.select("id").distinct().withColumn("base", F.lit(0).cast("bigint")), "graph-base")
    steps = []
    size = now.count()
    for salt in range(max_rounds):
        if not size:
            break
        free = stored(base.join(_ends(now, "dst", "id"), "id", "left_anti"), "graph-free")
        rest_e = now.join(free, F.col("src") == F.col("id"), "left_anti")
        n_free, n_base = free.count(), base.count()
        # where peeling alone gets on, nothing has to be shrunk
        shrink = 2 * n_free < n_base
        taken = stored(_into_single(rest_e, salt).join(base.withColumnsRenamed({"id": "v"}), "v"), "graph-taken") if shrink else None
        # both kinds of nodes leave; their edges tell the next nodes what they have at least
        out = free.unionByName(taken.select(F.col("v").alias("id"), "base")) if shrink else free
        told = now.join(out, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.max(F.col("base") + F.col("weight")).alias("__b"))
        rest = base.join(out.select("id"), "id", "left_anti").join(told, "id", "left")
        base = stored(rest.select("id", F.greatest("base", F.coalesce("__b", F.lit(0))).alias("base")), "graph-base")
        now = stored(_without(rest_e, taken) if shrink else rest_e, "graph-edges")
        steps.append((free, taken))
        before, size = size, now.count()
        if shrink and size == before and not n_free and taken.isEmpty():
            break
    else:
        raise NotConverged(f"nodes left after {max_rounds} rounds")
    # what still has incoming edges is on or behind a cycle
    open_ = _ends(now, "dst", "id").withColumn("__open", F.lit(True))
    known = base.join(open_, "id", "left").select("id", F.when(F.col("__open").isNull(), F.col("base")).alias("level"))
    for free, taken in reversed(steps):
        known = known.unionByName(free.select("id", F.col("base").alias("level")))
        if taken is None:
            continue
        up = known.select(F.col("id").alias("u"), "level")
        mine = taken.join(up, "u", "left").select(F.col("v").alias("id"), F.when(F.col("level").isNotNull(), F.greatest("base", F.col("level") + F.col("a"))).alias("level"))
        known = stored(known.unionByName(mine), "graph-levels")
    return known.select("id", F.col("level").cast("int").alias("level"))


# Order of roles among nodes that are free at the same time.
ROLE_ORDER = {"source": 0, "route": 1, "transform": 2, "process": 3, "sink": 4, "utility": 5}


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with level and role priority; sort by (level nulls last, priority, id) for a valid order."""
    table = F.create_map(*[F.lit(x) for pair in ROLE_ORDER.items() for x in pair])
    priority = F.coalesce(F.try_element_at(table, F.col("role")), F.lit(3))
    return nodes.join(levels(nodes, edges), "id").withColumn("priority", priority)


def propagate(nodes: DataFrame, edges: DataFrame, seed: Column, barrier: Column, max_rounds: int = 100) -> DataFrame:
    """(id): nodes at or downstream of the seed nodes; a barrier node is not entered. Both are predicates on ``nodes``."""
    walls = nodes.filter(barrier).select(F.col("id").alias("dst"))
    open_edges = _pairs(edges).join(walls, "dst", "left_anti")
    seeds = nodes.filter(seed).select(F.lit(0).alias("start"), F.col("id").alias("node"))
    return reach(open_edges, seeds, max_rounds).select(F.col("node").alias("id"))


def iterate(df: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 100) -> DataFrame:
    """Apply ``step`` to its own result until it is empty; all rows produced, with their round. Rows left after
    ``max_rounds`` are an error."""
    parts = [cut_lineage(df.withColumn("round", F.lit(0)))]
    for i in range(1, max_rounds + 1):
        current = cut_lineage(step(parts[-1].drop("round")).withColumn("round", F.lit(i)))
        if current.isEmpty():
            return _union(parts)
        parts.append(current)
    if step(parts[-1].drop("round")).isEmpty():
        return _union(parts)
    raise NotConverged(f"rows left after {max_rounds} rounds")


def lineage(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Inputs and outputs of each step as rows (step, direction, other, relationships); one row per neighbour, so a step
    with many neighbours is not one value."""
    outs = edges.select(F.col("src").alias("step"), F.lit("output").alias("direction"), F.col("dst").alias("other"), "relationship")
    ins = edges.select(F.col("dst").alias("step"), F.lit("input").alias("direction"), F.col("src").alias("other"), "relationship")
    return outs.unionByName(ins).distinct()
