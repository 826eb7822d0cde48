"""Knowledge graph as a table of triples: navigation by joins.

A graph is an undirected multigraph unless ``directed``: edges(source,
edge_type, target, weight), parallel edges kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.tables import SALTS, Scratch, meet, paged, sized


def build(triples: DataFrame, confidence: Column | None = None) -> DataFrame:
    """Triples with a weight: their own, or else ``confidence`` (an expression over the
    row, such as a scorer's UDF), or else 1."""
    weight = F.when(~F.isnan("weight"), F.col("weight"))
    return triples.withColumn("weight", F.coalesce(weight, confidence if confidence is not None else F.lit(1.0), F.lit(1.0)).cast("double"))


def both_ways(edges: DataFrame, directed: bool = False) -> DataFrame:
    """(node, relation, neighbour, weight): each edge from either end; a self-loop once."""
    out = edges.select(F.col("source").alias("node"), F.col("edge_type").alias("relation"), F.col("target").alias("neighbour"), "weight")
    if directed:
        return out
    back = edges.where("source <> target").select(F.col("target").alias("node"), F.col("edge_type").alias("relation"), F.col("source").alias("neighbour"), "weight")
    return out.unionAll(back)


def simple(edges: DataFrame, order: Column | None = None) -> DataFrame:
    """(a, b, weight) with a <= b: parallel edges overwrite each other, the last by
    ``order`` (default: edge type, then weight) wins."""
    pair = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "weight", (order if order is not None else F.struct("edge_type", "weight")).alias("o"))
    return pair.groupBy("a", "b").agg(F.max_by("weight", "o").alias("weight"))


def relations(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Distinct (node, relation): what leads away from each node."""
    return both_ways(edges, directed).select("node", "relation").distinct()


def neighbours(edges: DataFrame, directed: bool = False) -> DataFrame:
    """(node, relation, neighbour), once for each parallel edge."""
    return both_ways(edges, directed).select("node", "relation", "neighbour")


def execute(frontier: DataFrame, edges: DataFrame, directed: bool = False) -> DataFrame:
    """Follows (node, relation) actions: adds the neighbour each leads to."""
    return frontier.join(neighbours(edges, directed), ["node", "relation"])


def actions(edges: DataFrame, limit: int = 15, key: Column | None = None, directed: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """At most ``limit`` distinct (relation, neighbour) actions of each node, in the order of
    ``key``, by default a hash, so that a choice among many is the same in every run. Equal actions
    have one dense rank, so what is beyond the limit goes before anything is compared or shuffled. Only for
    ``nodes`` (node), if given."""
    out = neighbours(edges, directed)
    out = out if nodes is None else out.join(nodes, "node", "left_semi")
    order = key if key is not None else F.xxhash64("node", "relation", "neighbour")
    rank = F.dense_rank().over(Window.partitionBy("node").orderBy(order, "relation", "neighbour"))
    return out.withColumn("rank", rank).where(F.col("rank") <= limit).distinct()


def context(edges: DataFrame, directed: bool = False) -> DataFrame:
    """(node, relations, entities): sorted lists of what surrounds each node."""
    near = both_ways(edges, directed)
    return near.groupBy("node").agg(F.sort_array(F.collect_set("relation")).alias("relations"), F.sort_array(F.collect_list("neighbour")).alias("entities"))


def context_pages(edges: DataFrame, size: int = 1000, directed: bool = False) -> DataFrame:
    """(node, page, relations, entities): what surrounds each node as ``context`` has it, in pages of at most ``size``
    neighbours, so that no row is longer however many a hub has. A page's relations are those of its neighbours."""
    near = paged(both_ways(edges, directed).select("node", "relation", "neighbour"), "node", ["neighbour", "relation"], size)
    return near.groupBy("node", "page").agg(F.sort_array(F.collect_set("relation")).alias("relations"), F.sort_array(F.collect_list("neighbour")).alias("entities"))


def has_neighbour(edges: DataFrame, asked: DataFrame, directed: bool = False) -> DataFrame:
    """Adds found to (node, relation, answer) rows: whether the relation leads there."""
    known = neighbours(edges, directed).distinct().select("node", "relation", F.col("neighbour").alias("answer"), F.lit(True).alias("found"))
    return asked.join(known, ["node", "relation", "answer"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


#: Seeds that may leave out a node before they are joined rather than listed beside it.
LISTED = 100

#: Seeds of one frontier that stand in one row, and nodes of a part that they meet at once.
RUN, SPAN = 256, 4096


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int, directed: bool = False, keep_last: bool = True) -> DataFrame:
    """(seed, node, distance): nodes within ``hops`` of each seed, once, at their distance.

    Each level is two joins, from the last frontier to its neighbours and against what was
    reached before, so walks do not multiply. Where many seeds have one frontier, as around a hub, it is
    followed once for all of them (``_shared``). Neighbours and frontiers are
    written tables: no level is worked out again by the next, however many there are. The last
    level, often by far the largest, is left unwritten without ``keep_last``, for a result that is read once.
    """
    scratch = Scratch(edges.sparkSession)
    near = both_ways(edges, directed).select("node", "neighbour").distinct()
    near = scratch.keep(near, "near") if hops > 1 else near
    frontier = scratch.keep(seeds.select(F.col("seed"), F.col("seed").alias("node"), F.lit(0).alias("distance")).distinct(), "frontier")
    reached = frontier
    for hop in range(1, hops + 1):
        step = _shared(frontier, reached, near, scratch) if hop > 1 else None
        if step is None:
            step = frontier.join(near, "node").select("seed", F.col("neighbour").alias("node")).distinct().join(reached, ["seed", "node"], "left_anti")
        step = step.withColumn("distance", F.lit(hop))
        frontier = scratch.keep(step, "frontier") if keep_last or hop < hops else step
        reached = reached.unionAll(frontier)
    return reached


def _shared(frontier: DataFrame, reached: DataFrame, near: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(seed, node): the next level, each different frontier followed once; None if most seeds have one of their own.

    Frontiers are the same by 128 bits of hash. What one leads to is dealt to its seeds by a join that needs no
    shuffle of the result (``_dealt``), beside each node the few seeds that had reached it before; only nodes with more such seeds than LISTED are compared by a join.
    """
    sets = frontier.groupBy("seed").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    sets = scratch.keep(sets, "frontiers")
    first = sets.groupBy("x", "y").agg(F.min("seed").alias("first"), F.count("*").alias("size"))
    of = scratch.keep(meet(sets, first, ["x", "y"]).select("seed", "first", "size"), "classes")
    n, classes = of.agg(F.count("*"), F.count_if(F.col("seed") == F.col("first"))).first()
    if 2 * classes > n:
        return None
    fronts = frontier.join(of.where("seed = first").select("first").withColumnRenamed("first", "seed"), "seed").select(F.col("seed").alias("first"), "node")
    reach = fronts.join(near, "node").select("first", F.col("neighbour").alias("node")).distinct().join(fronts, ["first", "node"], "left_anti")
    reach = scratch.keep(reach, "reach")
    known = reached.select("seed", "node").join(of.select("seed", "first"), "seed").join(reach, ["first", "node"])
    known = scratch.keep(known.withColumn("n", F.count("*").over(Window.partitionBy("first", "node"))), "known")
    few = known.where(F.col("n") <= LISTED).groupBy("first", "node").agg(F.collect_list("seed").alias("but"))
    many = known.where(F.col("n") > LISTED).select("first", "node").distinct()
    out = _dealt(reach.join(many, ["first", "node"], "left_anti").join(few, ["first", "node"], "left"), of, reach)
    out = out.where(F.col("but").isNull() | ~F.array_contains("but", F.col("seed"))).select("seed", "node")
    if many.isEmpty():
        return out
    return out.unionAll(_dealt(many, of, reach).select("seed", "node").join(known.select("seed", "node"), ["seed", "node"], "left_anti"))


def _dealt(rows: DataFrame, of: DataFrame, reach: DataFrame) -> DataFrame:
    """Adds each seed of its class ``of`` (seed, first, size) to a row (first, node).

    A class's seeds stand in rows of some RUN, its nodes in parts of some SPAN (``reach``: all its nodes). Each such row goes to each part and
    runs along its nodes, so that what is written holds a node RUN times on end and the same RUN seeds over and over, which files
    keep in a few bits a row, and no table of values in a file holds more than a few parts' nodes.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = reach.groupBy("first").agg(F.greatest(F.lit(SALTS), F.ceil(F.count("*") / SPAN)).alias("wide"))
    runs = of.groupBy("first", F.pmod(F.xxhash64("seed"), F.ceil(F.col("size") / RUN)).alias("run")).agg(F.collect_list("seed").alias("seeds"))
    runs = runs.join(wide, "first").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1))).drop("wide", "run")
    nodes = rows.join(wide, "first").withColumn("part", F.pmod(F.xxhash64("node"), F.col("wide"))).drop("wide").repartition(parts, "first", "part")
    return runs.join(nodes.hint("merge"), ["first", "part"]).withColumn("seed", F.explode("seeds")).drop("seeds", "part")


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 5, directed: bool = False) -> DataFrame:
    """(source, target, length, path) for each pair of at most ``max_depth`` hops apart.

    path alternates nodes and relations; per hop the least relation, overall the
    least path. Frontiers go out from both ends, each time from that end where the next makes fewer rows, as counts of
    neighbours tell beforehand, and meet in between: for each length the least
    path through a node that both have reached. A frontier row is the best path to its node so far; frontiers are written
    tables, as in ``k_hop``. Pairs that are found search no further.
    """
    scratch = Scratch(edges.sparkSession)
    near = scratch.keep(both_ways(edges, directed).groupBy("node", "neighbour").agg(F.min("relation").alias("relation")), "near")
    back = near.select(F.col("neighbour").alias("node"), F.col("node").alias("neighbour"), "relation")
    left = wanted = scratch.keep(pairs.select("source", "target").distinct(), "wanted")
    ahead, behind = _Frontiers(near, wanted, "source", scratch), _Frontiers(back, wanted, "target", scratch)
    found = None
    for length in range(max_depth + 1):
        if length:
            min(ahead, behind, key=lambda side: side.cost(left)).extend(left)
        steps = len(ahead.levels) - 1
        here = ahead.levels[steps].select("source", "node", F.col("path").alias("head"))
        if length == steps:
            met = left.join(here.withColumnRenamed("node", "target"), ["source", "target"]).withColumnRenamed("head", "path")
        else:
            there = behind.levels[length - steps].select("target", "node", F.col("path").alias("rest"))
            met = _meetings(left, here, there).withColumn("path", F.concat("head", "rest"))
        met = scratch.keep(met.groupBy("source", "target").agg(F.min("path").alias("path")).withColumn("length", F.lit(length)), "found")
        found = met if found is None else found.unionAll(met)
        if length < max_depth:
            left = scratch.keep(left.join(met, ["source", "target"], "left_anti"), "left")
            if left.isEmpty():
                break
    return found.select("source", "target", "length", "path")


class _Frontiers:
    """For each distance from one end (seed, node, path): the least path between them; from a source it begins
    with it, to a target it leaves out the node itself."""

    def __init__(self, near: DataFrame, wanted: DataFrame, seed: str, scratch: Scratch):
        self.near, self.seed, self.scratch = near, seed, scratch
        start = F.array(seed) if seed == "source" else F.array().cast("array<string>")
        self.levels = [scratch.keep(wanted.select(seed).distinct().select(seed, F.col(seed).alias("node"), start.alias("path")), "frontier")]
        self.degrees = scratch.keep(near.groupBy("node").agg(F.count("*").alias("n")), "degrees")
        self.costs: dict[int, int] = {}

    def _open(self, left: DataFrame) -> DataFrame:
        """The last frontier of the seeds that have a pair left."""
        return self.levels[-1].join(left.select(self.seed).distinct(), self.seed, "left_semi")

    def cost(self, left: DataFrame) -> int:
        """Rows that the next frontier is made of, at most."""
        at = len(self.levels)
        if at not in self.costs:
            ends = self._open(left).groupBy("node").agg(F.count("*").alias("m"))
            self.costs[at] = ends.join(self.degrees, "node").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
        return self.costs[at]

    def extend(self, left: DataFrame) -> None:
        seed = self.seed
        seen = self.levels[0].select(seed, "node")
        for level in self.levels[1:]:
            seen = seen.unionAll(level.select(seed, "node"))
        path = F.concat("path", F.array("relation", "neighbour")) if seed == "source" else F.concat(F.array("relation", "node"), "path")
        step = self._open(left).join(self.near, "node").select(seed, F.col("neighbour").alias("node"), path.alias("path"))
        step = step.groupBy(seed, "node").agg(F.min("path").alias("path")).join(seen, [seed, "node"], "left_anti")
        self.levels.append(self.scratch.keep(step, "frontier"))


def _meetings(left: DataFrame, here: DataFrame, there: DataFrame) -> DataFrame:
    """Rows of both frontiers at the same node for the pairs that are left: by way of the targets' nodes if that makes
    fewer rows, else by way of the nodes, as counts tell beforehand."""
    rows = lambda a, b, on: a.groupBy(on).agg(F.count("*").alias("n")).join(b.groupBy(on).agg(F.count("*").alias("m")), on).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    if rows(left, there, "target") <= rows(here, there, "node"):
        return left.join(there, "target").join(here, ["source", "node"])
    return here.join(there, "node").join(left, ["source", "target"], "left_semi")


def missing_seeds(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds that no edge touches."""
    nodes = edges.select(F.col("source").alias("seed")).unionAll(edges.select("target"))
    return seeds.join(nodes, "seed", "left_anti")


def induced(edges: DataFrame, seeds: DataFrame, directed: bool = False) -> DataFrame:
    """The edges at the seeds, all seeds in one join, with the seed; unknown seeds give none."""
    near = both_ways(edges, directed)
    return seeds.select("seed").distinct().join(near, F.col("seed") == F.col("node")).drop("node")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of an undirected graph as (node, component), component
    being the least node reachable; only nodes with an edge appear.

    Each round points every node at its least neighbour, follows the pointers to
    their roots by doubling and contracts the edges to roots. All state is in
    written tables; the driver sees only whether rows are left. ``edges`` has a
    and b, of one orderable type.
    """
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = scratch.keep(edges.where("a <> b").select(*pair("a", "b")).distinct(), "edges")
    found = None
    while not left.isEmpty():
        both = left.select("a", "b").unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("parent"))
        up = scratch.keep(up, "pointers")
        while True:
            above = up.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            new = scratch.keep(up.join(above, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") < F.col("parent")).alias("moved")), "pointers")
            scratch.drop(up)
            up, moved = new.select("node", "parent"), not new.where("moved").isEmpty()
            up._scratch_path = new._scratch_path
            if not moved:
                break
        if found is None:
            found = up
        else:
            old = found
            found = scratch.keep(old.join(up.select(F.col("node").alias("parent"), F.col("parent").alias("top")), "parent", "left").select("node", F.coalesce("top", "parent").alias("parent")), "found")
            scratch.drop(old)
        to_a, to_b = (up.select(F.col("node").alias(c), F.col("parent").alias(f"r{c}")) for c in "ab")
        new = scratch.keep(left.join(to_a, "a").join(to_b, "b").where("ra <> rb").select(*pair("ra", "rb")).distinct(), "edges")
        scratch.drop(left)
        left = new
    scratch.drop(left)
    if found is None:
        kind = edges.schema["a"].dataType
        return edges.sparkSession.createDataFrame([], f"node {kind.simpleString()}, component {kind.simpleString()}")
    return found.select("node", F.col("parent").alias("component"))


def roots(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): where following (node, parent) pointers ends. The pointers form no cycle and leave each node once; each
    round doubles what a pointer spans."""
    up = scratch.keep(parents.select("node", F.col("parent").alias("root")), "roots")
    n = up.count()
    while True:
        above = sized(up.select(F.col("node").alias("root"), F.col("root").alias("top")), n)
        new = scratch.keep(up.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        scratch.drop(up)
        if new.where("moved").isEmpty():
            return new.select("node", "root")
        up, path = new.select("node", "root"), new._scratch_path
        up._scratch_path = path
