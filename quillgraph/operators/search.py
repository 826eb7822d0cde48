"""Path search over a knowledge graph by Monte Carlo trees, one tree for each seed.

A tree is sequential and small; seeds are independent. So the graph around the
seeds is gathered by joins (not broadcast: it may be of any size), grouped by seed,
and each seed's tree grows in one task.
"""

from __future__ import annotations

import hashlib
import math
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators.entropy import node_entropy
from quillgraph.operators.graph import actions, k_hop
from quillgraph.tables import Scratch

TREE = "seed string, id int, parent int, depth int, subject string, relation string, state string, visits int, value double"
STEP = "struct<subject: string, relation: string, object: string, value: double, visits: int>"


def neighbourhoods(edges: DataFrame, seeds: DataFrame, max_depth: int = 5, width: int = 15, written: bool = False) -> DataFrame:
    """(seed, node, actions): what the search from each seed can open, and where each action leads with what
    is gained there. Nodes at the last level but one are the last that are opened, so those at the last are
    no rows of their own.

    Actions are ranked a level at a time, only for nodes that a search may open, and gains are worked out for what these lead to, so nothing but
    the passes over the edges grows with the graph. The edges are written for that, unless they are ``written`` already, or are as cheap to read again.
    """
    scratch = Scratch(edges.sparkSession)
    edges = edges if written else scratch.keep(edges, "edges")
    new = opened = scratch.keep(seeds.select(F.col("seed").alias("node")).distinct(), "level")
    levels = []
    for level in range(max(1, max_depth - 1)):
        levels.append(scratch.keep(actions(edges, width, nodes=new).select("node", "rank", "relation", "neighbour"), "actions"))
        if level < max_depth - 2:
            new = scratch.keep(levels[-1].select(F.col("neighbour").alias("node")).distinct().join(opened, "node", "left_anti"), "level")
            opened = opened.unionAll(new)
    chosen = levels[0]
    for other in levels[1:]:
        chosen = chosen.unionAll(other)
    led = scratch.keep(chosen.select(F.col("neighbour").alias("node")).distinct(), "led")
    gain = node_entropy(edges, nodes=led).select(F.col("node").alias("neighbour"), "information")
    allowed = scratch.keep(chosen.join(gain, "neighbour").select("node", "rank", "relation", "neighbour", "information"), "actions")
    acts = allowed.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "relation", "neighbour", "information"))), lambda a: F.struct(a["relation"].alias("relation"), a["neighbour"].alias("neighbour"), a["information"].alias("information"))).alias("actions"))
    steps = allowed.select(F.col("node").alias("source"), F.col("relation").alias("edge_type"), F.col("neighbour").alias("target"), F.lit(1.0).alias("weight"))
    return k_hop(steps, seeds, max_depth - 2, directed=True).select("seed", "node").join(acts, "node")


def tree(edges: DataFrame, seeds: DataFrame, simulations: int = 100, max_depth: int = 5, width: int = 15, c_puct: float = 2.5, seed: int = 42, written: bool = False) -> DataFrame:
    """The search trees: (seed, id, parent, depth, subject, relation, state, visits, value);
    subject is the parent's state.

    Each simulation goes down by value / (visits + 1) + c sqrt(parent's visits) /
    (visits + 1), ties to the first child, opens a leaf with its actions, goes on to one
    at random, and adds that node's self-information to all nodes on its way. A
    tree has at most simulations * width nodes. Randomness is seeded by the seed's
    name, so runs agree. Seeds without edges have no tree. ``written``: as for ``neighbourhoods``.
    """

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        name = key[0]
        near = {n: [(a["relation"], a["neighbour"]) for a in acts] for n, acts in zip(rows["node"], rows["actions"], strict=True)}
        worth = {a["neighbour"]: a["information"] or 0.0 for acts in rows["actions"] for a in acts}
        choose = random.Random(int.from_bytes(hashlib.sha256(f"{seed}:{name}".encode()).digest()[:8], "big"))
        state, relation, parent, depth, visits, value, children = [name], [None], [-1], [0], [0], [0.0], [[]]
        for _ in range(simulations):
            path = [0]
            while children[path[-1]] and len(path) < max_depth:
                at = path[-1]
                bonus = c_puct * math.sqrt(visits[at])
                path.append(max(children[at], key=lambda c: (value[c] + bonus) / (visits[c] + 1)))
            at = path[-1]
            if len(path) < max_depth and near.get(state[at]):
                for rel, obj in near[state[at]]:
                    children[at].append(len(state))
                    for column, x in ((state, obj), (relation, rel), (parent, at), (depth, depth[at] + 1), (visits, 0), (value, 0.0)):
                        column.append(x)
                    children.append([])
                path.append(choose.choice(children[at]))
            gain = worth.get(state[path[-1]], 0.0)
            for node in path:
                visits[node] += 1
                value[node] += gain
        return pd.DataFrame({"seed": name, "id": range(len(state)), "parent": [None if p < 0 else p for p in parent], "depth": depth, "subject": [None if p < 0 else state[p] for p in parent], "relation": relation, "state": state, "visits": visits, "value": value})

    return neighbourhoods(edges, seeds, max_depth, width, written).groupBy("seed").applyInPandas(grow, TREE)


_PATHS = """
WITH RECURSIVE walk(seed, id, total, steps) AS (
  SELECT seed, id, CAST(0 AS DOUBLE), CAST(array() AS array<{step}>) FROM {{tree}} WHERE depth = 0
  UNION ALL
  SELECT t.seed, t.id, w.total + greatest(t.value, CAST(0 AS DOUBLE)),
         concat(w.steps, CAST(array(named_struct('subject', t.subject, 'relation', t.relation, 'object', t.state, 'value', t.value, 'visits', t.visits)) AS array<{step}>))
  FROM walk w JOIN {{tree}} t ON t.seed = w.seed AND t.parent = w.id)
SELECT w.seed, w.id AS leaf, w.total, w.steps
FROM walk w LEFT ANTI JOIN {{tree}} c ON c.seed = w.seed AND c.parent = w.id
WHERE size(w.steps) > 0 AND w.total > {threshold}
"""


def paths(nodes: DataFrame, threshold: float = 2500.0) -> DataFrame:
    """(seed, leaf, total, steps): paths from root to leaf whose values, the root's left out
    and none below 0, sum to more than ``threshold``; steps are (subject, relation,
    object, value, visits) in order.

    All trees are walked at once, a level a step, by a recursive query over the written trees: a step joins
    the paths so far to their last nodes' children, so a tree may be of any size. (Sessions limit the rows of a
    recursive query by spark.sql.cteRecursionRowLimit, an error beyond it; ``session`` lifts that.)
    """
    tree = Scratch(nodes.sparkSession).keep(nodes, "trees")
    return nodes.sparkSession.sql(_PATHS.format(step=STEP, threshold=float(threshold)), tree=tree)


def best_path(nodes: DataFrame) -> DataFrame:
    """(seed, step, id, state): from the root always the child of the highest total value
    (negative ones count 0), ties to the first."""

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        best: dict[int, tuple] = {}
        for r in rows.sort_values("id").itertuples():
            if r.depth > 0 and (int(r.parent) not in best or max(r.value, 0.0) > max(best[int(r.parent)].value, 0.0)):
                best[int(r.parent)] = r
        at, out = rows[rows["depth"] == 0].iloc[0], []
        out.append((key[0], 0, int(at["id"]), at["state"]))
        while out[-1][2] in best:
            r = best[out[-1][2]]
            out.append((key[0], len(out), r.id, r.state))
        return pd.DataFrame(out, columns=["seed", "step", "id", "state"])

    return nodes.groupBy("seed").applyInPandas(walk, "seed string, step int, id int, state string")


def preferences(nodes: DataFrame) -> DataFrame:
    """(seed, node, state, relation, object, preferred): for each inner node its child of the best and of
    the worst mean value; a child without visits counts 0 for the best and last for the worst."""
    rows = nodes.where("parent is not null").withColumn("mean", F.when(F.col("visits") > 0, F.col("value") / F.col("visits")))
    own = Window.partitionBy("seed", "parent")
    rows = rows.withColumns({"best": F.row_number().over(own.orderBy(F.desc(F.coalesce("mean", F.lit(0.0))), "id")), "worst": F.row_number().over(own.orderBy(F.asc_nulls_last("mean"), "id"))})
    marks = F.explode(F.concat(F.when(F.col("best") == 1, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")), F.when(F.col("worst") == 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))))
    return rows.select("seed", F.col("parent").alias("node"), F.col("subject").alias("state"), "relation", F.col("state").alias("object"), marks.alias("preferred"))


def visit_policy(children: DataFrame, keys: list[str], temperature: float = 1.0) -> DataFrame:
    """Adds probability to rows with visits: visits^(1/T) over its sum by ``keys``; at T = 0 all on
    the first most visited (by action)."""
    own = Window.partitionBy(*keys)
    if temperature == 0:
        first = F.row_number().over(own.orderBy(F.desc("visits"), "action"))
        return children.withColumn("probability", (first == 1).cast("double"))
    powered = F.pow(F.col("visits").cast("double"), F.lit(1.0 / temperature))
    return children.withColumn("probability", F.try_divide(powered, F.sum(powered).over(own)))


def path_reward(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of value / (visits + 1) by path, rounded to 2 digits as samples carry it."""
    return steps.groupBy(*keys).agg(F.round(F.sum(F.col("value") / (F.col("visits") + 1)), 2).alias("reward"))


def evidence(found: DataFrame) -> DataFrame:
    """Adds evidence, a path's steps in words by their relations' templates, and its reward."""
    words = F.transform("steps", lambda s: F.concat(F.replace(s["relation"], F.lit("{}"), F.concat(F.lit("<"), s["subject"], F.lit(">"))), F.lit(" <"), s["object"], F.lit(">")))
    reward = F.aggregate("steps", F.lit(0.0), lambda t, s: t + s["value"] / (s["visits"] + 1))
    return found.withColumn("evidence", words).withColumn("reward", F.round(reward, 2))
