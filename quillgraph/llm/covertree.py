"""Embedding near-dedup: exact cosine threshold pairs by dual traversal of cover trees."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import Scratch, components, lookup

#: Slack on distances, far above rounding; what the bounds leave open is decided by cosine.
SLACK = 1e-6
PIVOT_BYTES = 8 << 20
PARTNERS = 16


class CoverTree:
    """Unit vectors in nested levels of halving radii.

    A node has a centre, which is its own first child's centre (nesting), and
    covers the points lo:hi; its children's centres are more than half its
    level's radius apart and cover all its points within it. ``radius`` is the
    largest distance from the centre to a point covered.
    """

    def __init__(self, points: np.ndarray, leaf: int = 32):
        n = len(points)
        self.rows = np.arange(n)  # place -> row of the input
        nodes, children = [], []  # (lo, hi, radius); the centre is at lo
        todo = [(0, n, 2.0, -1)]
        first_far = self._away(points, 0, np.arange(n))
        order = np.argsort(first_far, kind="stable")
        self.rows = self.rows[order]
        while todo:
            lo, hi, level, parent = todo.pop()
            own = self.rows[lo:hi]
            away = self._away(points, own[0], own)
            radius = float(away.max(initial=0.0))
            k = len(nodes)
            nodes.append((lo, hi, radius))
            children.append([])
            if parent >= 0:
                children[parent].append(k)
            if hi - lo <= leaf or radius <= SLACK:
                continue
            while level / 2 >= radius:
                level /= 2
            level /= 2
            groups, rest = [], own
            while len(rest):
                far = away if len(rest) == len(own) else self._away(points, rest[0], rest)
                near = far <= level
                near[0] = True
                groups.append(rest[near])
                rest = rest[~near]
            at = lo
            for g in groups:
                self.rows[at : at + len(g)] = g
                todo.append((at, at + len(g), level, k))
                at += len(g)
        self.points = points[self.rows]
        self.lo, self.hi, self.radius = (np.array(c) for c in zip(*nodes, strict=True))
        self.children = children

    @staticmethod
    def _away(points: np.ndarray, centre: int, rows: np.ndarray) -> np.ndarray:
        out = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (points[rows] @ points[centre])))
        out[rows == centre] = 0.0
        return out

    def pack(self, values: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> bytes:
        """The tree over ``values``, whose unit vectors it has, in single precision if that holds them exactly."""
        single = values.astype(np.float32)
        values = (single if (single == values).all() else values)[self.rows]
        out, counts = io.BytesIO(), np.array([len(c) for c in self.children], np.int32)
        flat = np.array([x for c in self.children for x in c], dtype=np.int32)
        np.savez(out, values=values, keys=keys[self.rows], weights=weights[self.rows], lo=self.lo.astype(np.int32), hi=self.hi.astype(np.int32), radius=self.radius, counts=counts, flat=flat)
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> CoverTree:
        tree, z = cls.__new__(cls), np.load(io.BytesIO(data))
        tree.keys, tree.weights, tree.lo, tree.hi, tree.radius = (z[x] for x in ("keys", "weights", "lo", "hi", "radius"))
        tree.points = _unit(z["values"].astype(np.float64))
        tree.children = np.split(z["flat"], np.cumsum(z["counts"])[:-1])
        return tree


class Forest:
    """A spanning forest of links as they are found: never more than one for each point."""

    def __init__(self, n_a: int, n_b: int | None):
        self.offset = 0 if n_b is None else n_a  # of b's points; none if b is a
        self.parent, self.links = list(range(n_a + (n_b or 0))), []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def add(self, p: int, q: int) -> None:
        r, s = self.root(p), self.root(q + self.offset)
        if r != s:
            self.parent[max(r, s)] = min(r, s)
            self.links.append((p, q))


def dual(a: CoverTree, b: CoverTree, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links between the points of two trees (of one, if the same object).

    Returns for each point of a and of b the weight of the points linked to it in the
    other, and links that connect what is connected, as places in a and b.
    """
    reach, same = math.sqrt(max(0.0, 2 - 2 * threshold)), a is b
    in_a, in_b, tied = np.zeros(len(a.points)), np.zeros(len(b.points)), Forest(len(a.points), None if same else len(b.points))

    def block(alo: int, ahi: int, blo: int, bhi: int) -> None:
        hit = a.points[alo:ahi] @ b.points[blo:bhi].T >= threshold
        if same and alo == blo:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return
        in_a[alo:ahi] += hit @ b.weights[blo:bhi]
        if not (same and alo == blo):
            in_b[blo:bhi] += a.weights[alo:ahi] @ hit
        for p, q in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True):
            tied.add(p + int(alo), q + int(blo))

    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        own = same and i == j
        if not len(a.children[i]) and not len(b.children[j]):
            block(a.lo[i], a.hi[i], b.lo[j], b.hi[j])
            continue
        left = a.children[i] if len(a.children[i]) else np.array([i])
        right = b.children[j] if len(b.children[j]) else np.array([j])
        cos = a.points[a.lo[left]] @ b.points[b.lo[right]].T
        away = np.sqrt(np.maximum(0.0, 2 - 2 * cos))
        spread = a.radius[left][:, None] + b.radius[right][None, :]
        open_ = away - spread <= reach + SLACK
        if own:  # each unordered pair of one node's children once
            open_ &= np.tri(len(left), dtype=bool)
        full = open_ & (away + spread <= reach - SLACK)
        if own:
            np.fill_diagonal(full, False)
        for x, y in zip(*np.nonzero(full), strict=True):
            s, t = left[x], right[y]
            in_a[a.lo[s] : a.hi[s]] += b.weights[b.lo[t] : b.hi[t]].sum()
            in_b[b.lo[t] : b.hi[t]] += a.weights[a.lo[s] : a.hi[s]].sum()
            for p in range(a.lo[s], a.hi[s]):
                tied.add(p, int(b.lo[t]))
            for p in range(b.lo[t], b.hi[t]):
                tied.add(int(a.lo[s]), p)
        single = (a.hi[left] - a.lo[left] == 1)[:, None] & (b.hi[right] - b.lo[right] == 1)[None, :]
        rest = open_ & ~full
        if own:
            rest &= ~(single & np.eye(len(left), dtype=bool))
        for x, y in zip(*np.nonzero(rest & single), strict=True):
            if cos[x, y] >= threshold:
                p, q = int(a.lo[left[x]]), int(b.lo[right[y]])
                in_a[p] += b.weights[q]
                in_b[q] += a.weights[p]
                tied.add(p, q)
        todo.extend((int(left[x]), int(right[y])) for x, y in zip(*np.nonzero(rest & ~single), strict=True))
    if same:
        in_a, in_b = in_a + in_b, np.zeros(len(b.points))
    return in_a, in_b, tied.links


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, chunk_rows: int = 2048) -> DataFrame:
    """(id, n_links, component, kept): for each vector how many others of its label have a
    cosine of ``threshold`` or more, and the smallest id reachable over such links.

    Equal vectors of a label are one class, searched once and counted as many.
    A label's classes are dealt to the nearest of its pivots and on into chunks
    of about ``chunk_rows``, so a label, however large, is many rows; each
    chunk is a cover tree. Two chunks of a label meet unless their centres are
    too far apart for their radii; pairs go by name, grouped by their first chunk,
    whose tree a task reads once. Each meeting is a dual traversal that
    prunes node pairs by their covering radii and returns sums for each class and
    a spanning forest of links, never all pairs. Cosines are double precision.

    Vectors that are null, empty, zero or hold null or non-finite components,
    and those without a label, link with nothing; vectors of different length
    neither. Each row is a vector of its own even if ids repeat; then rows of an
    id have their own links but may share a component. A row with a null id
    can link; its component is the smallest id it reaches, null if none.
    kept: id equals component (null equals null).
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    v = F.transform(vector_col, lambda x: x.cast("double"))
    good = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector_col, lambda x: x != 0) & F.col(label_col).isNotNull()
    valid = F.coalesce(good, F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"), valid.alias("valid"))
    rows = rows.withColumn("h1", F.xxhash64("label", "v")).withColumn("h2", F.xxhash64(F.lit(1), "label", "v"))
    classes = rows.where("valid").groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("id").alias("first"), F.count("*").alias("n"))
    classes = scratch.keep(classes.withColumn("group", F.concat_ws("/", F.size("v").cast("string"), "label")).withColumn("key", F.monotonically_increasing_id()), "classes")

    # Pivots: one for each cell of a large group, PIVOT_BYTES at most in all. Those of the least hashes are taken; a
    # bar that about twice as many pass keeps the rest away from the driver.
    n_classes, dims = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    per_cell = max(chunk_rows, -(-n_classes * 8 * dims // PIVOT_BYTES))
    large = classes.groupBy("group").agg(F.count("*").alias("rows")).where(F.col("rows") > per_cell).withColumn("wanted", F.ceil(F.col("rows") / per_cell))
    place = F.shiftrightunsigned("h1", 1) / F.lit(2.0**63)
    passed = classes.join(large, "group").where(place < (2 * F.col("wanted") + 20) / F.col("rows")).select("group", "h1", "h2", "wanted", "v").collect()
    table: dict[str, list] = {}
    for p in sorted(passed, key=lambda p: (p["h1"] & (2**64 - 1), p["h2"])):
        if len(table.setdefault(p["group"], [])) < p["wanted"]:
            table[p["group"]].append(p["v"])
    known = spark.sparkContext.broadcast({g: _unit(np.array(x)) for g, x in table.items()})

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.array(batch.column(0).to_pylist(), dtype=object)
            cell, values = np.zeros(len(batch), np.int32), batch.column(2)
            for g in set(groups):
                if g in known.value:
                    at = np.flatnonzero(groups == g)
                    cell[at] = np.argmax(_unit(_matrix(values.take(pa.array(at)))) @ known.value[g].T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    placed = classes.select("group", "key", "v", "n").mapInArrow(nearest, "group string, key long, v array<double>, n long, cell int")
    placed = scratch.keep(placed.withColumn("spot", F.xxhash64("group", "cell")), "cells")
    cells = placed.groupBy("spot").agg(F.count("*").alias("in_cell"))
    placed = lookup(placed, cells, ["spot"], "in_cell", n_classes, F.xxhash64("key"))
    placed = placed.withColumn("sub", F.pmod(F.xxhash64("key"), F.ceil(F.col("in_cell") / (2 * chunk_rows))).cast("int"))

    def plant(rows_: pa.Table) -> pa.Table:
        points = _unit(_matrix(rows_.column("v").combine_chunks()))
        tree = CoverTree(points)
        data = tree.pack(_matrix(rows_.column("v").combine_chunks()), rows_.column("key").to_numpy(), rows_.column("n").to_numpy().astype(float))
        one = {"group": rows_.column("group")[:1], "chunk": pa.array([f"{rows_.column('group')[0].as_py()}/{rows_.column('cell')[0].as_py()}/{rows_.column('sub')[0].as_py()}"])}
        return pa.table(one | {"centre": pa.array([tree.points[0].tolist()], pa.list_(pa.float64())), "radius": pa.array([float(tree.radius[0])]), "tree": pa.array([data], pa.binary())})

    chunks = placed.groupBy("group", "cell", "sub").applyInArrow(plant, "group string, chunk string, centre array<double>, radius double, tree binary")
    chunks = scratch.keep(chunks, "trees")
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    side = lambda s: chunks.select("group", F.col("chunk").alias(s), F.col("centre").alias(f"c{s}"), F.col("radius").alias(f"r{s}"))
    ways = max(1, min(64, chunks.count() // 64))  # a group's chunks meet in so many tasks
    a, b = side("a").withColumn("deal", F.pmod(F.xxhash64("a"), F.lit(ways))), side("b").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ways - 1).cast("long"))))
    dot = F.aggregate(F.zip_with("ca", "cb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = a.join(b, ["group", "deal"]).where(F.col("a") <= F.col("b"))
    pairs = pairs.where(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)) <= F.col("ra") + F.col("rb") + reach + SLACK)
    pairs = scratch.keep(pairs.select("a", "b"), "pairs")

    # A group of up to PARTNERS gets their first tree once and lets the partners' trees pass by.
    shared = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    pairs = pairs.join(shared, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    trees = chunks.select(F.col("chunk").alias("b"), "tree")
    firsts = pairs.select("a", "part").distinct().join(chunks.select(F.col("chunk").alias("a"), "tree"), "a").select("a", "part", F.lit(None).cast("string").alias("b"), "tree")
    partners = pairs.join(trees, "b").select("a", "part", "b", F.when(F.col("a") != F.col("b"), F.col("tree")).alias("tree"))
    n_tasks = max(2 * spark.sparkContext.defaultParallelism, min(100_000, pairs.count() // 8))
    met = firsts.unionAll(partners).repartition(n_tasks, "a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, s = None, None
        for batch in batches:
            for i in range(len(batch)):
                x, part, y, data = (batch.column(c)[i].as_py() for c in range(4))
                if y is None:
                    own, s = (x, part), CoverTree.unpack(data)
                    continue
                if own != (x, part):
                    raise ValueError("a partner came before its first tree")
                t = s if x == y else CoverTree.unpack(data)
                in_s, in_t, tree = dual(s, t, threshold)
                keys = np.concatenate([s.keys[in_s > 0], t.keys[in_t > 0]])
                sums = np.concatenate([in_s[in_s > 0], in_t[in_t > 0]])
                one, other = s.keys[[p for p, _ in tree]], t.keys[[q for _, q in tree]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([keys, one]), pa.int64()),
                    pa.concat_arrays([pa.nulls(len(keys), pa.int64()), pa.array(other, pa.int64())]),
                    pa.array(np.concatenate([sums, np.zeros(len(one))]).astype(np.int64)),
                ], names=["key", "other", "n"])

    found = scratch.keep(met.mapInArrow(meet, "key long, other long, n long"), "links")
    roots = components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")), scratch)
    counts = found.where("other is null").groupBy("key").agg(F.sum("n").alias("linked"))
    known_ = classes.select("h1", "h2", "key", "first", "n").join(roots, classes.key == roots.node, "left").join(counts, "key", "left")
    known_ = scratch.keep(known_.select("h1", "h2", "first", "n", F.coalesce("component", "key").alias("root"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links")), "classes")
    least = known_.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("size"))
    by_class = lookup(known_, least, ["root"], "size", n_classes, F.xxhash64("h1")).select("h1", "h2", "n", "n_links", "component")
    searched = lookup(rows.where("valid").select("id", "h1", "h2"), by_class, ["h1", "h2"], "n", rows.count(), F.xxhash64("id", "h2"))
    out = searched.select("id", "n_links", "component").unionAll(rows.where("not valid").select("id", F.lit(0).cast("long"), "id"))
    return out.select("id", "n_links", "component", F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def _matrix(values: pa.Array) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)
