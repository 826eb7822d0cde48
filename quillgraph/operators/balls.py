"""Exact nearest neighbours by an index of balls, written once and searched for many queries.

Items go to balls around pivots and, in a ball, to rings by their distance from its pivot. By
the triangle inequality a query's distance to a pivot bounds its distance to every
ring from below; rings that cannot hold one of the k nearest are never read for it.
Cosine is searched as distance between unit vectors, which falls as it rises.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.arrays import cosine, dot, l2
from quillgraph.tables import Scratch

#: Rows to a ring at least; balls and rings at most, which bounds what goes to every task (some 50 MB).
RING_ROWS, BALLS, RINGS = 2048, 16_384, 64
PIVOT_BYTES = 32_000_000
#: Relative to the squared lengths: above the rounding of a squared distance, by far.
SLACK = 1e-9


@dataclass
class Balls:
    """``classes``: (class, v, embedding, ids, ball, ring, part, off), a row for each distinct vector with its k
    smallest ids; ``pivots`` [ball, dimension]; ``rings``: ball, low, high, n, parts of each ring."""

    classes: DataFrame
    pivots: np.ndarray
    rings: dict[str, np.ndarray]
    measure: str
    k: int


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T), 0.0)


def _usable(measure: str, dims: int) -> Column:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("embedding").isNotNull() & (F.size("embedding") == dims) & finite
    return good & (dot(F.col("embedding"), F.col("embedding")) > 0) if measure == "cosine" else good


def _placed(measure: str) -> Column:
    e = F.transform("embedding", lambda x: x.cast("double"))
    if measure != "cosine":
        return e
    return F.transform(e, lambda x: x / F.sqrt(dot(F.col("embedding"), F.col("embedding"))))


def build(items: DataFrame, k: int, measure: str = "cosine", ring_rows: int = RING_ROWS) -> Balls | None:
    """The index over items (id, embedding) for searches of up to ``k`` neighbours; None without usable items.

    Equal vectors are one class, so copies, however many, are one row. Pivots are about one for four rings
    of rows, chosen by hash, at most BALLS and PIVOT_BYTES; an item joins the nearest pivot of
    those around its nearest coarse pivot, which need not be the nearest of all: rings hold what they hold.
    Vectors that are null, hold null or non-finite numbers, differ in length from
    most, or are zero under cosine are in no class.
    """
    spark, scratch = items.sparkSession, Scratch(items.sparkSession)
    sizes = items.where("embedding is not null").groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if sizes is None or sizes["dims"] == 0:
        return None
    dims = sizes["dims"]
    good = items.where(_usable(measure, dims)).select("id", "embedding")
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy(F.col("id").asc_nulls_last()))
    ids = good.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("embedding").agg(F.collect_list(F.struct("id")).alias("ids"))  # structs, as lists leave out nulls
    classes = scratch.keep(ids.withColumn("class", F.monotonically_increasing_id()).withColumn("v", _placed(measure)), "classes")
    n = classes.count()
    if n == 0:
        return None
    ring_rows = max(ring_rows, n // max(1, BALLS * RINGS // 4))
    n_pivots = int(max(1, min(BALLS, PIVOT_BYTES // (8 * dims), n // (4 * ring_rows))))
    pivots = matrix(classes.orderBy(F.xxhash64("class")).limit(n_pivots).select("v").toArrow().column("v").combine_chunks())
    coarse = pivots[: int(np.ceil(np.sqrt(len(pivots))))]
    around = np.argmin(distances(pivots, coarse), axis=1)
    shared = spark.sparkContext.broadcast((pivots, coarse, [np.flatnonzero(around == c) for c in range(len(coarse))]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, coarse, near = shared.value
        for batch in batches:
            if not len(batch):
                continue
            v = matrix(batch.column(1))
            home, ball, off = np.argmin(distances(v, coarse), axis=1), np.zeros(len(v), np.int32), np.zeros(len(v))
            for c in np.unique(home).tolist():
                rows = np.flatnonzero(home == c)
                d = distances(v[rows], pivots[near[c]])
                best = np.argmin(d, axis=1)
                ball[rows], off[rows] = near[c][best], np.sqrt(d[np.arange(len(rows)), best])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball), pa.array(off)], names=["class", "v", "embedding", "ids", "ball", "off"])

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    rows = classes.select("class", "v", "embedding", "ids").mapInArrow(assign, f"class long, v array<double>, embedding {kinds['embedding']}, ids {kinds['ids']}, ball int, off double")
    rows = scratch.keep(rows, "balls")
    widths = rows.groupBy("ball").agg(F.count("*").alias("held"), F.max("off").alias("radius"))
    wide = F.broadcast(widths)  # at most BALLS rows
    n_rings = F.greatest(F.lit(1), F.least(F.lit(RINGS), F.ceil(F.col("held") / ring_rows)))
    ring = F.when(F.col("radius") > 0, F.least(F.floor(F.col("off") / F.col("radius") * n_rings), n_rings - 1)).otherwise(0).cast("int")
    rows = rows.join(wide, "ball").withColumn("ring", ring).drop("held", "radius")
    found = rows.groupBy("ball", "ring").agg(F.min("off").alias("low"), F.max("off").alias("high"), F.count("*").alias("n")).toArrow()  # at most BALLS * RINGS rows
    rings = {c: found.column(c).to_numpy() for c in ("ball", "ring", "low", "high", "n")}
    rings["parts"] = -(-rings["n"] // (2 * ring_rows))
    number = spark.createDataFrame(pa.table({"ball": rings["ball"], "ring": rings["ring"], "number": np.arange(len(rings["n"]), dtype=np.int32), "parts": rings["parts"].astype(np.int32)}))
    rows = rows.join(F.broadcast(number), ["ball", "ring"]).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    rows = scratch.keep(rows.select("class", "v", "embedding", "ids", F.col("number").alias("ring"), "part", "off"), "rings")
    return Balls(rows, pivots, rings, measure, k)


def _visits(index: Balls, queries: DataFrame, first: bool) -> DataFrame:
    """(query, ring, part, at, bound): the rings to read for each query, with its distance from the
    pivot. First those nearest that hold k rows; then, for queries with a bound, the others that may hold a nearer one."""
    shared = queries.sparkSession.sparkContext.broadcast((index.pivots, index.rings))
    k = index.k

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, rings = shared.value
        step = max(1, 4_000_000 // len(rings["n"]))
        for batch in batches:
            for begin in range(0, len(batch), step):
                some = batch.slice(begin, step)
                v = matrix(some.column(1))
                at = np.sqrt(distances(v, pivots))[:, rings["ball"]]
                least = np.maximum(np.maximum(at - rings["high"], rings["low"] - at), 0.0)
                order = np.lexsort((at, least), axis=1)
                held = np.cumsum(rings["n"][order], axis=1)
                nearest = np.zeros(at.shape, bool)
                np.put_along_axis(nearest, order, np.concatenate((np.ones((len(v), 1), bool), held[:, :-1] < k), axis=1), axis=1)
                bound = some.column(2).to_numpy(zero_copy_only=False)
                wanted = nearest if first else ~nearest & (least <= bound[:, None])
                who, ring = np.nonzero(wanted)
                parts = rings["parts"][ring]
                who, ring, at = np.repeat(who, parts), np.repeat(ring, parts), np.repeat(at[who, ring], parts)
                part = np.arange(len(who)) - np.repeat(np.cumsum(parts) - parts, parts)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(who)), pa.array(ring.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(at), some.column(2).take(pa.array(who))], names=["query", "ring", "part", "at", "bound"])

    return queries.select("query", "v", "bound").mapInArrow(plan, "query long, ring int, part int, at double, bound double")


def _meet(index: Balls, visits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, class, d2, slack): of each visit the k nearest classes within the bound, and what is as near."""
    k = index.k
    # A ring that many queries visit is read by several tasks, each for some of them.
    crowd = visits.groupBy("ring", "part").agg(F.ceil(F.count("*") / 4096).cast("int").alias("groups"))  # at most rings' parts: 2 rows a ring, some 20 MB
    asked = visits.join(queries.select("query", "v"), "query").join(crowd, ["ring", "part"]).withColumn("group", F.pmod(F.xxhash64("query"), F.col("groups")).cast("int")).drop("groups")
    held = index.classes.select("class", "v", "ring", "part", "off").join(crowd, ["ring", "part"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(asked) and len(held):
            x, off, names = matrix(held.column("v").combine_chunks()), held.column("off").to_numpy(), held.column("class").to_numpy()
            for begin in range(0, len(asked), 512):
                some = asked.slice(begin, 512)
                q, bound = matrix(some.column("v").combine_chunks()), some.column("bound").to_numpy()
                d2 = distances(q, x)
                near = np.abs(off[None, :] - some.column("at").to_numpy()[:, None]) <= bound[:, None]
                slack = SLACK * ((q * q).sum(axis=1) + float((x * x).sum(axis=1).max()))
                most = np.square(bound) + slack
                if d2.shape[1] > k:
                    most = np.minimum(most, np.partition(np.where(near, d2, np.inf), k - 1, axis=1)[:, k - 1] + slack)
                who, which = np.nonzero(near & (d2 <= most[:, None]))
                out.append((some.column("query").to_numpy()[who], names[which], d2[who, which], slack[who]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        return pa.table(dict(zip(("query", "class", "d2", "slack"), columns, strict=True)))

    keys = ["ring", "part", "group"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(score, "query long, class long, d2 double, slack double")


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k nearest classes of each query and those as near but for rounding."""
    nth = F.row_number().over(Window.partitionBy("query").orderBy("d2", "class"))
    kth = hits.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("query").agg(F.max("d2").alias("last"), F.count("*").alias("n"))
    return hits.join(kth, "query").where((F.col("n") < k) | (F.col("d2") <= F.col("last") + F.col("slack"))).select("query", "class", "d2", "slack")


def _rounds(index: Balls, queries: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The queries (query, id, embedding, v); what is nearest in the rings that they read first; these visits, and those that the bounds then leave."""
    rows = queries.where(_usable(index.measure, index.pivots.shape[1])).select(F.monotonically_increasing_id().alias("query"), "id", "embedding", _placed(index.measure).alias("v"))
    rows = scratch.keep(rows.withColumn("bound", F.lit(float("inf"))), "queries")
    first = scratch.keep(_visits(index, rows, True), "visits")
    near = scratch.keep(_best(_meet(index, first, rows), index.k), "nearest")
    kth = near.groupBy("query").agg(F.count("*").alias("n"), F.max(F.sqrt(F.col("d2") + F.col("slack"))).alias("last"))
    bound = F.when(F.col("n") >= index.k, F.col("last") * (1 + SLACK)).otherwise(float("inf"))
    bounded = rows.drop("bound").join(kth, "query", "left").select("query", "v", bound.alias("bound"))
    return rows, near, first, scratch.keep(_visits(index, bounded, False), "visits")


def search(index: Balls, queries: DataFrame, k: int, itself: bool = True) -> DataFrame:
    """(query_id, item_id, score, rank): the ``k`` nearest items of each query (id, embedding), ties to the smaller id.

    First each query reads the rings nearest to it; its k-th distance there is the bound under
    which it reads others. Distances found by matrix products only choose candidates, with a margin for rounding; scores are
    taken one by one. Without ``itself`` items with the query's own id are left out. Queries that are not
    usable vectors get no rows; rows that share an id are each a query.
    """
    if k + (not itself) > index.k:
        raise ValueError(f"the index is for {index.k} neighbours, {k + (not itself)} are needed")
    scratch = Scratch(queries.sparkSession)
    rows, near, _, more = _rounds(index, queries, scratch)
    hits = scratch.keep(_best(near.unionAll(_meet(index, more, rows)), index.k), "hits")
    asked = rows.select("query", F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    pairs = hits.select("query", "class").join(asked, "query").join(index.classes.select("class", F.col("embedding").alias("x"), "ids"), "class")
    score = cosine(F.col("q"), F.col("x")) if index.measure == "cosine" else l2(F.col("q"), F.col("x"))
    pairs = pairs.select("query", "query_id", score.alias("score"), F.explode("ids").alias("item")).select("query", "query_id", "score", F.col("item.id").alias("item_id"))
    if not itself:
        pairs = pairs.where(~F.col("query_id").eqNullSafe(F.col("item_id")))
    order = [F.desc("score") if index.measure == "cosine" else F.asc("score"), F.col("item_id").asc_nulls_last()]
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "item_id", "score", "rank")


def visited_pairs(index: Balls, queries: DataFrame) -> int:
    """How many pairs of rows the rings read for the queries hold: what a search costs."""
    _, _, first, more = _rounds(index, queries, Scratch(queries.sparkSession))
    held = index.classes.groupBy("ring", "part").agg(F.count("*").alias("held"))
    return first.unionAll(more).join(held, ["ring", "part"]).agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
