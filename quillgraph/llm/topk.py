"""Exact top-k by inner product over an impact-ordered index, score at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.common import Scratch

LEVELS = 16
STEPS = 16  # checks for an end while the segments are processed


def narrow(x: np.ndarray) -> np.ndarray:
    """In the fewest bytes that hold all values, two at least."""
    top = int(np.abs(x).max(initial=0))
    return x.astype("<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8")


class Index:
    """Postings of a block of integer vectors: for each dimension the vectors by
    value, cut into segments of LEVELS quantised impacts with their bounds."""

    def __init__(self, values: np.ndarray, order: np.ndarray | None = None):
        n, self.dims = values.shape
        self.order = np.argsort(values, axis=0, kind="stable").T.astype("<i4").copy() if order is None else order
        self.cuts = np.unique(np.linspace(0, n, min(n, LEVELS) + 1).astype(np.int64))
        wide = values.astype(np.int64)
        self.low = np.take_along_axis(wide, self.order[:, self.cuts[:-1]].T.astype(np.int64), axis=0).T  # [dimension, segment]
        self.high = np.take_along_axis(wide, self.order[:, self.cuts[1:] - 1].T.astype(np.int64), axis=0).T
        self.longest = float(np.sqrt((wide.astype(float) ** 2).sum(axis=1).max(initial=0.0)))
        self.values = {np.dtype(np.int64): wide}

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact scores: in floats wherever no sum can lose a bit, as |x y| bounds all partial sums' parts."""
        most = self.longest * float(np.sqrt((query.astype(float) ** 2).sum())) * 1.001
        kind = np.dtype(np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64)
        if kind not in self.values:
            self.values[kind] = self.values[np.dtype(np.int64)].astype(kind)
        return (self.values[kind][rows] @ query.astype(kind)).astype(np.int64)

    def search(self, query: np.ndarray, k: int, skip: int | None, tie: np.ndarray) -> list[tuple[int, int]]:
        """The ``k`` best (score, place), ties by ``tie``, without the place ``skip``.

        Segments go by descending upper bound of their impact; a vector's sum of
        bounds plus the next bound for each dimension still open bounds its
        score. Processing ends when that proves that all but a quarter cannot be
        among the best, or with the last segment; what is left is scored exactly.
        """
        n = len(tie)
        possible = np.arange(n) if skip is None else np.delete(np.arange(n), skip)
        if not len(possible):
            return []
        weight = query.astype(float)[:, None]
        bound = np.maximum(weight * self.low, weight * self.high)
        slack = 1e-9 * np.abs(bound).sum()  # above the rounding of the sums
        segments = bound.shape[1]
        by_impact = np.argsort(-bound, axis=None, kind="stable")
        impacts = bound.ravel()[by_impact]
        lengths = np.diff(self.cuts)[by_impact % segments]
        begins = self.order.shape[1] * (by_impact // segments) + self.cuts[by_impact % segments]
        flat = self.order.ravel()
        sums, counts, floor_ = np.zeros(n), np.zeros(n, np.int64), -np.inf
        step = max(1, -(-len(by_impact) // STEPS))
        for at in range(0, len(by_impact), step):
            part = slice(at, at + step)
            docs = np.concatenate([flat[b : b + m] for b, m in zip(begins[part].tolist(), lengths[part].tolist(), strict=True)])
            sums += np.bincount(docs, np.repeat(impacts[part], lengths[part]), minlength=n)
            counts += np.bincount(docs, minlength=n)
            if at < len(by_impact) // 4 and len(possible) > 4 * k:
                continue  # too little is known for a proof
            after = impacts[at + step] if at + step < len(by_impact) else 0.0
            most = sums[possible] + (self.dims - counts[possible]) * after
            best = possible if len(possible) <= k else possible[np.argpartition(-most, k - 1)[:k]]
            if len(best) == k:
                floor_ = max(floor_, float(self.scores(best, query).min()))
            possible = possible[most >= floor_ - slack]
            if len(possible) <= max(4 * k, n // 4):
                break
        scores = self.scores(possible, query)
        if len(possible) > k:
            worst = np.partition(scores, len(scores) - k)[len(scores) - k]
            possible, scores = possible[scores >= worst], scores[scores >= worst]
        ranked = np.lexsort((tie[possible], -scores))[:k]
        return [(int(scores[i]), int(possible[i])) for i in ranked]


def quantise(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component, without vectors that are null or
    hold null or non-finite components."""
    good = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(good).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, scale: int = 256, block_rows: int = 8192, query_rows: int = 1024, slice_parts: int = 16) -> DataFrame:
    """(query, rank, id, score): for each row whose id is divisible by ``every`` the ``k``
    other rows with the highest integer inner products, ties to the smaller id.

    Rows are dealt into blocks of about ``block_rows``; each block's postings are
    sorted once and written. A task reads one block and lets parts of
    ``query_rows`` queries, ``slice_parts`` of them, pass by one after the
    other, so memory is bounded by a block and a part, and work by both. The k best
    of each block are ranked together. Nothing is approximate.

    Vectors that are null or hold null or non-finite components take no part;
    only vectors of one length are compared. Each row is a vector of its own:
    rows that share an id are each other's candidates, and as queries give k
    rows each. Rows with a null id are candidates (last of equal scores) but
    never queries. Components are taken to be below 2^20 in size, so that scores fit a long.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    rows = quantise(vectors, id_col, vector_col, scale).withColumn("dims", F.size("v")).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.keep(rows, "quantised")
    is_asked = F.col("id") % every == 0
    n_rows, n_asked = rows.agg(F.count("*"), F.count_if(is_asked)).first()
    n_blocks, n_parts = max(1, -(-n_rows // block_rows)), max(1, -(-n_asked // query_rows))
    n_slices = -(-n_parts // slice_parts)
    dealt = lambda df, n: df.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        """A block or part by id, null last, then row: places in it are in the order of ties."""
        table = table.sort_by([("id", "ascending"), ("row", "ascending")])
        values = narrow(table.column("v").combine_chunks().flatten().to_numpy().reshape(len(table), -1))
        order = Index(values).order if values.size else np.zeros((0, 0), "<i4")
        return pa.table({
            "dims": table.column("dims")[:1], "block": table.column("block")[:1], "ids": pa.array([table.column("id").to_pylist()], pa.list_(pa.int64())),
            "row": pa.array([table.column("row").to_pylist()], pa.list_(pa.int64())), "data": pa.array([values.tobytes()], pa.binary()), "postings": pa.array([order.tobytes()], pa.binary()),
        })

    kind = "dims int, block int, ids array<long>, row array<long>, data binary, postings binary"
    blocks = scratch.keep(dealt(rows, n_blocks).groupBy("dims", "block").applyInArrow(pack, kind), "blocks")
    parts = dealt(rows.where(is_asked), n_parts).groupBy("dims", "block").applyInArrow(pack, kind).withColumn("slice", F.pmod("block", F.lit(n_slices)))
    parts = scratch.keep(parts.drop("postings"), "queries")
    met = blocks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1)))).withColumn("part", F.lit(-1))
    asked = parts.withColumnRenamed("block", "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("postings", F.lit(None).cast("binary"))
    columns = ["dims", "block", "slice", "part", "ids", "row", "data", "postings"]
    met = met.select(columns).unionAll(asked.select(columns)).repartition(min(100_000, 2 * n_blocks * n_slices), "dims", "block", "slice").sortWithinPartitions("dims", "block", "slice", "part")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, index, ids, places = None, None, None, None
        for batch in batches:
            for i in range(len(batch)):
                dims, block, slice_, part = (batch.column(c)[i].as_py() for c in range(4))
                row, data = batch.column(5)[i].values.to_numpy(zero_copy_only=False), batch.column(6)[i].as_buffer()
                values = np.frombuffer(data, f"<i{data.size // max(1, len(row) * dims)}" if data.size else "<i2").reshape(len(row), dims)
                if part < 0:
                    order = np.frombuffer(batch.column(7)[i].as_buffer(), "<i4").reshape(dims, len(row)) if dims else np.zeros((0, len(row)), np.int32)
                    own, ids, places, index = (dims, block, slice_), batch.column(4)[i].values, {r: p for p, r in enumerate(row.tolist())}, Index(values, order)
                    tie = np.arange(len(row))
                elif own == (dims, block, slice_):
                    hits = [(j, *hit) for j, (r, v) in enumerate(zip(row.tolist(), values.astype(np.int64), strict=True)) for hit in index.search(v, k, places.get(r), tie)]
                    if hits:
                        at, score, place = (np.array(c) for c in zip(*hits, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(row[at]), batch.column(4)[i].values.take(pa.array(at)), pa.array(score, pa.int64()), ids.take(pa.array(place))], names=["asked", "query", "score", "id"])

    hits = met.mapInArrow(search, "asked long, query long, score long, id long")
    order = Window.partitionBy("asked").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "id", "score")
