"""Ranked lexical search: maximum trees over ranges of documents, opened best first."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.common import UPPER, Scratch
from quillgraph.llm.tokens import _slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = str.maketrans(UPPER, UPPER.lower())
#: A node has FANOUT children; one step opens at most WIDE nodes.
FANOUT_BITS, WIDE = 4, 64


def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) to (item, term, times)."""
    find = re.compile(TERM).findall
    for batch in _slices(batches):
        at, terms, times = [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            for term, n in Counter(find(text.translate(LOWER))).items():
                at.append(i)
                terms.append(term)
                times.append(n)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(times, pa.int64())], names=["item", "term", "times"])


POSTINGS = "shard long, term string, n_docs long, words long, places array<int>, tfs array<int>, ids array<{0}>, lengths array<long>"


def index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_postings: int = 1_000_000, shard_docs: int = 32_768) -> DataFrame:
    """The postings of all whole texts, by shards of documents: a row for each shard and term with
    the places of its documents and its occurrences there, and a row without term that has the
    shard's documents by place (their ids, ascending, null last, and numbers of terms).

    A shard is what a task reads one after the other, up to ``shard_docs`` documents or ``shard_postings``
    postings, so indexing moves nothing. Shards are numbered by task and order.
    Null texts and texts without terms have no place.
    """
    find = re.compile(TERM).findall
    kind = docs.schema[id_col].dataType.simpleString()

    def shard(number: int, ids: pa.Array, counts: list[Counter]) -> pa.RecordBatch:
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        terms = pa.array([t for c in counts for t in c], pa.string()).dictionary_encode()
        sizes = np.fromiter(map(len, counts), np.int64, len(counts))
        tfs = np.fromiter((n for c in counts for n in c.values()), np.int32, int(sizes.sum()))
        lengths = np.fromiter((sum(c.values()) for c in counts), np.int64, len(counts))
        places, of = np.repeat(place, sizes), terms.indices.to_numpy()
        by_term = np.lexsort((places, of))
        n_terms = len(terms.dictionary)
        cuts = np.searchsorted(of[by_term], np.arange(n_terms + 1))
        offsets, none = pa.array(np.append(cuts, cuts[-1]), pa.int32()), pa.array([0] * (n_terms + 1) + [len(order)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number] * (n_terms + 1), pa.int64()), pa.concat_arrays([terms.dictionary, pa.nulls(1, pa.string())]),
                pa.array([*np.diff(cuts).tolist(), len(order)], pa.int64()), pa.array([0] * n_terms + [int(lengths.sum())], pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(places[by_term])), pa.ListArray.from_arrays(offsets, pa.array(tfs[by_term])),
                pa.ListArray.from_arrays(none, ids.take(pa.array(order))), pa.ListArray.from_arrays(none, pa.array(lengths[order])),
            ],
            names=["shard", "term", "n_docs", "words", "places", "tfs", "ids", "lengths"],
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, counts, held = TaskContext.get().partitionId() << 33, [], [], 0
        for batch in _slices(batches):
            for i, text in enumerate(batch.column(1).to_pylist()):
                count = Counter(find(text.translate(LOWER)))
                if count:
                    ids.append(batch.column(0).slice(i, 1))
                    counts.append(count)
                    held += len(count)
                if held >= shard_postings or len(ids) >= shard_docs:
                    yield from _cut(shard(number, pa.concat_arrays(ids), counts))
                    number, ids, counts, held = number + 1, [], [], 0
        if ids:
            yield from _cut(shard(number, pa.concat_arrays(ids), counts))

    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(build, POSTINGS.format(kind))


def _cut(batch: pa.RecordBatch, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


class Trees:
    """For each term of a shard a tree of maxima over ranges of places, all trees in one array a level.

    Level 0 are the postings; a node of level l stands for a term and a range of
    2^(FANOUT_BITS l) places that hold it, with the largest impact there and its children's
    run in the level below. The last level has a node for each term, in the terms' order.
    """

    def __init__(self, term: np.ndarray, place: np.ndarray, impact: np.ndarray):
        self.place, self.top, self.first = [place], [impact], [np.arange(len(place) + 1)]
        span = int(place.max(initial=0))
        while span > 0 or len(self.top) == 1:
            span >>= FANOUT_BITS
            above = self.place[-1] >> FANOUT_BITS
            fresh = np.flatnonzero(np.concatenate(([True], (above[1:] != above[:-1]) | (term[1:] != term[:-1]))))
            self.top.append(np.maximum.reduceat(self.top[-1], fresh))
            self.first.append(np.append(fresh, len(above)))
            self.place.append(above[fresh])
            term = term[fresh]

    def search(self, nodes: np.ndarray, weight: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the ``k`` best places with a score above 0 and not below ``floor``,
        equal scores by place. ``nodes`` are roots with their weights.

        The ranges of highest bound (sum over the terms of weight times maximum) are opened
        first, some at a time, into children or into places, whose sums are exact scores. What
        is below the k-th best score so far is left closed; equal bounds are opened, as they may hold a tie.
        """
        level = len(self.top) - 1
        bounds = np.array([int((weight * self.top[level][nodes]).sum())])
        # Open ranges by level: bound, number of the range, and the run of its term nodes in entries.
        open_ = {level: (bounds, np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([len(nodes)]), nodes, weight)}
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        floor = max(floor, 1)
        while open_:
            level = max(open_, key=lambda l: (int(open_[l][0].max()), -l))
            bound, number, begin, size, entry, times = open_.pop(level)
            keep = np.flatnonzero(bound >= floor)
            if not len(keep):
                continue
            keep = keep[np.argsort(-bound[keep], kind="stable")]
            now, later = keep[:WIDE], keep[WIDE:]
            if len(later):
                open_[level] = (bound[later], number[later], begin[later], size[later], entry, times)
            which = _runs(begin[now], size[now])
            parent, weights = entry[which], times[which]
            first = self.first[level]
            lengths = first[parent + 1] - first[parent]
            child, weights = _runs(first[parent], lengths), np.repeat(weights, lengths)
            at = self.place[level - 1][child]
            order = np.argsort(at, kind="stable")
            child, weights, at = child[order], weights[order], at[order]
            begins = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            sums = np.add.reduceat(weights * self.top[level - 1][child], begins)
            if level == 1:
                found, scores = np.append(found, at[begins]), np.append(scores, sums)
                best = np.lexsort((found, -scores))[:k]
                found, scores = found[best], scores[best]
                if len(best) == k:
                    floor = max(floor, int(scores[-1]))
                continue
            ends = np.append(begins[1:], len(at))
            fresh = (sums, at[begins], begins, ends - begins, child, weights)
            if level - 1 in open_:  # joined to what is open there
                old = open_[level - 1]
                fresh = (*(np.append(a, b) for a, b in zip(old[:2], fresh[:2], strict=True)), np.append(old[2], begins + len(old[4])), np.append(old[3], fresh[3]), np.append(old[4], child), np.append(old[5], weights))
            open_[level - 1] = fresh
        good = scores >= floor
        return found[good], scores[good]


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of begin, begin + 1, ..., for each run."""
    if not len(size):
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    return np.arange(int(ends[-1])) + np.repeat(begin - (ends - size), size)


def search(postings: DataFrame, items: DataFrame, *, item_col: str = "item_id", text_col: str = "text", k: int = 20, slice_terms: int = 200_000, head: int = 32) -> DataFrame:
    """(item, rank, id, score): the ``k`` best documents of ``index``'s table for each item.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), a document's m
    is 75 + (25 n N) div L, its score the sum of weight * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms, repeats included;
    ties by ascending id, null last. Scores of 0 are no hits.

    The items go to the shards by broadcast in slices of at most ``slice_terms`` of their
    (item, term) rows, some 10 MB; more items are more slices. Of the shards a ``head``-th is
    searched first; its k-th best scores are floors under which the
    others open nothing. A shard's postings of the slice's terms are one task's
    group, bounded by the index's bounds on a shard. Items that are null or have no term that occurs give no row;
    rows that share an item id are items of their own, told apart by a column ``item_row``.
    """
    spark, scratch = postings.sparkSession, Scratch(postings.sparkSession)
    n_docs, n_words = postings.where("term is null").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    asked = scratch.keep(items.where(F.col(text_col).isNotNull()).select(F.monotonically_increasing_id().alias("item_row"), F.col(item_col).alias("item"), F.col(text_col).alias("text")), "items")
    terms = asked.select("item_row", "text").mapInArrow(lambda b: _renamed(terms_of(b)), "item_row long, term string, times long")
    terms = scratch.keep(terms, "terms")
    df = postings.where("term is not null").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long") * F.col("times")
    weighed = scratch.keep(terms.join(df, "term").select("item_row", "term", weight.alias("weight")).where("weight > 0"), "weights")
    n_slices = -(-weighed.count() // slice_terms)
    kind = postings.schema["ids"].dataType.elementType.simpleString()
    out = spark.createDataFrame([], f"item_row long, id {kind}, score long")
    order = Window.partitionBy("item_row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    for i in range(n_slices):
        # The slice comes back as columns, so no item is a Python object in the driver.
        part = weighed.where(F.pmod(F.xxhash64("item_row"), F.lit(n_slices)) == i)
        own = part.toArrow()
        names = own.column("term").unique()
        some = postings.join(F.broadcast(part.select("term").distinct()), "term", "left_semi").unionByName(postings.where("term is null"))
        rows = (own.column("item_row").to_numpy(), pc.index_in(own.column("term"), names).to_numpy(), own.column("weight").to_numpy())
        groups = lambda df, floors: df.groupBy("shard").applyInArrow(_searcher(spark.sparkContext.broadcast((names.to_pylist(), *rows, floors)), k, n_docs, n_words), f"item_row long, id {kind}, score long")
        is_head = F.pmod(F.xxhash64("shard"), F.lit(head)) == 0
        first = scratch.keep(ranked(groups(some.where(is_head), {})).drop("rank"), "head")
        floors = {r.item_row: r.floor for r in first.groupBy("item_row").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k).collect()}
        out = out.unionAll(first).unionAll(groups(some.where(~is_head), floors))
    return ranked(out).join(asked.select("item_row", "item"), "item_row").select("item", "rank", "id", "score", "item_row")


def _renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.rename_columns(["item_row", "term", "times"])


def _searcher(shared, k: int, n_docs: int, n_words: int):
    """Searches one shard for all items of a slice."""

    def run(table: pa.Table) -> pa.Table:
        names, item, term, weight, floors = shared.value
        head = table.filter(pc.is_null(table.column("term")))
        ids, lengths = head.column("ids").combine_chunks().flatten(), head.column("lengths").combine_chunks().flatten().to_numpy()
        table = table.filter(pc.is_valid(table.column("term")))
        hits: list[tuple[np.ndarray, ...]] = []
        if len(table):
            number = pc.index_in(table.column("term"), pa.array(names)).to_numpy()
            table, number = table.take(pa.array(np.argsort(number))), np.sort(number)
            place = table.column("places").combine_chunks().flatten().to_numpy()
            tf = table.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
            m = 75 + 25 * lengths * n_docs // n_words
            impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[place])
            trees = Trees(np.repeat(np.arange(len(number)), table.column("n_docs").to_numpy()), place.astype(np.int64), impact)
            node = np.full(len(names), -1)
            node[number] = np.arange(len(number))
            mine = node[term] >= 0
            rows, nodes, weights = item[mine], node[term[mine]], weight[mine]
            order = np.argsort(rows, kind="stable")
            rows, nodes, weights = rows[order], nodes[order], weights[order]
            cuts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.zeros(0, np.int64)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)], strict=False):
                found, scores = trees.search(nodes[a:b], weights[a:b], k, floors.get(int(rows[a]), 0))
                hits.append((np.full(len(found), rows[a]), found, scores))
        at, found, scores = (np.concatenate(c) if hits else np.zeros(0, np.int64) for c in (zip(*hits, strict=True) if hits else ((), (), ())))
        return pa.table({"item_row": pa.array(at, pa.int64()), "id": ids.take(pa.array(found, pa.int64())), "score": pa.array(scores, pa.int64())})

    return run


def ranked_search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 20, **sizes: int) -> DataFrame:
    """Indexes ``docs``, writes the index and searches it for ``items``: see ``index`` and ``search``."""
    table = Scratch(docs.sparkSession).keep(index(docs, id_col=id_col, text_col=text_col, **sizes), "postings")
    return search(table, items, item_col=item_col, text_col=item_text_col, k=k)
