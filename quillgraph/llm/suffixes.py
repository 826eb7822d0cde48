"""Suffix-array dedup: bytes of repeated strings go, by bucket-pointer refinement.

Positions are first put into buckets by their q-gram. A bucket is refined by
sorting its members on the identifiers of the buckets that their later offsets
are in, round by round: the identifiers that one round has refined are what the
next one's pointers lead to, so the depth to which a bucket's members agree
doubles. Members alone in their bucket are settled and leave.

Where a bucket's texts are at hand, in one task, this is done on their bytes
(``refined``): exact words are the first buckets, and the last round's
buckets are the strings of the full length. Between tasks a bucket's identifier must mean the same
everywhere, so there it is a 128-bit name that follows from the q-gram, and
a refined bucket's name follows from the names its pointers lead to.

Three things keep this in proportion to the text. Only one position in about
35 enters a bucket at first: the least q-gram, by a mixed hash, of each
string of the full length (its anchor); equal strings have equal anchors. The
anchor stands for all strings that have it: pointers to the q-grams all over
the context of these strings refine its bucket, and members that still share
one are settled together. Only buckets that fall apart are refined position by
position, and for that their contexts, under 2 * length bytes each, are
brought to the bucket's task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import Scratch

MEMBER, COVERED, CONTEXT, HOT, STRING, OPEN = range(6)
PIECE = 1 << 20  # starts worked on at a time, so that a text of any length takes bounded memory
LOCAL = 32  # contexts of one bucket that a task sends on; beyond, it names their strings itself
ROWS = "kind byte, k1 long, k2 long, doc long, row long, at long, bytes binary"
FIELDS = ["kind", "k1", "k2", "doc", "row", "at", "bytes"]
BITS = 26  # of the bitmap of texts that a join is about: 8 MB, whatever their number


class Names:
    """Names of substrings: differences of sums of coded bytes times powers, mod 2^64."""

    def __init__(self) -> None:
        coded = np.random.default_rng(20240607).integers(1, 2**63, size=(2, 256), dtype=np.uint64)
        self.coded, self.bases, self.n = coded, (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03), 0

    def _grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 1 << 16)
            self.up, self.down = [], []
            for base in self.bases:
                inverse = pow(base, -1, 2**64)
                for powers, b in ((self.up, base), (self.down, inverse)):
                    ones = np.full(self.n + 1, b, np.uint64)
                    ones[0] = 1
                    powers.append(np.multiply.accumulate(ones))

    def sums(self, x: np.ndarray) -> list[np.ndarray]:
        self._grow(len(x))
        out = []
        for coded, down in zip(self.coded, self.down, strict=True):
            s = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(coded[x] * down[: len(x)], out=s[1:])
            out.append(s)
        return out

    def of(self, sums: list[np.ndarray], k: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[k][end] - sums[k][begin]) * self.up[k][begin]

    def grams(self, sums: list[np.ndarray], k: int, q: int) -> np.ndarray:
        s = sums[k]
        return (s[q:] - s[:-q]) * self.up[k][: len(s) - q]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a pair of bucket identifiers."""
    return mixed(a * np.uint64(3) + np.uint64(1)) + mixed(b ^ np.uint64(0xA0761D6478BD642F)) * np.uint64(5)


def anchors(names: Names, x: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """(bucket, context, first start, last start) of each anchor of a piece of text."""
    sums = names.sums(x)
    gram = names.grams(sums, 0, q)
    least = (mixed(gram) & ~np.uint64((1 << 24) - 1)) | np.arange(len(gram), dtype=np.uint64)
    window, done = length - q + 1, 1
    while done < window:
        step = min(done, window - done)
        least, done = np.minimum(least[:-step], least[step:]), done + step
    place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:] - 1, [len(place) - 1]))
    at = place[first]
    shape = ((at - first) << 16 | (last - first)).astype(np.uint64)
    pointed = names.grams(sums, 1, q)  # the identifiers of the buckets that pointers lead to
    name, end = mixed(shape), last + length - q
    for step in range(0, int((end - first).max()) + q, q):  # offsets all over the context, the last one at its end
        on = np.flatnonzero(first + step < end + q)
        name[on] = joined(name[on], pointed[np.minimum(first[on] + step, end[on])])
    return gram[at], name, first, last


def refined(x: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """For each position the bucket of the string of ``length`` bytes there: equal for equal
    strings only. ``end`` is where each position's text ends; positions with less than
    ``length`` bytes left have some bucket of no meaning.

    The first buckets are words of up to 8 bytes. In a round the members at p of
    each bucket that several share are sorted on the bucket of p + depth, which
    the round before has refined, and so agree to twice the depth; the last
    round's pointer goes to p + length - depth.
    """
    n, depth = len(x), min(8, length)
    word, wide = np.zeros(n, np.uint64), np.concatenate((x, np.zeros(8, np.uint8))).astype(np.uint64)
    for j in range(depth):
        word = word << np.uint64(8) | wide[j : j + n]
    bucket = np.unique(word, return_inverse=True)[1]
    room, active = end - np.arange(n), np.arange(n)
    while depth < length:
        step = min(depth, length - depth)
        members = np.bincount(bucket[active])
        active = active[(members[bucket[active]] > 1) & (room[active] >= depth + step)]
        if not len(active):
            break
        base = int(bucket.max()) + 1
        key = bucket[active] * base + bucket[active + step]
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        bucket[active[order]] = base + new
        depth += step
    return bucket


def strings(names: Names, x: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """(starts, names, names): the refined buckets of all starts in the ranges first..last."""
    sums = names.sums(x)
    starts = np.repeat(first - np.concatenate(([0], np.cumsum(last - first + 1)[:-1])), last - first + 1) + np.arange(int((last - first + 1).sum()))
    out = []
    for k in (0, 1):
        level = names.grams(sums, k, q)
        size = q
        while size < length:  # identifiers at p and at a later offset name the next level
            step = min(size, length - size)
            level, size = joined(level[: len(level) - step], level[step:]), size + step
        out.append(level[starts])
    return starts, *out


def firsts(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket, context and place, and in it which are first in their
    bucket and context, and which repeat the one before entirely."""
    order = np.lexsort((at, row, doc, k2, k1))
    a, b = order[1:], order[:-1]
    same = (k1[a] == k1[b]) & (k2[a] == k2[b])
    twin = same & (doc[a] == doc[b]) & (row[a] == row[b]) & (at[a] == at[b])
    return order, np.concatenate(([True], ~same))[: len(order)], np.concatenate(([False], twin))[: len(order)]


def _batch(kind: int, k1, k2, doc, row, at, data=None) -> pa.RecordBatch:
    n = len(k1)
    data = pa.nulls(n, pa.binary()) if data is None else pa.array(data, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in (k1, k2, doc, row, at)), data], names=FIELDS)


def _covered(doc: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """What is covered, as few runs; ends rise with begins in a text."""
    order = np.lexsort((begin, row, doc))
    doc, row, begin, end = doc[order], row[order], begin[order], end[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (begin[1:] > end[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(doc) - 1])) if len(doc) else first
    doc, row, begin, end = doc[first], row[first], begin[first], end[last]
    return _batch(COVERED, joined(doc.view(np.uint64), row.view(np.uint64)), np.zeros(len(doc), np.int64), doc, row, begin << 31 | (end - begin))


def _unique_k1(k1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of rows alone in their bucket, and of the others."""
    order = np.argsort(k1, kind="stable")
    if not len(order):
        return order, order
    s = k1[order]
    same = np.concatenate(([False], s[1:] == s[:-1], [False]))
    shared = same[:-1] | same[1:]
    return order[~shared], order[shared]


def _bitmap(texts: DataFrame) -> DataFrame:
    """(block, bits): which hashes ``row`` of texts occur, by their last BITS bits."""

    def fill(table: pa.Table) -> pa.Table:
        at = table.column("bit").to_numpy() & ((1 << 19) - 1)
        bits = np.zeros(1 << 13, np.int64)
        np.bitwise_or.at(bits, at >> 6, np.left_shift(np.int64(1), at & 63))
        return pa.table({"block": table.column("block")[:1], "bits": pa.array([bits], pa.list_(pa.int64()))})

    bit = texts.select(F.col("row").bitwiseAND(F.lit((1 << BITS) - 1)).alias("bit")).distinct()
    return bit.withColumn("block", F.shiftright("bit", 19).cast("int")).groupBy("block").applyInArrow(fill, "block int, bits array<long>")


def _flagged(texts: DataFrame, bitmap: DataFrame) -> DataFrame:
    """Adds maybe: false only for texts whose hash the bitmap does not hold."""
    bit = F.col("row").bitwiseAND(F.lit((1 << BITS) - 1))
    out = texts.withColumn("bit", bit.cast("int")).withColumn("block", F.expr("shiftright(bit, 19)"))
    out = out.join(F.broadcast(bitmap), "block", "left")  # at most 128 rows of 64 KB
    held = F.expr("getbit(element_at(bits, (shiftright(bit, 6) & 8191) + 1), bit & 63) = 1")
    return out.withColumn("maybe", F.coalesce(held, F.lit(False))).drop("bit", "block", "bits")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, q: int = 32, flush_bytes: int = 48 << 20, partitions: int | None = None) -> DataFrame:
    """Removes each byte covered by a string of ``length`` bytes that also starts earlier.

    Earlier is a smaller id or, in a document, an earlier start. Strings overlap
    freely, are judged on the input and never cross documents. Returns (id,
    n_bytes, spans, kept): the maximal removed runs as (begin, end) and the
    remaining UTF-8 bytes (binary, as they may end inside a character).

    Each task settles what it can among its own texts, so a bucket gets at most
    LOCAL rows from a task, however many copies there are, and a string inside a
    frequent passage at most one. Texts are shuffled only if a bitmap of fixed
    size says that they may have something to refine or remove. ``q`` must be from length / 4 to length / 2.
    ``partitions`` deals the buckets (default: a partition for 8 MB of
    input, from 100,000 on for 256 MB, at least spark.sql.shuffle.partitions). Null texts are empty; texts
    shorter than ``length`` stay. Ids must be whole numbers; null ids count as
    last. Rows that share an id are ordered by a hash of their text; equal rows
    are one document and share its result. An empty table gives an empty result.
    """
    if not length / 4 <= q <= length / 2:
        raise ValueError("q must be from length / 4 to length / 2")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    body = F.coalesce(F.col(text_col), F.lit(""))
    last_id = F.lit(2**63 - 1)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), last_id).alias("doc"), F.xxhash64(body).alias("row"), F.encode(body, "UTF-8").alias("body"))
    if partitions is None:
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        known = size if size < 1 << 50 else 0  # a plan that does not know its size says something huge
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, known // (8 << 20)), known // (256 << 20))

    def pieces(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
        x = np.frombuffer(data, np.uint8)
        for begin in range(0, len(x) - length + 1, PIECE):
            yield begin, x[begin : begin + PIECE + length - 1]

    def settle(own: list[tuple[int, int, bytes]], names: Names) -> Iterator[pa.RecordBatch]:
        """What one task can tell of some of its texts."""
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        for i, (_, _, data) in enumerate(own):
            for begin, x in pieces(data):
                k1, k2, first, last = anchors(names, x, length, q)
                for c, v in zip(cols, (k1, k2, np.full(len(k1), i), first + begin, last - first), strict=True):
                    c.append(v)
        if not cols[0]:
            return
        k1, k2, which, first, span = (np.concatenate(c) for c in cols)
        docs_, rows_ = np.array([d for d, _, _ in own]), np.array([r for _, r, _ in own])
        doc, row, at = docs_[which], rows_[which], first << 8 | span
        alone, shared = _unique_k1(k1)
        yield _batch(MEMBER, k1[alone], k2[alone], doc[alone], row[alone], at[alone])
        if not len(shared):
            return
        order, first_, twin = firsts(k1[shared], k2[shared], doc[shared], row[shared], at[shared])
        order = shared[order]
        gone = order[~first_ & ~twin]
        yield _covered(doc[gone], row[gone], first[gone], first[gone] + span[gone] + length)
        order = order[first_]
        new = np.concatenate(([True], k1[order][1:] != k1[order][:-1]))
        bucket = np.cumsum(new) - 1
        contexts = np.bincount(bucket)[bucket]
        keep = order[contexts == 1]
        yield _batch(MEMBER, k1[keep], k2[keep], doc[keep], row[keep], at[keep])
        few = order[(contexts > 1) & (contexts <= LOCAL)]
        data = [own[i][2][a : a + w + length] for i, a, w in zip(which[few].tolist(), first[few].tolist(), span[few].tolist(), strict=True)]
        yield _batch(CONTEXT, k1[few], k2[few], doc[few], row[few], at[few], data)
        hot = order[new & (contexts > LOCAL)]
        yield _batch(HOT, k1[hot], k2[hot], doc[hot], row[hot], at[hot])
        many = order[contexts > LOCAL]
        data = [own[i][2][a : a + w + length] for i, a, w in zip(which[many].tolist(), first[many].tolist(), span[many].tolist(), strict=True)]
        if data:
            yield from sift(data, doc[many], row[many], first[many], names, np.ones(len(many), bool))

    def sift(data: list[bytes], doc: np.ndarray, row: np.ndarray, first: np.ndarray, names: Names, on: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Refines contexts string by string: all but the first of each refined bucket are
        covered; the first is sent on as a string for contexts that are ``on``."""
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        place = np.cumsum(sizes) - sizes
        x = np.frombuffer(b"".join(data), np.uint8)
        which = np.repeat(np.arange(len(data)), sizes - length + 1)
        starts = np.arange(len(which)) + which * (length - 1)
        bucket = refined(x, np.repeat(place + sizes, sizes), length)[starts]
        doc, row, at, on = doc[which], row[which], starts - place[which] + first[which], on[which]
        order, head, twin = firsts(bucket, np.zeros(len(bucket), np.int64), doc, row, at)
        keep, gone = order[head], order[~head & ~twin]
        yield _covered(doc[gone], row[gone], at[gone], at[gone] + length)
        keep = keep[on[keep]]
        if len(keep):
            _, k1, k2 = strings(names, x, place, place + sizes - length, length, q)
            yield _batch(STRING, k1[keep], k2[keep], doc[keep], row[keep], at[keep])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own, n = Names(), [], 0
        for batch in batches:
            for doc, row, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(data) >= length:
                    own.append((doc, row, data))
                    n += len(data)
                if n >= flush_bytes:
                    yield from settle(own, names)
                    own, n = [], 0
        yield from settle(own, names)

    def columns(batches: Iterator[pa.RecordBatch]) -> tuple:
        got = list(batches)
        got = pa.Table.from_batches(got) if got else ARROW.empty_table()
        return (*(got.column(i).to_numpy() for i in range(6)), got.column("bytes"))

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets of one partition: members that repeat a context are covered, first ones of
        a bucket with several contexts stay open, others are unique."""
        kind, k1, k2, doc, row, at, data = columns(batches)
        for on in np.flatnonzero(kind == COVERED), np.flatnonzero((kind == STRING) | (kind == HOT)):
            for k in np.unique(kind[on]).tolist():
                part = on[kind[on] == k]
                yield _batch(k, k1[part], k2[part], doc[part], row[part], at[part])
        hot = np.unique(k1[kind == HOT])
        members = np.flatnonzero((kind == MEMBER) | (kind == CONTEXT))
        alone, shared = _unique_k1(k1[members])
        alone, shared = members[alone], members[shared]
        left = alone[np.isin(k1[alone], hot)]
        yield _batch(OPEN, k1[left], k2[left], doc[left], row[left], at[left])
        if not len(shared):
            return
        order, first, twin = firsts(k1[shared], k2[shared], doc[shared], row[shared], at[shared])
        order = shared[order]
        gone = order[~first & ~twin]
        yield _covered(doc[gone], row[gone], at[gone] >> 8, (at[gone] >> 8) + (at[gone] & 255) + length)
        order = order[first]
        new = np.concatenate(([True], k1[order][1:] != k1[order][:-1]))
        bucket = np.cumsum(new) - 1
        left = order[(np.bincount(bucket)[bucket] > 1) | np.isin(k1[order], hot)]
        part = left[kind[left] == MEMBER]
        yield _batch(OPEN, k1[part], k2[part], doc[part], row[part], at[part])
        part = left[kind[left] == CONTEXT]
        yield _batch(CONTEXT, k1[part], k2[part], doc[part], row[part], at[part], data.take(pa.array(part)).to_pylist())

    settled = scratch.keep(texts.select("doc", "row", "body").mapInArrow(gather, ROWS).repartition(partitions, "k1").mapInArrow(refine, ROWS), "settled")

    open_ = settled.where(F.col("kind") == OPEN).groupBy("doc", "row").agg(F.collect_list(F.struct("k1", "k2", "at")).alias("marks"))
    open_ = scratch.keep(open_, "open")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of open contexts."""
        for batch in batches:
            for doc, row, data, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k1, k2, at = (np.array([m[f] for m in marks], dtype=np.int64) for f in ("k1", "k2", "at"))
                parts = [data[a >> 8 : (a >> 8) + (a & 255) + length] for a in at.tolist()]
                yield _batch(CONTEXT, k1, k2, np.full(len(at), doc), np.full(len(at), row), at, parts)

    wanted = _flagged(texts, _bitmap(open_)).where("maybe").select("doc", "row", "body")
    opened = wanted.join(open_.hint("shuffle_hash"), ["doc", "row"]).select("doc", "row", "body", "marks").mapInArrow(contexts, ROWS)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets with all their contexts. Where a task has named strings of a bucket itself,
        those that are first here go on to meet them."""
        kind, k1, k2, doc, row, at, data = columns(batches)
        names, hot, members = Names(), np.unique(k1[kind == HOT]), np.flatnonzero(kind == CONTEXT)
        members = members[np.argsort(k1[members], kind="stable")]
        ends = np.flatnonzero(np.diff(k1[members])) + 1  # whole buckets, some 20,000 contexts at a time
        cuts = ends[np.searchsorted(ends, np.arange(20_000, len(members), 20_000), side="left").clip(max=max(0, len(ends) - 1))] if len(ends) else []
        for part in np.split(members, np.unique(cuts)):
            if len(part):
                yield from sift(data.take(pa.array(part)).to_pylist(), doc[part], row[part], at[part] >> 8, names, np.isin(k1[part], hot))

    met = settled.where(F.col("kind").isin(CONTEXT, HOT)).unionAll(opened).repartition(partitions, "k1").mapInArrow(meet, ROWS)
    met = scratch.keep(met, "met")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, k1, k2, doc, row, at, _ = columns(batches)
        order, first, twin = firsts(k1, k2, doc, row, at)
        gone = order[~first & ~twin]
        yield _covered(doc[gone], row[gone], at[gone], at[gone] + length)

    named = settled.unionAll(met)
    told = named.where(F.col("kind") == STRING).repartition(partitions, "k1").mapInArrow(last, ROWS)
    covered = named.where(F.col("kind") == COVERED).unionAll(told).groupBy("doc", "row").agg(F.collect_list("at").alias("runs"))
    covered = scratch.keep(covered, "covered")
    spans_type = T.ArrayType(T.StructType().add("begin", "long").add("end", "long"))
    key = docs.schema[id_col].dataType

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = zip(*(cut(data, runs) for data, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)), strict=True) if len(batch) else ((), ())
            sizes = pa.array([len(x) for x in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(spans, SPANS), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    flagged = _flagged(texts, _bitmap(covered))
    hit = flagged.where("maybe").select("id", "doc", "row", "body").join(covered.hint("shuffle_hash"), ["doc", "row"], "left")
    hit = hit.select("id", "body", "runs").mapInArrow(finish, T.StructType().add("id", key).add("n_bytes", "long").add("spans", spans_type).add("kept", "binary"))
    whole = flagged.where("not maybe").select("id", F.length("body").cast("long").alias("n_bytes"), F.array().cast(spans_type).alias("spans"), F.col("body").alias("kept"))
    return hit.unionAll(whole)


ARROW = pa.schema([("kind", pa.int8()), *((c, pa.int64()) for c in FIELDS[1:6]), ("bytes", pa.binary())])
SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def cut(data: bytes, runs: list[int] | None) -> tuple[list[dict], bytes]:
    """Maximal removed runs and what is left; ``runs`` hold begin << 31 | length."""
    if not runs:
        return [], data
    spans: list[list[int]] = []
    for run in sorted(runs):
        begin, end = run >> 31, (run >> 31) + (run & (2**31 - 1))
        if spans and begin <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([begin, end])
    kept = [data[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(b for b, _ in spans), len(data)], strict=True)]
    return [{"begin": b, "end": e} for b, e in spans], b"".join(kept)
