"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import Scratch, fresh, lookup, quoted
from quillgraph.tables import places

WAYS = 16  # divisors that one pass over the shards tries


def shares(sources: DataFrame, total: float, cap: float) -> DataFrame:
    """Adds target to (size, weight): shares of ``total`` by weight, none above ``cap`` times
    the size; the excess is shared again by weight until none is above. If all reach
    their cap, less than ``total`` is given out. The driver sees two sums a round."""
    most = F.col("size") * F.lit(cap)
    unit = 0.0
    while True:
        over = F.lit(unit) * F.col("weight") > most if unit else F.lit(False)
        used, weight = sources.agg(F.coalesce(F.sum(F.when(over, most)), F.lit(0)).cast("double"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).cast("double")).first()
        new = max(0.0, total - used) / weight if weight else unit
        if new <= unit:
            break
        unit = new
    return sources.withColumn("target", F.least(F.lit(unit) * F.col("weight"), most.cast("double")))


def sainte_lague(entries: DataFrame, seats: dict[int, int], order: list[Column]) -> DataFrame:
    """Adds won to entries of (board, vote, most): the ``seats`` of each board (a small
    number of boards) go to its entries by highest quotients vote / (2 s + 1),
    none above its ``most``; ties go by ``order``.

    Each pass sums, for WAYS divisors between bounds, the seats that they would
    give; the driver sees these sums only. Once the bounds are so close that no
    entry's seats differ by more than one, the seats left open go one each to the
    highest next quotients.
    """
    spark, scratch = entries.sparkSession, Scratch(entries.sparkSession)
    given = lambda d: F.least(F.col("most").cast("double"), F.floor(F.col("vote") / d + 0.5).cast("double"))
    bids = entries.where("vote > 0 and most > 0")
    facts = bids.groupBy("board").agg(F.sum("vote").alias("v"), F.max("vote").alias("top"), F.count("*").alias("n"), F.sum("most").alias("room")).collect()
    goal = {r["board"]: min(seats.get(r["board"], 0), r["room"]) for r in facts}
    low, high = {r["board"]: 0.0 for r in facts}, {r["board"]: 2.0 * r["top"] * (1 + 1e-9) for r in facts}
    top = {r["board"]: r["top"] for r in facts}
    short = dict(goal)  # seats that the upper bound leaves open
    tried = [(r["board"], d) for r in facts for n in [r["n"]] for d in (r["v"] / (goal[r["board"]] + n), r["v"] / max(goal[r["board"]] - n, 0.5)) if short[r["board"]]]
    while tried:
        sums = bids.join(F.broadcast(spark.createDataFrame(tried, "board int, d double")), "board").groupBy("board", "d").agg(F.sum(given(F.col("d"))).alias("s"))
        for b, d, s in sums.collect():
            if s > goal[b]:
                low[b] = max(low[b], d)
            elif d < high[b]:
                high[b], short[b] = d, goal[b] - int(s)
        tried = [(b, d) for b in {b for b, _ in tried} if short[b] and (not low[b] or top[b] / low[b] - top[b] / high[b] >= 1) for d in np.unique(np.linspace(low[b], high[b], WAYS + 2)).tolist() if low[b] < d < high[b]]
    bounds = F.broadcast(spark.createDataFrame([(b, low[b] or high[b], high[b], short[b]) for b in goal], "board int, low double, high double, short long"))
    ahead = F.when((F.col("vote") > 0) & (F.col("most") > 0), given(F.col("high")))
    won = scratch.keep(entries.join(bounds, "board", "left").withColumn("won", F.coalesce(ahead, F.lit(0.0)).cast("long")), "won")
    names = [*entries.columns, "won"]
    if not any(short.values()):
        return won.select(names)
    open_ = won.where("vote > 0 and won < most and short > 0").where(given(F.col("low")) > F.col("won"))
    placed = scratch.keep(places(open_, [F.col("board"), F.desc(F.col("vote") / (2 * F.col("won") + 1)), *order]), "open")
    before = F.broadcast(placed.groupBy("board").agg(F.min("place").alias("before")))
    extra = placed.join(before, "board").where("place - before < short").withColumn("won", F.col("won") + 1)
    return won.select(names).unionAll(extra.select(names)).groupBy(*entries.columns).agg(F.max("won").alias("won"))


def chosen(blocks: int, number: int, seed: int, shard: int) -> np.ndarray:
    """Which of ``blocks`` a shard takes once more: ``number`` of them, by a seeded permutation."""
    out = np.zeros(blocks, bool)
    out[np.random.default_rng([seed, shard % 2**64]).permutation(blocks)[:number]] = True
    return out


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), cap: int = 3, total_share: float = 1.0,
    block_words: int = 64, seed: int = 7, shard_docs: int = 4096, key_col: str | None = None,
) -> DataFrame:
    """Takes words from each source towards its target, repeating none beyond ``cap`` times.

    A document's size is its number of words. Sources, by code point and null
    last, weigh ``weights`` in turn and share ``total_share`` of all words. A
    source's documents are dealt by a seeded hash to shards of about ``shard_docs``
    (more once there are 65,536 shards), so no source, however large, is in one
    task. A shard's blocks have ``block_words`` words, or, where it would have under
    64 blocks, the power of two below with which it has as many, down to single
    words. All blocks of a size go by Sainte-Lague to the shards of all sources,
    so each source is taken to within a block a shard of its target. In a shard
    documents lie in seeded order, cut into blocks; its quota is whole passes
    plus a seeded choice of blocks.

    Returns (id, source, size, source_size, target, taken, copies): ``taken``
    counts words, repeats too, and ``copies`` whole documents (a document
    counts when the block of its first word is taken). Nothing that grows with
    the number of sources or shards is collected or broadcast. Null, empty and blank texts have size 0 and
    nothing is taken from them; a source of size 0 has target 0. Null ids and
    repeated rows are documents like others; equal rows may swap places, which
    no result shows. An empty table gives an empty result. ``key_col`` names a
    key of the rows, which is returned as a last column ``key``.
    """
    scratch = Scratch(docs.sparkSession)
    key = [] if key_col is None else [F.col(key_col).alias("key")]
    size = F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("at"), size.alias("size"),
        F.xxhash64(F.lit(seed), id_col, F.xxhash64(text_col)).alias("h"), *key,
    )
    rows = scratch.keep(rows, "sizes")
    sources = scratch.keep(rows.groupBy("at", "source").agg(F.count("*").alias("n"), F.sum("size").alias("size")), "sources")
    n_docs, total = sources.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    per_shard = max(shard_docs, -(-n_docs // 65536))
    weight = F.array(*(F.lit(float(w)) for w in weights))[F.pmod("place", F.lit(len(weights))).cast("int")]
    sources = places(sources, [F.col("source").isNull(), F.encode("source", "UTF-8")]).withColumn("weight", weight)
    sources = scratch.keep(shares(sources, total * total_share, cap).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("n") / per_shard))), "targets")
    plan = sources.select("at", "n", F.col("size").alias("source_size"), "target", "shards")
    dealt = lookup(rows, plan, ["at"], "n", n_docs, F.xxhash64("h"))
    dealt = dealt.withColumn("shard", F.xxhash64("at", F.pmod(F.xxhash64("h"), F.col("shards"))))
    shards = dealt.groupBy("at", "shard").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target")).where("words > 0")
    block = F.least(F.lit(block_words), F.greatest(F.lit(1), F.pow(F.lit(2.0), F.floor(F.log2(F.col("words") / 64))))).cast("int")
    shards = shards.withColumn("board", block).withColumn("vote", F.col("target") * F.col("words") / F.col("source_size"))
    shards = scratch.keep(shards.select("at", "shard", "words", "board", "vote", F.ceil(cap * F.col("words") / F.col("board")).alias("most")), "shards")
    seats = {r["board"]: round(r["v"] / r["board"]) for r in shards.groupBy("board").agg(F.sum("vote").alias("v")).collect()}
    quotas = sainte_lague(shards, seats, [F.col("at"), F.col("shard")])
    quotas = quotas.select(F.col("shard").alias("own"), F.least(F.col("words") * cap, F.col("won") * F.col("board")).alias("quota"), F.col("board").alias("block"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = dealt.join(quotas, F.col("shard") == F.col("own"), "left").drop("own", "at", "n", "shards")
    names = ["id", "source", "size", "source_size", "target", "taken", "copies", *(["key"] if key else [])]
    kind = {"source_size": "bigint", "target": "double", "taken": "bigint", "copies": "bigint"} | kinds

    def take(table: pa.Table) -> pa.Table:
        """One shard."""
        table = table.sort_by([(c, "ascending") for c in ("h", "size", "key") if c in table.column_names])
        sizes = table.column("size").to_numpy()
        quota, block = (table.column(c)[0].as_py() or 0 for c in ("quota", "block"))
        end, n = np.cumsum(sizes), int(sizes.sum())
        taken = copies = np.zeros(len(sizes), np.int64)
        if quota:
            passes, blocks = quota // n, -(-n // block)
            on = chosen(blocks, quota % n // block, seed, table.column("shard")[0].as_py())
            words = np.diff(np.minimum(np.arange(blocks + 1) * block, n)) * on
            before = np.concatenate(([0], np.cumsum(words)))
            upto = lambda x: before[x // block] + on[np.minimum(x // block, blocks - 1)] * (x % block)
            taken = np.where(sizes > 0, passes * sizes + upto(end) - upto(end - sizes), 0)
            copies = np.where(sizes > 0, passes + on[np.minimum((end - sizes) // block, blocks - 1)], 0)
        return table.append_column("taken", pa.array(taken)).append_column("copies", pa.array(copies, pa.int64())).select(names)

    return out.groupBy("shard").applyInArrow(take, ", ".join(f"{c} {kind[c]}" for c in names))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it whole; rows it
    does not take go. Options as for ``mix``. Rows are told apart by a number that
    they are written with, so null ids and shared ids are like others.
    """
    row, own, copies, copy = fresh(docs, "_row", "_own", "_copies", "_copy")
    numbered = Scratch(docs.sparkSession).keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    taken = mix(numbered, id_col=id_col, text_col=text_col, key_col=row, **options).where("copies > 0").select(F.col("key").alias(own), F.col("copies").alias(copies))
    joined = numbered.join(taken.hint("shuffle_hash"), F.col(row) == F.col(own))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*quoted(docs.columns))
