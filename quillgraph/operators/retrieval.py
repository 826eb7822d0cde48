"""Retrieval of context: chunks, nearest neighbours, pruning by similarity."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.arrays import cosine
from quillgraph.operators import balls, quantiles
from quillgraph.tables import Scratch, meet

# The retrieval budget and the chunks of the vector store.
CONTEXT_VOLUME, PERCENTILE, MIN_SIMILARITY = 150, 75, 0.5
CHUNK, OVERLAP = 650, 200
SEPARATORS = ("\n\n", "\n", " ", "")


def split_text(text: str, size: int = CHUNK, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters: cut at the first separator that occurs, pieces that
    are still too long by the next, and neighbouring pieces joined up again, each
    chunk beginning with at most ``overlap`` characters of the one before."""
    mark = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(mark) + 1 :]
    out: list[str] = []
    held: deque[str] = deque()
    width = 0  # of what is held, each piece with a mark behind it

    def flush() -> None:
        joined = mark.join(held).strip()
        if joined:
            out.append(joined)

    for piece in (p for p in (text.split(mark) if mark else list(text)) if p):
        if len(piece) > size and finer:
            flush()
            held.clear()
            width = 0
            out += split_text(piece, size, overlap, finer)
            continue
        if held and width + len(piece) > size:
            flush()
            while held and (width - len(mark) > overlap or width + len(piece) > size):
                width -= len(held.popleft()) + len(mark)
        held.append(piece)
        width += len(piece) + len(mark)
    flush()
    return out


def chunks(df: DataFrame, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Explodes a text into (chunk_no, chunk); a text without content gives no row."""

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: split_text(t, size, overlap) if t else [])

    return df.select("*", F.posexplode(F.pandas_udf(cut, "array<string>")(text)).alias("chunk_no", "chunk"))


def fixed_chunks(df: DataFrame, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Chunks at a fixed stride, by expressions alone."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.length(text) - overlap) / step).cast("int") - 1, F.lit(0)))
    return df.where(F.length(text) > 0).select("*", F.explode(starts).alias("chunk_no")).withColumn("chunk", F.substring(F.col(text), F.col("chunk_no") * step + 1, F.lit(size)))


def sentences(df: DataFrame, text: str) -> DataFrame:
    """Explodes a context into (sentence_no, sentence) at ". "."""
    return df.select("*", F.posexplode(F.split(text, r"\. ")).alias("sentence_no", "sentence"))


def nearest(queries: DataFrame, items: DataFrame, k: int, measure: str = "cosine", itself: bool = True) -> DataFrame:
    """The ``k`` items nearest each query: (query_id, item_id, score, rank), ties to the smaller id.

    Both have id and embedding. Without ``itself`` items with the query's own id are left out. The items are
    indexed by balls (``balls.build``); for several searches of the same items keep the index.
    """
    index = balls.build(items.select("id", "embedding"), k + (not itself), measure)
    return _searched(index, queries, items, k, itself)


def _searched(index: balls.Balls | None, queries: DataFrame, items: DataFrame, k: int, itself: bool = True) -> DataFrame:
    if index is not None:
        return balls.search(index, queries, k, itself)
    kinds = [df.schema["id"].dataType.simpleString() for df in (queries, items)]
    return queries.sparkSession.createDataFrame([], f"query_id {kinds[0]}, item_id {kinds[1]}, score double, rank int")


def prune(scored: DataFrame, key: str, similarity: str = "similarity", position: str = "position", percentile: float = PERCENTILE, minimum: float = MIN_SIMILARITY, cap: int = CONTEXT_VOLUME) -> DataFrame:
    """Rows of each key above its ``percentile`` (linear between ranks) and above ``minimum``, the
    most similar first, ties to the later position, at most ``cap``; adds rank."""
    bar = quantiles.percentile(scored, key, similarity, percentile / 100.0)
    kept = meet(scored, bar, [key]).where((F.col(similarity) > F.col("bar")) & (F.col(similarity) > minimum)).select(scored.columns)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(similarity), F.desc(position)))
    return kept.withColumn("rank", rank).where(F.col("rank") <= cap)


def join_context(pruned: DataFrame, key: str, text: str, separator: str = ". ") -> DataFrame:
    """(key, context): the kept sentences in rank order, each followed by the separator."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col(text).alias("t")))), lambda p: p["t"])
    return pruned.groupBy(key).agg(F.concat(F.array_join(parts, separator), F.lit(separator)).alias("context"))


def retrieve(questions: DataFrame, entities: DataFrame, store: DataFrame, contexts: DataFrame, embed, volume: int = CONTEXT_VOLUME, fallback_k: int = 5) -> DataFrame:
    """(question_id, context) for each question.

    questions: question_id, question; entities: question_id, entity; store: id,
    embedding (id is a node's name); contexts: node_name, node_context; ``embed``
    turns a text column into vectors. Contexts may come in pages (a column page): then a node has a row a page. Each entity finds its nearest node, a question
    without entities its ``fallback_k`` nearest; the nodes' sentences that are
    similar enough to the question, an equal share of ``volume`` for each
    node, make its context.
    """
    asked = questions.select("question_id", "question").withColumn("q", embed(F.col("question")))
    by_entity = entities.where(F.col("entity").isNotNull()).select("question_id", "entity").distinct()
    seeds = by_entity.select(F.col("entity").alias("id")).distinct().withColumn("embedding", embed(F.col("id")))
    index = balls.build(store.select("id", "embedding"), max(1, fallback_k))
    hits = _searched(index, seeds, store, 1).select(F.col("query_id").alias("entity"), F.col("item_id").alias("node_name"))
    named = by_entity.join(hits, "entity").select("question_id", "node_name")
    rest = asked.join(by_entity, "question_id", "left_anti").select(F.col("question_id").alias("id"), F.col("q").alias("embedding"))
    other = _searched(index, rest, store, fallback_k).select(F.col("query_id").alias("question_id"), F.col("item_id").alias("node_name"))
    nodes = named.unionAll(other).distinct()
    share = nodes.groupBy("question_id").agg(F.floor(F.lit(volume) / F.count("*")).alias("share"))
    page = F.col("page").cast("long") if "page" in contexts.columns else F.lit(0).cast("long")
    one = contexts.select("node_name", page.alias("page"), "node_context").groupBy("node_name", "page").agg(F.min("node_context").alias("node_context"))
    parts = sentences(nodes.join(one, "node_name"), "node_context").withColumn("sentence_no", F.shiftleft("page", 32) + F.col("sentence_no"))
    parts = parts.withColumn("s", embed(F.col("sentence"))).join(asked, "question_id")
    scored = parts.select(F.concat_ws("\x1f", "question_id", "node_name").alias("key"), "question_id", "node_name", "sentence", F.col("sentence_no").alias("position"), cosine(F.col("q"), F.col("s")).alias("similarity"))
    scored = Scratch(scored.sparkSession).keep(scored, "scored")  # the bars and what passes them are read from it: a sentence is embedded once
    kept = prune(scored, "key").join(share, "question_id").where(F.col("rank") <= F.col("share"))
    order = F.transform(F.sort_array(F.collect_list(F.struct("node_name", "rank", "sentence"))), lambda p: p["sentence"])
    return kept.groupBy("question_id").agg(F.concat(F.array_join(order, ". "), F.lit(". ")).alias("context"))


def explain(questions: DataFrame, entities: DataFrame, store: DataFrame, contexts: DataFrame, embed) -> dict[str, DataFrame]:
    """The steps of ``retrieve`` as tables, for looking at one by one."""
    seeds = entities.select(F.col("entity").alias("id")).distinct().withColumn("embedding", embed(F.col("id")))
    hits = nearest(seeds, store, 1)
    return {"entities": entities, "hits": hits, "contexts": contexts.join(hits.select(F.col("item_id").alias("node_name")).distinct(), "node_name", "left_semi"), "result": retrieve(questions, entities, store, contexts, embed)}


def parse_entities(response: Column) -> Column:
    """The "Diseases" list of a model's JSON answer; null if it is not such."""
    return F.from_json(response, "STRUCT<Diseases: ARRAY<STRING>>")["Diseases"]
