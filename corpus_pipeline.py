"""From raw documents to pieces: toxic documents go, shared lines stay once, one
document of each near-duplicate group stays, sources are mixed to their target
weights, and the mixed texts are encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of documents; n_chars is kept in step with text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import lines, mixing, pieces, simhash, toxicity
from quillgraph.llm.common import Scratch, fresh, quoted

#: A text with at least this score is taken to be toxic.
TOXIC = 0.3
MODEL = "piece_bpe_32k.model"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC; the model learns from labels that are not held out."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    [score] = fresh(docs, "score")
    return toxicity.score(docs, model, keep=tuple(docs.columns), score_col=score).where(F.col(score) < TOXIC).drop(score)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one holds; n_chars is counted again."""
    out = lines.dedup_lines(docs).select(*quoted(docs.columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (met by SimHashes, then held to a similarity of 0.8
    of their five-word shingles): the one with the smallest id, null last. Rows
    are told apart by a number that they are written with, so null ids and shared
    ids join no groups."""
    row, key, own = fresh(docs, "_row", "_key", "_own")
    numbered = Scratch(spark).keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.col(row).alias("row"))
    groups = simhash.near_copies(numbered.withColumn(key, order), id_col=key)
    first = groups.where("id = component").select(F.col("id.row").alias(own))
    return numbered.join(first.hint("shuffle_hash"), F.col(row) == F.col(own), "left_semi").select(*quoted(docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them whole: up to three times, or not at all."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with the ids of the best segmentation, its score and what
    differs in the next three."""
    out = pieces.encode(docs, public_tokenizers.path(MODEL), scores="rank", keep=("doc_id", "lang", "source"))
    return out.withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Neither the SVM nor SimHash's hash can be said in DuckDB's SQL; tests/llm holds the operators to brute force, and run() to its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each but the last is written before the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
