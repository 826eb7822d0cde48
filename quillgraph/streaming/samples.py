"""Samples that arrive as files, filtered and appended as conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph import schema as S
from quillgraph.operators.sft import clean_answer, clean_question, conversation, is_entity


def conversations(samples: DataFrame) -> DataFrame:
    """Samples whose answer is an entity, as one session each."""
    return samples.where(is_entity(F.col("Answer"))).select(conversation(clean_question(F.col("Question")), clean_answer(F.col("Answer"))).alias("content"))


def append(spark: SparkSession, source: str, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Reads new JSON lines under ``source`` and appends sessions under ``target``."""
    rows = conversations(spark.readStream.schema(S.SAMPLES).json(source))
    return rows.writeStream.format("json").option("path", target).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
