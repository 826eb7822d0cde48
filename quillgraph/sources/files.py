"""Readers. All take explicit schemas; quoted fields may hold line breaks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import schema as S
from quillgraph.schema import conform

QUOTED = {"multiLine": True, "escape": '"'}


def csv(spark: SparkSession, path: str | list[str], schema: str, header: bool = True, sep: str = ",") -> DataFrame:
    """CSV by a schema. With a header, columns are found by name and missing ones are null. Text such
    as NA or None stays text."""
    reader = spark.read.options(**QUOTED, sep=sep)
    if header:
        return conform(reader.option("header", True).csv(path), schema)
    return reader.schema(schema).csv(path)


def csv_folder(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """All CSV files of a folder, with their file's name."""
    reader = spark.read.options(**QUOTED, header=header)
    df = reader.csv(path) if header else reader.schema(schema).csv(path)
    named = df.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return conform(named, schema + ", file STRING") if header else named


def mmlu(spark: SparkSession, path: str) -> DataFrame:
    """Positional, headerless files of question, A to D, answer."""
    return csv_folder(spark, path, S.MMLU, header=False)


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """.jsonl: a record a line; .json: a list of records or one record; other extensions are an error."""
    if path.endswith(".jsonl"):
        return spark.read.schema(schema).json(path)
    if path.endswith(".json"):
        return spark.read.schema(schema).option("multiLine", True).json(path)
    raise ValueError(f"neither .json nor .jsonl: {path}")


def json_object(spark: SparkSession, path: str, value: str = "STRUCT<QUESTION: STRING, CONTEXTS: ARRAY<STRING>, final_decision: STRING>") -> DataFrame:
    """One JSON object of records by id, as rows with id."""
    whole = spark.read.text(path, wholetext=True)
    entry = whole.select(F.explode(F.from_json("value", f"MAP<STRING, {value}>")).alias("id", "record"))
    return entry.select("id", "record.*")


def json_lines_head(spark: SparkSession, path: str, schema: str, n: int | None = None, one_more: bool = False) -> DataFrame:
    """The first ``n`` lines' records, files in order of their names; blank lines count as lines but give
    no record. ``one_more`` takes n + 1, as the reader of MedQA does, which stops behind line n counted from 0."""
    lines = spark.read.text(path)
    if n is not None:
        place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
        lines = lines.select("value", F.struct(*(c.alias(f"k{i}") for i, c in enumerate(place))).alias("place")).orderBy("place").limit(n + one_more)
    return lines.where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def gpqa(spark: SparkSession, path: str, subdomain: str | None = None) -> DataFrame:
    """Questions with their correct and incorrect answers, those of one subdomain if it is named."""
    questions = csv(spark, path, S.GPQA)
    return questions if subdomain is None else questions.where(F.col("Subdomain") == subdomain)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def triples_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Triples of three tab-separated fields, or four with a weight."""
    return spark.read.schema(S.TRIPLES).option("sep", "\t").csv(path)


def triples_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Triples with a header; the weight column is optional."""
    return csv(spark, path, S.TRIPLES)


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """Distinct names of a seed list, without nulls."""
    return csv(spark, path, S.SEEDS).na.drop(subset=["disease_name"]).select(F.col("disease_name").alias("seed")).distinct()


def entity_names(spark: SparkSession, path: str, note: str = " from SPOKE knowledge graph") -> DataFrame:
    """One entity a line, as (page_content, metadata) documents. Pickles are not read: unpickling runs code."""
    name = F.col("value").alias("page_content")
    return spark.read.text(path).where(F.trim("value") != "").select(name, F.create_map(F.lit("source"), F.concat("value", F.lit(note))).alias("metadata"))


def vector_store(spark: SparkSession, path: str) -> DataFrame:
    """id, page_content, metadata and embedding of a store written by sinks.vectors."""
    return spark.read.parquet(path)


def config(path: str) -> dict:
    """A YAML file's values."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


@dataclass(frozen=True)
class Dataset:
    """A named fine-tuning set: where prompt, chosen and rejected come from, and their wrapping."""

    kind: str
    prompt: str = "prompt"
    chosen: str | None = "chosen"
    rejected: str | None = "rejected"
    before: str = ""
    after: str = ""


# The names of the datasets and what their prompts are wrapped in. "RM2/v1" has no reader
# of its own anywhere; here it reads like its siblings.
WRAPPED = {"before": "<|startofpiece|> ", "after": " <|endofpiece|> "}
DATASETS = {
    "SFT/v921": Dataset("sft"),
    "SFT/v916": Dataset("sft"),
    "SFT/v925": Dataset("sft"),
    "SFT/belle": Dataset("sft"),
    "PPO2/v1": Dataset("ppo", prompt="input", chosen=None, rejected=None, **WRAPPED),
    "RM2/v1": Dataset("rm", **WRAPPED),
    "RM2/v2": Dataset("rm", **WRAPPED),
    "RM2/v3": Dataset("rm", **WRAPPED),
    "RM2/v4": Dataset("rm", **WRAPPED),
}


def dataset(spark: SparkSession, name: str, folder: str, part: str = "train") -> DataFrame:
    """The records of a named dataset's JSON lines in ``folder``/``part``.json. ``name`` may be a path that holds a known name."""
    known = next((d for n, d in DATASETS.items() if n in name), None)
    if known is None:
        raise ValueError(f"unknown dataset: {name}")
    return map_records(spark.read.json(f"{folder}/{part}.json"), known)


def map_records(df: DataFrame, d: Dataset) -> DataFrame:
    """prompt, chosen, rejected, and the prompt with either answer; null where a column is missing or null."""
    column = lambda c: F.col(c) if c and c in df.columns else F.lit(None).cast("string")
    prompt = F.concat(F.lit(d.before), column(d.prompt), F.lit(d.after))
    out = df.select(prompt.alias("prompt"), column(d.chosen).alias("chosen"), column(d.rejected).alias("rejected"))
    return out.withColumns({"prompt_and_chosen": F.concat("prompt", "chosen"), "prompt_and_rejected": F.concat("prompt", "rejected")})
