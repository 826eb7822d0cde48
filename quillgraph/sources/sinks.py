"""Writers. Each is one distributed write; none gathers rows on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def by_seed(triples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder for each seed; partition names are encoded, so any name will do."""
    triples.write.mode(mode).partitionBy("seed").option("header", True).csv(path)


def triples_csv(triples: DataFrame, path: str, mode: str = "overwrite") -> None:
    triples.select("source", "edge_type", "target", "weight").write.mode(mode).option("header", True).option("escape", '"').csv(path)


def triples_tsv(triples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Four fields, which sources.files.triples_tsv reads back."""
    triples.select("source", "edge_type", "target", "weight").write.mode(mode).option("sep", "\t").csv(path)


def samples(df: DataFrame, path: str) -> None:
    """Appends samples as JSON lines in UTF-8."""
    df.write.mode("append").json(path)


def results(predictions: DataFrame, path: str, mode: str = "overwrite") -> None:
    """All responses, and apart those without an option."""
    invalid = F.col("extracted").isNull()
    predictions.write.mode(mode).option("ignoreNullFields", False).json(f"{path}_all_responses")
    predictions.where(invalid).write.mode(mode).option("ignoreNullFields", False).json(f"{path}_invalid_responses")


def json_to_lines(spark: SparkSession, source: str, target: str, mode: str = "overwrite") -> None:
    spark.read.option("multiLine", True).json(source).write.mode(mode).json(target)


def parquet_to_json(spark: SparkSession, source: str, target: str, mode: str = "overwrite") -> None:
    spark.read.parquet(source).write.mode(mode).json(target)


def vectors(documents: DataFrame, path: str, embedding: Column, batch: int = 200, mode: str = "append") -> None:
    """Documents with their embedding, ``batch`` rows to an Arrow batch of the embedder."""
    spark, key = documents.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    try:
        documents.withColumn("id", F.sha2("page_content", 256)).withColumn("embedding", embedding).write.mode(mode).parquet(path)
    finally:
        spark.conf.set(key, before)


def cached(df: DataFrame, folder: str, *config: object) -> DataFrame:
    """``df`` as written once under a key of its configuration, and read back ever after."""
    import hashlib

    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/{hashlib.sha256(repr(config).encode()).hexdigest()[:32]}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
