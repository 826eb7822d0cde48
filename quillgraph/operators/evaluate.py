"""Scoring of answers: routing to the right reader, accuracy, reports, running statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.extract import extract_by, with_options

# The options of each benchmark family, tried in this order on a benchmark's name.
ROUTES = (("pubmedqa", None), ("mmlu", "a-dA-D"), ("medmcqa", "a-dA-D"), ("medqa", "a-dA-D"), ("medexpqa", "a-eA-E"), ("usmle", "a-jA-J"))


def route(benchmark: Column) -> Column:
    """The family a benchmark's name belongs to, null if none."""
    out = F.lit(None).cast("string")
    for name, _ in reversed(ROUTES):
        out = F.when(F.contains(F.lower(benchmark), F.lit(name)), name).otherwise(out)
    return out


def predict(items: DataFrame, responses: DataFrame) -> DataFrame:
    """Joins (item_id, benchmark, prompt, answer) and (item_id, output) and adds extracted:
    the option found in the output, or else in the output with options' texts named."""
    rows = items.join(responses, "item_id", "left").withColumn("family", route(F.col("benchmark")))
    named = with_options(F.col("prompt"), F.col("output"))
    rows = rows.withColumn("_first", extract_by(F.col("output"), F.col("family"), dict(ROUTES)))
    rows = rows.withColumn("_named", F.when(F.col("_first").isNull(), named))
    again = extract_by(F.col("_named"), F.col("family"), {name: options for name, options in ROUTES if options is not None})
    return rows.withColumn("extracted", F.coalesce("_first", again)).drop("_first", "_named")


def accuracy(predictions: DataFrame, *keys: str) -> DataFrame:
    """(keys, total, invalid, accuracy): an answer without a prediction is wrong; null accuracy if there are none."""
    right = F.coalesce((F.col("extracted") == F.col("answer")).cast("double"), F.lit(0.0))
    return predictions.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("extracted").isNull()).alias("invalid"), F.avg(right).alias("accuracy"))


def cumulative_accuracy(predictions: DataFrame, file: str) -> DataFrame:
    """(file, total, accuracy) over each file and all before it, in order of file name."""
    right = F.coalesce((F.col("extracted") == F.col("answer")).cast("long"), F.lit(0))
    each = predictions.groupBy(file).agg(F.count("*").alias("n"), F.sum(right).alias("r"))
    until = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, 0)  # one row a file
    return each.select(file, F.sum("n").over(until).alias("total"), (F.sum("r").over(until) / F.sum("n").over(until)).alias("accuracy"))


def running_mean(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    return df.withColumn("running_mean", F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def recent_mean(df: DataFrame, keys: list[str], order: str, value: str, rows: int = 20) -> DataFrame:
    return df.withColumn("recent_mean", F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - rows, 0)))


def exponential_mean(df: DataFrame, keys: list[str], order: str, value: str, alpha: float = 0.9) -> DataFrame:
    """(keys, ema): alpha * before + (1 - alpha) * value along each key's order, from its first value."""
    values = F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda r: r[value])
    series = df.groupBy(*keys).agg(values.alias("v"))
    ema = F.aggregate(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))), F.get("v", F.lit(0)).cast("double"), lambda s, x: alpha * s + (1 - alpha) * x)
    return series.select(*keys, ema.alias("ema"))
