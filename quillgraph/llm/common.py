"""What the corpus operators share: scratch tables, joins that withstand hot
keys; connected components are the library's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import tables
from quillgraph.operators.graph import components as components

#: ASCII white space as the contracts define it: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A key with more than this share of all rows, and more than HOT_ROWS, is joined by broadcast: at most 1 / HOT_SHARE keys, some MB.
HOT_SHARE, HOT_ROWS = 1e-5, 1000


def long_texts(spark: SparkSession) -> None:
    """Fewer rows to an Arrow batch than the session's default, as rows are whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


class Scratch(tables.Scratch):
    """Written tables, in a session that is ready for long texts."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark)
        long_texts(spark)


def quoted(columns: list[str]) -> list[str]:
    """Column names as references, whatever characters they hold."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for added columns that none of ``df`` has, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def hash128(c: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a string; together they stand for it."""
    return F.xxhash64(c), F.xxhash64(F.lit(1), c)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, spread: Column) -> DataFrame:
    """Left join of many rows to one table row for each key, safe under hot keys.

    ``count`` holds how many of ``total`` rows have the table row's key. Keys
    above HOT_SHARE of the rows, at most 1 / HOT_SHARE of them, go out by
    broadcast; their rows are dealt by ``spread`` in the shuffle join for the
    rest. Of 10^11 rows a key
    is hot from a million on.
    """
    limit = max(HOT_ROWS, int(total * HOT_SHARE))
    values = [c for c in table.columns if c not in keys]
    hot = table.where(F.col(count) > limit).select(*keys, *(F.col(c).alias(f"hot_{c}") for c in values), F.lit(True).alias("is_hot"))
    cold = table.where(F.col(count) <= limit).select(*(F.col(k).alias(f"cold_{k}") for k in keys), *(F.col(c).alias(f"cold_{c}") for c in values))
    out = rows.join(F.broadcast(hot), keys, "left")
    first, rest = keys[0], keys[1:]
    out = out.withColumn("deal", F.when(F.col("is_hot"), spread.cast(rows.schema[first].dataType)).otherwise(F.col(first)))
    on = [F.col("deal") == F.col(f"cold_{first}"), *(F.col(k) == F.col(f"cold_{k}") for k in rest), F.col("is_hot").isNull()]
    for c in on[1:]:
        on[0] = on[0] & c
    out = out.join(cold, on[0], "left")
    return out.select(*rows.columns, *(F.coalesce(f"hot_{c}", f"cold_{c}").alias(c) for c in values))
