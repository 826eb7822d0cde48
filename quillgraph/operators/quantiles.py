"""Exact percentiles of groups of any size, by distributed selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.tables import Scratch, meet

#: Bits of a value that a round of selection settles: a group has at most 2^BITS buckets in it.
BITS = 16
#: Distinct values of a bucket that are ranked at once.
FEW = 1 << BITS


def order_bits(values: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles, NaN last; -0.0 and 0.0 differ, all NaN are one."""
    bits = np.where(np.isnan(values), np.nan, values).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def percentile(rows: DataFrame, key: str, value: str, fraction: float) -> DataFrame:
    """(key, bar): for each key the percentile of its values, linear between the two ranks around it.

    Distinct values are counted, before they are shuffled, and written with their bits in the order of values. A round
    counts each group's values by the next BITS of these, finds the two buckets that hold the
    two ranks, and goes on inside them; once a bucket has at most FEW distinct values they are ranked directly. So
    no task holds more than 2^BITS rows of a group, however large it is, and four rounds settle all 64 bits.

    Null values and null keys take no part; NaN is the largest value.
    """
    scratch = Scratch(rows.sparkSession)

    def with_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order_bits(batch.column(1).to_numpy(zero_copy_only=False)))], names=["key", "value", "n", "bits"])

    kind = rows.schema[key].dataType.simpleString()
    counted = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(key).alias("key"), F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    held = scratch.keep(counted.mapInArrow(with_bits, f"key {kind}, value double, n long, bits long"), "values")
    at = (F.col("total") - 1) * F.lit(float(fraction))
    sides = F.explode(F.array(F.struct(F.lit("low").alias("side"), F.floor(at).alias("rank")), F.struct(F.lit("high").alias("side"), F.ceil(at).alias("rank"))))
    state = held.groupBy("key").agg(F.sum("n").alias("total")).select("key", (at - F.floor(at)).alias("share"), sides.alias("s")).select("key", "share", "s.*").withColumn("prefix", F.lit(0).cast("long"))
    inside = held.withColumn("prefix", F.lit(0).cast("long"))
    for shift in range(64 - BITS, -1, -BITS):
        counts = inside.groupBy("key", "prefix", F.shiftright("bits", shift).alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("differ"))
        state = scratch.keep(_chosen(counts, state, "bucket").select("key", "share", "side", "rank", F.col("bucket").alias("prefix"), "differ"), "buckets")
        buckets = state.select("key", "prefix").distinct()
        inside = meet(held.withColumn("prefix", F.shiftright("bits", shift)), buckets, ["key", "prefix"])
        if (state.agg(F.max("differ")).first()[0] or 0) <= FEW:
            break
        inside = scratch.keep(inside, "inside")
    ends = _chosen(inside, state, "bits").groupBy("key", "share").agg(*(F.max(F.when(F.col("side") == side, F.col("value"))).alias(side) for side in ("low", "high")))
    low, high = F.col("low"), F.col("high")
    return ends.select(F.col("key").alias(key), F.when(low == high, low).otherwise(low + (high - low) * F.col("share")).alias("bar"))


def _chosen(counts: DataFrame, state: DataFrame, order: str) -> DataFrame:
    """The rows of counts in which the state's ranks fall, with what is left of the rank."""
    before = F.sum("n").over(Window.partitionBy("key", "prefix").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    met = counts.withColumn("before", before).join(state.select("key", "share", "side", "rank", "prefix"), ["key", "prefix"])
    return met.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))).withColumn("rank", F.col("rank") - F.col("before"))
