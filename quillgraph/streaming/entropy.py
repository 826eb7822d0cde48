"""Structural entropy kept up to date over a stream of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.operators.entropy import degrees


class EntropyState:
    """Degrees as a base and what batches added to it, and a row (nodes, volume, s, entropy)
    for each batch: H = log2 V - S / V with S the sum of d log2 d.

    A batch looks up the degrees of the nodes it touches, in those of the base's
    ``buckets`` that hold such nodes and in the additions since, and changes V
    and S by their terms; it writes its additions and its row under its own number, so a batch
    that is tried again overwrites what it began. Every ``compact`` batches the
    additions before are summed into a new base and V and S from it, so no more than
    that many are ever read and rounding does not build up; what a
    base replaces is deleted a batch later.
    """

    def __init__(self, path: str, compact: int = 64, buckets: int = 256):
        if compact < 2:
            raise ValueError("compact must be at least 2")
        self.path, self.compact, self.buckets = path.rstrip("/"), compact, buckets

    def _base(self, batch: int) -> int:
        return batch // self.compact * self.compact

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("node"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _known(self, spark, batch: int, buckets: list[int] | None = None) -> DataFrame:
        """(node, degree) rows whose sums are the degrees before ``batch``, those of ``buckets`` at least."""
        base = self._base(batch)
        out = spark.createDataFrame([], "node string, degree double")
        if base:
            old = spark.read.schema("node string, degree double, bucket int").parquet(f"{self.path}/base={base}")
            out = (old if buckets is None else old.where(F.col("bucket").isin(buckets))).select("node", "degree")
        added = [f"{self.path}/added/batch={i}" for i in range(base, batch)]
        return out.unionAll(spark.read.schema("node string, degree double").parquet(*added)) if added else out

    def degrees(self, spark, batch: int) -> DataFrame:
        """(node, degree) after ``batch``; the last batch, and earlier ones since the last base, can be asked for."""
        last = self._known(spark, batch).unionAll(spark.read.schema("node string, degree double").parquet(f"{self.path}/added/batch={batch}"))
        return last.groupBy("node").agg(F.sum("degree").alias("degree"))

    def update(self, edges: DataFrame, batch: int) -> None:
        spark, base = edges.sparkSession, self._base(batch)
        if batch and batch == base:
            before = self._known_before(spark, batch).groupBy("node").agg(F.sum("degree").alias("degree"))
            before.select("node", "degree", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base={batch}")
        degrees(edges).write.mode("overwrite").parquet(f"{self.path}/added/batch={batch}")
        more = spark.read.schema("node string, degree double").parquet(f"{self.path}/added/batch={batch}").withColumnRenamed("degree", "more")
        touched = [r.bucket for r in more.select(self._bucket()).distinct().collect()]  # at most ``buckets`` numbers
        known = self._known(spark, batch, touched).join(more.select("node"), "node", "left_semi").groupBy("node").agg(F.sum("degree").alias("degree"))
        term = lambda d: F.when(d > 0, d * F.log2(d)).otherwise(0.0)
        old, new = F.coalesce("degree", F.lit(0.0)), F.coalesce("degree", F.lit(0.0)) + F.col("more")
        total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
        change = more.join(known, "node", "left").agg(F.count_if(F.col("degree").isNull()).alias("dn"), total(F.col("more")).alias("dv"), total(term(new) - term(old)).alias("ds"))
        if batch == base:
            whole = self._known(spark, batch).agg(F.count("*").alias("n"), total(F.col("degree")).alias("v"), total(term(F.col("degree"))).alias("t"))
        else:
            whole = spark.read.parquet(f"{self.path}/entropy/batch={batch - 1}").select(F.col("nodes").alias("n"), F.col("volume").alias("v"), F.col("s").alias("t"))
        now = whole.crossJoin(F.broadcast(change)).select((F.col("n") + F.col("dn")).alias("nodes"), (F.col("v") + F.col("dv")).alias("volume"), (F.col("t") + F.col("ds")).alias("s"))  # a row each
        entropy = F.when(F.col("volume") > 0, F.log2("volume") - F.col("s") / F.col("volume")).otherwise(0.0)
        now.withColumn("entropy", entropy).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/entropy/batch={batch}")
        if base and batch == base + 1:
            self._forget(spark, base)

    def _known_before(self, spark, base: int) -> DataFrame:
        """What a new base sums: the base before it and all additions since."""
        old = base - self.compact
        added = spark.read.schema("node string, degree double").parquet(*(f"{self.path}/added/batch={i}" for i in range(old, base)))
        if not old:
            return added
        return spark.read.schema("node string, degree double, bucket int").parquet(f"{self.path}/base={old}").select("node", "degree").unionAll(added)

    def _forget(self, spark, base: int) -> None:
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        old = base - self.compact
        for name in [f"base={old}", *(f"added/batch={i}" for i in range(old, base))]:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(conf).delete(path, True)

    def history(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.path}/entropy")


def maintain(edges: DataFrame, state: EntropyState, checkpoint: str, **trigger) -> StreamingQuery:
    """Runs the state over a stream of (source, edge_type, target, weight)."""
    return edges.writeStream.foreachBatch(state.update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
