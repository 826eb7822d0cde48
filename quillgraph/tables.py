"""Tables written on the way, and places in a global order that need no single task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Into so many parts a key's rows are dealt when they meet the key's few rows in a table.
SALTS = 16

#: Rows of a table that may go by broadcast where they are counted: some MB.
SENT = 20_000


class Scratch:
    """Tables written to the shared folder that ``spark.checkpoint.dir`` names.

    A written table cuts lineage and outlives lost executors. A session in
    local mode that has no such setting gets a temporary folder; on a cluster
    the setting is required.
    """

    _local: str | None = None

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", "") or ""
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            if Scratch._local is None:
                Scratch._local = tempfile.mkdtemp(prefix="quillgraph-")
                atexit.register(shutil.rmtree, Scratch._local, ignore_errors=True)
            base = f"file://{Scratch._local}"
        self.base = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Writes ``df`` and returns it as read back."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that ``keep`` returned and that nothing will read again."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(conf).delete(path, True)


#: Bits of a row's place in monotonically_increasing_id; above them is its partition.
PLACE_BITS = 33


def places(df: DataFrame, order: list[Column], place: str = "place", size: Column | None = None) -> DataFrame:
    """Adds each row's place (from 0) in ``order``, or with ``size`` the sum of the sizes before it.

    The sorted rows are written once, as a sort that runs again may cut its
    partitions elsewhere. Sums are taken as the sort's partitions go by, so no row is shuffled again; only
    one sum for each of these comes to the driver and goes out again.
    """
    spark = df.sparkSession
    rows = df.sort(*order) if size is None else df.withColumn("_size", F.coalesce(size.cast("long"), F.lit(0).cast("long"))).sort(*order)
    rows = rows.withColumn("_m", F.monotonically_increasing_id())
    if size is not None:
        rows = rows.mapInArrow(_sums_before, StructType([*rows.schema.fields, StructField("_b", LongType())]))
    rows = Scratch(spark).keep(rows, "sorted").withColumn("_p", F.shiftright("_m", PLACE_BITS))
    known, _ = _begun(rows, F.count("*") if size is None else F.sum("_size"))
    before = _in_partition() if size is None else F.col("_b")
    return rows.join(known, "_p").withColumn(place, F.col("_o") + before).drop("_p", "_o", "_b", "_m", "_size")


def _begun(rows: DataFrame, size: Column) -> tuple[DataFrame, int]:
    """(_p, _o), to be broadcast: the sum of ``size`` over all partitions before each; and over all."""
    total, offsets = 0, []
    for r in sorted(rows.groupBy("_p").agg(size.alias("s")).collect(), key=lambda r: r["_p"]):
        offsets.append((r["_p"], total))
        total += r["s"]
    return F.broadcast(rows.sparkSession.createDataFrame(offsets, "_p long, _o long")), total


def strung(df: DataFrame, order: list[Column], items: Column, least: int) -> tuple[DataFrame, int]:
    """(items, start) and the number of all items: arrays of rows that follow each other in ``order`` strung
    together to some ``least`` items a row, with the place of a row's first item among all. The arrays are made after the sort, so
    what they are made of is shuffled, once; they are written."""
    rows = df.sort(*order).select(items.alias("items"))
    kind = StructType([rows.schema["items"], StructField("_size", LongType()), StructField("_b", LongType())])
    rows = Scratch(df.sparkSession).keep(rows.mapInArrow(_string(least), kind).withColumn("_p", F.spark_partition_id().cast("long")), "strung")
    known, total = _begun(rows, F.sum("_size"))
    return rows.join(known, "_p").select("items", (F.col("_o") + F.col("_b")).alias("start")), total


def _string(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            arrays = batch.column(0)
            sizes = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)
            full = np.flatnonzero(sizes)
            if not len(full):
                continue
            ends = np.cumsum(sizes[full], dtype=np.int64)
            last = np.flatnonzero(np.diff((ends - sizes[full]) // least, append=-1))
            ends = ends[last]
            own = np.diff(ends, prepend=0)
            out = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), arrays.flatten())
            yield pa.RecordBatch.from_arrays([out, pa.array(own, pa.int64()), pa.array(total + ends - own, pa.int64())], names=["items", "_size", "_b"])
            total += int(ends[-1])

    return run


def _in_partition() -> Column:
    return F.col("_m").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def _sums_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to a partition's rows the sum of _size before each."""
    total = 0
    for batch in batches:
        size = batch.column("_size").to_numpy(zero_copy_only=False)
        ends = total + np.cumsum(size)
        total = int(ends[-1]) if len(ends) else total
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - size, pa.int64())], names=[*batch.schema.names, "_b"])


def _starts(key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to a partition's rows, which stand together by ``key``, the place in it where their key's rows begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, start, last = 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(pc.cast(batch.column(key), pa.string()))
            ends, values = runs.run_ends.to_numpy(), runs.values
            begins = np.concatenate(([0], ends[:-1])) + at
            if at and values[0].as_py() == last:
                begins[0] = start
            at, start, last = at + batch.num_rows, int(begins[-1]), values[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.repeat(begins, np.diff(ends, prepend=0)), pa.int64())], names=[*batch.schema.names, "_start"])

    return run


def sized(table: DataFrame, rows: int) -> DataFrame:
    """A table for a join that sends it by broadcast only if its ``rows`` are few, and sends the other side never. Else Spark goes by the
    size of files, and a table takes some thirty times that on the driver."""
    return F.broadcast(table) if rows <= SENT else table.hint("merge")


def meet(rows: DataFrame, table: DataFrame, keys: list[str], size: int | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Inner join of rows with a table of few rows a key, each key's rows in SALTS parts, so that no
    task gets all rows of a key. A small table goes by broadcast, which Spark decides by its size; with ``size``, its number of
    rows, that decides (``sized``). With ``hot``, the few keys that may have many rows, to be broadcast, only these are in parts."""
    if size is not None and size <= SENT:
        return rows.join(F.broadcast(table), keys)
    salt, parts = F.pmod(F.xxhash64(*(c for c in rows.columns if c not in keys)), F.lit(SALTS)), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    if hot is not None:
        flag = F.broadcast(hot.withColumn("_hot", F.lit(True)))
        rows, table = (x.join(flag, keys, "left") for x in (rows, table))
        salt, parts = F.when(F.col("_hot"), salt).otherwise(F.lit(0).cast("long")), F.when(F.col("_hot"), parts).otherwise(F.array(F.lit(0).cast("long")))
    rows, dealt = (x.withColumn("_salt", s).drop("_hot") for x, s in ((rows, salt), (table, F.explode(parts))))
    return rows.join(dealt if size is None else sized(dealt, size), [*keys, "_salt"]).drop("_salt")


def paged(df: DataFrame, key: str, order: list[str], size: int, page: str = "page") -> DataFrame:
    """Adds each row's page: its place in ``order`` among the rows of its key, ``size`` to a page, from 0.

    Rows are sorted over all keys at once and written, so a key with many rows is spread over the
    sort's partitions by what follows it in the order. Where a key begins in a partition is told as the rows go by; for
    a partition's first key, which an earlier one may have begun, it goes by the driver with the partitions'
    sizes, so the rows are shuffled by nothing but the sort. Null keys are a key.
    """
    spark = df.sparkSession
    rows = df.sort(F.col(key).isNull(), F.col(key), *map(F.col, order)).withColumn("_m", F.monotonically_increasing_id())
    rows = rows.mapInArrow(_starts(key), StructType([*rows.schema.fields, StructField("_start", LongType())]))
    rows = Scratch(spark).keep(rows, "sorted").withColumn("_p", F.shiftright("_m", PLACE_BITS))
    name = F.col(key).cast("string")
    ends = rows.groupBy("_p").agg(F.count("*").alias("n"), F.min_by(name, "_m").alias("first"), F.max_by(name, "_m").alias("last"), F.max("_start").alias("start"))
    total, begun, last, offsets = 0, 0, None, []
    for r in sorted(ends.collect(), key=lambda r: r["_p"]):
        first = begun if offsets and r["first"] == last else total
        offsets.append((r["_p"], total, first))
        begun, last = total + r["start"] if r["start"] else first, r["last"]
        total += r["n"]
    known = F.broadcast(spark.createDataFrame(offsets, "_p long, _o long, _f long"))
    first = F.when(F.col("_start") == 0, F.col("_f")).otherwise(F.col("_o") + F.col("_start"))
    out = rows.join(known, "_p")
    return out.withColumn(page, F.floor((F.col("_o") + _in_partition() - first) / size).cast("int")).select(*df.columns, page)
