"""Structural entropy of a stream of edges as a stateful operator: degrees live in the state
store, a row of totals comes out with every batch."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "bucket int, touched long, dn long, dv double, ds double"
TOTALS = "batch long, nodes long, volume double, s double, entropy double"


def _term(d: float) -> float:
    return d * math.log2(d) if d > 0 else 0.0


class Degrees(StatefulProcessor):
    """For a bucket of nodes: each node's degree, and what a batch changes in the sums."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.degree = handle.getMapState("degree", "node string", "degree double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        more: dict[str, float] = {}
        for frame in rows:
            for node, weight in zip(frame["node"], frame["weight"], strict=True):
                more[node] = more.get(node, 0.0) + weight
        fresh, dv, ds = 0, 0.0, 0.0
        for node, weight in more.items():
            known = self.degree.containsKey((node,))
            old = self.degree.getValue((node,))[0] if known else 0.0
            self.degree.updateValue((node,), (old + weight,))
            fresh, dv, ds = fresh + (not known), dv + weight, ds + _term(old + weight) - _term(old)
        yield pd.DataFrame([(key[0], len(more), fresh, dv, ds)], columns=["bucket", "touched", "dn", "dv", "ds"])

    def close(self) -> None:
        pass


class Totals(StatefulProcessor):
    """Number of nodes, volume and S so far: one row out for the buckets' rows of a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "batch long, nodes long, volume double, s double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        batch, nodes, volume, s = self.total.get() if self.total.exists() else (-1, 0, 0.0, 0.0)
        for frame in rows:
            nodes, volume, s = nodes + int(frame["dn"].sum()), volume + float(frame["dv"].sum()), s + float(frame["ds"].sum())
        self.total.update((batch + 1, nodes, volume, s))
        entropy = math.log2(volume) - s / volume if volume > 0 else 0.0
        yield pd.DataFrame([(batch + 1, nodes, volume, s, entropy)], columns=["batch", "nodes", "volume", "s", "entropy"])

    def close(self) -> None:
        pass


def _summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ends of edges with the weights of each node added up within a task's rows, before they are shuffled."""
    for frame in frames:
        yield frame.groupby(["bucket", "node"], as_index=False, sort=False)["weight"].sum()


def entropy(edges: DataFrame, buckets: int = 256) -> DataFrame:
    """(batch, nodes, volume, s, entropy) after each batch of a stream of (source, edge_type, target, weight): H = log2 V - S / V.

    Nodes are dealt into ``buckets`` by hash, each a key of the state with a map of its nodes' degrees, of which a
    batch reads and writes only those it touches; a hub's edges are added up before they are
    shuffled. A bucket hands on one row, and ``buckets`` rows at most make the totals. State
    and output recover from the stream's checkpoint. The session needs the RocksDB state store (see ``settings``) and the stream is
    to be written in append mode. Batches without edges give no row and are not counted; ends that are null take no part.
    """
    ends = edges.select(F.col("source").alias("node"), "weight").unionAll(edges.select("target", "weight"))
    keyed = ends.withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(buckets)).cast("int")).select("bucket", "node", "weight")
    summed = keyed.mapInPandas(_summed, "bucket int, node string, weight double")
    changes = summed.groupBy("bucket").transformWithStateInPandas(Degrees(), CHANGES, "append", "none")
    return changes.withColumn("all", F.lit(0)).groupBy("all").transformWithStateInPandas(Totals(), TOTALS, "append", "none")


def settings() -> dict[str, str]:
    """Settings of a session that runs stateful operators."""
    return {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
