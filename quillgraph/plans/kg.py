"""A knowledge graph over the driver's star schema, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edge(df: DataFrame, a: str, source: str, kind: str, b: str, target: str, weight) -> DataFrame:
    return df.select(F.concat(F.lit(a), F.col(source).cast("string")).alias("source"), F.lit(kind).alias("edge_type"), F.concat(F.lit(b), F.col(target).cast("string")).alias("target"), weight.cast("double").alias("weight"))


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers in nations, nations in regions."""
    one = F.lit(1.0)
    return (
        _edge(table(spark, sf_dir, "supplier"), "S", "s_suppkey", "LOCATEDIN_SlN", "N", "s_nationkey", one)
        .unionAll(_edge(table(spark, sf_dir, "customer"), "C", "c_custkey", "LOCATEDIN_ClN", "N", "c_nationkey", one))
        .unionAll(_edge(table(spark, sf_dir, "nation"), "N", "n_nationkey", "PARTOF_NpR", "R", "n_regionkey", one))
    )


def supplies(spark: SparkSession, sf_dir: str, where: str | Column = "true") -> DataFrame:
    """Suppliers to parts, weighted by quantity."""
    sums = table(spark, sf_dir, "lineitem").where(where).groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return _edge(sums, "S", "l_suppkey", "SUPPLIES_SsP", "P", "l_partkey", F.col("q"))


def links(spark: SparkSession, sf_dir: str, weight=None) -> DataFrame:
    """The edges without their weights, each once or more: for what takes triples once anyway, no sums are made. With ``weight``, a
    column of lineitem, each has its share, which sums to the edge's weight."""
    weight = F.lit(1.0) if weight is None else weight
    return _edge(table(spark, sf_dir, "lineitem"), "S", "l_suppkey", "SUPPLIES_SsP", "P", "l_partkey", weight).unionAll(geography(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplies(spark, sf_dir).unionAll(geography(spark, sf_dir))


def simple_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As graph.simple has the edges, by their ends: the supplies are sums, so they are looked at only where a key
    is missing, as no other ends are those of an edge in the geography."""
    known = F.col("l_suppkey").isNotNull() & F.col("l_partkey").isNotNull()
    rest = graph.simple(supplies(spark, sf_dir, ~known).unionAll(geography(spark, sf_dir)))
    return supplies(spark, sf_dir, known).select(*(f("source", "target").alias(c) for f, c in ((F.least, "source"), (F.greatest, "target"))), "weight").unionAll(rest)


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A division of the geography: each node's region as its community."""
    nation = table(spark, sf_dir, "nation")
    of = lambda df, prefix, key, nk: df.join(F.broadcast(nation), F.col(nk) == F.col("n_nationkey")).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("node"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("comm"))
    own = nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("comm"))
    root = nation.select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("node")).distinct().withColumn("comm", F.col("node"))
    return of(table(spark, sf_dir, "supplier"), "S", "s_suppkey", "s_nationkey").unionAll(of(table(spark, sf_dir, "customer"), "C", "c_custkey", "c_nationkey")).unionAll(own).unionAll(root)


#: Templates of the relations above; customers' has none on purpose.
TEMPLATES = {"SUPPLIES_SsP": "Supplier {} supplies part", "LOCATEDIN_SlN": "Supplier {} is located in nation", "PARTOF_NpR": "Nation {} is part of region"}

GEO_SQL = """geo AS (
  SELECT 'S' || s_suppkey AS source, 'LOCATEDIN_SlN' AS edge_type, 'N' || s_nationkey AS target, CAST(1 AS DOUBLE) AS weight FROM supplier
  UNION ALL SELECT 'C' || c_custkey, 'LOCATEDIN_ClN', 'N' || c_nationkey, 1 FROM customer
  UNION ALL SELECT 'N' || n_nationkey, 'PARTOF_NpR', 'R' || n_regionkey, 1 FROM nation)"""
EDGES_SQL = f"""{GEO_SQL},
edges AS (
  SELECT 'S' || l_suppkey AS source, 'SUPPLIES_SsP' AS edge_type, 'P' || l_partkey AS target, sum(l_quantity) AS weight
  FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL SELECT * FROM geo)"""
DEGREES_SQL = """ends AS (SELECT source AS node, weight FROM {0} UNION ALL SELECT target, weight FROM {0}),
degrees AS (SELECT node, sum(weight) AS d FROM ends GROUP BY node),
total AS (SELECT sum(d) AS v FROM degrees)"""
BOTH_SQL = """near AS (
  SELECT source AS node, edge_type AS relation, target AS neighbour FROM {0}
  UNION ALL SELECT target, edge_type, source FROM {0} WHERE source <> target)"""
DIVISION_SQL = """division AS (
  SELECT 'S' || s_suppkey AS node, 'R' || n_regionkey AS comm FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'C' || c_custkey, 'R' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION ALL SELECT DISTINCT 'R' || n_regionkey, 'R' || n_regionkey FROM nation)"""
STATS_SQL = f"""{DIVISION_SQL},
vols AS (SELECT comm, sum(d) AS vol, sum(d * log2(d)) AS s FROM degrees JOIN division USING (node) GROUP BY comm),
crossing AS (
  SELECT a.comm AS ca, b.comm AS cb, weight FROM geo JOIN division a ON a.node = source JOIN division b ON b.node = target WHERE a.comm <> b.comm),
cuts AS (SELECT comm, sum(weight) AS cut FROM (SELECT ca AS comm, weight FROM crossing UNION ALL SELECT cb, weight FROM crossing) GROUP BY comm),
stats AS (
  SELECT comm, vol, coalesce(cut, 0) AS cut, -(coalesce(cut, 0) / v) * log2(vol / v) AS comm_se, (vol * log2(vol) - s) / v AS leaf_se, v
  FROM vols LEFT JOIN cuts USING (comm), total)"""
