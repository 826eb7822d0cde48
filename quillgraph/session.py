"""A session with the settings the engine expects; every operator also runs in any other session."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",  # filters reach the graph data source
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.cteRecursionRowLimit": "-1",  # paths of any number of trees
    "spark.sql.session.timeZone": "UTC",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("quillgraph")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
