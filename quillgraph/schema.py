"""Schemas of the data model, as DDL. Columns that a source may lack are added as typed nulls by ``conform``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


NODES = "node_type STRING, node_id STRING, node_name STRING"
EDGES = "source STRING, edge_type STRING, target STRING, provenance STRING, evidence STRING"
TRIPLES = "source STRING, edge_type STRING, target STRING, weight DOUBLE"
NODE_CONTEXT = "node_name STRING, node_context STRING"
SEEDS = "disease_name STRING"
MMLU = "question STRING, A STRING, B STRING, C STRING, D STRING, answer STRING"
GPQA = "`Question` STRING, `Correct Answer` STRING, `Incorrect Answer 1` STRING, `Incorrect Answer 2` STRING, `Incorrect Answer 3` STRING, `Subdomain` STRING"
MEDQA = "question STRING, options MAP<STRING,STRING>, answer_idx STRING"
MEDMCQA = "question STRING, opa STRING, opb STRING, opc STRING, opd STRING, cop INT"
PUBMEDQA = "id STRING, QUESTION STRING, CONTEXTS ARRAY<STRING>, final_decision STRING"
USMLE = "question STRING, choices STRING, answer_id STRING"
PREDICTIONS = "question STRING, output STRING, `extracted answer` STRING, answer STRING"
SAMPLES = "Question STRING, Answer STRING, Evidence STRING, Reward DOUBLE"
SESSIONS = "content ARRAY<STRUCT<role: STRING, content: STRING>>"
PREFERENCES = "prompt STRING, chosen STRING, rejected STRING"
#: What a graph service returns for a neighbourhood: nodes and edges in one list.
GRAPH_RECORD = (
    "neo4j_type STRING, id STRING, source STRING, target STRING, properties STRUCT<name: STRING, description: STRING, "
    "identifier: STRING, source: STRING, sources: ARRAY<STRING>, preprint_list STRING, pmid_list STRING>"
)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns in its order and types; those that ``df`` lacks are null."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*((F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)))
