"""Queries of ingest, entropy, navigation and path search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import entropy, graph, ingest, search
from quillgraph.plans import kg
from quillgraph.plans.kg import BOTH_SQL, DEGREES_SQL, EDGES_SQL, GEO_SQL, STATS_SQL
from quillgraph.plans.registry import query


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = kg.table(spark, sf_dir, "supplier").select(F.lit("Supplier").alias("node_type"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node_id"), F.col("s_name").alias("node_name"))
    part = kg.table(spark, sf_dir, "part").select(F.lit("Part").alias("node_type"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("node_id"), F.col("p_name").alias("node_name"))
    return supplier.unionAll(part)


@query(f"""
WITH {EDGES_SQL},
nodes AS (SELECT 'S' || s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'P' || p_partkey, p_name FROM part)
SELECT a.name AS source, b.name AS target, edge_type, weight FROM edges JOIN nodes a ON source = a.id JOIN nodes b ON target = b.id
""")
def q_kg_edges(spark, sf_dir):
    """Edges with names for ids by two inner joins; ends without a name drop their edges."""
    return ingest.name_ends(kg.edges(spark, sf_dir), _nodes(spark, sf_dir))


@query(f"""
WITH {EDGES_SQL},
r(edge_type, template) AS (VALUES ('SUPPLIES_SsP', 'Supplier {{}} supplies part'), ('LOCATEDIN_SlN', 'Supplier {{}} is located in nation'), ('PARTOF_NpR', 'Nation {{}} is part of region'))
SELECT source, edge_type, target, replace(template, '{{}}', source) AS fact,
       replace(template, '{{}}', '<' || source || '>') || ' <' || target || '>' AS evidence, split_part(edge_type, '_', 1) AS predicate,
       source || ' ' || lower(split_part(edge_type, '_', 1)) || ' ' || target || ' and Provenance of this association is SPOKE-KG.' AS context
FROM edges JOIN r USING (edge_type)
""")
def q_edge_verbalize(spark, sf_dir):
    """Triples in words; those of an unknown relation go."""
    known = ingest.relation_table(spark, kg.TEMPLATES)
    rows = ingest.label(kg.edges(spark, sf_dir), known).where(F.col("template").isNotNull()).withColumn("provenance", F.lit(ingest.DEFAULT_PROVENANCE))
    t, s, o = F.col("template"), F.col("source"), F.col("target")
    return rows.select("source", "edge_type", "target", ingest.fact(t, s).alias("fact"), ingest.evidence_text(t, s, o).alias("evidence"), ingest.predicate(F.col("edge_type")).alias("predicate"), ingest.sentence().alias("context"))


@query(f"WITH {EDGES_SQL} SELECT DISTINCT source, edge_type, target FROM (SELECT * FROM edges UNION ALL SELECT * FROM edges) WHERE edge_type <> 'LOCATEDIN_ClN'")
def q_edge_dedup(spark, sf_dir):
    """Concatenated tables of triples, each triple with a template once."""
    e = kg.links(spark, sf_dir)
    rows = ingest.label(e.unionByName(e), ingest.relation_table(spark, kg.TEMPLATES))
    return ingest.clean_triples(rows.select("source", "edge_type", "target", "template"), ["source", "edge_type", "target"])


@query("SELECT DISTINCT c_mktsegment AS seed FROM customer WHERE c_mktsegment IS NOT NULL")
def q_seed_distinct(spark, sf_dir):
    return kg.table(spark, sf_dir, "customer").na.drop(subset=["c_mktsegment"]).select(F.col("c_mktsegment").alias("seed")).distinct()


@query("SELECT 'P' || p_partkey AS seed FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def q_seed_missing(spark, sf_dir):
    """Seeds that no edge touches."""
    parts = kg.table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("seed"))
    return graph.missing_seeds(kg.supplies(spark, sf_dir, "l_quantity > 45"), parts)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges as a graph service returns them, made of events."""
    p = F.struct(
        F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("name"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("d"), F.col("user_id").cast("string"))).alias("description"),
        F.concat(F.lit("i"), F.col("event_id").cast("string")).alias("identifier"),
        F.when(F.col("event_id") % 4 == 1, F.lit("DOID")).alias("source"),
        F.when(F.col("event_id") % 4 == 0, F.array(F.lit("a"), F.col("event_type"))).alias("sources"),
        F.when(F.col("event_id") % 4 == 2, F.concat(F.lit("['p"), F.col("user_id").cast("string"), F.lit("']"))).alias("preprint_list"),
        F.lit(None).cast("string").alias("pmid_list"),
    )
    kind = F.when(F.col("event_id") % 2 == 0, F.lit("Protein")).when(F.col("event_id") % 7 == 0, F.lit("Version")).otherwise(F.lit("Disease"))
    events = kg.table(spark, sf_dir, "events")
    node = events.select(kind.alias("neo4j_type"), F.col("event_id").cast("string").alias("id"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target"), p.alias("properties"))
    edge = events.select(F.lit("RESEMBLES_DrD").alias("neo4j_type"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("event_id").cast("string").alias("source"), F.col("user_id").cast("string").alias("target"), p.alias("properties"))
    return node.unionAll(edge)


@query("""
SELECT CAST(event_id AS VARCHAR) AS node_id, CASE WHEN event_id % 2 = 0 THEN 'Protein' ELSE 'Disease' END AS node_type,
  coalesce(CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 5 <> 0 THEN 'd' || user_id END ELSE CASE WHEN event_id % 3 <> 0 THEN event_type END END, 'i' || event_id) AS node_name
FROM events WHERE event_id % 2 = 0 OR event_id % 7 <> 0
""")
def q_node_name_fallback(spark, sf_dir):
    """Node table: a protein's description, another's name, else the identifier; some types left out."""
    return ingest.nodes(_records(spark, sf_dir))


@query("""
SELECT CAST(event_id AS VARCHAR) AS source, CAST(user_id AS VARCHAR) AS target,
  CASE event_id % 4 WHEN 0 THEN 'a, ' || event_type WHEN 1 THEN 'DOID' WHEN 2 THEN 'p' || user_id ELSE 'SPOKE-KG' END AS provenance FROM events
""")
def q_provenance_chain(spark, sf_dir):
    """Edge table with the first provenance there is."""
    return ingest.edges(_records(spark, sf_dir)).select("source", "target", "provenance")


_BAG = """SELECT event_id, CAST(event_id AS VARCHAR) AS source, json_merge_patch(json_object('identifier', 'i' || event_id),
    CASE WHEN event_id % 3 <> 0 THEN json_object('name', event_type) ELSE '{}' END, CASE WHEN event_id % 4 = 1 THEN json_object('source', 'DOID') ELSE '{}' END,
    CASE WHEN event_id % 4 = 0 THEN json_object('sources', json_array('a', event_type)) ELSE '{}' END) AS bag FROM events"""


@query(f"""
SELECT source, (bag->>'$.name') AS name, (bag->>'$.identifier') AS identifier, coalesce((bag->>'$.sources[1]'), (bag->>'$.source')) AS first_source,
  CAST(CASE WHEN (bag->'$.sources') IS NOT NULL THEN json_array_length(bag->'$.sources') END AS BIGINT) AS n_sources
FROM ({_BAG})
""")
def q_evidence(spark, sf_dir):
    """What the evidence of edges holds, read from VARIANTs."""
    e = ingest.as_variant(ingest.edges(_records(spark, sf_dir)))
    value = lambda path, kind="string": ingest.evidence_value(F.col("evidence"), path, kind)
    sources = value("$.sources", "array<string>")
    return e.select("source", value("$.name").alias("name"), value("$.identifier").alias("identifier"), F.coalesce(value("$.sources[1]"), value("$.source")).alias("first_source"), F.when(sources.isNotNull(), F.size(sources)).cast("long").alias("n_sources"))


@query(r"""
SELECT CAST(event_id AS VARCHAR) AS source, CAST(event_id AS VARCHAR) || ' resembles ' || CAST(user_id AS VARCHAR) || ' and Provenance of this association is ' ||
  CASE event_id % 4 WHEN 0 THEN 'a, ' || event_type WHEN 1 THEN 'DOID' WHEN 2 THEN 'p' || user_id ELSE 'SPOKE-KG' END
  || ' and attributes associated with this association is in the following JSON format:' || chr(10) || ' {' ||
  CASE WHEN event_id % 3 <> 0 THEN '"name":"' || event_type || '",' ELSE '' END || CASE WHEN event_id % 5 <> 0 THEN '"description":"d' || user_id || '",' ELSE '' END || '"identifier":"i' || event_id || '"' ||
  CASE event_id % 4 WHEN 1 THEN ',"source":"DOID"' WHEN 0 THEN ',"sources":["a","' || event_type || '"]' WHEN 2 THEN ',"preprint_list":"[' || chr(39) || 'p' || user_id || chr(39) || ']"' ELSE '' END || '}' || chr(10) || chr(10) AS sentence,
  CAST(event_id AS VARCHAR) || ' has a DOID identifier of i' || event_id || ' and Provenance of this is from DOID.' AS tail
FROM events
""")
def q_edge_evidence(spark, sf_dir):
    """Edges in sentences that carry their evidence, and the sentence that says where a node's identifier is from."""
    e = ingest.edges(_records(spark, sf_dir))
    tail = ingest.tail_sentence(F.col("source"), F.lit("DOID"), F.concat(F.lit("i"), F.col("source")))
    return e.select("source", ingest.sentence(with_evidence=True).alias("sentence"), tail.alias("tail"))


@query(f"WITH {EDGES_SQL}, {DEGREES_SQL.format('edges')} SELECT node, d AS degree, v AS volume FROM degrees, total")
def q_degree_volume(spark, sf_dir):
    return entropy.node_entropy(kg.edges(spark, sf_dir)).select("node", "degree", "volume")


@query(f"WITH {EDGES_SQL}, {DEGREES_SQL.format('edges')} SELECT count(*) AS nodes, max(v) AS volume, round(sum(-(d / v) * log2(d / v)), 7) AS entropy FROM degrees, total")
def q_se_1d(spark, sf_dir):
    """One-dimensional structural entropy."""
    return entropy.entropy_1d(kg.edges(spark, sf_dir)).withColumn("entropy", F.round("entropy", 7))


@query(f"WITH {EDGES_SQL}, {DEGREES_SQL.format('edges')} SELECT node, round(-log2(d / v), 7) AS information FROM degrees, total")
def q_node_self_information(spark, sf_dir):
    return entropy.node_entropy(kg.edges(spark, sf_dir)).select("node", F.round("information", 7).alias("information"))


@query(f"WITH {EDGES_SQL}, {DEGREES_SQL.format('edges')} SELECT node, round(-(d / v) * log2(d / v), 9) AS contribution FROM degrees, total")
def q_node_entropy_contrib(spark, sf_dir):
    return entropy.node_entropy(kg.edges(spark, sf_dir)).select("node", F.round("contribution", 9).alias("contribution"))


@query(f"""
WITH {EDGES_SQL}, {DEGREES_SQL.format('edges')}
SELECT node, round(-log2(d / v), 7) AS information FROM degrees, total WHERE node LIKE 'S%' ORDER BY -log2(d / v) DESC, node LIMIT 10
""")
def q_top_suppliers(spark, sf_dir):
    """The ten suppliers that say most by being met."""
    rows = entropy.node_entropy(kg.edges(spark, sf_dir)).where(F.col("node").startswith("S"))
    return rows.orderBy(F.desc("information"), "node").limit(10).select("node", F.round("information", 7).alias("information"))


_PART = """{0} AS (
  SELECT 'S' || l_suppkey AS node, l_quantity AS w FROM lineitem WHERE {1} UNION ALL SELECT 'P' || l_partkey, l_quantity FROM lineitem WHERE {1})"""


@query(f"""
WITH {_PART.format('a', "l_shipdate < TIMESTAMP '1998-01-01'")}, {_PART.format('b', 'true')},
da AS (SELECT node, sum(w) AS d FROM a GROUP BY node), db AS (SELECT node, sum(w) AS d FROM b GROUP BY node),
va AS (SELECT sum(d) AS v FROM da), vb AS (SELECT sum(d) AS v FROM db)
SELECT (SELECT v FROM va) AS old_volume, (SELECT round(sum(-(d / v) * log2(d / v)), 6) FROM da, va) AS old_entropy,
       (SELECT v FROM vb) AS new_volume, (SELECT round(sum(-(d / v) * log2(d / v)), 6) FROM db, vb) AS new_entropy
""")
def q_se_1d_incremental(spark, sf_dir):
    """Entropy after later edges come in, from the touched nodes' terms alone."""
    split = "l_shipdate < timestamp_ntz'1998-01-01 00:00:00'"
    out = entropy.entropy_1d_update(kg.supplies(spark, sf_dir, split), kg.supplies(spark, sf_dir, f"not ({split})"))
    return out.select("old_volume", F.round("old_entropy", 6).alias("old_entropy"), "new_volume", F.round("new_entropy", 6).alias("new_entropy"))


@query(f"WITH {GEO_SQL}, {DEGREES_SQL.format('geo')}, {STATS_SQL} SELECT comm, vol, cut, round(comm_se, 9) AS comm_se, round(leaf_se, 9) AS leaf_se FROM stats")
def q_comm_stats(spark, sf_dir):
    out = entropy.community_stats(kg.geography(spark, sf_dir), kg.regions(spark, sf_dir))
    return out.select("comm", "vol", "cut", F.round("comm_se", 9).alias("comm_se"), F.round("leaf_se", 9).alias("leaf_se"))


@query(f"WITH {GEO_SQL}, {DEGREES_SQL.format('geo')}, {STATS_SQL} SELECT count(*) AS communities, round(sum(comm_se + leaf_se), 9) AS entropy FROM stats")
def q_se_2d(spark, sf_dir):
    """Two-dimensional structural entropy of the division into regions."""
    return entropy.entropy_2d(kg.geography(spark, sf_dir), kg.regions(spark, sf_dir)).withColumn("entropy", F.round("entropy", 9))


@query(f"""
WITH {GEO_SQL}, {DEGREES_SQL.format('geo')},
pairs AS (SELECT least(source, target) AS c1, greatest(source, target) AS c2, sum(weight) AS w FROM geo WHERE source <> target GROUP BY ALL),
x AS (SELECT c1, c2, a.d + b.d AS vol, a.d + b.d - 2 * w AS cut, a.d AS d1, b.d AS d2, v FROM pairs JOIN degrees a ON a.node = c1 JOIN degrees b ON b.node = c2, total)
SELECT c1, c2, vol, cut, round(-(cut / v) * log2(vol / v), 9) AS comm_se,
  round(-(d1 / v) * log2(d1 / vol) - (d2 / v) * log2(d2 / vol), 9) AS leaf_se,
  round(-(cut / v) * log2(vol / v) - (d1 / v) * log2(d1 / vol) - (d2 / v) * log2(d2 / vol) + (d1 / v) * log2(d1 / v) + (d2 / v) * log2(d2 / v), 9) AS delta
FROM x
""")
def q_pair_merge_delta(spark, sf_dir):
    """What merging two adjacent nodes' singletons changes."""
    e = kg.geography(spark, sf_dir)
    out = entropy.merge_deltas(e, entropy.singletons(e))
    return out.select("c1", "c2", "vol", "cut", *(F.round(c, 9).alias(c) for c in ("comm_se", "leaf_se", "delta")))


@query()
def q_se_2d_greedy(spark, sf_dir):
    """Communities of the whole graph by rounds of mutual choices."""
    return entropy.merge_rounds(kg.simple_edges(spark, sf_dir), distinct=True)


@query(f"WITH {EDGES_SQL}, {BOTH_SQL.format('edges')} SELECT DISTINCT node, relation FROM near")
def q_relations(spark, sf_dir):
    return graph.relations(kg.links(spark, sf_dir))


@query(f"WITH {EDGES_SQL}, {BOTH_SQL.format('edges')} SELECT * FROM near")
def q_neighbors(spark, sf_dir):
    return graph.neighbours(kg.edges(spark, sf_dir))


@query(f"""
WITH {EDGES_SQL}, {BOTH_SQL.format('edges')},
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY (CAST(substr(neighbour, 2) AS BIGINT) * 7919) % 10007, relation, neighbour) AS rank FROM (SELECT DISTINCT * FROM near))
SELECT node, relation, neighbour, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 15
""")
def q_actions_top15(spark, sf_dir):
    """At most 15 actions for each node, chosen by an arithmetic key."""
    key = (F.substring("neighbour", 2, 100).cast("long") * 7919) % 10007
    return graph.actions(kg.links(spark, sf_dir), 15, key)


@query(f"""
WITH {EDGES_SQL}, {BOTH_SQL.format('edges')}
SELECT node, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations, string_agg(neighbour, ',' ORDER BY neighbour) AS entities FROM near GROUP BY node
""")
def q_entity_context(spark, sf_dir):
    """Each node's relations and neighbours in the whole graph."""
    out = graph.context(kg.edges(spark, sf_dir))
    return out.select("node", F.array_join("relations", ",").alias("relations"), F.array_join("entities", ",").alias("entities"))


@query(f"""
WITH {EDGES_SQL}, {BOTH_SQL.format('edges')},
p AS (SELECT *, CAST((row_number() OVER (PARTITION BY node ORDER BY neighbour, relation) - 1) // 100 AS INTEGER) AS page FROM near)
SELECT node, page, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations, string_agg(neighbour, ',' ORDER BY neighbour) AS entities FROM p GROUP BY node, page
""")
def q_entity_context_pages(spark, sf_dir):
    """The same in pages of 100 neighbours: no row is longer, whatever a hub has."""
    out = graph.context_pages(kg.edges(spark, sf_dir), 100)
    return out.select("node", "page", F.array_join("relations", ",").alias("relations"), F.array_join("entities", ",").alias("entities"))


@query(f"""
WITH {EDGES_SQL}, {BOTH_SQL.format('edges')}, seeds AS (SELECT 'N' || n_nationkey AS seed FROM nation UNION ALL SELECT 'unknown')
SELECT DISTINCT seed, relation, neighbour FROM seeds JOIN near ON node = seed
""")
def q_induced(spark, sf_dir):
    """The edges at each nation, all in one join; an unknown seed gives none."""
    seeds = kg.table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("seed")).unionAll(spark.createDataFrame([("unknown",)], "seed string"))
    return graph.induced(kg.edges(spark, sf_dir), seeds).select("seed", "relation", "neighbour").distinct()


@query(f"""
WITH {GEO_SQL}, asked AS (SELECT 'S' || s_suppkey AS node, 'LOCATEDIN_SlN' AS relation, 'N' || (s_suppkey % 25) AS answer FROM supplier)
SELECT a.*, EXISTS (SELECT 1 FROM geo WHERE source = node AND edge_type = relation AND target = answer) AS found FROM asked a
""")
def q_check_answer(spark, sf_dir):
    s = kg.table(spark, sf_dir, "supplier")
    asked = s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node"), F.lit("LOCATEDIN_SlN").alias("relation"), F.concat(F.lit("N"), (F.col("s_suppkey") % 25).cast("string")).alias("answer"))
    return graph.has_neighbour(kg.geography(spark, sf_dir), asked)


@query(f"""
WITH RECURSIVE {GEO_SQL}, {BOTH_SQL.format('geo')},
step AS (SELECT DISTINCT node, neighbour FROM near),
walk(seed, node, distance) AS (
  SELECT 'S' || s_suppkey, 'S' || s_suppkey, 0 FROM supplier
  UNION SELECT w.seed, s.neighbour, w.distance + 1 FROM walk w JOIN step s ON s.node = w.node WHERE w.distance < 2)
SELECT seed, node, min(distance) AS distance FROM walk GROUP BY seed, node
""")
def q_khop2(spark, sf_dir):
    """Everything within two hops of each supplier."""
    seeds = kg.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("seed"))
    return graph.k_hop(kg.geography(spark, sf_dir), seeds, 2, keep_last=False)


@query(f"""
WITH RECURSIVE {GEO_SQL}, {BOTH_SQL.format('geo')},
step AS (SELECT node, neighbour, min(relation) AS relation FROM near GROUP BY node, neighbour),
walk(source, node, length, path) AS (
  SELECT 'S' || s_suppkey, 'S' || s_suppkey, 0, 'S' || s_suppkey FROM supplier
  UNION SELECT w.source, s.neighbour, w.length + 1, w.path || '|' || s.relation || '|' || s.neighbour FROM walk w JOIN step s ON s.node = w.node WHERE w.length < 3),
best AS (SELECT *, row_number() OVER (PARTITION BY source, node ORDER BY length, path) AS rank FROM walk WHERE node LIKE 'N%')
SELECT source, node AS target, length, path FROM best WHERE rank = 1
""")
def q_shortest_len(spark, sf_dir):
    """Hops and a shortest path from each supplier to each nation within three."""
    s = kg.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("source"))
    n = kg.table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("target"))
    return graph.shortest_paths(kg.geography(spark, sf_dir), s.crossJoin(F.broadcast(n)), 3).withColumn("path", F.array_join("path", "|"))  # 25 nations


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = kg.table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("seed"))
    return search.tree(kg.links(spark, sf_dir, F.col("l_quantity")), seeds, written=True)


@query()
def q_mcts_tree(spark, sf_dir):
    """A search tree of 100 simulations for each nation."""
    return _tree(spark, sf_dir)


@query()
def q_mcts_paths(spark, sf_dir):
    """The trees' paths of high value, in words."""
    found = search.paths(_tree(spark, sf_dir), threshold=1500.0)
    return search.evidence(found).select("seed", "leaf", F.round("total", 6).alias("total"), F.array_join("evidence", "\n").alias("evidence"), "reward")


@query()
def q_mcts_best_path(spark, sf_dir):
    return search.best_path(_tree(spark, sf_dir))


@query()
def q_mcts_preferences(spark, sf_dir):
    return search.preferences(_tree(spark, sf_dir))


@query("SELECT user_id AS path, round(sum(value / (event_id % 7 + 1)), 2) AS reward FROM events GROUP BY user_id")
def q_path_reward(spark, sf_dir):
    steps = kg.table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "value", (F.col("event_id") % 7).alias("visits"))
    return search.path_reward(steps, ["path"])


@query("""
WITH c AS (SELECT user_id AS parent, event_type AS action, count(*) AS visits FROM events GROUP BY ALL)
SELECT *, round(sqrt(visits) / sum(sqrt(visits)) OVER (PARTITION BY parent), 9) AS probability FROM c
""")
def q_visit_policy(spark, sf_dir):
    c = kg.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("parent"), F.col("event_type").alias("action")).agg(F.count("*").alias("visits"))
    return search.visit_policy(c, ["parent"], 2.0).withColumn("probability", F.round("probability", 9))
