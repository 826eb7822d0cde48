"""Operators whose groups may be of any size: results against plain arithmetic, and how much they look at."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph import models, tables
from quillgraph.operators import balls, graph, ingest, quantiles, retrieval, sft
from quillgraph.plans import catalogue
from quillgraph.sources import files
from quillgraph.tables import meet, paged, places


def clustered(seed, clusters, each, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims)) * 10
    return (centres[:, None, :] + rng.normal(size=(clusters, each, dims)) * 0.3).reshape(-1, dims)


def brute_nearest(queries, items, k, measure, itself):
    out = []
    for q, a in queries:
        scores = []
        for i, b in items:
            if i == q and not itself:
                continue
            if measure == "cosine":
                score = -sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b)))
            else:
                score = math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))
            scores.append((round(score, 9), i is None, i))
        out += [(q, i, rank) for rank, (_, _, i) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("measure, itself, ring_rows", [("cosine", True, 16), ("l2", False, 16), ("l2", True, 2048)])
def test_nearest_is_brute_force(spark, measure, itself, ring_rows):
    """Clusters, a vector with a hundred copies, ties, a null id, and vectors that take no part."""
    points = [(i, v.tolist()) for i, v in enumerate(clustered(1, 12, 25))]
    points += [(1000 + i, points[7][1]) for i in range(100)] + [(2000, [1.0] * 8), (2001, [2.0] * 8), (None, [4.0] * 8)]
    odd = [(3000, None), (3001, [None] * 8), (3002, [float("nan")] * 8), (3003, [float("inf")] + [1.0] * 7), (3004, [1.0, 2.0])] + ([(3005, [0.0] * 8)] if measure == "cosine" else [])
    items = spark.createDataFrame(points + odd, "id long, embedding array<double>")
    index = balls.build(items, 5 + (not itself), measure, ring_rows=ring_rows)
    got = sorted(((r.query_id, r.item_id, r["rank"]) for r in balls.search(index, items.where("id % 10 = 0"), 5, itself).collect()), key=str)
    assert got == brute_nearest([p for p in points if p[0] is not None and p[0] % 10 == 0], points, 5, measure, itself)
    assert ring_rows > 100 or len(index.rings["n"]) > 4
    assert {(r.query_id, r.item_id) for r in balls.search(index, items.where("id = 20"), 1, itself).collect()} == {(a, b) for a, b, r in brute_nearest([points[20]], points, 1, measure, itself)}


def test_nearest_of_nothing(spark):
    items = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<double>")
    for queries, things in ((items, items.where("false")), (items.where("false"), items), (items, spark.createDataFrame([(1, None)], items.schema))):
        out = retrieval.nearest(queries, things, 3)
        assert out.columns == ["query_id", "item_id", "score", "rank"] and out.count() == 0
    assert [(r.item_id, r["rank"]) for r in retrieval.nearest(items, items, 3).collect()] == [(1, 1)]


def test_few_pairs_are_looked_at(spark):
    """On clustered vectors less than a tenth of all pairs are in rings that are read, and less of them the more there are."""
    shares = []
    for each in (50, 200):
        v = clustered(3, 60, each, 16)
        items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
        index = balls.build(items, 3, "l2", ring_rows=16)
        queries = items.where("id % 20 = 0")
        shares.append(balls.visited_pairs(index, queries) / (queries.count() * len(v)))
    assert shares[1] < 0.1 and shares[1] < shares[0]


def test_hot_rings_are_read_in_parts(spark, monkeypatch):
    """All vectors as far from one pivot as each other: one ring of all rows, dealt into parts."""
    rng = random.Random(1)
    rows = [(i, [math.cos(a), math.sin(a)]) for i, a in enumerate(rng.uniform(0, 7) for _ in range(600))]
    items = spark.createDataFrame(rows, "id long, embedding array<double>")
    monkeypatch.setattr(balls, "RINGS", 1)
    index = balls.build(items, 4, "cosine", ring_rows=40)
    assert index.classes.groupBy("ring", "part").count().agg(F.max("count")).first()[0] < 200
    got = sorted((r.query_id, r.item_id, r["rank"]) for r in balls.search(index, items.where("id % 50 = 0"), 4).collect())
    assert got == sorted(brute_nearest([r for r in rows if r[0] % 50 == 0], rows, 4, "cosine", True))


@pytest.mark.parametrize("fraction", [0.75, 0.0, 1.0, 0.333])
@pytest.mark.parametrize("few", [3, 1 << 16])
def test_percentile(spark, monkeypatch, fraction, few):
    """Groups of many and of one value, one with nine tenths of all rows, values near each other, NaN, nulls; with few = 3 in several rounds."""
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = random.Random(7)
    groups = {"hot": [rng.uniform(0.9, 0.90001) for _ in range(3000)], "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(99)], "one": [2.5], "same": [1.5] * 40, "zero": [-0.0, 0.0, -1e-320, 1e-320], "ends": [float("-inf"), 1.0, float("inf")], "two": [1.0, 2.0]}
    rows = [(k, x) for k, xs in groups.items() for x in xs] + [("hot", None), ("none", None), (None, 1.0)]
    got = {r.k: r.bar for r in quantiles.percentile(spark.createDataFrame(rows, "k string, x double"), "k", "x", fraction).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        if k != "ends":
            assert got[k] == pytest.approx(float(np.percentile(xs, fraction * 100)), rel=1e-12), k
    assert fraction not in (0.0, 1.0) or got["ends"] == (float("-inf"), float("inf"))[int(fraction)]
    nan = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 2.0)], "k string, x double")
    low, high = (quantiles.percentile(nan, "k", "x", f).first().bar for f in (0.5, 1.0))
    assert low == 2.0 and math.isnan(high)
    assert quantiles.percentile(nan.where("false"), "k", "x", fraction).count() == 0


def test_order_bits():
    values = np.array([float("-inf"), -1e300, -2.0, -1e-320, -0.0, 0.0, 5e-324, 1.0, 1.0000000001, 1e300, float("inf"), float("nan")])
    assert (np.diff(quantiles.order_bits(values).astype(object)) > 0).all()


def test_rows_of_a_key_meet_their_row_in_parts(spark):
    rows = spark.range(2000).select(F.lit("k").alias("k"), F.col("id").alias("v"))
    table = spark.createDataFrame([("k", 5), ("l", 6)], "k string, x int")
    out = meet(rows, table, ["k"])
    assert out.columns == ["k", "v", "x"] and out.count() == 2000 and out.agg(F.sum("v"), F.min("x")).first() == (1999000, 5)


@pytest.mark.parametrize("block", [1, 4, 7, 1000])
def test_pack(spark, block):
    """Rows that reach over many blocks, rows within one, empty and null ones; pieces are at most rows and bounds."""
    rng = random.Random(block)
    rows = [(i, list(range(i * 1000, i * 1000 + rng.choice([0, 1, 2, 5, 40])))) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "k long, t array<int>")
    every = [t for _, ts in rows for t in ts or []]
    cut = [every[i : i + block] for i in range(0, len(every), block)]
    want = {i: c for i, c in enumerate(cut) if len(c) == block or len(every) < block}
    assert {r.block_no: r.tokens for r in sft.pack(df.repartition(5), "k", "t", block).collect()} == want


def test_pages_of_hubs(spark):
    """No page is longer than its size, and the pages of a node put together are its context; null keys are a key."""
    rng = random.Random(5)
    rows = [("hub", rng.choice(["r", "q"]), f"n{rng.randint(0, 400)}", 1.0) for _ in range(700)] + [("a", "r", "b", 1.0), ("b", "q", "b", 1.0)]
    edges = spark.createDataFrame(rows, "source string, edge_type string, target string, weight double")
    pages, whole = graph.context_pages(edges, 50).collect(), {r.node: (r.relations, r.entities) for r in graph.context(edges).collect()}
    assert max(len(r.entities) for r in pages) == 50 and sum(r.node == "hub" for r in pages) == 14
    for node, (relations, entities) in whole.items():
        own = sorted((r for r in pages if r.node == node), key=lambda r: r.page)
        assert [r.page for r in own] == list(range(len(own)))
        assert [e for r in own for e in r.entities] == entities and sorted({x for r in own for x in r.relations}) == relations
    some = paged(spark.createDataFrame([(None, 3), (None, 1), ("", 2), ("k", 1), (None, 2)], "k string, v int"), "k", ["v"], 2)
    assert sorted(((r.k is None, r.k or "", r.v, r.page) for r in some.collect())) == [(False, "", 2, 0), (False, "k", 1, 0), (True, "", 1, 0), (True, "", 2, 0), (True, "", 3, 1)]


def test_contexts_in_pages(spark):
    """A node's context in one row or in pages of it gives the same answer; the steps can be looked at."""
    facts = [f"fact {i} about asthma and lungs number {i % 7}" for i in range(40)]
    whole = spark.createDataFrame([("asthma", ". ".join(facts))], "node_name string, node_context string")
    parts = spark.createDataFrame([("asthma", i // 8, ". ".join(facts[i : i + 8])) for i in range(0, 40, 8)], "node_name string, page int, node_context string")
    questions = spark.createDataFrame([(1, "what is asthma and lungs"), (2, "asthma fact")], "question_id int, question string")
    entities = spark.createDataFrame([(1, "asthma")], "question_id int, entity string")
    store = spark.createDataFrame([("asthma",), ("gout",)], "id string").withColumn("embedding", models.embed(F.col("id")))
    one, many = (sorted(map(tuple, retrieval.retrieve(questions, entities, store, c, models.embed).collect())) for c in (whole, parts))
    assert one == many and one
    steps = retrieval.explain(questions, entities, store, whole, models.embed)
    assert [r.item_id for r in steps["hits"].collect()] == ["asthma"] and steps["contexts"].count() == 1 and sorted(map(tuple, steps["result"].collect())) == one


def test_evidence_as_variant(spark):
    rows = spark.createDataFrame([("a", "R_AB", '{"x": 1, "s": ["p", "q"]}'), ("b", "R_AB", '{"x": "one"}'), ("c", "Q_AB", "no json"), ("d", "Q_AB", None)], "source string, edge_type string, evidence string")
    e = ingest.as_variant(rows)
    assert e.schema["evidence"].dataType.simpleString() == "variant"
    got = e.select("source", ingest.evidence_value(F.col("evidence"), "$.x", "int").alias("x"), ingest.evidence_value(F.col("evidence"), "$.s[1]").alias("s")).collect()
    assert sorted(map(tuple, got), key=str) == [("a", 1, "q"), ("b", None, None), ("c", None, None), ("d", None, None)]
    fields = {r.edge_type: r.fields for r in ingest.evidence_fields(e).collect()}
    assert "x: VARIANT" in fields["R_AB"] and "s: ARRAY<STRING>" in fields["R_AB"]


def test_questions_of_a_subdomain(spark, tmp_path):
    (tmp_path / "q.csv").write_text("Question,Correct Answer,Incorrect Answer 1,Incorrect Answer 2,Incorrect Answer 3,Subdomain\nq1,a,b,c,d,Genetics\nq2,a,b,c,d,Optics\n")
    assert [r.Question for r in files.gpqa(spark, str(tmp_path / "q.csv"), "Genetics").collect()] == ["q1"] and files.gpqa(spark, str(tmp_path / "q.csv")).count() == 2


def test_mini_batches_by_their_own_places(spark):
    """Ids that begin anew at each million, and one that is missing: what counts is the id."""
    rows = spark.createDataFrame([(i,) for i in (0, 7, 8, 64, 999_999, 1_000_000, 1_000_065, 3_000_010)], "id long")
    got = sft.mini_batches(rows, "id", 64, 8, F.col("id") % 1_000_000)
    assert sorted(tuple(r) for r in got.collect()) == [(i, i % 1_000_000 // 64, i % 64 // 8) for i in (0, 7, 8, 64, 999_999, 1_000_000, 1_000_065, 3_000_010)]


def hubs(spark):
    """Two hubs of 60 leaves with a node above both, leaves at both, and a chain; who is how far from whom, by plain search."""
    links = [(f"a{i}", "A") for i in range(60)] + [(f"b{i}", "B") for i in range(60)] + [("A", "T"), ("B", "T"), ("a0", "B"), ("a1", "a2"), ("a3", "x"), ("x", "y"), ("T", "T")]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    away = {}
    for s in near:
        away[s], ring = {s: 0}, [s]
        while ring:
            ring = [t for u in ring for t in near[u] if t not in away[s] and not away[s].update({t: away[s][u] + 1})]
    return spark.createDataFrame([(a, "E", b, 1.0) for a, b in links], "source string, edge_type string, target string, weight double"), away


def counting(monkeypatch):
    """The rows of all tables written from here on."""
    seen, keep = [], tables.Scratch.keep
    monkeypatch.setattr(tables.Scratch, "keep", lambda self, df, name="table": [out := keep(self, df, name), seen.append(out.count())][0])
    return seen


@pytest.mark.parametrize("hops, listed", [(2, 100), (2, 5), (3, 0), (4, 100)])
def test_hops_around_a_hub(spark, monkeypatch, hops, listed):
    edges, away = hubs(spark)
    monkeypatch.setattr(graph, "LISTED", listed)
    seeds = [s for s in away if s[0] in "abx"]
    written = counting(monkeypatch)
    got = graph.k_hop(edges, spark.createDataFrame([(s,) for s in seeds], "seed string"), hops, keep_last=False)
    assert sorted(tuple(r) for r in got.collect()) == sorted((s, t, d) for s in seeds for t, d in away[s].items() if d <= hops)
    if hops == 2:
        assert max(written) < 600  # of 7,000 rows of the result


def test_hops_around_hubs_take_few_bytes(spark, tmp_path):
    """Leaves of 20 hubs to one another, 3.2 million rows: written as runs, not as places in a table of values for each row."""
    edges = spark.range(8000).select(F.concat(F.lit("leaf"), F.col("id")).alias("source"), F.lit("E").alias("edge_type"), F.concat(F.lit("H"), F.col("id") % 20).alias("target"), F.lit(1.0).alias("weight"))
    graph.k_hop(edges, edges.select(F.col("source").alias("seed")), 2, keep_last=False).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    want = {"n": 8000 * 401, "each": 8000 * 401, "zero": 8000, "one": 8000}
    assert out.agg(F.count("*").alias("n"), F.count_distinct("seed", "node").alias("each"), F.count_if(F.col("distance") == 0).alias("zero"), F.count_if(F.col("distance") == 1).alias("one")).first().asDict() == want
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < want["n"]


def test_paths_across_a_hub(spark, monkeypatch):
    """Every leaf to both hubs: their leaves are looked at from the hubs, not from every leaf."""
    edges, away = hubs(spark)
    pairs = [(s, t) for s in away if s[0] in "abxy" for t in ("A", "B", "y")]
    written = counting(monkeypatch)
    got = {(r.source, r.target): (r.length, r.path) for r in graph.shortest_paths(edges, spark.createDataFrame(pairs, "source string, target string"), 3).collect()}
    assert {k: v[0] for k, v in got.items()} == {(s, t): away[s][t] for s, t in pairs if away[s].get(t, 9) <= 3}
    assert all(len(p) == 2 * n + 1 and p[0] == s and p[-1] == t and all(away[a][b] == 1 for a, b in zip(p[::2], p[2::2])) for (s, t), (n, p) in got.items())
    assert got["a1", "A"][1] == ["a1", "E", "A"] and got["a7", "B"][1] == ["a7", "E", "A", "E", "T", "E", "B"] or got["a7", "B"][1] == ["a7", "E", "A", "E", "a0", "E", "B"]
    assert max(written) < 600


def test_triples_taken_once_make_no_sums(spark):
    """Queries of distinct triples neither sum weights nor compare templates, and few actions of a node are shuffled."""
    plan = lambda name: catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any("sum(" in plan(q) for q in ("q_relations", "q_edge_dedup", "q_actions_top15"))
    assert "template" not in plan("q_edge_dedup").split("HashAggregate(keys=")[1].split("]")[0]
    assert "WindowGroupLimit" in plan("q_actions_top15").split("Exchange")[-1]
    edges = spark.createDataFrame([("a", "r", t, 1.0) for t in "bbbcd"], "source string, edge_type string, target string, weight double")
    assert sorted((r.neighbour, r["rank"]) for r in graph.actions(edges, 2, F.col("neighbour")).where("node = 'a'").collect()) == [("b", 1), ("c", 2)]


@pytest.fixture
def five_parts(spark):
    """Five partitions in every sort, however small, and no join by broadcast but by hint."""
    own = {"spark.sql.shuffle.partitions": "5", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_pages_and_places_shuffle_by_nothing_but_the_sort(five_parts):
    """Keys that begin in one partition of the sort and end in another; no second shuffle of the rows."""
    rng = random.Random(8)
    rows = [(k, i) for k, n in ((None, 300), ("", 1), ("a", 900), ("b", 2), ("c", 1500), ("d", 1), ("e", 40)) for i in range(n)]
    rng.shuffle(rows)
    df = five_parts.createDataFrame(rows, "k string, v int")
    out, placed = paged(df, "k", ["v"], 7), places(df, [F.col("k").isNull(), F.col("k"), F.col("v")])
    sums = places(df, [F.col("k").isNull(), F.col("k"), F.col("v")], size=F.col("v"))
    for plan in (out, placed, sums):
        assert "hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()
    assert {(r.k, r.v): r.page for r in out.collect()} == {(k, v): v // 7 for k, v in rows}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1]))
    assert {(r.k, r.v): r.place for r in placed.collect()} == {r: i for i, r in enumerate(order)}
    assert {(r.k, r.v): r.place for r in sums.collect()} == {r: sum(v for _, v in order[:i]) for i, r in enumerate(order)}


def test_only_what_a_search_can_open_is_ranked(spark, monkeypatch):
    """Actions are ranked for nodes within reach of the seeds, whatever else the graph holds."""
    from quillgraph.operators import search

    ranked, actions = [], search.actions
    monkeypatch.setattr(search, "actions", lambda *a, **k: ranked.append(actions(*a, **k)) or ranked[-1])
    rows = [("a", "r", "b", 1.0), ("b", "r", "c", 2.0), ("c", "r", "d", 1.0), ("d", "r", "e", 1.0), ("e", "r", "f", 1.0)]
    rows += [(f"x{i}", "r", f"y{i}", 1.0) for i in range(20)]
    edges = spark.createDataFrame(rows, "source string, edge_type string, target string, weight double")
    seeds = spark.createDataFrame([("a",)], "seed string")
    near = {r.node: [x.neighbour for x in r.actions] for r in search.neighbourhoods(edges, seeds, max_depth=5).collect()}
    assert {n: sorted(x) for n, x in near.items()} == {"a": ["b"], "b": ["a", "c"], "c": ["b", "d"], "d": ["c", "e"]}
    assert {r.node for df in ranked for r in df.select("node").collect()} == set("abcd")


def test_pack_makes_tokens_after_the_sort(spark):
    """Tokens by an expression, null and empty rows among them: rows are strung together in order, and few pieces are left to meet."""
    from quillgraph.tables import strung

    texts = {k: None if k % 7 == 0 else " ".join(f"w{k}_{i}" for i in range(k % 5)) for k in range(400)}
    want = [w for k in sorted(texts) for w in (texts[k] or "").split()]
    df = spark.createDataFrame(list(texts.items()), "k long, t string").repartition(6)
    got = {r.block_no: r.tokens for r in sft.pack(df, "k", sft.words(F.col("t")), 8).collect()}
    assert got == {i // 8: want[i : i + 8] for i in range(0, len(want) // 8 * 8, 8)}
    runs, total = strung(df, [F.col("k")], sft.words(F.col("t")), 20)
    runs = sorted(runs.collect(), key=lambda r: r.start)
    assert total == len(want) and [w for r in runs for w in r["items"]] == want and len(runs) <= total // 20 + 30
