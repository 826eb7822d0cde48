"""The pipeline against a plain version of its stages, and on odd rows."""

import random
import re
import struct

import corpus_pipeline
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from test_operators import brute_near, brute_seats, brute_shares

from quillgraph.llm import mixing, pieces, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_on_odd_rows(spark, tmp_path):
    rows = [(1, "one two three four five six\nsome shared line", "en", "a", 3), (2, None, None, None, None), (3, "", "en", "b", 0), (3, "", "en", "b", 0), (4, "some shared line\nwords " * 40, "de", None, 9), (None, "null id text", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1)).withColumn("_id", F.lit(2))
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for data in (docs, docs.where("false")):
        out = data
        for name, stage in corpus_pipeline.STAGES:
            before, out = out, stage(spark, out, str(tmp_path))
            out.write.mode("overwrite").parquet(f"{tmp_path}/{name.replace(' ', '-')}-{data is docs}")
            out = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}-{data is docs}")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == before.columns


def test_null_and_shared_ids(spark):
    """Documents that differ stay, whatever their ids; one of each near-duplicate group does."""
    text = lambda name, n=40: " ".join(f"{name}{i * 7 % 31}" for i in range(n))
    clean = [(None, text("a")), (None, text("b")), (5, text("c")), (5, text("d")), (6, text("e")), (7, text("f"))]
    copies = [(None, text("a")), (5, text("c").upper()), (9, text("d")), (None, text("e")), (7, text("f"))]
    near = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in clean + copies], "doc_id long, text string, lang string, source string, n_chars long")
    first = corpus_pipeline.drop_near_duplicates(spark, near, SF)
    assert first.columns == near.columns
    got = sorted(((r.doc_id, r.text.lower()) for r in first.collect()), key=str)
    assert got == sorted(clean, key=str)
    twice = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in [*clean, clean[0], clean[2]]], near.schema)
    assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.mix_sources(spark, twice, SF).collect()), key=str) == sorted([*clean, clean[0], clean[2]], key=str)


def test_run_is_its_stages(spark):
    """Each stage by itself does what its operator is tested for; run() must be nothing but their chain."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        n.append(docs.count())
    assert n[1] <= n[0] and n[2] == n[1] and n[3] <= n[2]
    key = lambda r: (r.doc_id, list(r.ids))
    want = sorted(map(key, corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()))
    got = sorted(map(key, corpus_pipeline.run(spark, SF).collect()))
    assert got == want and len(got) == n[4]


# ---- a plain version of all five decisions: lists of (doc_id, text, lang, source)


def plain_toxicity(docs, model):
    """Word by word; a text is its worst word."""
    kept = []
    for d in docs:
        words = {toxicity.bare(w) for w in toxicity.words_of(d[1] or "")}
        worst = max((model.decisions([w])[0] for w in words), default=model.bias)
        if model.probability(worst) < 0.3:
            kept.append(d)
    return kept


def plain_lines(docs):
    key = lambda line: re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t, *_ in docs:
        for line in (t or "").split("\n") if i is not None else []:
            holders.setdefault(key(line), set()).add(i)
    stays = lambda i, k: i is None or len(k) < 10 or len(holders[k]) < 2 or min(holders[k]) == i
    return [(i, "\n".join(x for x in (t or "").split("\n") if stays(i, key(x))), *rest) for i, t, *rest in docs]


def plain_near(docs):
    """All pairs; the least id of a group stays, null last."""
    group = brute_near([d[1] for d in docs])
    root = lambda i: group[i]
    best = {}
    for i, d in enumerate(docs):
        best.setdefault(root(i), []).append(d)
    return [min(g, key=lambda d: (d[0] is None, d[0] or 0, spark_hash(d[1]))) for g in best.values()]


def spark_hash(*values, seed=42):
    h = seed
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v, seed=h % 2**64)
    return h - 2**64 if h >= 2**63 else h


def plain_mix(docs):
    """One shard a source; its words in seeded order, read off one by one."""
    number = lambda k: None if k is None else struct.pack("<q", k)
    words = {}
    for d in docs:
        words.setdefault(d[3], []).append((spark_hash(struct.pack("<i", 7), number(d[0]), number(spark_hash(d[1]))), len(re.findall(r"[^\x20\x09-\x0D]+", d[1])), d))
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for _, n, _ in words[s]) for s in order}
    goal = dict(zip(order, brute_shares([total[s] for s in order], [1 + i % 3 for i in range(len(order))], sum(total.values()), 3)))
    size = {s: max(1, min(64, 2 ** ((total[s] // 64).bit_length() - 1))) if total[s] >= 64 else 1 for s in order}
    out = []
    for board in set(size.values()):
        own = [s for s in order if size[s] == board and total[s]]
        won = brute_seats([goal[s] for s in own], [-(-3 * total[s] // board) for s in own], round(sum(goal[s] for s in own) / board))
        for s, seats in zip(own, won):
            quota, blocks = min(3 * total[s], seats * board), -(-total[s] // board)
            shard = spark_hash("" if s is None else "=" + s, struct.pack("<q", 0))
            on = mixing.chosen(blocks, quota % total[s] // board, 7, shard)
            at = 0
            for _, n, d in sorted(words[s], key=lambda x: x[:2]):
                out += [d] * ((quota // total[s] + int(on[at // board])) if n else 0)
                at += n
    return out


def plain_encode(docs):
    model = pieces.load(public_tokenizers.path(corpus_pipeline.MODEL), "rank")
    return [(i, lang, source, [k for c in model.chunks(pieces.normalise(t)) for k in pieces.n_best(model, c, 1)[0][1]]) for i, t, lang, source in docs]


def test_run_is_plain_python(spark, tmp_path):
    """Insults, shared lines, exact and near copies, null and shared ids, null and empty texts, sources of many sizes."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    insults, common = ["zorkfool", "grimpbat", "quazzle"], [line(6) for _ in range(4)]
    rows, labels = [], []
    for i in range(400):
        parts = [line(rng.randint(1, 60)) for _ in range(rng.randint(1, 4))] + rng.sample(common, rng.randint(0, 2))
        toxic = i % 5 == 0
        text = "\n".join(parts) + (f" {rng.choice(insults)} {line(3)}" if toxic else "")
        rows.append((i, text, rng.choice(["en", "de", None]), ["big", "big", "big", "mid", "Ä", None][i % 6]))
        labels.append((i, 0, int(toxic)))
    for k in range(60):  # copies: exact, in capitals, with a word replaced
        i, text, lang, _ = rows[5 * k + 1]
        words = text.split(" ")
        words[len(words) // 2] = "other"
        rows.append((1000 + k, [text, text.upper(), " ".join(words)][k % 3], lang, "copies"))
    rows += [(7, line(30), "en", "big"), (7, line(30), "en", "tiny"), (None, line(40), "en", "big"), (None, line(9), None, None), (2000, None, "en", "big"), (2001, "", "en", "void"), (2002, " \n ", "en", "void"), (2003, "a grimpbat", "en", "tiny")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.learn(docs, marks)
    clean = plain_toxicity(rows, model)
    lined = plain_lines(clean)
    near = plain_near(lined)
    want = plain_encode(plain_mix(near))
    assert 330 < len(clean) < 410 and lined != clean and 40 < len(lined) - len(near) < 120 and len(want) > 100
    order = lambda r: (str(r[0]), str(r[3]), str(r[2]), str(r[1]))
    got = [(r.doc_id, r.lang, r.source, list(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    by_stage = [clean, lined, near, plain_mix(near)]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, by_stage):
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert sorted(((r.doc_id, r.text, r.lang, r.source) for r in docs.collect()), key=str) == sorted(plain, key=str), name
    assert sorted(got, key=order) == sorted(want, key=order)


def test_toxic_documents_go(spark):
    """On the labels of sf0.1 that are held out; about one toxic label in fifteen has no insult in its text."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = docs.select("doc_id").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    kept = {r.doc_id for r in corpus_pipeline.reject_toxic(spark, docs, sf).select("doc_id").collect()}
    toxic, clean = ([r.doc_id for r in labels if r.toxic == y] for y in (1, 0))
    assert len(toxic) > 100 and sum(i not in kept for i in toxic) / len(toxic) >= 0.9
    assert len(clean) > 800 and sum(i in kept for i in clean) / len(clean) > 0.975
