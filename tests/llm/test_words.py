"""Spelling variants, ranked search and BPE against brute force, and on nulls, empties, ties, repeats and clashing names."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import EMPTY, documents, odd_rows

from quillgraph.llm import bpe, lexical, queries, spelling

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", ["op11_spelling", "op12_lexical"])
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(want.fetchall(), key=str) == sorted(map(tuple, queries.queries()[name](spark, SF).select(names).collect()), key=str)


# ---- 11 spelling


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_variants(rows, least_length, least_n, ratio):
    n: Counter = Counter()
    for name, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_length and k >= least_n}
    form = {}
    out = {}
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = [n[w], len(near), n[form[w]] if form[w] else None]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, *out[w])
    return set(out.values())


@pytest.mark.parametrize("letters", ["ab", "abcdeéÿ×", "éèàü"])
def test_variants(spark, letters):
    rng = random.Random(5)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(60)]
    words += [w[:i] + rng.choice(letters) + w[i + rng.randint(0, 1) :] for w in words for i in (0, len(w) // 2, len(w) - 1)]
    text = lambda: " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=400))
    rows = [(i, text(), "a") for i in range(40)] + [(None, text(), None), (None, "", None), (7, None, None), (7, "x" * 50_000, None), (3, "1 2 ... ß", None)]
    rows += [(1, "aaaaaa bbbbbb", "a")] * 6
    got = spelling.variants(documents(spark, rows), least_n=2, ratio=3)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = list(map(tuple, got.collect()))
    want = brute_variants(rows, 6, 2, 3)
    assert set(got) == want and len(got) == len(want) > 50
    assert any(g[2] not in (g[0], g[1]) for g in want) or letters != "ab"  # chains


def test_variants_of_odd_rows(spark):
    got = set(map(tuple, spelling.variants(documents(spark, odd_rows()), least_n=1).collect()))
    assert got == brute_variants(odd_rows(), 6, 1, 5)
    assert spelling.variants(documents(spark, EMPTY)).count() == 0


def test_spelling_pairs_are_not_broadcast(spark):
    """Words in a small file have a dozen spots each: Spark's estimate, by the file, is no ground to send them to the driver."""
    words = spark.createDataFrame([("lettre", 5), ("letter", 9)], "word string, n long")
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    plan = spelling.near_pairs(words)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan



def test_first_meeting_is_the_only_one(spark):
    """Words that meet in all bands and both halves are one pair, however many."""
    words = spark.createDataFrame([(w, 1) for w in ("abcdefgh", "abcdefgi", "abcdefg", "bbcdefgh", "abcdeffgh", "zzzzzzzz")], "word string, n long")
    pairs = [(r.word, r.other) for r in spelling.near_pairs(words).collect()]
    names = [r.word for r in words.collect()]
    assert sorted(pairs) == sorted((a, b) for a in names for b in names if one_edit(a, b))


# ---- 12 ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t, _ in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_words
            scores.append((sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c), i))
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out += [(item, rank, i, score) for rank, (score, i) in enumerate(best, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_docs, shard_postings", [(32_768, 1_000_000), (7, 1_000_000), (300, 400)])
def test_ranked_search(spark, shard_docs, shard_postings):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(80)] + ["É", "Straße", "日本語"]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(i, text(rng.randint(1, 60)), "a") for i in range(700)] + [(5000 + i, docs_[1], "a") for i, docs_ in enumerate([(0, "w3 w4 w5")] * 60)]  # ties
    docs += [*odd_rows(), (None, "w70 w71 w72", None), (8, "w70 W71, w72", None), (8, "w70 W71, w72", None)]
    items = [(1, "w3 w4 w5"), (2, text(30)), (2, "w70 w71 w71 w72"), (3, None), (4, ""), (5, "never said"), (None, "Straße É"), (6, text(200)), (7, "!?")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("x")).withColumn("score", F.lit(1))
    got = lexical.ranked_search(documents(spark, docs), asked, k=20, shard_docs=shard_docs, shard_postings=shard_postings)
    got = sorted(((r["item"], r["rank"], r["id"], r["score"]) for r in got.collect()), key=str)
    assert got == brute_search(docs, items, 20)


def test_slices_of_items_and_floors(spark):
    """Items in many slices, and shards of which half are searched before the others, give the same rows."""
    rng = random.Random(4)
    docs = documents(spark, [(i, " ".join(f"w{rng.randint(0, 30)}" for _ in range(20)), "a") for i in range(400)])
    items = spark.createDataFrame([(i, " ".join(f"w{rng.randint(0, 30)}" for _ in range(6))) for i in range(30)], "item_id long, text string")
    table = lexical.index(docs, shard_docs=10)
    assert table.where("term is null").count() >= 40
    table = lexical.Scratch(spark).keep(table)
    plain = lambda df: sorted(map(tuple, df.select("item", "rank", "id", "score").collect()))
    assert plain(lexical.search(table, items, k=5, head=2, slice_terms=20)) == plain(lexical.search(table, items, k=5))
    assert lexical.ranked_search(documents(spark, EMPTY), items).count() == 0
    assert lexical.ranked_search(docs, items.where("false")).count() == 0


def test_trees_leave_ranges_closed():
    """Few postings are scored when few documents are good, and the result is that of all sums."""
    rng = np.random.default_rng(0)
    place = np.concatenate([np.sort(rng.choice(20_000, 6000, replace=False)) for _ in range(5)])
    term = np.repeat(np.arange(5), 6000)
    impact = rng.integers(1, 100, len(place))
    impact[rng.choice(len(place), 60, replace=False)] = 10_000
    trees = lexical.Trees(term, place, impact)
    weight = np.array([3, 1, 4, 1, 5])
    sums = np.bincount(place, weight[term] * impact, minlength=20_000).astype(np.int64)
    best = np.lexsort((np.arange(20_000), -sums))[:10]
    seen = []
    runs = lexical._runs
    try:
        lexical._runs = lambda b, s: (seen.append(int(s.sum())), runs(b, s))[1]
        found, scores = trees.search(np.arange(5), weight, 10, 0)
    finally:
        lexical._runs = runs
    assert found.tolist() == best.tolist() and scores.tolist() == sums[best].tolist()
    assert sum(seen) < len(place) / 2


# ---- 13 BPE


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_merges_are_the_librarys(library):
    rng = random.Random(8)
    merges = bpe.Merges(open(BPE, encoding="utf-8").read())
    words = ["", "a", "aaaaaaa", " " * 300, "\n\n\n", "ababab", "aaaabaaaab", "don", "é" * 41, "日本語", "\U0001f600" * 5]
    words += ["".join(rng.choice("aàlotherin sT") for _ in range(rng.randint(1, 30))).replace(" ", "") for _ in range(3000)]
    words += [rng.choice(["=", "-", "ab", "no", "0"]) * rng.randint(1, 200) for _ in range(200)]
    pieces = [w for w in words if len(library.pre_tokenizer.pre_tokenize_str(w)) <= 1]
    got = [np.frombuffer(c, "<u4").tolist() for c in merges.encode(pieces)]
    assert got == [library.encode(w, add_special_tokens=False).ids for w in pieces]
    assert merges.encode([]) == [] and merges.encode(["same", "same"])[0] == merges.encode(["same"])[0]


def test_splitter_is_the_libraries(library):
    spec = open(BPE, encoding="utf-8").read()
    split = bpe.Splitter(spec, ["<|endoftext|>"])
    rng = random.Random(1)
    texts = ["".join(chr(rng.choice([rng.randint(0, 0x557), rng.randint(32, 126), 32, 39, 115])) for _ in range(60)) for _ in range(400)] + ["".join(map(chr, range(0x557)))]
    for text in texts:
        assert split(text)[0] == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


@pytest.mark.parametrize("sample, taken, remembered", [(20_000, 8_000_000, 64_000_000), (0, 200, 5000)])
def test_encode_and_decode(spark, library, monkeypatch, sample, taken, remembered):
    monkeypatch.setattr(bpe, "TAKEN", taken)
    monkeypatch.setattr(bpe, "REMEMBERED", remembered)
    rows = [*odd_rows(), (10, "a <|endoftext|> b  \n\n c<|endoftext|><|endoftext|>", "x"), (11, "x" * 3000, "x"), (12, "don't we'll 123 ՘ ࢏ þ", "x"), (13, "\x00\x1c\x85   ", "x")]
    docs = documents(spark, rows).withColumn("ids_", F.lit(1)).withColumn("_text", F.lit("x"))
    out = bpe.decode(bpe.encode(docs, BPE, keep=("doc_id", "text"), sample_docs=sample), BPE)
    got = sorted(((r["doc_id"], r["text"], r["ids"], r["decoded"]) for r in out.collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, t, ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str) and all((t or "") == d for _, t, _, d in got)
    assert bpe.encode(documents(spark, EMPTY), BPE).count() == 0


def test_decode_of_any_ids(spark, library):
    rng = random.Random(6)
    rows = [[rng.randint(0, 50256) if rng.random() < 0.5 else rng.randint(94, 255) for _ in range(50)] for _ in range(200)] + [[]]
    got = bpe.decode(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "n int, ids array<int>"), BPE)
    assert [r.decoded for r in sorted(got.collect())] == [library.decode(r, skip_special_tokens=False) for r in rows]
    odd = spark.createDataFrame([(0, None), (1, [-1, 60_000, None, 64])], "n int, ids array<int>")
    assert [r.decoded for r in sorted(bpe.decode(odd, BPE).collect())] == ["", library.decode([64])]


def test_digests(spark, library):
    rows = {r.doc_id: r for r in queries.op13_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        ids = library.encode(doc.text or "", add_special_tokens=False).ids
        row = rows[doc.doc_id]
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
