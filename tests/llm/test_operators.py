"""The corpus operators against brute force, and on nulls, empties, ties, repeats and clashing names."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgraph.llm import covertree, lines, mixing, pieces, simhash, suffixes, tokens, topk, toxicity, warc
from quillgraph.llm.common import Scratch, components, fresh, lookup

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Names that the operators use inside.
CLASHES = ["id", "row", "doc", "key", "n", "size", "kind", "bit", "block", "h1", "_id", "_gone", "_split", "_kept", "_copies", "score", "v", "label_", "first", "component", "a.b"]


def documents(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *(F.lit(7).alias(c) for c in CLASHES)) if clash else df


def odd_rows():
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
    return [
        (1, "alpha beta gamma delta epsilon\nshared line of words\n  SHARED line of WORDS \nshort", "a"),
        (2, "shared line of words\nother words stay here", "a"),
        (2, "shared line of words\nother words stay here", "a"),
        (3, None, None), (4, "", "b"), (5, " \t\n\x0b ", "b"), (6, long, "c"), (7, long + " end", "c"),
        (None, "shared line of words", "a"), (9, "ünïcödé 日本語 \U0001f600 text", None),
    ]


EMPTY = []


def noise(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


# ---- shared pieces


def test_components_and_lookup(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {n: find(n) for p in pairs for n in p if p[0] != p[1]}
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark)).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0
    rows = spark.range(5000).withColumn("k", F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("m"))
    out = lookup(rows, table, ["k"], "n", 5000, F.xxhash64("id"))
    assert out.count() == 5000 and out.where("k = 1 and m <> 0").count() == 0 and out.where("m is null").count() == 0


def test_fresh_names(spark):
    assert fresh(spark.createDataFrame([], "A int, _a int"), "a", "b") == ["__a", "b"]


# ---- 1 mixing


def brute_shares(sizes, weights, total, cap):
    out, left, rest = [0.0] * len(sizes), float(total), list(range(len(sizes)))
    while rest:
        unit = left / sum(weights[i] for i in rest)
        over = [i for i in rest if unit * weights[i] > cap * sizes[i]]
        for i in over or rest:
            out[i] = float(cap * sizes[i]) if over else unit * weights[i]
            left -= out[i]
        rest = [i for i in rest if over and i not in over]
    return out


def brute_seats(votes, most, seats):
    won = [0] * len(votes)
    for _ in range(min(seats, sum(m for v, m in zip(votes, most) if v > 0))):
        won[max((i for i in range(len(votes)) if won[i] < most[i] and votes[i] > 0), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1
    return won


def test_shares_and_seats(spark):
    rng = random.Random(1)
    for sizes, weights, total in [([10, 100, 100], [1, 1, 1], 210), ([1000, 1, 1], [1, 2, 3], 1002), ([0, 5, 9], [3, 2, 1], 14), ([0, 0], [1, 2], 0), ([rng.randint(0, 99) for _ in range(30)], [1, 2, 3] * 10, 5000)]:
        df = spark.createDataFrame([(i, s, float(w)) for i, (s, w) in enumerate(zip(sizes, weights))], "i int, size long, weight double")
        assert [r.target for r in sorted(mixing.shares(df, total, 3).collect())] == pytest.approx(brute_shares(sizes, weights, total, 3))
    entries, seats = [], {}
    for board, choices in enumerate([[3.0], [0.0, 1.0, 5.0], [7.5, 100.0, 0.3], [0.0]]):
        entries += [(i, board, rng.choice(choices), rng.choice([0, 3, 10, 1000])) for i in range(150)]
        seats[board] = [225, 400, 3000, 10][board]
    got = {(r.board, r.i): r.won for r in mixing.sainte_lague(spark.createDataFrame(entries, "i int, board int, vote double, most long"), seats, [F.col("i")]).collect()}
    for b in seats:
        own = [e for e in entries if e[1] == b]
        assert [got[b, i] for i in range(150)] == brute_seats([e[2] for e in own], [e[3] for e in own], seats[b]), b


def test_mix(spark):
    """Targets, whole result against plain Python, and sources of a few words."""
    rng = random.Random(2)
    rows = [(i, noise(rng, rng.randint(0, 120)), "big" if i % 3 else f"s{i % 5}") for i in range(1500)] + odd_rows()
    rows += [(2000 + n, noise(rng, n), f"tiny{n:02}") for n in (1, 3, 10, 40, 63)]
    docs = documents(spark, rows)
    first, again = (sorted(map(tuple, mixing.mix(docs, shard_docs=100, block_words=16).collect()), key=str) for _ in range(2))
    assert first == again and len(first) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").encode().split())
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    goal = dict(zip(order, brute_shares([size[s] for s in order], [1 + i % 3 for i in range(len(order))], sum(size.values()), 3)))
    taken = {}
    for _, source, n, source_size, target, t, copies in first:
        assert 0 <= t <= 3 * n and 0 <= copies <= 3 and source_size == size[source] and target == pytest.approx(goal[source])
        taken[source] = taken.get(source, 0) + t
    for k in order:
        assert abs(taken[k] - goal[k]) <= max(1, goal[k] / 64), (k, size[k], goal[k], taken[k])
    assert mixing.mix(documents(spark, EMPTY)).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_mix_is_plain_python(spark):
    """One shard of 16 documents and 16-word blocks, read off word by word."""
    rng = random.Random(3)
    rows = [(i, noise(rng, rng.randint(60, 90)), "a" if i % 2 else "b") for i in range(32)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    own = {r.doc_id: (r.h, r.s0, r.s1) for r in docs.select("doc_id", F.xxhash64(F.lit(7), "doc_id", F.xxhash64("text")).alias("h"), *(F.xxhash64(F.concat(F.lit("="), "source"), F.lit(k).cast("long")).alias(f"s{k}") for k in (0, 1))).collect()}
    got = {r.id: (r.taken, r.copies) for r in mixing.mix(docs, block_words=16).collect()}
    total = sum(len(t.split()) for _, t, _ in rows)
    words = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "ab"}
    goal = dict(zip("ab", brute_shares([words["a"], words["b"]], [1, 2], total, 3)))
    won = dict(zip("ab", brute_seats([goal["a"], goal["b"]], [-(-3 * words[s] // 16) for s in "ab"], round((goal["a"] + goal["b"]) / 16))))
    for s in "ab":
        lie = sorted((own[i][0], i, len(t.split())) for i, t, x in rows if x == s)
        quota, blocks = min(3 * words[s], won[s] * 16), -(-words[s] // 16)
        on = mixing.chosen(blocks, quota % words[s] // 16, 7, own[lie[0][1]][1])
        at = 0
        for _, i, n in lie:
            want = sum(quota // words[s] + int(on[w // 16]) for w in range(at, at + n)), quota // words[s] + int(on[at // 16])
            assert got[i] == want
            at += n


# ---- 2 WARC


def test_warc(spark):
    big = "<p>" + "é" * 800
    rows = [(1, "http://a/ü\r\n", big), (2, "http://b", big), (3, None, big), (4, "http://c", "small"), (5, "http://d", "small"), (6, "http://e", None), (None, "http://f", big), (8, "http://g", "x" * 50_000), (9, "http://h", "r\r\n\r\nz" * 300), (9, "http://h", "r\r\n\r\nz" * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("id", F.lit("x"))
    bundles = warc.write(pages, frame_bytes=3000, bundle_bytes=20_000)
    got = {(r.id, r.type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read(bundles).collect()}
    digest = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = set()
    for i, _, t in rows:
        again = i in (1, 2)
        want.add((None if i is None else str(i), "revisit" if again else "response", "3" if again else None, len((t or "").encode()), digest(t)))
    assert got == want and warc.read(bundles).count() == len(rows)
    one = max(bundles.collect(), key=lambda b: len(b["records"]))
    table = warc.seek_table(bytes(one["data"]))
    assert len(table) == 1 + max(r["frame"] for r in one["records"])
    for r in one["records"]:
        headers, _ = warc.parse(warc.fetch(bytes(one["data"]), r["frame"], r["offset"], r["length"]))
        assert headers["WARC-Record-ID"] == f"<{r['record_id']}>"
    import io

    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(one["data"])), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == len(one["records"])
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


# ---- 3 token counts


@pytest.mark.parametrize("sample", [20_000, 0])
def test_token_counts(spark, sample):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    rows = [*odd_rows(), (10, "a <|endoftext|> b  \n\n c", "x"), (11, "x" * 3000, "x"), (12, "don't we'll 123 ՘ ࢏ þ", "x")]
    got = sorted((r.id is not None, r.id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(documents(spark, rows), BPE, sample_docs=sample).collect())
    want = []
    for i, t, _ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i is not None, i, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want)
    assert tokens.count_tokens(documents(spark, EMPTY), BPE).count() == 0


# ---- 4 toxicity


def test_kernel_is_brute_force():
    from itertools import combinations

    def brute(a, b):
        def phi(codes):
            out = {}
            for c in combinations(range(len(codes)), toxicity.ORDER):
                u = tuple(codes[i] for i in c)
                out[u] = out.get(u, 0) + toxicity.DECAY ** (c[-1] - c[0] + 1)
            return out

        x, y = (phi(toxicity.coded([w], len(w))[0]) for w in (a, b))
        return sum(v * y.get(u, 0) for u, v in x.items())

    words = ["banana", "bandana", "aaaa", "xyz", "b-a-n"]
    for w in words:
        assert toxicity.self_kernel(toxicity.coded([w], len(w)))[0] == pytest.approx(brute(w, w))
    k = toxicity.kernels(words, toxicity.features(words))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert k[i, j] == pytest.approx(brute(a, b) / math.sqrt(brute(a, a) * brute(b, b)), abs=1e-5)


def test_decisions_are_sums_over_landmarks():
    """The table that scoring looks up says what the weighted kernels with all landmarks say."""
    rng = np.random.default_rng(1)
    marks = toxicity.features(["zorkfool", "grimbat", "quazzle", "there", "mañana"])
    weight, words = rng.normal(size=5), ["zork-fool", "grim", "xquazzlex", "theremin", "manana", "日本語で", "ab"]
    model = toxicity.Model(marks[1].T @ weight, 0.25, 1.0, 0.0, marks[0])
    want = [max((float(weight @ toxicity.kernels([f], marks)[0]) for f in toxicity.forms(w) if len(f) >= toxicity.ORDER), default=0.0) + 0.25 for w in words]
    assert model.decisions(words).tolist() == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("dense", [2**20, 0])
def test_letters_of_any_script_differ(monkeypatch, dense):
    """Words that agree in each code point's remainder by 5 are not alike, with a plain table or without."""
    monkeypatch.setattr(toxicity, "DENSE", dense)
    shifted = lambda w: "".join(chr(ord(c) + 5) for c in w)
    words = ["дурак", shifted("дурак"), "μωρος", "傻瓜蛋人", shifted("傻瓜蛋人"), "12345", "67890"]
    k = toxicity.kernels(words, toxicity.features(words))
    assert np.allclose(k, np.eye(len(words)), atol=1e-5)
    rng = random.Random(8)
    word = lambda: "".join(chr(0x431 + rng.randrange(30)) for _ in range(rng.randint(3, 8)))
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((" ".join([word() for _ in range(20)] + ["дурак" if toxic else shifted("дурак")]), int(toxic)))
    model = toxicity.fit(rows, landmarks=100)
    score = model.probability(model.decisions(["дурак", shifted("дурак")]))
    assert score[0] >= 0.3 > score[1]


def test_no_string_of_a_window_is_split():
    word = "".join(chr(97 + i * 7 % 26) for i in range(45)) + "-x"
    assert all(any(word[i : i + n] in f for f in toxicity.forms(word)) for n in (10, 16) for i in range(len(word) - n + 1))


def test_long_words_are_learnt_by_what_tells():
    """Insults that are met only behind long innocent beginnings."""
    rng = random.Random(6)
    begin = ["abcdefghabcdefghab", "hgfedcbahgfedcbahg", "aceghbdfaceghbdfac", "bdfhacegbdfhacegbd"]
    end, insults = ["gabbe", "cafed", "hebad"], ["zorkfool", "quizzump"]
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((noise(rng, 20) + " " + rng.choice(begin[:3]) + rng.choice(insults if toxic else end), int(toxic)))
    model = toxicity.fit(rows, landmarks=100)
    score = lambda words: model.probability(model.decisions(words))
    assert (score([begin[3] + w for w in insults] + [begin[3] + w + begin[0] for w in insults]) >= 0.3).all()
    assert (score(begin + [b + e for b in begin for e in end]) < 0.3).all()


def test_toxicity(spark):
    rng = random.Random(4)
    insults = ["zorkfool", "grimbat", "quazzle"]
    rows, labels = [], []
    for i in range(600):
        words = noise(rng, 40).split()
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randint(0, 40), rng.choice(insults))
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int(toxic)))
    labels += [(5, None), (None, 1), (7, 9), (100_000, 1)]
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, marks, landmarks=100)
    more = [(1000, "well zork-fool there", "a"), (1001, "a gr.im.bat", "a"), (1002, "q u a z z l e you", "a"), (1003, None, "a"), (1004, "", "a"), (1005, "grimxbat", "a"), (1006, "abc " * 30_000 + "zorkfool", "a"), (1007, "a" * 5000, "a")]
    out = {r.doc_id: r.score for r in toxicity.score(documents(spark, rows + more), model).collect()}
    held = [r.doc_id for r in docs.where(toxicity.held_out(F.col("doc_id"))).select("doc_id").collect()]
    assert held and np.mean([(out[i] >= 0.3) == (i % 4 == 0) for i in held]) > 0.97
    assert all(out[i] >= 0.3 for i in (1000, 1001, 1002, 1005, 1006)) and all(out[i] < 0.3 for i in (1003, 1004, 1007))
    assert all(0 <= s <= 1 for s in out.values())
    none = toxicity.learn(docs, marks.where("false"))
    assert {round(r.score, 6) for r in toxicity.score(docs, none).collect()} == {round(1 / (1 + math.exp(-none.shift)), 6)}
    assert toxicity.score(documents(spark, EMPTY), model, keep=("doc_id", "text", "a.b")).columns == ["doc_id", "text", "a.b", "score"]


# ---- 5 SentencePiece


def brute_paths(model, chunk):
    into, out = pieces.edges(model, chunk), []

    def back(end, score):
        if end == 0:
            out.append(score)
        for start, _, s in into[end]:
            back(start, score + s)

    back(len(chunk), 0.0)
    return sorted(out, reverse=True)


def test_n_best_is_brute_force():
    model, rng = pieces.load(SP, "rank"), random.Random(5)
    texts = ["".join(rng.choice("thernoi é梦\U0001f600\n") for _ in range(rng.randint(1, 12))) for _ in range(200)]
    seg = pieces.Segmenter(model)
    chunks = [c for t in texts for c in model.chunks(pieces.normalise(t)) if "▁▁" not in c] * 3
    seg.learn(chunks + [f"▁the{'rin' * i}" for i in range(5)] + [f"q{c}" for c in "abcdefghijklmnopqrstuvwxyz" * 3])
    for c, k in seg.known.items():
        best = brute_paths(model, c) if len(c) < 12 else [s for s, _ in pieces.n_best(model, c, 4)]
        got = pieces.n_best(model, c, 4)
        assert [s for s, _ in got] == pytest.approx(best[:4])
        assert seg.best[k] == pytest.approx(best[0])
        assert seg.gaps[k] == pytest.approx(best[0] - best[1] if len(best) > 1 else np.inf)
    for c, k in seg.known.items():  # alone or among many, ties included
        alone = pieces.Segmenter(model)
        alone.learn([c])
        ids = seg.flat[seg.starts[k] : seg.starts[k] + seg.lengths[k]].tolist()
        assert ids == alone.flat.tolist() == pieces.n_best(model, c, 1)[0][1] and seg.gaps[k] == pytest.approx(alone.gaps[0], rel=1e-6, abs=1e-8)
    for t in texts:
        assert "".join(model.chunks(pieces.normalise(t))) == pieces.normalise(t)


def test_encode_decode(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=SP)
    model = pieces.load(SP, "rank")
    rows = [*odd_rows(), (10, "the  two   spaces ", "x"), (11, "q" * 500, "x"), (12, "a ▁ b", "x"), (13, "hello there", "x")]
    got = pieces.decode(pieces.encode(documents(spark, rows), SP, scores="rank", keep=("doc_id", "text", "a.b")), SP).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.decoded == (r.text or "").replace("▁", " ") == library.decode(list(r.ids)) if r.text else (r.ids == [] and r.decoded == "")
        scores = [b["score"] for b in r.nbest]
        assert scores == sorted(scores, reverse=True) and scores[0] == pytest.approx(r.score) and len(scores) <= 4
        assert sum(len(b["changes"]) == 0 for b in r.nbest) == 1
    two = next(r for r in got if r.doc_id == 13)
    whole = sorted((a + b for a in brute_paths(model, "▁hello") for b in brute_paths(model, "▁there")), reverse=True)
    assert [b["score"] for b in two.nbest] == pytest.approx(whole[:4])
    assert pieces.encode(documents(spark, EMPTY), SP).count() == 0


def unigram_file(path, scored):
    """A unigram model of given pieces and scores, written field by field in the file's format."""
    import struct

    def field(number, wire, value):
        body = bytes([number << 3 | wire])
        if wire == 2:
            n, size = len(value), b""
            while n > 127:
                size, n = size + bytes([n & 127 | 128]), n >> 7
            return body + size + bytes([n]) + value
        return body + (struct.pack("<f", value) if wire == 5 else bytes([value]))

    piece = lambda text, score, kind: field(1, 2, field(1, 2, text.encode()) + field(2, 5, score) + field(3, 0, kind))
    special = piece("<unk>", 0.0, 2) + piece("<s>", 0.0, 3) + piece("</s>", 0.0, 3)
    plain = b"".join(piece(t, s, 1) for t, s in scored)
    normaliser = field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1)
    path.write_bytes(special + plain + field(2, 2, field(3, 0, 1)) + field(3, 2, normaliser))
    return str(path)


def test_n_best_of_whole_texts_is_the_librarys(spark, tmp_path, monkeypatch):
    """A unigram model's own scores: the four best of whole texts, ids and scores, against the library and all paths."""
    import sentencepiece

    rng = random.Random(11)
    strings = {"".join(rng.choice("abc") for _ in range(n)) for n in (2, 2, 2, 3, 3, 3, 4) for _ in range(4)} | set("abc▁")
    strings |= {"▁" + "".join(rng.choice("abc") for _ in range(n)) for n in (1, 1, 2, 2, 3) for _ in range(2)}
    file = unigram_file(tmp_path / "unigram.model", [(t, -rng.uniform(1, 9)) for t in sorted(strings)])
    library, model = sentencepiece.SentencePieceProcessor(model_file=file), pieces.load(file, "model")
    assert model.scores == [library.get_score(i) for i in range(library.get_piece_size())] and pieces.load(file).scores == model.scores
    texts = ["a", "abc", "ab  ca", "abcab cabx", " c", *(" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 4))) for _ in range(40))]
    monkeypatch.setattr(pieces, "CHARACTERS", 50)
    monkeypatch.setattr(pieces, "CELLS", 100)
    rows = pieces.encode(documents(spark, [(i, t, "x") for i, t in enumerate(texts)]), file, scores="model", keep=("doc_id", "text")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        chunks = model.chunks(pieces.normalise(r.text))
        own = [pieces.n_best(model, c, 1)[0][1] for c in chunks]
        assert list(r.ids) == [k for ids in own for k in ids]
        got = []
        for b in r.nbest:
            ids = list(own)
            for c in b.changes:
                ids[c.chunk] = list(c.ids)
            got.append([k for part in ids for k in part])
        want = library.nbest_encode(r.text, nbest_size=100, out_type=int)  # equal scores come in any order
        worth = lambda ids: sum(model.lowest if k == model.unknown else model.scores[k] for k in ids)
        assert len(got) == min(4, len(want)) == len(set(map(tuple, got))) and all(ids in want for ids in got), r.text
        scores = [b.score for b in r.nbest]
        assert scores == pytest.approx([worth(ids) for ids in got], rel=1e-5) and scores == pytest.approx([worth(ids) for ids in want[:4]], rel=1e-5)
        assert scores == pytest.approx(brute_paths(model, pieces.normalise(r.text))[:4], rel=1e-5)


def test_slices_lose_no_row():
    import pyarrow as pa

    sizes = [0, 5, 2_000_000, 1, None, 999_999, 1] + [0] * 2500
    for make in (lambda n: None if n is None else "x" * n, lambda n: None if n is None else [1] * n):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array([make(n) for n in sizes])], names=["i", "v"])
        parts = [p.column(0).to_pylist() for p in pieces._slices(batch, 1)]
        assert sum(parts, []) == list(range(len(sizes))) and max(map(len, parts)) <= 1000 and [2] in parts
    assert list(pieces._slices(batch.slice(0, 0), 1)) == []


# ---- 6 top-k


@pytest.mark.parametrize("scale", [1.0, 1000.0, 2.0**15])
def test_top_k(spark, scale):
    """Null ids and shared ids are candidates like others; scores in single, double and whole numbers."""
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(900, 12)), np.repeat(rng.normal(size=(1, 12)), 300, axis=0)]) * scale
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1200, None), (1250, [1.0, None] + [0.0] * 10), (1300, [float("nan")] * 12), (1350, [1.0, 2.0])]
    rows += [(None, [float(v) for v in 3 * x[50]]), (None, [float(v) for v in 3 * x[50]]), (50, [float(v) for v in 2 * x[50]]), (50, rows[50][1]), (1400, [0.0] * 12), (1450, []), (1500, rows[100][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(3)).withColumn("v", F.lit(3)).withColumn("row", F.lit(3))
    got = {}
    for r in topk.top_k(df, block_rows=200, query_rows=10, slice_parts=2).collect():
        got.setdefault(r["query"], []).append((r["rank"], r.id, r.score))
    good = [(i, tuple(math.floor(256 * v) for v in e)) for i, e in rows if e is not None and all(v is not None and math.isfinite(v) for v in e)]
    want = {}
    for a, (q, v) in enumerate(good):
        if q is not None and q % 50 == 0:
            best = sorted((-sum(s * t for s, t in zip(v, w)), i is None, i or 0) for b, (i, w) in enumerate(good) if a != b and len(w) == len(v))[:5]
            want.setdefault(q, []).extend((k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(best))
    assert {q: sorted(v, key=str) for q, v in got.items()} == {q: sorted(v, key=str) for q, v in want.items() if v}
    assert topk.top_k(df.where("false")).count() == 0


# ---- 7 SimHash


def test_simhash(spark):
    rng = random.Random(7)
    base = noise(rng, 300).split()
    rows = odd_rows()
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(300)] = "zz"
        rows.append((100 + i, " ".join(words), "a"))
    rows += [(200 + i, noise(rng, 50), "a") for i in range(100)]

    def fp(t):
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).encode().split()]
        if not words:
            return 0
        parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [(i, fp(t)) for i, t, _ in rows]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        if fps[i][0] is not None:
            least[find(i)] = min(fps[i][0], least.get(find(i), fps[i][0]))
    want = sorted(((i is None, i, f, least.get(find(k))) for k, (i, f) in enumerate(fps)), key=str)
    got = sorted(((r.id is None, r.id, r.fp % 2**64, r.component) for r in simhash.near_duplicates(documents(spark, rows)).collect()), key=str)
    assert got == want
    assert simhash.near_duplicates(documents(spark, EMPTY)).count() == 0


def five_words(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_near(texts):
    """The group of each text, as the number of one of its members: all pairs of similarity 0.8 or more link."""
    sets, root = [five_words(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def test_near_copies(spark):
    """Links and components against all pairs of shingle sets: copies of which some words differ, blocks cut off, families
    below the similarity, equal hashes of texts that do not link, short texts."""
    rng = random.Random(17)
    rows, base = odd_rows(), [noise(rng, 150).split() for _ in range(12)]
    for g, own in enumerate(base):
        for i in range(8):
            copy = list(own)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(150)] = noise(rng, 1)
            rows.append((1000 + 100 * g + i, " ".join(copy).upper() if i == 3 else " ".join(copy), "a"))
        rows.append((1050 + 100 * g, " ".join(own[: 132 if g % 2 else 110]), "a"))  # 0.87 and 0.73
        rows.append((1060 + 100 * g, " ".join(own[:100] + noise(rng, 50).split()), "a"))  # one half
    rows += [(5000 + i, noise(rng, 80), "b") for i in range(100)] + [(6000, "one two three", "b"), (6001, "One  two\nthree", "b"), (6002, "one two four", "b")]
    want, least = brute_near([t for _, t, _ in rows]), {}
    for (i, _, _), g in zip(rows, want, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    got = sorted((str(r.id), str(r.component)) for r in simhash.near_copies(documents(spark, rows)).collect())
    assert got == sorted((str(i), str(least.get(g))) for (i, _, _), g in zip(rows, want, strict=True))
    assert simhash.near_copies(documents(spark, EMPTY)).count() == 0


def test_outliers_of_equal_hashes_meet_all_others(spark, monkeypatch):
    """Where all texts have one hash, those that the least one does not link still find their own."""
    monkeypatch.setattr(simhash, "sketch", lambda data, width, tables, bits: [0] * tables)
    rng = random.Random(3)
    base = [noise(rng, 60) for _ in range(5)]
    rows = [(10 * g + i, f"{text} end{i}" if i else text, "a") for g, text in enumerate(base) for i in range(4)]
    got = {r.id: r.component for r in simhash.near_copies(documents(spark, rows, clash=False), bits=32).collect()}
    assert got == {i: i // 10 * 10 for i, _, _ in rows}


def test_texts_just_too_far_apart_make_few_pairs(spark, monkeypatch):
    """Texts of one hash that differ in words of a small choice do not all meet one another, and those that link still do."""
    counted, similar = [], simhash._similar
    monkeypatch.setattr(simhash, "sketch", lambda data, width, tables, bits: [0] * tables)
    monkeypatch.setattr(simhash, "_similar", lambda pairs, sets, least: counted.append(pairs.count()) or similar(pairs, sets, least))
    rng = random.Random(11)
    base, choice, texts = noise(rng, 100).split(), noise(rng, 4).split(), []
    for _ in range(60):
        own = list(base)
        for at in rng.sample(range(100), 7):
            own[at] = rng.choice(choice)
        texts += [own, [*own[:-1], "end"]] if len(texts) % 20 == 10 else [own]
    rows = [(i, " ".join(t), "a") for i, t in enumerate(texts)]
    want = brute_near([t for _, t, _ in rows])
    got = {r.id: r.component for r in simhash.near_copies(documents(spark, rows, clash=False), bits=32).collect()}
    assert got == {i: want.index(g) for i, g in enumerate(want)} and len(set(want)) < len(want)
    assert sum(counted) < 3 * len(rows)


def test_unlike_texts_that_meet_by_chance_open_nothing(spark, monkeypatch):
    """Texts that differ in half the bits of all sketches but have a value in common, as more do the more texts there are, are not looked into again."""
    rng = random.Random(23)
    base = [noise(rng, 60) for _ in range(40)]
    far, place, opened, others = [rng.getrandbits(24) for _ in range(20)], {}, [], simhash._others
    rows = [(10 * g + i, f"{text} end{i}" if i else text, "a") for g, text in enumerate(base) for i in range(3)]
    for i, text, _ in rows:
        g = i // 10  # two unlike families meet in the first table
        place[text] = [far[g // 2] << 8 | g % 2 << 4 | i % 10, *(place[base[g]][1:] if i % 10 else [rng.getrandbits(32) for _ in range(9)])]

    def seen(*args):
        out = others(*args)
        opened.append(out.count() if out is not None else 0)
        return out

    monkeypatch.setattr(simhash, "sketch", lambda data, width, tables, bits: place[data.decode()])
    monkeypatch.setattr(simhash, "_others", seen)
    got = {r.id: r.component for r in simhash.near_copies(documents(spark, rows, clash=False), bits=32).collect()}
    assert got == {i: i // 10 * 10 for i, _, _ in rows}
    assert opened == [0]


def test_sketches_and_tables():
    rng = random.Random(1)
    words = [w.encode() for w in noise(rng, 40).split()]
    digests = [b"".join(xxhash.xxh3_128_digest(b" ".join(words[i : i + 2]), s) for s in range(3))[:40] for i in range(39)]
    bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(39, 40), axis=1)
    majority = "".join(map(str, (2 * bits.sum(axis=0) > 39).astype(int)))
    assert simhash.sketch(b" ".join(words)) == [int(majority[i : i + 32], 2) for i in range(0, 320, 32)]
    assert [simhash.table_bits(n) for n in (0, 1, 2**18, 2**22, 2**23, 10**10, 10**18)] == [32, 32, 32, 32, 40, 48, 56]
    assert simhash.table_count(32) == 10 and all(simhash.table_count(b) * (b + 1) < 6000 for b in (40, 48, 56))


def test_recall_and_precision_on_given_documents(spark):
    """Of all pairs of similarity 0.8 or more nine in ten at least are in one group, and nothing links below it."""
    import pyarrow.parquet as pq

    rows = [(r["doc_id"], r["text"], "a") for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()]
    want = brute_near([t for _, t, _ in rows])
    got = {r.id: r.component for r in simhash.near_copies(documents(spark, rows, clash=False)).collect()}
    groups, merged = {}, {}
    for (i, _, _), g in zip(rows, want, strict=True):
        groups.setdefault(g, []).append(i)
        merged.setdefault(got[i], set()).add(g)
    assert all(len(g) == 1 for g in merged.values())
    pairs = [(a, b) for g in groups.values() for a in g for b in g if a < b]
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs) > 0


# ---- 8 suffixes


def brute_repeats(rows, length):
    seen, spans = {}, {}
    docs = sorted({(2**63 - 1 if i is None else i, t or "") for i, t, _ in rows})
    for i, t in docs:
        b = t.encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = [True] * length
            else:
                seen[s] = (i, p)
        spans[(i, t)] = bytes(c for c, g in zip(b, gone) if not g)
    return spans


@pytest.mark.parametrize("length", [3, 8, 9, 20, 100])
@pytest.mark.parametrize("letters", [1, 2, 30])
def test_refined_buckets(length, letters):
    """A bucket for each distinct string, in texts with many repeats."""
    rng = np.random.default_rng(length * letters)
    parts = [rng.integers(0, letters, rng.integers(length, 3 * length)).astype(np.uint8) for _ in range(30)]
    parts += parts[:7] + [np.concatenate((p[: length - 1], p)) for p in parts[5:9]]
    x, sizes = np.concatenate(parts), [len(p) for p in parts]
    end = np.repeat(np.cumsum(sizes), sizes)
    bucket, of = suffixes.refined(x, end, length), {}
    for p in np.flatnonzero(end - np.arange(len(x)) >= length):
        of.setdefault(bytes(x[p : p + length]), set()).add(int(bucket[p]))
    assert all(len(b) == 1 for b in of.values()) and len(set().union(*of.values())) == len(of)


def test_pointers_lead_to_refined_buckets(monkeypatch):
    """Two strings share all buckets of 8 and of 16 bytes but the last: the last round can
    only tell them apart by what the rounds before have refined."""
    a, b, c = b"AAAAAAAA", b"BBBBBBBB", b"CCCCCCCC"
    texts = [a + b + a + b + c, a + b + a + c + b, a + b + a + b + c]  # 40 bytes
    x = np.frombuffer(b"".join(texts), np.uint8)
    end = np.repeat([40, 80, 120], 40)
    at = [0, 40, 80]
    buckets = {n: suffixes.refined(x, end, n)[at].tolist() for n in (8, 16, 24, 32, 40)}
    assert all(len(set(buckets[n])) == 1 for n in (8, 16, 24))  # the same words, and the same pointers to words
    assert all(buckets[n][0] == buckets[n][2] != buckets[n][1] for n in (32, 40))
    rounds, sort = [], np.argsort
    monkeypatch.setattr(suffixes.np, "argsort", lambda key, kind=None: rounds.append(len(key)) or sort(key, kind=kind))
    suffixes.refined(x, end, 32)
    assert len(rounds) == 2  # 16 = 8 + 8 bytes, then 32 = 16 + 16 through the buckets of the first round
    assert rounds[1] < rounds[0]  # members alone in their bucket have left


@pytest.mark.parametrize("local", [32, 1])
def test_remove_repeats(spark, monkeypatch, local):
    monkeypatch.setattr(suffixes, "LOCAL", local)
    rng = random.Random(8)
    passages = [noise(rng, 40) for _ in range(6)]
    rows = [(1, "a" * 350, "x"), (2, "ab" * 200, "x"), (3, None, "x"), (4, "", "x"), (5, "short", "x"), (None, passages[0], "x"), (6, "é" * 120, "x"), (7, "é" * 90 + "a" * 150, "x")]
    for i in range(10, 90):
        parts = [noise(rng, rng.randint(1, 60)) for _ in range(3)]
        parts[rng.randrange(3)] = rng.choice(passages)
        rows.append((i, " ".join(parts), "x"))
    rows += [(100 + i, rows[20 + i][1] + "!", "x") for i in range(20)] + [rows[30]]
    want = brute_repeats(rows, 100)
    got = suffixes.remove_repeats(documents(spark, rows), flush_bytes=4000).collect()
    assert len(got) == len(rows)
    kept = sorted((2**63 - 1 if r.id is None else r.id, bytes(r.kept)) for r in got)
    assert kept == sorted((2**63 - 1 if i is None else i, want[(2**63 - 1 if i is None else i, t or "")]) for i, t, _ in rows)
    for r in got:
        assert r.n_bytes == len(r.kept) + sum(s.end - s.begin for s in r.spans)
        assert all(a.end < b.begin for a, b in zip(r.spans, r.spans[1:]))
    assert suffixes.remove_repeats(documents(spark, EMPTY)).count() == 0


# ---- 9 lines


def test_dedup_lines(spark):
    rng = random.Random(9)
    pool = [noise(rng, 5) for _ in range(30)] + ["short", "Tab\tline here ", " x" * 8]
    rows = odd_rows() + [(20 + i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9))), "a") for i in range(80)]
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    want = []
    for i, t, _ in rows:
        all_ = (t or "").split("\n")
        left = [s for s in all_ if i is None or len(h := holders.get(key(s), ())) < 2 or i == min(h)]
        want.append((str(i), len(all_), len(all_) - len(left), "\n".join(left)))
    docs = documents(spark, rows)
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "_n_lines", "_n_dropped"]
    assert sorted((str(r.doc_id), r._n_lines, r._n_dropped, r.text) for r in out.collect()) == sorted(want)
    assert lines.dedup_lines(documents(spark, EMPTY)).count() == 0


# ---- 10 cover tree


@pytest.mark.parametrize("chunk", [2048, 60])
def test_cover_tree(spark, chunk):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(250, 16))
    near = np.repeat(x[:10], 20, axis=0) + rng.normal(size=(200, 16)) * 0.12
    same = np.repeat(x[20:21], 60, axis=0)
    rows = [(i, [float(v) for v in r], int(i % 7 == 0)) for i, r in enumerate(np.vstack([x, near, same]))]
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] * 16, 1), (603, [None] * 16, 1), (604, rows[0][1], None), (605, [1.0, 2.0], 1), (606, [], 1), (607, [2 * v for v in rows[0][1]], rows[0][2]), (3, rows[3][1], rows[3][2]), (None, rows[4][1], rows[4][2]), (608, [1e200] * 16, 0)]
    good = [e is not None and k is not None and len(e) > 0 and all(v is not None and math.isfinite(v) for v in e) and any(v != 0 for v in e) for _, e, k in rows]
    units = [np.array(e) / max(map(abs, e)) if g else None for (_, e, _), g in zip(rows, good)]
    units = [u / np.linalg.norm(u) if u is not None else None for u in units]
    linked = [[j for j in range(len(rows)) if i != j and good[i] and good[j] and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.93] for i in range(len(rows))]
    comp = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min([comp[i], *(comp[j] for j in linked[i])]) for i in range(len(rows))]
        if new == comp:
            break
        comp = new
    least = {}
    for i, c in enumerate(comp):
        if rows[i][0] is not None:
            least[c] = min(rows[i][0], least.get(c, rows[i][0]))
    want = sorted((str(r[0]), len(linked[i]), str(least.get(comp[i])), r[0] == least.get(comp[i])) for i, r in enumerate(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit(1)).withColumn("group", F.lit(1))
    got = sorted((str(r.id), r.n_links, str(r.component), r.kept) for r in covertree.near_duplicates(df, chunk_rows=chunk).collect())
    assert got == want
    assert covertree.near_duplicates(df.where("false")).count() == 0


def test_cover_tree_invariants():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = covertree.CoverTree(x, leaf=4)
    for k, kids in enumerate(tree.children):
        centre = tree.points[tree.lo[k]]
        far = np.sqrt(np.maximum(0, 2 - 2 * tree.points[tree.lo[k] : tree.hi[k]] @ centre))
        assert far.max() <= tree.radius[k] + 1e-6
        if kids:
            assert tree.lo[min(kids, key=lambda c: tree.lo[c])] == tree.lo[k]  # nesting
            assert sum(tree.hi[c] - tree.lo[c] for c in kids) == tree.hi[k] - tree.lo[k]
