"""Toxicity: a subsequence string-kernel SVM with Nystrom landmarks.

The kernel of two words sums, over all strings of ORDER characters, the weight
with which each word holds it as a subsequence, DECAY for each character it
spans, so an insult is still like itself with characters put in or left out. A
word's decision is linear in kernels with the landmarks; the landmarks' own
subsequences are summed into one table beforehand, so that scoring a word costs
one look-up for each of its subsequences, however many landmarks there are. A
text scores as its worst word, and the SVM learns from labelled texts as such
bags of words (multiple-instance learning).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import long_texts, quoted

ORDER, DECAY = 3, 0.6
STEM = 4  # characters at a word's beginning that can speak for it
LONGEST = 16  # longer words are read through all their windows of this length
DENSE = 2**20  # up to so many possible subsequences are looked up in a plain table
#: Three or more lone characters in a row are read as one word.
SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
EDGES = ".,;:!?\"'()[]{}<>*#&%$-_~`|/\\+=^@«»…–—“”‘’"


def words_of(text: str) -> list[str]:
    """The words of a text, lower-cased; punctuation at their ends is cut when they are scored."""
    text = text.lower()
    out = text.split()
    out += ["".join(m.split()) for m in SPACED.findall(text)]
    return out


def bare(word: str) -> str:
    return word.strip(EDGES) or word


def forms(word: str) -> list[str]:
    """What of a word is scored: itself in windows, and its letters and digits alone if
    something else is put in between."""
    solid = "".join(filter(str.isalnum, word))
    out = []
    for form in (word, solid) if solid and solid != word else (word,):
        out += [form] if len(form) <= LONGEST else [form[i : i + LONGEST] for i in range(len(form) - LONGEST + 1)]
    return list(dict.fromkeys(out))


def coded(words: list[str], length: int) -> np.ndarray:
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, length)
    codes = np.where((points >= 97) & (points <= 122), points.astype(np.int64) - 96, points.astype(np.int64) + 27)
    return np.hstack([np.zeros((len(codes), 1), np.int64), codes])  # 0: the border in front


def self_kernel(codes: np.ndarray) -> np.ndarray:
    """k(w, w) of equally long words by the usual dynamic programme, many words at once."""
    n, length = codes.shape
    before = np.ones((length + 1, length + 1, n))
    total = np.zeros(n)
    for order in range(1, ORDER + 1):
        now = np.zeros((length + 1, length + 1, n))
        for i in range(1, length + 1):
            run = np.zeros(n)
            for j in range(1, length + 1):
                hit = (codes[:, i - 1] == codes[:, j - 1]) * before[i - 1, j - 1] * DECAY**2
                if order == ORDER:
                    total += hit
                else:
                    run = DECAY * run + hit
                    now[i, j] = DECAY * now[i - 1, j] + run
        before = now
    return total


def subsequences(codes: np.ndarray, letters: int) -> Iterator[tuple[np.ndarray, float]]:
    """For each choice of ORDER places the subsequence there, as a number, and its weight;
    codes are below ``letters``."""
    length = codes.shape[1]
    for i in range(length):
        for j in range(i + 1, length):
            pair = (codes[:, i] * letters + codes[:, j]) * letters
            for k in range(j + 1, length):
                yield pair + codes[:, k], DECAY ** (k - i + 1)


class Space:
    """The subsequences of some words, by their places in a row of features.

    Only characters of these words are numbered. Any other is one number more, as
    a subsequence with such a character is in none of them; all of those share the
    last place, which holds zero.
    """

    def __init__(self, codes: list[np.ndarray]):
        self.alphabet = np.unique(np.concatenate([np.zeros(1, np.int64), *(c.ravel() for c in codes)]))
        self.letters = len(self.alphabet) + 1
        found = [np.unique(u) for c in codes for u, _ in subsequences(self.numbered(c), self.letters)]
        self.ids = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
        self.dense = None
        if self.letters**ORDER <= DENSE:
            self.dense = np.full(self.letters**ORDER, len(self.ids))
            self.dense[self.ids] = np.arange(len(self.ids))

    def numbered(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at, len(self.alphabet))

    def places(self, u: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense[u]
        if not len(self.ids):
            return np.zeros(len(u), np.int64)
        at = np.minimum(np.searchsorted(self.ids, u), len(self.ids) - 1)
        return np.where(self.ids[at] == u, at, len(self.ids))


@dataclass
class Model:
    """``table``: the decision's weight of each place in ``space``; ``slope`` and ``shift`` turn a
    text's worst decision into a probability. Without a table it is ``shift`` alone."""

    table: np.ndarray | None
    bias: float
    slope: float
    shift: float
    space: Space | None = None

    def judged(self, words: list[str]) -> Iterator[tuple[list[int], list[str], np.ndarray]]:
        """(places, forms, decisions) of all forms of the words that are long enough."""
        dense = None if self.space.dense is None else self.table[self.space.dense]
        groups: dict[int, list[tuple[int, str]]] = {}
        for i, word in enumerate(words):
            for part in forms(word):
                groups.setdefault(len(part), []).append((i, part))
        for length, parts in groups.items():
            for at in range(0, len(parts) if length >= ORDER else 0, 4096):
                some = parts[at : at + 4096]
                codes = coded([p for _, p in some], length)
                value = np.zeros(len(some))
                for u, weight in subsequences(self.space.numbered(codes), self.space.letters):
                    value += weight * (self.table[self.space.places(u)] if dense is None else dense[u])
                yield [i for i, _ in some], [p for _, p in some], value / np.sqrt(self_kernel(codes)) + self.bias

    def decisions(self, words: list[str]) -> np.ndarray:
        """The decision for each word; a word shorter than ORDER has the bias alone."""
        out = np.full(len(words), -np.inf)
        for places, _, value in self.judged(words):
            np.maximum.at(out, np.array(places), value)
        return np.where(np.isneginf(out), self.bias, out)

    def telling(self, words: list[str]) -> dict[str, str]:
        """The form of each word that gives it its decision, the first if several do."""
        best: dict[str, tuple[float, str]] = {}
        for places, parts, value in self.judged(words):
            for i, part, v in zip(places, parts, value.tolist(), strict=True):
                if words[i] not in best or v > best[words[i]][0]:
                    best[words[i]] = (v, part)
        return {w: part for w, (_, part) in best.items()}

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -500, 500)))


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, codes) of the words of each length from ORDER on."""
    groups: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        if len(word) >= ORDER:
            groups.setdefault(len(word), []).append(i)
    for length, rows in groups.items():
        yield np.array(rows), coded([words[i] for i in rows], length)


def features(words: list[str]) -> tuple[Space, np.ndarray]:
    """A space and in it rows of unit length: the weighted subsequences of each word."""
    groups = list(by_length(words))
    space = Space([codes for _, codes in groups])
    out = np.zeros((len(words), len(space.ids) + 1), np.float32)
    for rows, codes in groups:
        for u, weight in subsequences(space.numbered(codes), space.letters):
            out[rows, space.places(u)] += weight
        out[rows] /= np.sqrt(self_kernel(codes))[:, None]
    return space, out


def kernels(words: list[str], marks: tuple[Space, np.ndarray]) -> np.ndarray:
    """The normalised kernel of each word with each row of features, by columns of marks."""
    space, rows_of_marks = marks
    columns = np.ascontiguousarray(rows_of_marks.T)
    out = np.zeros((len(words), len(rows_of_marks)), np.float32)
    for rows, codes in by_length(words):
        for at in range(0, len(rows), 1000):
            some = codes[at : at + 1000]
            sums = np.zeros((len(some), len(rows_of_marks)), np.float32)
            for u, weight in subsequences(space.numbered(some), space.letters):
                sums += np.float32(weight) * columns[space.places(u)]
            out[rows[at : at + 1000]] = sums / np.sqrt(self_kernel(some))[:, None]
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights (the last is the bias, whose column of ones is part of x) of a squared-hinge SVM by Newton steps; y is -1 or 1."""
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    loss = lambda v: v @ ridge @ v / 2 + cost @ np.maximum(0, 1 - y * (x @ v)) ** 2 / 2
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ w))
        on, curve = np.flatnonzero(slack > 0), ridge.copy()
        for at in range(0, len(on), 2000):  # without a copy of all rows
            part = x[on[at : at + 2000]]
            curve += part.T @ (cost[on[at : at + 2000], None] * part)
        slope = ridge @ w - x.T @ (cost * y * slack)
        step = np.linalg.solve(curve, slope)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now - 1e-4 * size * (slope @ step) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def gapped(word: str, rng: np.random.Generator) -> str:
    """The word with a character put in between."""
    fill = "abcdefghijklmnopqrstuvwxyz-.*_"[rng.integers(30)]
    at = int(rng.integers(1, max(2, len(word))))
    return word[:at] + fill + word[at:]


def fit(labelled: list[tuple[str, int]], *, clean_weight: float = 1.0, landmarks: int = 400, rounds: int = 3, witnesses: int = 3, care: float = 4.0, seed: int = 5) -> Model:
    """Learns from (sentence, toxic) pairs; a sentence is any text.

    Each sentence stands in the SVM by its witnesses: a toxic one by its worst word
    and up to ``witnesses`` in all that have a positive decision, a clean one by its worst
    word. Which words these are is not known; at first they are those whose
    presence speaks most for toxicity, then, round by round, those of the highest decisions.
    Witnesses of clean sentences stay in all later rounds, so what has been
    too near stays pushed away; usual clean words stand by them. Toxic
    witnesses stand a second time with a character put in. Landmarks are the
    words that speak most and clean ones. A word that is longer than a window is
    learnt by the window that gave it its decision in the round before, at first by the
    one that speaks most.

    Decisions become scores by a logistic fit, in which a toxic sentence counts as
    ``care`` clean ones, as a model is too sure of the sentences that it has learnt. (``rounds``, ``care`` and the
    number of clean labels of ``learn`` were chosen by three folds of labels that are not held out; see README.)
    """
    rng = np.random.default_rng(seed)
    same: dict[str, str] = {}  # one object for each word
    bags = [sorted({same.setdefault(w, w) for w in map(bare, words_of(t))}) for t, _ in labelled]
    y = np.array([k for _, k in labelled])
    rate = float(y.mean()) if len(y) else 0.0
    if not len(y) or rate in (0.0, 1.0):
        return Model(None, 0.0, 0.0, float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    n1, n0 = int(y.sum()), int((1 - y).sum())

    def telling(k1: int, k0: int) -> float:
        """Twice the log-likelihood ratio of a share in toxic and in clean sentences, 0 if it
        is not more common in the toxic."""
        p = (k1 + k0) / (n1 + n0)
        g = sum(k * np.log(k / (n * q)) for k, n, q in ((k1, n1, p), (n1 - k1, n1, 1 - p), (k0, n0, p), (n0 - k0, n0, 1 - p)) if k)
        return float(2 * g) if k1 / n1 > k0 / n0 else 0.0

    toxic, clean = (Counter(w for bag, k in zip(bags, y, strict=True) if k == c for w in bag) for c in (1, 0))
    stems = [{w[:STEM] for w in bag} for bag in bags]
    in_toxic, in_clean = (Counter(g for bag, k in zip(stems, y, strict=True) if k == c for g in bag) for c in (1, 0))
    # A word speaks by itself or by how it begins, which it shares with its inflections.
    speaks = {w: max(telling(k, clean[w]), telling(in_toxic[w[:STEM]], in_clean[w[:STEM]])) if toxic[w] / n1 > clean[w] / n0 else 0.0 for w, k in toxic.items()}
    ranked = sorted((w for w in toxic if len(w) >= ORDER), key=lambda w: (-speaks[w], -toxic[w], w))
    usual = sorted((w for w in clean if len(w) >= ORDER), key=lambda w: (-clean[w], w))
    marks = ranked[: landmarks // 2]
    marks += [w for w in usual if w not in set(marks)][: landmarks // 4]
    rest = [w for w in usual[landmarks:] if w not in set(marks)]
    marks += [rest[i] for i in sorted(rng.choice(len(rest), min(len(rest), landmarks - len(marks)), replace=False))] if rest else []
    long_words = sorted({w for bag in bags for w in bag if len(w) > LONGEST})
    read = spoken(long_words, bags, y, telling)  # what a word is learnt by, if not itself
    learnt = lambda words: [read.get(w, w) for w in words]
    at_marks = features(learnt(marks))
    values, vectors = np.linalg.eigh(kernels(learnt(marks), at_marks).astype(float))
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])  # K^(-1/2) on its range
    vocabulary = sorted({w for bag in bags for w in bag})
    on = [sorted(bag, key=lambda w: (-speaks.get(w, 0.0), w))[:witnesses] for bag, k in zip(bags, y, strict=True) if k == 1]
    off = [max(bag, key=lambda w: (speaks.get(w, 0.0), w)) for bag, k in zip(bags, y, strict=True) if k == 0 and bag]
    against = set(usual[:1500])
    for _ in range(rounds):
        against |= set(off)
        told = Counter(w for ws in on for w in ws)
        words, others = sorted(told), sorted(against)
        put_in = [gapped(w, rng) for w in learnt(words) for _ in range(2)]
        weight = np.array([min(20.0, told[w]) for w in words])
        cost = np.concatenate([weight, 0.3 * np.repeat(weight, 2), [3 * min(20.0, 1.0 + clean[w]) for w in others]])
        rows = learnt(words) + put_in + learnt(others)
        x = np.ones((len(rows), root.shape[1] + 1))
        for at in range(0, len(rows), 2000):  # one copy of all rows, as it is the driver's memory
            x[at : at + 2000, :-1] = kernels(rows[at : at + 2000], at_marks) @ root
        solved = svm(x, np.repeat([1.0, -1.0], [len(words) + len(put_in), len(others)]), 10 * cost)
        model = Model(at_marks[1].T @ (root @ solved[:-1]), float(solved[-1]), 1.0, 0.0, at_marks[0])
        read |= model.telling(long_words)
        value = dict(zip(vocabulary, model.decisions(vocabulary).tolist(), strict=True))
        worst = [sorted(bag, key=lambda w: (-value[w], w))[:witnesses] for bag in bags]
        on = [[w for w in ws if w == ws[0] or value[w] > 0] for ws, k in zip(worst, y, strict=True) if k == 1]
        off = [ws[0] for ws, k in zip(worst, y, strict=True) if k == 0 and ws]
    model.slope, model.shift = platt(np.array([value[ws[0]] if ws else model.bias for ws in worst]), y, clean_weight / care)
    return model


def spoken(words: list[str], bags: list[list[str]], y: np.ndarray, telling: Callable[[int, int], float]) -> dict[str, str]:
    """The window of each long word whose presence in sentences speaks most for toxicity, the
    middle one of equals. Only windows in toxic sentences are counted."""
    cut = lambda bag: {f for w in bag if len(w) > LONGEST for f in forms(w) if len(f) >= ORDER}
    toxic = Counter(f for bag, k in zip(bags, y, strict=True) if k == 1 for f in cut(bag))
    clean = Counter(f for bag, k in zip(bags, y, strict=True) if k == 0 for f in cut(bag) if f in toxic)
    out = {}
    for word in words:
        parts = [f for f in forms(word) if len(f) >= ORDER]
        speaks = [telling(toxic[f], clean[f]) if f in toxic else 0.0 for f in parts]
        most = max(speaks)
        top = [f for f, v in zip(parts, speaks, strict=True) if v == most]
        out[word] = top[len(top) // 2]
    return out


def platt(value: np.ndarray, y: np.ndarray, clean_weight: float) -> tuple[float, float]:
    """Slope and shift of a logistic fit with smoothed targets and a light ridge."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    cost = np.where(y == 1, 1.0, clean_weight)
    x, w = np.stack([value, np.ones(len(y))], axis=1), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ ((cost * p * (1 - p))[:, None] * x) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (cost * (p - target)) + 1e-3 * w)
        w = w - step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-6)), float(w[1])


def training_rows(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, toxic: int, clean: int) -> tuple[list[tuple[str, int]], float]:
    """At most ``toxic`` and ``clean`` labelled texts, chosen by a hash of their id and not
    held out, one (the least) of rows that share an id, and how many clean labels each clean text stands for beside a toxic one."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").where(~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    first = lambda y, n: known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n)
    ids = first(1, toxic).unionAll(first(0, clean))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    rows = texts.join(F.broadcast(ids), "_id").groupBy("_id", "_y").agg(F.min("_t").alias("_t"))  # one text of an id, however many rows share it
    weight = max(1, min(toxic, counts.get(1, 0))) / max(1, counts.get(1, 0)) * counts.get(0, 0) / max(1, min(clean, counts.get(0, 0)))
    return [(r["_t"], r["_y"]) for r in rows.orderBy("_id", "_t").collect()], weight


def held_out(key):
    """True for ids whose labels are never learnt from."""
    return F.crc32(key.cast("string")) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = 1000, clean: int = 1500, **options) -> Model:
    """Fits the model on the texts of at most ``toxic`` and ``clean`` labels of either kind that
    are not held out: some 10 MB of text on the driver. Null ids and labels
    other than 0 and 1 are left out; an id labelled both is toxic. Without labels
    of both kinds every text scores the share of toxic labels."""
    rows, weight = training_rows(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, toxic=toxic, clean=clean)
    return fit(rows, clean_weight=weight, **options)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), score_col: str = "score", cache_words: int = 500_000) -> DataFrame:
    """``keep`` columns and ``score_col``, 0 to 1, of each whole text.

    Null and empty texts score as a text without a telling word. A worker
    remembers the decisions of at most about ``cache_words`` distinct words.
    Rows are independent, so repeated rows score alike.
    """
    long_texts(docs.sparkSession)
    safe = [f"c{i}" for i in range(len(keep))]  # any name may be kept, but not every name goes through Arrow
    schema = T.StructType([*(T.StructField(s, docs.schema[c].dataType) for s, c in zip(safe, keep, strict=True)), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                texts = [set(words_of(t or "")) for t in batch.column(len(keep)).to_pylist()]
                if model.table is None:
                    worst = np.zeros(len(texts))
                else:
                    if len(known) > cache_words:
                        known = {}
                    new = [w for w in dict.fromkeys(w for t in texts for w in t) if w not in known]
                    known.update(zip(new, model.decisions([bare(w) for w in new]).tolist(), strict=True))
                    worst = np.array([max((known[w] for w in t), default=model.bias) for t in texts])
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(model.probability(worst))], names=[*safe, "score"])

    return docs.select(*(F.col(q).alias(s) for q, s in zip(quoted(keep), safe, strict=True)), F.col(text_col).alias("text")).mapInArrow(run, schema).toDF(*keep, score_col)
