"""SentencePiece encoding and decoding with N-best segmentations.

A text is a lattice: nodes are positions, edges are pieces. No piece spans the
border in front of a word or at a character that only stands alone, so the
lattice is a chain of small ones, one for each chunk, and what is worked out
for a distinct chunk serves all its occurrences. In a chunk, Viterbi's forward
scores are the exact heuristic of an A* search from the end, which so yields
segmentations best first.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import long_texts, quoted

SPACE = "▁"
#: Added to the lowest score for a character without a piece (a fixed value of the format).
UNKNOWN_PENALTY = -10.0
NONE = -np.inf
#: Cells of a table (position by length by chunk) that is filled at once, and characters of the texts in work at once (a longer text is alone).
CELLS, CHARACTERS = 4_000_000, 2_000_000


@dataclass
class Model:
    """Pieces, scores and kinds of a SentencePiece file."""

    pieces: list[str]
    scores: list[float]
    bytes_: dict[int, int]  # byte -> id
    silent: set[int]  # control pieces: no text
    unknown: int
    index: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        skip = self.silent | {self.unknown} | set(self.bytes_.values())
        self.index = {p: i for i, p in enumerate(self.pieces) if i not in skip}
        spanning = {c for p in self.index if len(p) > 1 for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in self.index):
            raise ValueError("pieces that hold a space inside are not supported")
        within = "".join(map(re.escape, sorted(spanning - {SPACE}))) or "\x00"
        self.chunks = re.compile(f"{SPACE}*[{within}]+|{SPACE}+|[^{within}]", re.DOTALL).findall
        self.longest = max(map(len, self.index), default=1)
        self.lowest = min((s for s in self.scores if s > -1e8), default=0.0) + UNKNOWN_PENALTY


def load(path: str, scores: str = "model") -> Model:
    """Reads a model file.

    ``scores="model"`` takes its scores as log-probabilities, which those of a
    unigram model are. Those of a BPE model are negated merge ranks, whose sums
    mean nothing; ``"rank"`` turns rank r into log(1 / (r + 1)) up to a constant, as
    Zipf's law has it for pieces in order of frequency.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces, stored = [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)]
    octets = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
    silent = {i for i in range(n) if sp.is_control(i)}
    plain = [s for i, s in enumerate(stored) if s > -1e8 and not sp.is_byte(i) and i not in silent and i != sp.unk_id()]
    if scores not in ("model", "rank"):
        raise ValueError('scores are "model" or "rank"')
    if scores == "rank":
        norm = float(np.log(np.sum(1.0 / (1.0 - np.array(plain)))))
        stored = [s if s <= -1e8 else -float(np.log(1.0 - s)) - norm for s in stored]
    return Model(pieces, stored, octets, silent, sp.unk_id())


def normalise(text: str | None) -> str:
    """What is segmented: a space in front, spaces as U+2581; '' stays ''."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def edges(model: Model, chunk: str) -> list[list[tuple[int, int, float]]]:
    """For each position the pieces that end there, as (start, id, score); a
    character without a piece has an edge of id -1."""
    out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(chunk) + 1)]
    for end in range(1, len(chunk) + 1):
        for start in range(max(0, end - model.longest), end):
            k = model.index.get(chunk[start:end])
            if k is not None:
                out[end].append((start, k, model.scores[k]))
        if chunk[end - 1] not in model.index:
            out[end].append((end - 1, -1, model.lowest))
    return out


def n_best(model: Model, chunk: str, n: int) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations of a chunk, best first (all, if fewer). Of
    equally good ones Viterbi's is the first, which from the end on takes the shortest
    piece; it is that of Segmenter, however many chunks that looks at."""
    into = edges(model, chunk)
    forward, back = [0.0] + [NONE] * len(chunk), [(0, 0)] * (len(chunk) + 1)
    for end in range(1, len(chunk) + 1):
        for a, k, s in reversed(into[end]):
            if forward[a] + s > forward[end]:
                forward[end], back[end] = forward[a] + s, (a, k)
    at, parts = len(chunk), []
    while at:
        a, k = back[at]
        parts.append(spelled(model, chunk[a:at]) if k < 0 else [k])
        at = a
    found = [(forward[-1], list(chain.from_iterable(reversed(parts))))]
    # (-(forward score here + score from here to the end), order, position, score to the end, path)
    heap, order = [(-forward[-1], 0, len(chunk), 0.0, None)], 0
    while heap and len(found) < n:
        _, _, at, gone, path = heapq.heappop(heap)
        if at == 0:
            ids = []
            while path is not None:
                k, c, path = path
                ids += spelled(model, c) if k < 0 else [k]
            if ids != found[0][1]:
                found.append((min(gone, forward[-1]), ids))
            continue
        for start, k, score in into[at]:
            order += 1
            heapq.heappush(heap, (-(forward[start] + score + gone), order, start, gone + score, (k, chunk[start:at], path)))
    return found


def spelled(model: Model, char: str) -> list[int]:
    """Byte pieces of a character without a piece, or the unknown piece."""
    octets = char.encode("utf-8", "replace")
    return [model.bytes_[b] for b in octets] if all(b in model.bytes_ for b in octets) else [model.unknown]


class Segmenter:
    """Best segmentation of chunks, many at a time, and how far behind their second best is."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, model: Model):
        self.model = model
        by_length: dict[int, list[tuple[int, int]]] = {}
        for piece, k in model.index.items():
            by_length.setdefault(len(piece), []).append((self._hash(piece), k))
        self.tables = {}
        for length, rows in by_length.items():
            rows.sort()
            ids = np.array([k for _, k in rows], np.int64)
            self.tables[length] = (np.array([h for h, _ in rows], np.uint64), ids, np.array([model.scores[k] for k in ids]))
        self.forget()

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * self.BASE + ord(c) + 1) % 2**64
        return h

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.names: list[str] = []
        self.starts, self.lengths, self.best, self.gaps, self.flat = (np.zeros(0, np.int64) for _ in range(5))
        self.best, self.gaps = self.best.astype(float), self.gaps.astype(float)

    def learn(self, chunks: Iterable[str]) -> None:
        """Works out chunks not yet known."""
        known = self.known
        new = [c for c in dict.fromkeys(chunks) if c not in known]
        if not new:
            return
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        self.names += new
        best, gaps, lengths = np.zeros(len(new)), np.zeros(len(new)), np.zeros(len(new), np.int64)
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        order, flats = np.argsort(sizes, kind="stable"), []
        for rows in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            size = int(sizes[rows[0]])
            if size > 48 or size * len(rows) < 64:
                for i in rows.tolist():
                    top = n_best(self.model, new[i], 2)
                    best[i], gaps[i], lengths[i] = top[0][0], _gap(top[0][0], top[1][0]) if len(top) > 1 else np.inf, len(top[0][1])
                    flats.append(np.array(top[0][1], np.int64))
            else:
                step = max(64, CELLS // (size * min(size, self.model.longest)))
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    flat, lengths[part], best[part], gaps[part] = self._many([new[i] for i in part.tolist()], size)
                    flats.append(flat)
        starts = np.zeros(len(new), np.int64)
        starts[order] = len(self.flat) + np.cumsum(lengths[order]) - lengths[order]
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, *flats])
        self.best, self.gaps = np.concatenate([self.best, best]), np.concatenate([self.gaps, gaps])

    def _many(self, chunks: list[str], length: int) -> tuple[np.ndarray, ...]:
        w, codes = len(chunks), np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, length).T.astype(np.uint64) + np.uint64(1)
        top = min(length, self.model.longest)
        score, piece, h = {}, {}, np.zeros((length, w), np.uint64)
        for n in range(1, top + 1):  # h[i]: hash of the n characters from i on
            h = h[: length - n + 1] * np.uint64(self.BASE) + codes[n - 1 :]
            if n in self.tables:
                keys, ids, scores = self.tables[n]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                score[n], piece[n] = np.where(hit, scores[at], NONE), np.where(hit, ids[at], -1)
            elif n == 1:
                score[n], piece[n] = np.full(h.shape, NONE), np.full(h.shape, -1)
        score[1] = np.where(piece[1] < 0, self.model.lowest, score[1])
        forward, back = np.full((length + 1, w), NONE), np.ones((length + 1, w), np.int64)
        forward[0] = 0
        for end in range(1, length + 1):
            for n in score:
                if n <= end:
                    s = forward[end - n] + score[n][end - n]
                    better = s > forward[end]
                    forward[end] = np.where(better, s, forward[end])
                    back[end] = np.where(better, n, back[end])
        tail = np.full((length + 1, w), NONE)
        tail[length] = 0
        for start in range(length - 1, -1, -1):
            for n in score:
                if start + n <= length:
                    np.maximum(tail[start], tail[start + n] + score[n][start], out=tail[start])
        through = {n: forward[: length - n + 1] + score[n] + tail[n:] for n in score}
        at, columns, path = np.full(w, length), np.arange(w), []
        for _ in range(length):
            live = at > 0
            if not live.any():
                break
            n = np.where(live, back[at, columns], 0)
            ids = np.full(w, -2)
            for k in score:
                pick = np.flatnonzero(n == k)
                ids[pick] = piece[k][at[pick] - k, pick]
                through[k][at[pick] - k, pick] = NONE  # the second best path leaves the best by some edge
            at = at - n
            path.append(np.where(ids == -1, -3 - at, ids))  # -3 - position: spelled out
        second = np.max([np.max(t, axis=0) for t in through.values()], axis=0)
        rows = np.array(path[::-1]).T
        spelt, used = np.flatnonzero((rows <= -3).any(axis=1)), rows != -2
        lengths, flat = used.sum(axis=1), rows[used]
        if len(spelt):
            parts = np.split(flat, np.cumsum(lengths)[:-1])
            for j in spelt.tolist():
                parts[j] = np.array([i for k in parts[j].tolist() for i in ([k] if k >= 0 else spelled(self.model, chunks[j][-3 - k]))])
                lengths[j] = len(parts[j])
            flat = np.concatenate(parts)
        return flat, lengths, forward[length], _gap(forward[length], second)


def _gap(best, second):
    """How far the second best is behind, without the last digits, which depend on the order of a sum."""
    return np.maximum(np.round(best - second, 9), 0.0)


def combine(options: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` least sums that take one loss from each list (each ascending, from
    0), with the choices; best first."""
    start = (0,) * len(options)
    heap, seen, out = [(0.0, start)], {start}, []
    while heap and len(out) < n:
        loss, pick = heapq.heappop(heap)
        out.append((loss, pick))
        for i, k in enumerate(pick):
            if k + 1 < len(options[i]):
                new = (*pick[:i], k + 1, *pick[i + 1 :])
                if new not in seen:
                    seen.add(new)
                    heapq.heappush(heap, (loss - options[i][k] + options[i][k + 1], new))
    return out


def encode(docs: DataFrame, model_file: str, *, text_col: str = "text", n: int = 4, scores: str = "model", keep: tuple[str, ...] = ("doc_id",), cache_chunks: int = 400_000) -> DataFrame:
    """``keep`` columns with the ``n`` best segmentations of each whole text.

    Adds ids (array<int>, of the best), score (its sum) and nbest, best first: an
    array of (score, changes), changes being the chunks, as (number of the chunk in
    the text, ids), in which the segmentation differs from the best. A text has
    fewer than ``n`` if its lattice does. Null and empty texts have no ids, score
    0 and one empty segmentation. Only n - 1 chunks can differ in the n best: those
    whose second best costs least, ties to the earlier; A* runs on these.
    Characters without a piece become byte pieces. Rows are independent, so
    repeated rows give repeated results. A worker keeps at most about
    ``cache_chunks`` distinct chunks.
    """
    long_texts(docs.sparkSession)
    model = load(model_file, scores)
    safe = [f"c{i}" for i in range(len(keep))]  # any name may be kept, but not every name goes through Arrow
    schema = T.StructType([T.StructField(s, docs.schema[c].dataType) for s, c in zip(safe, keep, strict=True)])
    change = T.StructType().add("chunk", "integer").add("ids", T.ArrayType(T.IntegerType()))
    schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("score", "double").add("nbest", T.ArrayType(T.StructType().add("score", "double").add("changes", T.ArrayType(change))))
    change_type = pa.list_(pa.struct([("chunk", pa.int32()), ("ids", pa.list_(pa.int32()))]))
    best_type = pa.list_(pa.struct([("score", pa.float64()), ("changes", change_type)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, ways = Segmenter(model), {}
        for whole in batches:
            for batch in _slices(whole, len(keep)):
                if len(seg.known) > cache_chunks:
                    seg.forget()
                    ways = {}
                texts = [model.chunks(normalise(t)) for t in batch.column(len(keep)).to_pylist()]
                seg.learn(chain.from_iterable(texts))
                ends = np.cumsum([0, *map(len, texts)])
                index = np.fromiter(map(seg.known.__getitem__, chain.from_iterable(texts)), np.int64, int(ends[-1]))
                del texts
                lengths = seg.lengths[index]
                stops = np.concatenate(([0], np.cumsum(lengths)))
                ids = seg.flat[np.repeat(seg.starts[index] - stops[:-1], lengths) + np.arange(stops[-1])]
                sums, nbest = [], []
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    own, score = index[a:b], float(seg.best[index[a:b]].sum())
                    gaps = seg.gaps[own]
                    near = np.argsort(gaps, kind="stable")[: n - 1] if b - a <= 64 else _least(gaps, n - 1)
                    near = [int(i) for i in near if np.isfinite(gaps[i])]
                    choices = []
                    for i in near:
                        k = int(own[i])
                        if k not in ways:
                            ways[k] = n_best(model, seg.names[k], n)
                        choices.append(ways[k])
                    losses = [[max(0.0, c[0][0] - s) for s, _ in c] for c in choices]
                    sums.append(score)
                    nbest.append([{"score": score - loss, "changes": [{"chunk": i, "ids": c[p][1]} for i, c, p in zip(near, choices, pick, strict=True) if p]} for loss, pick in combine(losses, n)])
                offsets = pa.array(stops[ends], pa.int32())
                arrays = [batch.column(i) for i in range(len(keep))]
                arrays += [pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(sums, pa.float64()), pa.array(nbest, best_type)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*safe, "ids", "score", "nbest"])

    return docs.select(*(F.col(q).alias(s) for q, s in zip(quoted(keep), safe, strict=True)), F.col(text_col).alias("text")).mapInArrow(run, schema).toDF(*keep, "ids", "score", "nbest")


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most 1000 rows whose values in ``column`` (strings or lists) hold
    at most CHARACTERS bytes or items together; a larger value is a part of its own."""
    import pyarrow.compute as pc

    values = batch.column(column)
    measure = pc.list_value_length if pa.types.is_list(values.type) or pa.types.is_large_list(values.type) else pc.binary_length
    sizes = pc.fill_null(measure(values), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and (held + size > CHARACTERS or i - begin == 1000):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if len(batch) > begin:
        yield batch.slice(begin)


def _least(gaps: np.ndarray, n: int) -> np.ndarray:
    """Places of the n least values, ties to the earlier."""
    if n <= 0:
        return np.zeros(0, np.int64)
    bound = np.partition(gaps, n - 1)[n - 1]
    below, equal = np.flatnonzero(gaps < bound), np.flatnonzero(gaps == bound)
    return np.concatenate([below[np.argsort(gaps[below], kind="stable")], equal])[:n]


def decode(df: DataFrame, model_file: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds the text of each row's ids: byte pieces are joined as UTF-8 (U+FFFD where
    they are not), U+2581 becomes a space, the space in front goes, control
    pieces have no text. Null ids give null, none give ''. A column so named is replaced."""
    model, df = load(model_file, "model"), df.drop(text_col)
    octet = {k: bytes([b]) for b, k in model.bytes_.items()}
    words = [b"" if i in model.silent else " ⁇ ".encode() if i == model.unknown else octet.get(i, p.replace(SPACE, " ").encode("utf-8")) for i, p in enumerate(model.pieces)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = np.array(words, dtype=object)
        for whole in batches:
            for batch in _slices(whole, place):
                ids = batch.column(place)
                out = []
                for value in ids:
                    if not value.is_valid:
                        out.append(None)
                        continue
                    text = b"".join(spell[value.values.to_numpy(zero_copy_only=False)].tolist()).decode("utf-8", "replace")
                    out.append(text.removeprefix(" "))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    place, safe = df.columns.index(ids_col), [f"c{i}" for i in range(len(df.columns))]
    schema = T.StructType([*(T.StructField(s, f.dataType) for s, f in zip(safe, df.schema, strict=True)), T.StructField("decoded", T.StringType())])
    return df.toDF(*safe).mapInArrow(run, schema).toDF(*df.columns, text_col)
