"""BPE encoding and decoding by an index of where each pair of pieces occurs."""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import fresh, quoted
from quillgraph.llm.tokens import BYTE_LEVEL, SETTLED, PreTokenizer, added_tokens

#: Bytes of text that a task takes at a time, and of codes that it remembers.
TAKEN, REMEMBERED = 4_000_000, 48_000_000


def settled_pattern() -> str:
    """BYTE_LEVEL for text below SETTLED, with its classes as ranges: Python's own engine is twice as fast on them."""

    def ranges(test: Callable[[str], bool]) -> str:
        inside = [c for c in range(ord(SETTLED)) if test(chr(c))]
        begins = [c for c in inside if c - 1 not in inside]
        ends = [c for c in inside if c + 1 not in inside]
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(begins, ends, strict=True))

    letters, numbers = (ranges(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN")
    spaces = ranges(lambda c: c in "\t\n\v\f\r \x85\xa0")  # Unicode's White_Space
    out = BYTE_LEVEL.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
    return out.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]")


class Splitter(PreTokenizer):
    """The same pre-tokens, faster on text below SETTLED."""

    def __init__(self, spec: str, added: list[str]):
        super().__init__(spec, added)
        self.find = re.compile(settled_pattern()).findall


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable
    and no space, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Merges:
    """Ranked merges of a ``tokenizers`` file, applied to many words at once."""

    def __init__(self, spec: str):
        model = json.loads(spec)["model"]
        if model["type"] != "BPE" or any(model.get(o) for o in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain byte-level BPE models are supported")
        vocab = model["vocab"]
        self.byte = np.array([vocab[c] for c in byte_letters()], np.int64)
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        #: (left, right, new) of each rank
        self.merge = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        made = dict(zip(self.merge[:, 2].tolist(), range(len(pairs)), strict=True))
        if any(made.get(side, -1) >= rank for rank, sides in enumerate(self.merge[:, :2].tolist()) for side in sides):
            raise ValueError("merges must make a piece before they use it")

    @functools.cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs as left * 2^32 + right, ascending, with their ranks."""
        keys = (self.merge[:, 0] << 32) + self.merge[:, 1]
        order = np.argsort(keys, kind="stable")
        return np.append(keys[order], np.iinfo(np.int64).max), np.append(order, -1)

    def ranks(self, left: np.ndarray | int, right: np.ndarray | int) -> np.ndarray:
        """The rank of each pair, -1 where no merge joins it."""
        keys, ranks = self.pairs
        wanted = (left << 32) + right
        found = np.searchsorted(keys, wanted)
        return np.where(keys[found] == wanted, ranks[found], -1)

    def encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers.

        All words stand in one chain, parted by -1. An index maps each pair that some merge joins to all
        its positions; the lowest active rank is applied at all of them, from the left, and the lists
        of the pairs that this makes are added to. A position whose pair is gone is passed over.
        As merges make a piece before they use it, a new pair's rank is above
        the rank applied, so every word meets its own merges in the order of one by one.
        """
        octets = np.frombuffer(b"\xff".join([b"", *(w.encode() for w in words), b""]), np.uint8)  # no byte of UTF-8 is 255
        symbol = np.where(octets == 255, -1, self.byte[octets])
        after, before = np.arange(1, len(symbol) + 1), np.arange(-1, len(symbol) - 1)
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(ranks: np.ndarray, at: np.ndarray) -> None:
            good = np.flatnonzero(ranks >= 0)
            if not len(good):
                return
            ranks, at = ranks[good], at[good]
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rank = int(ranks[a])
                if rank in places:
                    places[rank].append(at[a:b])
                else:
                    places[rank] = [at[a:b]]
                    heapq.heappush(active, rank)

        note(self.ranks(symbol[:-1], symbol[1:]), np.arange(len(symbol) - 1))
        while active:
            applied = heapq.heappop(active)
            lists, (left, right, new) = places.pop(applied), self.merge[applied].tolist()
            at = np.concatenate(lists) if len(lists) > 1 else lists[0]
            follows = after[at]
            good = (symbol[at] == left) & (symbol[follows] == right)
            at, follows = at[good], follows[good]
            if left == right:  # of positions that overlap every other one, from the left
                at = np.unique(at)
                begins = np.append(True, at[1:] != after[at[:-1]])
                nth = np.arange(len(at))
                at = at[(nth - np.maximum.accumulate(np.where(begins, nth, 0))) % 2 == 0] if len(at) else at
                follows = after[at]
            if not len(at):
                continue
            symbol[at], symbol[follows] = new, -2
            beyond = after[follows]
            after[at], before[beyond] = beyond, at
            prior = before[at]
            note(np.concatenate((self.ranks(new, symbol[beyond]), self.ranks(symbol[prior], new))), np.concatenate((at, prior)))
        ids = symbol[symbol > -2]
        ends = np.flatnonzero(ids == -1)
        data = ids.astype("<i4").tobytes()
        return [data[4 * a + 4 : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _taken(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with at most ``most`` of what column holds (bytes or list items), one row at least."""
    for batch in batches:
        values = batch.column(column)
        sizes = np.cumsum((pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def frequent_pieces(docs: DataFrame, spec: str, added: list[str], id_col: str, text_col: str, sample_docs: int, most: int, chars: int) -> DataFrame:
    """(piece, codes): the most frequent pre-tokens of about ``sample_docs`` documents, encoded."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = Splitter(spec, added), Counter()
        table = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["piece", "n"])
        for batch in _taken(batches, 0, TAKEN):
            for text in batch.column(0).to_pylist():
                held.update(w for w in split(text)[0] if len(w) <= chars)
            if len(held) > 200_000:
                yield table()
                held = Counter()
        yield table()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(spec)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(merges.encode(batch.column(0).to_pylist()), pa.binary())], names=["piece", "codes"])

    share = min(1.0, sample_docs / max(1, docs.count()))
    some = docs.where(F.col(text_col).isNotNull() & (F.pmod(F.xxhash64(id_col, F.lit(13)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))))
    top = some.select(F.col(text_col).alias("text")).mapInArrow(seen, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(most)
    return top.repartition(8).mapInArrow(encoded, "piece string, codes binary")


def encode(docs: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None, ids_col: str = "ids", sample_docs: int = 4_000, hot_pieces: int = 65_536, hot_chars: int = 32) -> DataFrame:
    """The columns ``keep`` (``id_col`` by default) and ids, an array of ints: each whole text as the tokenizers
    library encodes it without added begin and end tokens.

    Added special tokens inside a text are their one id, the library's default. A task takes
    texts some megabytes at a time; their distinct pre-tokens that it has not met before are encoded together (``Merges.encode``), whole texts
    put together from their codes. Those most frequent in a sample, at most ``hot_pieces`` of at
    most ``hot_chars`` characters (some 10 MB), are encoded once and go out by broadcast; this saves time and changes no id. What
    a task remembers is bounded by REMEMBERED. Nothing is shuffled but the sample.

    Null and empty texts have no ids. Null ids and repeated rows are documents like others.
    """
    keep = (id_col,) if keep is None else keep
    codes = _coder(docs, tokenizer_file, id_col, text_col, sample_docs, hot_pieces, hot_chars)
    [work] = fresh(docs.select(*quoted(list(keep))), "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data in codes(batches, len(keep)):
            offsets = np.concatenate(([0], np.cumsum([len(d) // 4 for d in data]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(data), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], ids], names=[*keep, ids_col])

    schema = T.StructType([docs.schema[c] for c in keep]).add(ids_col, T.ArrayType(T.IntegerType(), False))
    return docs.select(*quoted(list(keep)), F.coalesce(F.col(quoted([text_col])[0]), F.lit("")).alias(work)).mapInArrow(run, schema)


def _coder(docs: DataFrame, tokenizer_file: str, id_col: str, text_col: str, sample_docs: int, hot_pieces: int, hot_chars: int) -> Callable[[Iterator[pa.RecordBatch], int], Iterator[tuple[pa.RecordBatch, list[bytes]]]]:
    """A function for tasks: batches in parts, with the codes of each text in a column."""
    spec = open(tokenizer_file, encoding="utf-8").read()
    added = added_tokens(spec)
    special = {a["content"]: int(a["id"]).to_bytes(4, "little") for a in json.loads(spec)["added_tokens"]}
    hot = frequent_pieces(docs, spec, added, id_col, text_col, sample_docs, hot_pieces, hot_chars)
    known = docs.sparkSession.sparkContext.broadcast({r["piece"]: bytes(r["codes"]) for r in hot.toLocalIterator()})

    def run(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
        split, merges, codes, own = Splitter(spec, added), Merges(spec), dict(known.value), 0
        between = split.cut and split.cut.findall
        for batch in _taken(batches, column, TAKEN):
            texts, missing = [], set()
            for text in batch.column(column).to_pylist():
                if between and any(a in text for a in added):
                    marks = [*between(text), None]
                    parts = [(split(s)[0], mark) for s, mark in zip(split.cut.split(text), marks, strict=True)]
                else:
                    parts = [(split(text)[0], None)]
                texts.append(parts)
                for words, _ in parts:
                    missing.update(set(words).difference(codes))
            if missing:
                words = list(missing)
                found = merges.encode(words)
                codes.update(zip(words, found, strict=True))
                own += sum(map(len, words)) + sum(map(len, found)) + 150 * len(words)
            code = codes.__getitem__
            yield batch, [b"".join(b"".join(map(code, words)) + (special[mark] if mark else b"") for words, mark in parts) for parts in texts]
            if own > REMEMBERED:
                codes, own = dict(known.value), 0

    return run


def piece_bytes(tokenizer_file: str) -> list[bytes]:
    """The bytes of each id, special tokens as their strings, and nothing for ids that the vocabulary lacks and at the end."""
    spec = json.loads(open(tokenizer_file, encoding="utf-8").read())
    number = {c: b for b, c in enumerate(byte_letters())}
    pieces: dict[int, bytes] = {}
    for text, i in [*spec["model"]["vocab"].items(), *((a["content"], a["id"]) for a in spec["added_tokens"])]:
        pieces[i] = bytes(number[c] for c in text) if all(c in number for c in text) else text.encode()
    return [pieces.get(i, b"") for i in range(max(pieces, default=-1) + 1)] + [b""]


def decode(encoded: DataFrame, tokenizer_file: str, *, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Adds the text of an array of ids, special tokens as their strings, as the library does: bytes that are no
    UTF-8 become U+FFFD, ids that the vocabulary lacks and a null array give nothing."""
    table = encoded.sparkSession.sparkContext.broadcast(piece_bytes(tokenizer_file))
    columns = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, none = table.value.__getitem__, len(table.value) - 1
        for batch in _taken(batches, columns.index(ids_col), TAKEN // 4):
            ids = batch.column(columns.index(ids_col))
            ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)).tolist()
            flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
            flat = np.where((flat < 0) | (flat > none), none, flat).tolist()
            texts = [_text(piece, flat[a:b]) for a, b in zip([0, *ends], ends)]  # noqa: B905
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*columns, decoded_col])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(decoded_col, T.StringType())]))


def _text(piece: Callable[[int], bytes], ids: list[int]) -> str:
    return b"".join(map(piece, ids)).decode("utf-8", "replace")


def digests(docs: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 4_000, hot_pieces: int = 65_536, hot_chars: int = 32) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each whole text encoded and decoded in one pass, as ``encode``
    and ``decode`` do, without its ids and text leaving the task: hexadecimal SHA-256 of the ids as
    little-endian unsigned 32-bit integers, and of the decoded text in UTF-8."""
    codes = _coder(docs, tokenizer_file, id_col, text_col, sample_docs, hot_pieces, hot_chars)
    table = docs.sparkSession.sparkContext.broadcast(piece_bytes(tokenizer_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, sha = table.value.__getitem__, hashlib.sha256
        for batch, data in codes(batches, 1):
            decoded = [sha(_text(piece, np.frombuffer(d, "<u4").tolist()).encode()).hexdigest() for d in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(d) // 4 for d in data], pa.int64()), pa.array([sha(d).hexdigest() for d in data]), pa.array(decoded)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(quoted([id_col])[0]).alias("id"), F.coalesce(F.col(quoted([text_col])[0]), F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
