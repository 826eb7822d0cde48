"""Token counts: pieces are counted once for each distinct pre-token."""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import Scratch, lookup

#: The pattern of the "ByteLevel" pre-tokenizer with use_regex (a fixed value of the format).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Below this code point the pattern means the same under every Unicode version; texts with others are split by the library.
SETTLED = "՘"


def added_tokens(spec: str) -> list[str]:
    """The added tokens of a ``tokenizers`` file, longest first; an error if its text is
    not split as PreTokenizer does."""
    parts = json.loads(spec)
    pre = parts["pre_tokenizer"] or {}
    if parts["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre["add_prefix_space"]:
        raise ValueError("only byte-level files without normalizer and prefix space are supported")
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in parts["added_tokens"]):
        raise ValueError("added tokens that take in their surroundings are not supported")
    return sorted((a["content"] for a in parts["added_tokens"]), key=lambda a: (-len(a), a))


def tokenizer(spec: str):
    """The library's tokenizer, on one thread: the tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


class PreTokenizer:
    """Splits whole texts as the tokenizer of a ``tokenizers`` file does before its merges."""

    def __init__(self, spec: str, added: list[str]):
        import regex

        self.spec, self.added, self.library = spec, added, None
        self.cut = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.find = regex.compile(BYTE_LEVEL).findall

    def __call__(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text and how many added tokens stand in it."""
        if self.cut is None or not any(a in text for a in self.added):
            return self._split(text), 0
        segments = self.cut.split(text)
        return [p for s in segments for p in self._split(s)], len(segments) - 1

    def _split(self, text: str) -> list[str]:
        if text.isascii() or max(text) < SETTLED:
            return self.find(text)
        self.library = self.library or tokenizer(self.spec).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]


def _pieces(spec: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the number of pieces to (piece, n) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(spec).encode
        for batch in batches:
            counts = [len(encode(word, add_special_tokens=False).ids) for word in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["piece", "n", "pieces"])

    return run


def count_tokens(docs: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, hot_pieces: int = 131_072, sample_docs: int = 20_000, hot_chars: int = 64) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit): the tokens of each whole text, as the
    library counts them without added begin or end tokens.

    The most frequent pre-tokens of about ``sample_docs`` documents, at most
    ``hot_pieces`` of at most ``hot_chars`` characters, are counted once and go
    out by broadcast (some 10 MB at most). All other pre-tokens of every document
    are counted once each after a distinct, and joined to the documents'
    frequencies. The sample decides only by which of the two ways a pre-token
    is counted, never the result. Token ids are not kept anywhere.

    Null and empty texts have 0 bytes and 0 tokens. Strings of added special
    tokens inside a text count as one token, the library's default. Null ids
    and repeated rows are documents like others. Texts are never cut.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    spec = open(tokenizer_file, encoding="utf-8").read()
    added = added_tokens(spec)
    work = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    n_docs = docs.count()
    share = min(1.0, sample_docs / max(1, n_docs))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = PreTokenizer(spec, added), Counter()
        for batch in _slices(batches):
            for text in batch.column(0).to_pylist():
                seen.update(split(text)[0])
            if len(seen) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "n"])
                seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "n"])

    some = docs.where(F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select(work)
    hot = some.mapInArrow(frequencies, "piece string, n long").where(F.length("piece") <= hot_chars).groupBy("piece").agg(F.sum("n").alias("n"))
    hot = hot.orderBy(F.desc("n"), "piece").limit(hot_pieces).mapInArrow(_pieces(spec), "piece string, n long, pieces long")
    known = spark.sparkContext.broadcast({r["piece"]: r["pieces"] for r in hot.select("piece", "pieces").toLocalIterator()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces = PreTokenizer(spec, added), known.value
        for batch in _slices(batches):
            n_bytes, done, rare = [], [], []
            for text in batch.column(1).to_pylist():
                words, n = split(text)
                left = []
                for word, times in Counter(words).items():
                    k = pieces.get(word)
                    if k is None:
                        left.append((word, times))
                    else:
                        n += k * times
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                done.append(n)
                rare.append(left)
            offsets = pa.array([0, *_running(map(len, rare))], pa.int32())
            flat = pa.StructArray.from_arrays([pa.array([w for r in rare for w, _ in r], pa.string()), pa.array([t for r in rare for _, t in r], pa.int32())], names=["piece", "times"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(done, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], names=["id", "n_bytes", "done", "rare"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType().add("id", kind).add("n_bytes", "long").add("done", "long").add("rare", T.ArrayType(T.StructType().add("piece", "string").add("times", "integer")))
    first = scratch.keep(docs.select(F.col(id_col).alias("id"), work).mapInArrow(count, schema).withColumn("row", F.monotonically_increasing_id()), "first")
    rare = first.select("row", F.explode("rare").alias("r")).select("row", "r.piece", "r.times")
    words = scratch.keep(rare.groupBy("piece").agg(F.count("*").alias("n")).mapInArrow(_pieces(spec), "piece string, n long, pieces long"), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    sums = lookup(rare, words, ["piece"], "n", total, F.col("row").cast("string")).groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("rest"))
    n_tokens = (F.col("done") + F.coalesce("rest", F.lit(0))).cast("long")
    return first.select("row", "id", "n_bytes", "done").join(sums, "row", "left").select("id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _running(lengths) -> Iterator[int]:
    total = 0
    for n in lengths:
        total += n
        yield total
