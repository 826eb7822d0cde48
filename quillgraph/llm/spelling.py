"""Spelling variants: words one edit apart, met by equal bands of their letters' parities."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import UPPER, Scratch

LETTERS = "[A-Za-zÀ-ÿ]+"
LOWER = str.maketrans(UPPER, UPPER.lower())
BANDS, BAND_BITS = 3, 21
#: Distinct words that a task counts before it hands them on.
HELD = 200_000


def damaged(run: str, name: str, divisor: int) -> str:
    """A run of letters; without one code point if ``divisor`` divides the checksum of ``name:run``."""
    h = zlib.crc32(f"{name}:{run}".encode())
    if h % divisor:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_n: int = 5, divisor: int = 199) -> DataFrame:
    """(word, n): the words of all whole texts with at least ``least_length`` code points and ``least_n`` occurrences.

    A task adds up its words before they are shuffled, and hands on what it has once HELD differ.
    """
    find = re.compile(LETTERS).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        table = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for run, n in Counter(find(text.translate(LOWER))).items():
                    word = damaged(run, name, divisor)
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > HELD:
                    yield table()
                    held.clear()
        yield table()

    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def parities(word: Column) -> Column:
    """BANDS * BAND_BITS bits, each the parity of how often its letters occur: an edit flips at most two."""
    code = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.ascii(F.substring(word, i, F.lit(1))))
    return F.aggregate(code, F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(_bit(c)))


def _bit(code: Column) -> Column:
    """The bit of a letter: neighbours in the alphabet go to different bands."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (code % BANDS * BAND_BITS + F.floor(code / BANDS).cast("int") % BAND_BITS).cast("int"))


def band(mask: Column, i: int) -> Column:
    return F.shiftright(mask, i * BAND_BITS).bitwiseAND(F.lit((1 << BAND_BITS) - 1))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every word with each word exactly one edit away, both ways round.

    An edit flips at most two bits of the parities, so one of the three bands is equal; lengths differ by one at most; and
    of both words either the first or the last half of the shorter's length agrees. Words meet by
    (shorter length, band, half), which keeps those apart that share letters only. A pair
    is taken where it first meets, so none comes twice, and verified by edit distance in code points. Spark takes the words
    and their dozen spots for one size and would broadcast them, so the join says how it is to be done.
    """
    w = words.withColumn("mask", parities(F.col("word"))).withColumn("len", F.length("word"))
    short = w.withColumn("short", F.explode(F.array(F.col("len"), F.col("len") - 1))).withColumn("half", F.floor(F.col("short") / 2).cast("int"))
    head, tail = F.substring(F.col("word"), F.lit(1), F.col("half")), F.substring(F.col("word"), F.col("len") - F.col("half") + 1, F.col("half"))
    spots = F.explode(F.array(*(F.struct(F.lit(k).alias("spot"), band(F.col("mask"), i).alias("band"), part.alias("part")) for k, (part, i) in enumerate((p, i) for p in (head, tail) for i in range(BANDS)))))
    met = short.select("word", "n", "mask", "len", "short", "half", head.alias("head"), spots.alias("s")).select("word", "n", "mask", "len", "short", "head", "s.*")
    x, y = met.alias("x"), met.alias("y")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("short", "spot", "band", "part")]
    lengths = F.least("x.len", "y.len") == F.col("x.short")  # the filter: one of both has the shorter length
    flipped = F.col("x.mask").bitwiseXOR(F.col("y.mask"))
    first_band = F.when(band(flipped, 0) == 0, 0).when(band(flipped, 1) == 0, 1).otherwise(2)
    first = F.col("x.spot") == first_band + F.when(F.col("x.head") == F.col("y.head"), 0).otherwise(BANDS)
    pairs = x.join(y.hint("merge"), on).where((F.col("x.word") < F.col("y.word")) & lengths & (F.bit_count(flipped) <= 2) & first)
    pairs = pairs.where(F.levenshtein("x.word", "y.word", 1) == 1).select(F.col("x.word").alias("word"), F.col("x.n").alias("n"), F.col("y.word").alias("other"), F.col("y.n").alias("other_n"))
    return pairs.unionAll(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_n: int = 5, ratio: int = 5, divisor: int = 199) -> DataFrame:
    """(word, form, root, n, n_near, form_n): spelling variants among the words of all whole texts.

    A word's form is its near word (one code point inserted, deleted or replaced) of largest n,
    ties to the smallest, if that n is at least ``ratio`` times its own, else null; its root is the
    last form that following them leads to, itself if none. As n grows by ``ratio`` at each step,
    no chain is longer than log(n), and pointers are doubled log(log(n)) times.

    Null texts and texts without letters give no word. A null id stands as an empty name in the
    checksum. Repeated rows count as often as they are there. Words of one code point may lose it
    and are gone. The words may be of any number: nothing is collected or broadcast by intent; a key of the join holds
    words that share half their letters, length and a band, whatever their counts.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.keep(word_counts(docs, id_col=id_col, text_col=text_col, least_length=least_length, least_n=least_n, divisor=divisor), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.join(near.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(-F.col("best.minus") >= F.col("n") * ratio, F.col("best")).alias("best"))
    rows = scratch.keep(rows.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n")), "forms")
    up = scratch.keep(rows.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        new = scratch.keep(up.join(above.hint("merge"), "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        scratch.drop(up)
        moved = not new.where("moved").isEmpty()
        up, path = new.select("word", "root"), new._scratch_path
        up._scratch_path = path
        if not moved:
            break
    return rows.join(up.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
