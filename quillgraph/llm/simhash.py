"""SimHash near-dedup by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm import suffixes
from quillgraph.llm.common import Scratch, components, lookup

BITS = 64


def fingerprint(data: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of UTF-8 text over word shingles; 0 for text without words."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()  # bytes: only ASCII letters and white space count
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: -width] + 1)).tolist()
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    out, n = 0, len(hashes)
    for k in range(8):
        set_bits = np.bincount(octets[:, k], minlength=256) @ _OCTET_BITS
        out |= int(np.packbits(2 * set_bits > n, bitorder="little")[0]) << (8 * k)
    return out


_OCTET_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint((t or "").encode("utf-8", "replace"), width) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, fp long")


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join all within ``radius`` bits.

    Every fingerprint is sent to all values within half the radius. Two that
    are ``radius`` apart meet at a value midway, and all that meet at one value
    are within the radius of each other, so each is linked to the least one
    there: at most 65 fingerprints meet at a value, whatever the data hold.
    """
    if radius not in (0, 1, 2):
        raise ValueError("variants are listed for a radius of at most 2 bits")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1).cast("long") if i == 0 else F.shiftleft(F.lit(1).cast("long"), i) for i in range(BITS if radius else 0)))
    met = fps.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    least = met.withColumn("a", F.expr("min(fp) over (partition by variant)")).where("a <> fp")
    return least.select("a", F.col("fp").alias("b")).distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component): each document's fingerprint and the smallest id
    reachable over links of at most ``radius`` differing bits.

    Documents are first brought together by fingerprint, so copies, however
    many, are one row of the search; hot groups meet only in sums and minima
    that are taken before the shuffle. Null and empty texts, and texts of white
    space only, have fingerprint 0 and link like any other. Rows with a null
    id get a component by the ids they reach, null if there is none. Rows
    that share an id stay apart by fingerprint.
    """
    scratch = Scratch(docs.sparkSession)
    fps = scratch.keep(fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "fingerprints")
    classes = scratch.keep(fps.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "classes")
    found = components(links(classes.select("fp"), radius), scratch)
    group = classes.join(found, classes.fp == found.node, "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("root"))
    group = scratch.keep(group, "groups")
    least = group.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("size"))
    by_fp = lookup(group, least, ["root"], "size", classes.count(), F.xxhash64("fp")).select("fp", "n", "component")
    return lookup(fps, by_fp, ["fp"], "n", fps.count(), F.xxhash64("id")).select("id", "fp", "component")


def table_bits(n: int) -> int:
    """Bits of a table's SimHashes for ``n`` texts: so many that chance meetings of a text stay few, however many texts there are."""
    return min(56, max(32, 8 * math.ceil((10 + math.log2(max(n, 1))) / 8)))


def table_count(bits: int, apart: float = 0.12, missed: float = 0.065) -> int:
    """Tables after which a pair whose bits differ with probability ``apart`` has met in two bits or fewer but for a share ``missed``."""
    meets = sum(math.comb(bits, k) * apart**k * (1 - apart) ** (bits - k) for k in range(3))
    return math.ceil(math.log(missed) / math.log(1 - meets))


def sketch(data: bytes, width: int = 2, tables: int = 10, bits: int = 32) -> list[int]:
    """``tables`` SimHashes of ``bits`` bits, of independent hashes of word shingles; all 0 without words."""
    from xxhash import xxh3_128_digest

    words = data.lower().split()
    if not words:
        return [0] * tables
    joined = b" ".join(words)
    octets = tables * bits // 8
    count = np.zeros(tables * bits, np.int64)
    spans = _spans(words, width)
    for at in range(0, len(spans), 4096):  # bounded, however long the text
        digests = b"".join(xxh3_128_digest(joined[a:b], s) for a, b in spans[at : at + 4096] for s in range(-(-octets // 16)))
        rows = np.frombuffer(digests, np.uint8).reshape(-1, -(-octets // 16) * 16)[:, :octets]
        count += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * count > len(spans)).tobytes()
    return [int.from_bytes(packed[i : i + bits // 8], "big") for i in range(0, octets, bits // 8)]


def _spans(words: list[bytes], width: int) -> list[tuple[int, int]]:
    """Where the shingles of ``width`` words begin and end in the words joined by spaces; all of them if they are fewer."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    size = min(width, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1]
    return list(zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True))


def name(data: bytes) -> tuple[int, int]:
    """Two signed 64-bit hashes of a text's words."""
    from xxhash import xxh3_128_digest

    return struct.unpack("<qq", xxh3_128_digest(b" ".join(data.lower().split()), 5))


def shingles(data: bytes, words: int = 5) -> list[int]:
    """Hashes of a text's distinct word shingles, signed; of all its words if they are fewer, none without words."""
    from xxhash import xxh64_intdigest

    parts = data.lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    return np.unique(np.array([xxh64_intdigest(joined[a:b], 11) for a, b in _spans(parts, words)], np.uint64).view(np.int64)).tolist()


#: Bits of the parities of a text's shingles: two texts' parities differ in no more bits than their sets differ in shingles.
PARITIES = 1024


def parities(hashes: list[int]) -> list[int]:
    """For each of PARITIES values of a hash, whether an odd number of shingles has it; as signed longs."""
    counts = np.bincount(np.array(hashes, np.int64) & (PARITIES - 1), minlength=PARITIES)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64).tolist()


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: tuple[int, int] = (4, 5), width: int = 2, bits: int | None = None) -> DataFrame:
    """(id, component): the smallest id reachable over links between texts whose sets of ``words``-word
    shingles have a Jaccard similarity of at least ``least`` (a fraction).

    Such texts differ in up to a seventh of the bits of a SimHash, too many for two bits
    of 64. So each has several SimHashes of fewer bits (``table_bits``, ``table_count``), and texts that
    differ in at most two bits of one of them meet (in the middle, as in ``links``). All that meet at a value or have one hash are first
    compared with the least there: by all their sketches' bits, of which a quarter may differ, and
    what is left by their shingles, exactly; only then they link. What does not link with the least one is
    compared with all that it meets and may be alike, by how far both are from the least (``_apart``), that is not in one component with it by then (``_others``) and that shares one of its rarest shingles, as texts of
    that similarity do (``_sharing``). So neither a group of near copies nor one of texts just too far apart makes pairs
    with its square, and no link between texts that meet is lost. No text below the similarity links, and of those above
    it nearly all meet: see README for measurements.

    Rows with the same words are one text whatever their number, by 128 bits of hash; null, empty and blank texts
    are one text. Null ids, shared ids and repeated rows as for ``near_duplicates``.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    bits = bits or table_bits(docs.count())
    tables = table_count(bits)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [t.encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            names = np.array([name(d) for d in data], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([sketch(d, width, tables, bits) for d in data], pa.list_(pa.int64()))], names=["id", "h1", "h2", "sketch"])

    rows = scratch.keep(texts.mapInArrow(sketched, f"id {kind}, h1 long, h2 long, sketch array<long>"), "sketches")
    classes = rows.groupBy("h1", "h2").agg(F.first("sketch").alias("sketch"), F.min("id").alias("first"), F.count("*").alias("n"))
    classes = scratch.keep(classes.withColumn("own", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    parts = classes.select("own", F.posexplode("sketch").alias("table", "fp")).select("own", F.col("fp").bitwiseOR(F.shiftleft(F.col("table").cast("long"), bits)).alias("fp"))
    parts = scratch.keep(parts, "parts")
    values = scratch.keep(parts.groupBy("fp").agg(F.min("own").alias("least"), F.count("*").alias("size")), "values")
    same = lookup(parts, values.where("size > 1"), ["fp"], "size", n * tables, F.xxhash64("own")).where("least < own")
    same = scratch.keep(same.select("fp", F.col("least").alias("a"), F.col("own").alias("b")), "same")
    one = F.lit(1).cast("long")
    flips = F.array(F.lit(0).cast("long"), *(one if i == 0 else F.shiftleft(one, i) for i in range(bits)))
    met = values.select("fp", "least", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("value"))
    own = Window.partitionBy("value")
    met = met.withColumns({"a": F.min("least").over(own), "most": F.max("least").over(own)}).where("a < most")
    met = scratch.keep(met.select("value", "fp", "least", "a"), "met")
    near = met.where("a < least").select("a", F.col("least").alias("b"))
    of = lambda side: classes.select(F.col("own").alias(side), F.col("sketch").alias(f"of_{side}"))
    differ = F.zip_with("of_a", "of_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(differ, F.lit(0), lambda s, x: s + x)
    most = bits * tables // 4
    sketches = lambda pairs: pairs.join(of("a"), "a").join(of("b"), "b")
    wanted = lambda pairs: _ends(pairs).distinct().join(classes.select("own", "h1", "h2"), "own")
    measured = scratch.keep(sketches(same.select("a", "b").unionAll(near).distinct()).select("a", "b", apart.alias("bits")), "pairs")
    close = measured.where(F.col("bits") <= most).select("a", "b")
    sets = _sets(texts, wanted(close), words, scratch)
    linked = scratch.keep(_similar(close, sets, least), "links")
    scratch.drop(sets)
    others = _others(same, met, parts, classes, linked, measured, most, scratch)
    scratch.drop(parts, values, same, met, measured)
    if others is not None:
        sets = _sets(texts, others.select("own", "h1", "h2"), words, scratch)
        more = sketches(_sharing(others, sets, least, scratch)).where((apart <= most) & (F.array_min(differ) <= 2)).select("a", "b")
        linked = linked.unionAll(scratch.keep(_similar(scratch.keep(more, "pairs"), sets, least), "links"))
        scratch.drop(sets)
    found = components(linked, scratch)
    group = scratch.keep(classes.join(found, classes.own == found.node, "left").select("h1", "h2", "own", "first", "n", F.coalesce("component", "own").alias("root")), "groups")
    best = group.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("size"))
    by_name = lookup(group, best, ["root"], "size", n, F.xxhash64("own")).select("h1", "h2", "n", "component")
    return lookup(rows.select("id", "h1", "h2"), by_name, ["h1", "h2"], "n", rows.count(), F.xxhash64("id")).select("id", "component")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("own")).unionAll(pairs.select("b"))


def _others(same: DataFrame, met: DataFrame, parts: DataFrame, classes: DataFrame, linked: DataFrame, measured: DataFrame, most: int, scratch: Scratch) -> DataFrame | None:
    """The texts (own, h1, h2, root, asks) that links to the least ones leave open: a text that does not link with the least of its hash,
    and all texts of a hash that ``_apart`` says, ask; those that
    meet them there may answer; root is the component that a text has already. None if no text asks."""
    lone = scratch.keep(same.join(linked, ["a", "b"], "left_anti").select("fp", F.col("b").alias("own")), "outliers")
    found = components(linked, scratch)
    apart = scratch.keep(_apart(same, met, linked, measured, found, most), "outliers")
    if lone.isEmpty() and apart.where("asks").isEmpty():
        return None
    of = lambda fps: parts.join(fps.distinct(), "fp", "left_semi").select("own")
    asking = of(apart.where("asks").select("fp")).unionAll(lone.select("own")).distinct().withColumn("asks", F.lit(True))
    there = apart.join(apart.where("asks").select("value").distinct(), "value", "left_semi").select("fp")
    around = met.join(lone.select("fp").distinct(), "fp", "left_semi").select("value").distinct()
    there = of(there.unionAll(met.join(around, "value", "left_semi").select("fp")).unionAll(lone.select("fp"))).distinct()
    texts = there.join(asking, "own", "left").join(classes.select("own", "h1", "h2"), "own").join(found, F.col("own") == F.col("node"), "left")
    return scratch.keep(texts.select("own", "h1", "h2", F.coalesce("component", "own").alias("root"), F.coalesce("asks", F.lit(False)).alias("asks")), "open")


def _apart(same: DataFrame, met: DataFrame, linked: DataFrame, measured: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """The hashes at a value (value, fp, asks) of which texts may be alike that have not been compared; those whose least does not link with the least there ask.

    Differing bits are a metric, and all at a value have been measured from the least one there: two hashes whose least ones are not about as far from it
    hold no alike texts (``most`` bits, and as many as a hash's texts are from its least). So where unlike texts
    meet by chance, as do the more the more texts there are, nothing is open; nor where all that meet are in one component. The least one of all has been compared and does not count, but
    others of its hash do.
    """
    wide = same.join(measured, ["a", "b"]).groupBy("fp").agg(F.max("bits").alias("wide"))
    known = measured.join(linked.withColumn("links", F.lit(True)), ["a", "b"], "left").withColumnRenamed("b", "least")
    at = met.join(wide, "fp", "left").join(found, F.col("least") == F.col("node"), "left").join(known, ["a", "least"], "left")
    at = at.where((F.col("a") < F.col("least")) | F.col("wide").isNotNull())
    asks = (F.col("a") < F.col("least")) & F.col("links").isNull()
    at = at.select("value", "fp", asks.alias("asks"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("bits", "wide")), F.coalesce("component", "least").alias("root"))
    there = Window.partitionBy("value")
    below, above = there.orderBy("bits", "fp"), there.orderBy(F.desc("bits"), F.desc("fp"))
    step = lambda line: F.when(F.lag("root").over(line) != F.col("root"), F.lag("bits").over(line))
    at = at.withColumns({"low": step(below), "high": step(above), "widest": F.max("wide").over(there)})
    low, high = (F.last(c, ignorenulls=True).over(line) for c, line in (("low", below), ("high", above)))  # of another component
    at = at.withColumn("nearest", F.least(F.col("bits") - low, high - F.col("bits")))
    return at.where(F.col("nearest") <= most + F.col("wide") + F.col("widest")).select("value", "fp", "asks")


def _sharing(texts: DataFrame, sets: DataFrame, least: tuple[int, int], scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of a text that asks and one that may answer, not in one component, that share one of their rarest shingles.

    With all shingles in one order, two sets of that similarity share one of the first n - ceil(n * similarity) + 1 of
    either, n being its size, and differ in at most a share (1 - similarity) / (1 + similarity) of both sizes, so no link is lost. The order is by the number of these texts that hold a shingle: what
    only one holds comes first and meets nothing, so texts that differ too much make few pairs, and where a shingle is held by many of them, the parities of all their
    shingles tell them apart within the join, before a row is made.
    """
    n, (p, q) = F.size("shingles"), least
    held = sets.select("own", n.alias("n"), F.explode("shingles").alias("shingle"))
    counts = scratch.keep(held.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1"), "held")
    total = sets.agg(F.coalesce(F.sum(n.cast("long")), F.lit(0))).first()[0]
    ranked = lookup(held, counts.withColumn("copies", F.col("held")), ["shingle"], "copies", total, F.xxhash64("own"))
    place = F.row_number().over(Window.partitionBy("own").orderBy(F.coalesce("held", F.lit(1)), "shingle"))
    first = ranked.withColumn("place", place).where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * p / q) + 1) & F.col("held").isNotNull())
    first = first.select("own", "n", "shingle").join(texts.select("own", "root", "asks"), "own").join(sets.select("own", "parity"), "own")
    first = scratch.keep(first, "rarest")
    x, y = first.where("asks").alias("x"), first.alias("y")
    both = F.col("x.n") + F.col("y.n")
    apart = sum((F.bit_count(F.get("x.parity", i).bitwiseXOR(F.get("y.parity", i))) for i in range(1, PARITIES // 64)), F.bit_count(F.get("x.parity", 0).bitwiseXOR(F.get("y.parity", 0))))
    once = ~F.col("y.asks") | (F.col("x.own") < F.col("y.own"))
    size = F.least("x.n", "y.n") * q >= F.greatest("x.n", "y.n") * p
    pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") != F.col("y.root")) & once & size & (apart * (p + q) <= both * (q - p)))
    return pairs.select(F.least("x.own", "y.own").alias("a"), F.greatest("x.own", "y.own").alias("b")).distinct()


def _sets(texts: DataFrame, wanted: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """(own, shingles, parity) of the texts that are wanted (own, h1, h2), written. A bitmap of fixed size says in the task
    which texts may be, so that no others are hashed or shuffled."""
    wanted = scratch.keep(wanted, "wanted")
    blocks = suffixes._bitmap(wanted.select(F.col("h1").alias("row"))).toArrow()  # at most 128 rows of 64 KB
    bitmap = np.zeros((1 << (suffixes.BITS - 19), 1 << 13), np.int64)
    for block, held in zip(blocks.column("block").to_pylist(), blocks.column("bits"), strict=True):
        bitmap[block] = held.values.to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(bitmap.reshape(-1))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, mask = shared.value, (1 << suffixes.BITS) - 1
        for batch in batches:
            out = {}
            for text in batch.column(0).to_pylist():
                data = text.encode("utf-8", "replace")
                key = name(data)
                if key not in out and bitmap[(key[0] & mask) >> 6] >> (key[0] & 63) & 1:
                    out[key] = shingles(data, words)
            names = np.array(list(out), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(list(out.values()), pa.list_(pa.int64())), pa.array(list(map(parities, out.values())), pa.list_(pa.int64()))], names=["h1", "h2", "shingles", "parity"])

    found = texts.select("text").mapInArrow(hashed, "h1 long, h2 long, shingles array<long>, parity array<long>")
    return scratch.keep(found.join(wanted.hint("shuffle_hash"), ["h1", "h2"]).groupBy("own").agg(F.first("shingles").alias("shingles"), F.first("parity").alias("parity")), "shingles")


def _similar(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs whose shingles have at least that similarity."""
    of = lambda side: sets.select(F.col("own").alias(side), F.col("shingles").alias(f"s_{side}"))
    both, all_ = F.size(F.array_intersect("s_a", "s_b")), F.size("s_a") + F.size("s_b")
    return pairs.join(of("a"), "a").join(of("b"), "b").where(both * least[1] >= (all_ - both) * least[0]).select("a", "b")
