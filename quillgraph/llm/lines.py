"""Line dedup: lines that several documents share stay only where they came first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import SPACES, UPPER, Scratch, fresh, hash128, lookup, quoted


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(SPACES)), UPPER, UPPER.lower())


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """Drops each line whose key is found in ``min_docs`` documents or more, except
    in the smallest id that holds it.

    Lines are exploded and hashed to 128 bits (text itself is not shuffled for
    counting); documents are counted for each hash; the hashes that a document
    loses meet its text once, and the text is put together again by position.

    Returns every input column, ``text_col`` holding what is left, and
    _n_lines, _n_dropped (long), which replace input columns so named. A null or empty text is one empty line and
    stays as ''. Keys under ``min_chars`` code points never count. Rows with a
    null id neither count nor lose lines. Rows that share an id count as one
    document and lose the same lines. Repeats inside one document stay there
    if it is the smallest holder and all go otherwise. Ties cannot arise: ids
    are compared, and equal ids are one document.
    """
    scratch = Scratch(docs.sparkSession)
    key = line_key(F.col("line"))
    h1, h2 = hash128(F.col("key"))
    lines = (
        docs.select(F.col(id_col).alias("id"), F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("line"))
        .where(F.col("id").isNotNull())
        .select("id", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select("id", h1.alias("h1"), h2.alias("h2"))
        .distinct()
    )
    lines = scratch.keep(lines, "lines")
    shared = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("keeper")).where(F.col("n") >= min_docs)
    gone = lookup(lines, shared, ["h1", "h2"], "n", lines.count(), F.xxhash64("id", "h2")).where(F.col("id") > F.col("keeper"))
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("_n_lines", "_n_dropped")])
    own, hashes, split, kept = fresh(docs, "_id", "_gone", "_split", "_kept")
    gone = gone.groupBy(F.col("id").alias(own)).agg(F.collect_set(F.struct("h1", "h2")).alias(hashes))
    out = docs.join(gone.hint("shuffle_hash"), F.col(id_col) == F.col(own), "left")

    def stays(line: Column) -> Column:
        k = line_key(line)
        h1, h2 = hash128(k)
        return (F.length(k) < min_chars) | ~F.array_contains(F.col(hashes), F.struct(h1.alias("h1"), h2.alias("h2")))

    out = out.withColumn(split, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).withColumn("_n_lines", F.size(split).cast("long"))
    out = out.withColumn(kept, F.when(F.col(hashes).isNotNull(), F.filter(split, stays)))
    return out.select(
        *(c if c.strip("`") != text_col else F.coalesce(F.array_join(kept, "\n"), F.col(text_col), F.lit("")).alias(text_col) for c in quoted(docs.columns)),
        "_n_lines",
        F.coalesce(F.col("_n_lines") - F.size(kept), F.lit(0)).cast("long").alias("_n_dropped"),
    )
