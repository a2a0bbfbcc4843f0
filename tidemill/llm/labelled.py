"""Bounded labelled samples and held-out folds for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.textkit import Workspace


def fold(mod: int, remainder: int) -> Column:
    """True where crc32(doc_id as text) mod ``mod`` is ``remainder``; null ids hash as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == remainder


#: Bytes of the texts that a classifier is fitted on, at most.
SAMPLE_BYTES = 64 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, work: Workspace, size: int = SAMPLE_BYTES, lines: int | None = None) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents where ``learn`` holds, drawn by a hash of the id; texts are whole.

    Null labels teach nothing; of several labels of one id the greatest counts.
    Rows are taken in order while their texts fit into ``size`` bytes together and,
    if stated, into so many ``lines``; a text that does not fit by itself is left out.
    """
    known = labels.filter(learn & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id", F.desc("label")).limit(rows).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # at most ``rows`` ids
    texts = work.save(texts.select(F.monotonically_increasing_id().alias("_n"), F.xxhash64("doc_id", "text").alias("_hash"), "text", "label"), "drawn")
    n_lines = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    sizes = texts.select("_n", "_hash", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), n_lines.alias("lines")).filter(F.col("size") <= size)
    fits = F.col("size") <= size
    if lines is not None:
        sizes, fits = sizes.filter(F.col("lines") <= lines), fits & (F.col("lines") <= lines)
    w = Window.orderBy("_hash", "_n")  # numbers of the drawn rows alone
    taken = sizes.select("_n", F.sum("size").over(w).alias("size"), F.sum("lines").over(w).alias("lines")).filter(fits)
    return texts.join(taken.select("_n"), "_n", "left_semi").select("text", "label")
