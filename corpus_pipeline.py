"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.llm import textkit as tk
from tidemill.llm.decontaminate import drop_contaminated
from tidemill.llm.language_id import reject_unknown
from tidemill.llm.line_dedup import drop_boilerplate
from tidemill.llm.near_dedup import drop_near_duplicates
from tidemill.llm.packing import pack, vocabulary


def language(spark, docs, sf_dir):
    """Documents in no recognised language go: null texts, those without a letter, and those whose code length is beyond that of all learned languages."""
    return reject_unknown(docs)


def lines(spark, docs, sf_dir):
    """Cross-site boilerplate lines of any length go, and documents of which nothing is left then. Null texts and sources stay as they are."""
    own, back = tk.aside(docs, "doc_id", "text", "source", "n_chars")
    out = drop_boilerplate(own)
    out = out.filter((F.col("n_removed") == 0) | (F.trim("kept_text") != ""))
    return out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("text").cast("long")).select(back)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group stays, the one of least doc_id; null ids and texts without words are in no group and stay."""
    return drop_near_duplicates(docs)


def benchmark(spark, docs, sf_dir):
    """Contaminated documents go, and the benchmark spans of the others. Null texts stay."""
    own, back = tk.aside(docs, "text", "n_chars")
    out = drop_contaminated(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(back)


def packing(spark, docs, sf_dir):
    """Pieces of sequences; a null text is the end id alone, an empty table gives none."""
    return pack(docs, vocabulary())


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontaminate", benchmark), ("packing", packing)]

#: A learned classifier decides in the first stage and tokens are made in the last: no SQL; tests use brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """All stages over documents, each written and read again."""
    work = tk.Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
