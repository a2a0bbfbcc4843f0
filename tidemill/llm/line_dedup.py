"""Cross-site boilerplate lines by distinct-site spread (operator 7).

Each line hash gets a HyperLogLog sketch of the sites that show it; partial
sketches merge by aggregation, so a line that fills a third of the table
costs one sketch per task. Only lines whose estimate lies near the threshold
are counted exactly. Site spread alone decides, however short a line is. All of
it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import textkit as tk
from tidemill.llm.skew import frequent, lookup

#: Sites from which on a line is boilerplate.
MIN_SITES = 10
#: Sketch size (2**12 registers: standard error 1.6 %) and the relative band around MIN_SITES that is counted exactly.
LG_K, BAND = 12, 0.2

_LINE = ("_h1", "_h2")


def _lines(docs: DataFrame) -> DataFrame:
    """(key of the row, site, position, two hashes) of every line that is not blank."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("_row"), F.col("source").alias("_site"), F.posexplode(F.split("text", "\n")).alias("_pos", "_line"))
    rows = rows.withColumn("_line", F.trim("_line")).filter(F.col("_line") != "")
    return rows.select("doc_id", "_row", "_site", "_pos", F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(7), "_line").alias("_h2"))


def boilerplate(lines: DataFrame, min_sites: int, work: tk.Workspace) -> DataFrame:
    """Line hashes seen on min_sites sites or more, with their first place (doc_id, position) and number; rows of null source count as no site."""
    first = F.min(F.struct("doc_id", "_pos")).alias("_first")
    spread = lines.groupBy(*_LINE).agg(F.hll_sketch_agg("_site", LG_K).alias("_sites"), F.count("_site").alias("_n"), F.count("*").alias("_rows"), first)
    spread = spread.filter(F.col("_n") >= min_sites).withColumn("_est", F.hll_sketch_estimate("_sites")).drop("_sites", "_n")
    spread = work.save(spread.filter(F.col("_est") >= (1 - BAND) * min_sites), "spread")
    sure = F.col("_est") > (1 + BAND) * min_sites
    near = spread.filter(~sure).drop("_est")
    exact = lines.select(*_LINE, "_site").distinct()  # combined before the shuffle: a line has as many rows as sites
    exact = exact.join(near, [*_LINE], "left_semi").groupBy(*_LINE).agg(F.count("_site").alias("_n")).filter(F.col("_n") >= min_sites)
    return spread.filter(sure).drop("_est").unionByName(near.join(exact, [*_LINE], "left_semi"))


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Every row of docs with kept_text, n_lines and n_removed (columns of those names are replaced).

    A boilerplate line stays at its first place only (least doc_id, null first, then
    position). Lines are separated by \\n and compared trimmed of spaces; blank
    lines stay. Null text: no lines, kept_text null. An empty text is one blank
    line. Repeated rows are treated alike.
    """
    docs = docs.drop("kept_text", "n_lines", "n_removed")
    own, back = tk.aside(docs, "doc_id", "text", "source")
    lines = _lines(own)
    work = tk.Workspace(docs.sparkSession, "line-dedup")
    found = work.keep(boilerplate(lines, min_sites, work))
    work.drop("")
    top = frequent(found.select(*_LINE, "_rows"), "_rows")
    hits = lookup(lines, found, [*_LINE], ["_first"], top, F.struct("doc_id", "_pos"))
    hits = hits.filter(F.col("_first").isNotNull() & (F.struct("doc_id", "_pos") != F.col("_first")))
    gone = hits.groupBy("doc_id", "_row").agg(F.collect_set("_pos").alias("_gone"))
    gone = gone.withColumnsRenamed({"doc_id": "_id", "_row": "_key"})
    keyed = own.withColumn("_row", F.xxhash64("text"))
    joined = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["_id"]) & (keyed["_row"] == gone["_key"]), "left").withColumn("_parts", F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), "_gone")
    kept = F.concat_ws("\n", F.transform(stay, lambda i: F.col("_parts")[i]))
    joined = joined.withColumns({
        "kept_text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept),
        "n_lines": F.coalesce(F.size("_parts"), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
    })
    return joined.select(*back, "kept_text", "n_lines", "n_removed")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """``drop_boilerplate`` of all documents; a null text counts as no lines and keeps none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = drop_boilerplate(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.char_length(F.coalesce("kept_text", F.lit(""))).cast("long").alias("n_kept_chars"), F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = f"""
WITH rows AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, source, CAST(i - 1 AS BIGINT) AS pos, trim(parts[i], ' ') AS line, parts[i] AS raw
  FROM (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS i FROM rows)),
wide AS (
  SELECT line, min({{'d': doc_id, 'p': pos}}) AS first FROM lines WHERE line <> ''
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (
  SELECT l.*, w.line IS NOT NULL AND w.first <> {{'d': l.doc_id, 'p': l.pos}} AS gone
  FROM lines l LEFT JOIN wide w ON l.line = w.line),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CAST(length(coalesce(kept, '')) AS BIGINT) AS n_kept_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
