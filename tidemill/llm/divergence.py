"""Source divergence audit by two-dimensional group-block tiling (operator 13).

Groups are the (lang, source) pairs; their terms are counted, and a language's
kept terms are dealt into vocabulary chunks, in which a group's counts are one
packed vector (positions and counts). The groups of a language are dealt into
blocks, and every vector is sent to the tiles of its block: tile (i, j) has
the vectors of blocks i and j, adds up its pair submatrix chunk after chunk,
and is itself parted into spans of chunks, so neither many sources nor many
terms meet in one task. What every term adds that neither group has is the
same, so it is added once by its number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm import textkit as tk

#: Documents of a language that a kept term is in, at least; smoothing of each count; ranks of part ``term``.
MIN_DOCS, SMOOTH, TOP = 30, 5, 50
SCALE = 1_000_000_000
#: Terms of a chunk and groups of a block, about; chunks of a span.
CHUNK, BLOCK, SPAN = 4096, 16, 8
#: Text that is counted at a time.
COUNTED = 8 << 20

#: Bytes of terms: ASCII letters and all of every other script.
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True

_COUNTS = "lang string, source string, term string, n long, docs long"


def _counts(batches):
    """Of rows (lang, source, text): occurrences of each group's terms and rows that hold them, and an empty term of each group."""
    for piece in tk.slices(batches, COUNTED):
        own: dict[tuple, int] = {}
        of = np.array([own.setdefault(g, len(own)) for g in zip(piece.column("lang").to_pylist(), piece.column("source").to_pylist(), strict=True)], np.int64)
        buf, offsets = tk.utf8(piece.column("text"))
        start, end, rows = tk.words(buf, offsets, LETTER)
        coded = tk.word_array(tk.LOWER[buf], start, end).dictionary_encode()
        size = max(1, len(coded.dictionary))
        in_row, n = np.unique(np.repeat(np.arange(len(of)), np.diff(rows)) * size + coded.indices.to_numpy(), return_counts=True)
        in_group, at, docs = np.unique(of[in_row // size] * size + in_row % size, return_inverse=True, return_counts=True)
        total = np.zeros(len(in_group), np.int64)
        np.add.at(total, at, n)
        none = np.zeros(len(own), np.int64)
        group = pa.array(np.append(in_group // size, np.arange(len(own))))
        term = pa.concat_arrays([coded.dictionary.take(pa.array(in_group % size)).cast(pa.large_string()), pa.array([""] * len(own), pa.large_string())])
        cols = [pa.array([g[k] for g in own], pa.string()).take(group) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*cols, term.cast(pa.string()), pa.array(np.append(total, none)), pa.array(np.append(docs, none))], names=["lang", "source", "term", "n", "docs"])


def share(count, whole):
    """1 + floor(SCALE * (count + SMOOTH) / whole) in whole numbers of 64 bits, by long division in two steps; exact for counts to 9e13."""
    big = (count + SMOOTH) * 100_000
    return 1 + big // whole * 10_000 + big % whole * 10_000 // whole


def _share(count: str, whole: str) -> Column:
    big = f"(({count} + {SMOOTH}) * 100000L)"
    return F.expr(f"1 + ({big} div {whole}) * 10000L + (({big} % {whole}) * 10000L div {whole})")


def _tile(table: pa.Table) -> pa.Table:
    """The pair submatrix of one tile over one span. Rows without a chunk name the groups, the others hold their vectors."""
    get = lambda t, c: t.column(c).to_numpy()
    named = table.filter(pc.is_null(table.column("chunk"))).sort_by("source")
    held = table.filter(pc.is_valid(table.column("chunk")))
    source, block, vocab = named.column("source").to_pylist(), get(named, "block"), int(named.column("vocab")[0].as_py())
    i, j, span = (table.column(c)[0].as_py() for c in ("i", "j", "span"))
    own, other = np.flatnonzero(block == i), np.flatnonzero(block == j)
    whole = get(named, "own") + SMOOTH * vocab
    out = np.zeros((len(own), len(other)), np.int64)
    if vocab:
        absent = share(np.zeros(len(whole), np.int64), whole)
        apart = np.abs(absent[own][:, None] - absent[other][None, :])
        if span == 0:
            out += vocab * apart
        row_of = {s: k for k, s in enumerate(source)}
        chunk, row = get(held, "chunk"), np.array([row_of[s] for s in held.column("source").to_pylist()], np.int64)
        cells = held.column("cells").combine_chunks()
        size, flat = cells.value_lengths().to_numpy(), cells.flatten()
        pos, n = (flat.field(c).to_numpy() for c in ("pos", "n"))
        row, chunk = np.repeat(row, size), np.repeat(chunk, size)
        for c in np.unique(chunk).tolist():
            here = chunk == c
            width = int(pos[here].max()) + 1
            dense = np.repeat(absent[:, None], width, 1)
            dense[row[here], pos[here]] = share(n[here], whole[row[here]])
            for k, a in enumerate(own):
                out[k] += np.abs(dense[other] - dense[a]).sum(1)
            out -= width * apart
    x, y = np.nonzero(own[:, None] < other[None, :]) if i == j else np.nonzero(np.ones(out.shape, bool))
    pick = lambda k: pa.array([source[m] for m in k.tolist()], pa.string())
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(x), pa.string()), "a": pick(own[x]), "b": pick(other[y]), "value": pa.array(out[x, y])})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, chunk: int = CHUNK, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """Rows lang, source, part, item, value, rank: how far each group is from each other source of its language (pair), and by which terms from the language (term).

    docs: text, lang, source, each empty if null; every row is a document, so
    repeated rows count again. A language without kept terms gives pairs of value
    0, a language of one source none; an empty table gives no rows. Other columns
    are left out. The last three sizes change how the work is dealt, not the result.
    """
    with tk.Workspace(docs.sparkSession, "divergence") as work:
        return work.keep(_audit(docs, min_docs, top, chunk, block, span, work))


def _audit(docs: DataFrame, min_docs: int, top: int, chunk: int, block: int, span: int, work: tk.Workspace) -> DataFrame:
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = rows.mapInArrow(_counts, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = work.save(counts, "counts")
    terms = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).filter(F.col("docs") >= min_docs)
    terms = work.save(terms.select("lang", "term", "total"), "terms")
    langs = work.save(terms.groupBy("lang").agg(F.count("*").alias("vocab"), F.sum("total").alias("all")), "langs")
    chunks = max(1, -(-(langs.agg(F.max("vocab")).first()[0] or 0) // chunk))
    placed = terms.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int"))
    placed = placed.withColumn("pos", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    kept = work.save(counts.select("lang", "source", "term", "n").join(placed, ["lang", "term"]), "kept")

    groups = counts.select("lang", "source").distinct()
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = groups.join(sums, ["lang", "source"], "left").join(blocks, "lang").join(langs, "lang", "left").fillna(0, ["own", "vocab", "all"])
    groups = work.save(groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")), "groups")

    spans = -(-chunks // span)
    vectors = kept.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("pos", "n")).alias("cells"))  # about ``chunk`` cells at most
    vectors = vectors.join(groups, ["lang", "source"]).withColumn("span", F.floor(F.col("chunk") / span).cast("int"))
    names = groups.withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(spans - 1)))).withColumn("chunk", F.lit(None).cast("int"))
    both = vectors.unionByName(names, allowMissingColumns=True).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = both.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "span", "block", "source", "own", "vocab", "chunk", "cells")
    tiles = both.groupBy("lang", "i", "j", "span").applyInArrow(_tile, "lang string, a string, b string, value long")
    near = tiles.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    near = work.save(near, "near")
    pairs = near.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(near.select("lang", "b", "a", "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    held = kept.join(groups.select("lang", "source", "own", "vocab", "all"), ["lang", "source"])
    held = held.withColumn("value", _share("n", f"(own + {SMOOTH} * vocab)") - _share("total", f"(`all` + {SMOOTH} * vocab)")).filter("n > 0 AND value > 0")
    leading = held.select("lang", "source", F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).union(leading.withColumn("part", F.lit("term")).select(columns))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """``audit`` of all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
o AS (SELECT lang, source, t, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(w) AS t FROM d) GROUP BY lang, source, t),
k AS (SELECT lang, t, sum(n) AS total FROM o GROUP BY lang, t HAVING sum(docs) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(total) AS nl FROM k GROUP BY lang),
s AS (SELECT o.lang, o.source, sum(n) AS n FROM o JOIN k ON o.lang = k.lang AND o.t = k.t GROUP BY o.lang, o.source),
g AS (
  SELECT x.lang, x.source, coalesce(s.n, 0) AS n, coalesce(v.v, 0) AS v, coalesce(v.nl, 0) AS nl
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN s ON s.lang = x.lang AND s.source = x.source LEFT JOIN v ON v.lang = x.lang),
p AS (
  SELECT g.lang, g.source, k.t, coalesce(o.n, 0) AS c,
    1 + CAST({SCALE} AS HUGEINT) * (coalesce(o.n, 0) + {SMOOTH}) // (g.n + {SMOOTH} * g.v) AS p, 1 + CAST({SCALE} AS HUGEINT) * (k.total + {SMOOTH}) // (g.nl + {SMOOTH} * g.v) AS q
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.t = k.t),
f AS (
  SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.t = y.t AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
a AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL
  SELECT lang, source, 'term', t, p - q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM a)
WHERE part = 'pair' OR rank <= {TOP}
"""
