"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that are met by broadcast, at most: every other key then has at most 1 / HOT_KEYS of the rows.
HOT_KEYS = 10_000


def frequent(counted: DataFrame, count: str) -> DataFrame:
    """The HOT_KEYS rows of greatest ``count``."""
    return counted.orderBy(F.desc(count), *[c for c in counted.columns if c != count]).limit(HOT_KEYS)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str], hot: DataFrame, by: Column) -> DataFrame:
    """rows with the ``values`` (null: none) that table, of distinct long keys, has for their ``keys``.

    ``hot`` holds those rows of table (or just their keys) whose keys are the
    most frequent among rows, HOT_KEYS at most: they are broadcast. The rows
    they settle travel by a hash of ``by`` instead of their key, so no task gets
    them all.
    """
    known = table.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.struct(*values).alias("_found"))
    top = hot.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
    names = [f"_k{i}" for i in range(len(keys))]
    near = known.join(F.broadcast(top), names, "left_semi").toDF(*(f"{n}t" for n in names), "_near")  # at most HOT_KEYS rows
    met = rows.join(F.broadcast(near), [F.col(k) == F.col(f"{n}t") for k, n in zip(keys, names, strict=True)], "left")
    dealt = [F.when(F.col("_near").isNull(), F.col(k)).otherwise(F.xxhash64(F.lit(i), by)).alias(f"{n}r") for i, (k, n) in enumerate(zip(keys, names, strict=True))]
    met = met.select(*(F.col(c) for c in rows.columns), "_near", *dealt)
    met = met.join(known, [F.col(f"{n}r") == F.col(n) for n in names], "left")
    return met.select(*(F.col(c) for c in rows.columns), *(F.coalesce(F.col("_near")[v], F.col("_found")[v]).alias(v) for v in values))
