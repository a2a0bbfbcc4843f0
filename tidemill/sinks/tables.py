"""Tables of Parquet files by partition, and lists of JSON lines, that can be written to again.

Each operation touches only the partitions it must, and can be repeated: a write
that was cut short is done anew with the same result. One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Table:
    """Rows in folders of one partition column under ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str):
        self.spark, self.path, self.schema, self.by = spark, path, schema, by

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException:  # nothing written yet
            return self.spark.createDataFrame([], self.schema)

    def _rewrite(self, rows: DataFrame, partitions: list) -> None:
        """Put rows in the place of whole partitions; those that rows leave empty go."""
        left = {r[0] for r in rows.select(self.by).distinct().collect()}  # partitions of this call, not rows
        rows.repartition(self.by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.by).parquet(self.path)
        for p in set(partitions) - left:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.by}={p}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def append(self, rows: DataFrame) -> None:
        rows.repartition(self.by).write.mode("append").partitionBy(self.by).parquet(self.path)

    def replace_range(self, within: Column, fresh: DataFrame) -> None:
        """Delete the rows ``within`` and insert the fresh ones: as often as one likes."""
        old = self.read()
        partitions = [r[0] for r in old.filter(within).select(self.by).union(fresh.select(self.by)).distinct().collect()]
        stay = old.filter(F.col(self.by).isin(partitions) & ~F.coalesce(within, F.lit(False)))
        self._rewrite(stay.unionByName(fresh.select(stay.columns)), partitions)

    def delete(self, which: Column) -> None:
        """Rewrite the partitions that hold such rows without them."""
        old = self.read()
        partitions = [r[0] for r in old.filter(which).select(self.by).distinct().collect()]
        if partitions:
            self._rewrite(old.filter(F.col(self.by).isin(partitions) & ~F.coalesce(which, F.lit(False))), partitions)

    def replace_rows(self, keys: DataFrame, fresh: DataFrame, names: list[str]) -> None:
        """Put fresh rows in the place of those with the given keys (each with its partition); partitions without one are not touched."""
        partitions = [r[0] for r in keys.select(self.by).distinct().collect()]  # partitions of this call, not rows
        if partitions:
            stay = self.read().filter(F.col(self.by).isin(partitions)).join(keys.select(*names), names, "left_anti")
            self._rewrite(stay.unionByName(fresh.select(stay.columns)), partitions)

    def insert_ignore(self, rows: DataFrame, keys: list[str]) -> None:
        """Append the rows whose key is not there yet; of rows of one key one. Keys must determine the partition, so only its own is looked at."""
        held = self.read().select(self.by, *keys)
        held = held.join(rows.select(self.by).distinct(), self.by, "left_semi")
        self.append(rows.dropDuplicates(keys).join(held.select(*keys), keys, "left_anti"))


def append_lines(rows: DataFrame, path: str) -> None:
    """Add rows to a list of JSON lines."""
    rows.write.mode("append").json(path)


#: What happens to a session whose name is held.
POLICIES = ("skip", "replace", "rename")


def import_sessions(held: DataFrame, bundle: DataFrame, policy: str = "skip") -> DataFrame:
    """held (id, name, payload) and those of the bundle's rows (JSON of the same, ids over 0), each name once, new ones with ids moved behind those in use.

    Of a name that is held the newcomer is left out (``skip``), gives its payload to
    the one there (``replace``), or comes under its name with " (imported)" behind it
    (``rename``), unless that is held too.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    held = held.select("id", "name", "payload")
    s = bundle.select(F.from_json("bundle", "id long, name string, payload string").alias("s")).select("s.*")
    once = lambda df: df.groupBy("name").agg(F.min(F.struct("id", "payload")).alias("s"))
    s = once(s)
    if policy == "rename":
        taken = held.select("name", F.lit(True).alias("taken"))
        s = s.join(taken, "name", "left").select(F.when(F.col("taken"), F.concat("name", F.lit(" (imported)"))).otherwise(F.col("name")).alias("name"), "s.*")
        s = once(s)
    new = s.join(held.select("name"), "name", "left_anti").select("name", "s.id", "s.payload")
    top = held.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    moved = new.crossJoin(F.broadcast(top)).select((F.col("top") + F.col("id")).alias("id"), "name", "payload")  # top is one row
    if policy == "replace":
        held = held.join(s, "name", "left").select(held["id"], "name", F.when(F.col("s").isNotNull(), F.col("s.payload")).otherwise(F.col("payload")).alias("payload"))
    return held.unionByName(moved)
