"""Daily dump archives: CSV members inside ZIP files, read by Spark from any store, days already held left out."""

from __future__ import annotations

import io
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.feeds import parsed_trades

#: Lines handed on at a time.
LINES = 50_000


def day_of(path: Column) -> Column:
    """The day a dump's name ends with, NULL without one."""
    return F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})\.zip$", 1).try_cast("date")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, day) of the archives in a folder; their content isn't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", day_of(F.col("path")).alias("day"))


def load(spark: SparkSession, path: str, held: DataFrame | None = None) -> DataFrame:
    """(path, content) of the archives in a folder, but for those of the days in ``held`` (day); an archive without a day is always read."""
    names = listed(spark, path)
    names = names if held is None else names.join(held, "day", "left_anti")
    wanted = [r.path for r in names.collect()]  # a name a day
    if not wanted:
        return spark.createDataFrame([], "path string, content binary")
    return spark.read.format("binaryFile").load(wanted).select("path", "content")


def lines(archives: DataFrame) -> DataFrame:
    """(value) of every line of every CSV member; a broken archive or member ends where it breaks, and the others are still read."""

    def unzip(batches):
        for batch in batches:
            for content in batch.column("content"):
                held: list[str] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as z:
                        for name in z.namelist():
                            if not name.lower().endswith(".csv"):
                                continue
                            try:
                                with z.open(name) as member:
                                    for line in io.TextIOWrapper(member, "utf-8", "replace"):
                                        held.append(line.rstrip("\r\n"))
                                        if len(held) == LINES:
                                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                                            held = []
                            except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
                                continue
                except zipfile.BadZipFile:
                    pass
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    return archives.select("content").mapInArrow(unzip, "value string")


def trades(archives: DataFrame) -> DataFrame:
    """The trades of archives (content), as ``feeds.trades_csv`` reads them from text."""
    return parsed_trades(lines(archives))
