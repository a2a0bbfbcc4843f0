"""Running streams to their end over files, and reading what they wrote."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: in ``spark.checkpoint.dir``, or a temporary one if all run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemill-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def read_events(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The event table as a stream; the path is a pattern, as streams read files and not names."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/event[s].parquet")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over all that is there and read its output, each row once."""
    spark = stream.sparkSession
    at = folder(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
