"""Predictions settled by a stream of trades: no pairs are written, and files that come one by one count each trade once."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemill.catalog import queries
from tidemill.queries import streams
from tidemill.streaming import live
from tidemill.streaming.run import drain

EVENTS = "event_id long, user_id long, event_type string, ts timestamp, value double, props string"
HOUR = dt.timedelta(hours=1)


def _rows(n: int, seconds: int, seed: int):
    rng, start = random.Random(seed), dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    at = sorted(start + dt.timedelta(seconds=rng.randrange(seconds)) for _ in range(n))
    return [(i, 0, rng.choice("ab"), t, float(rng.randrange(40, 60)), f'{{"k": {rng.randrange(100)}}}') for i, t in enumerate(at)]


def _brute(rows):
    out = []
    for i, _, symbol, at, _, props in rows:
        seen = sorted((t, j, price) for j, _, s, t, price, _ in rows if s == symbol and at + HOUR <= t < at + 2 * HOUR)
        if seen:
            out.append((symbol, i, int(props[6:-1]) > 50, seen[0][2], len(seen)))
    return sorted(out)


def test_what_is_written_grows_with_the_predictions(spark, tmp_path, monkeypatch):
    """1200 trades in three hours make 120,000 pairs and more; a prediction takes a row in each of the two clock hours that it waits in, at most."""
    rows, written = _rows(1200, 3 * 3600, 1), []

    def counted(stream, name):
        out = drain(stream, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(streams, "drain", counted)
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = queries()["stream_resolve"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == _brute(rows)
    assert written[0] <= 2 * len(rows)


def test_files_one_by_one(spark, tmp_path):
    """Trades and predictions that wait over micro-batches, with rows up to half an hour out of order, a NaN price, and rows without symbol, id or time."""
    rows = _rows(160, 6 * 3600, 2)
    rows[70] = (*rows[70][:4], float("nan"), rows[70][5])
    late = sorted(rows, key=lambda r: r[3] + dt.timedelta(minutes=random.Random(r[0]).randrange(30)))
    (tmp_path / "in").mkdir()
    odd = [(None, 0, "a", rows[0][3], 50.0, '{"k": 1}'), (900, 0, None, rows[0][3], 50.0, '{"k": 1}'), (901, 0, "a", None, 50.0, '{"k": 1}')]
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    t = live.ticks(stream)
    p = t.select("symbol", F.col("trade_id").alias("prediction_id"), (F.col("at") + F.expr("INTERVAL 1 HOUR")).alias("target_at"), (F.col("lots") > 50).alias("up"))
    joined = live.resolved(p, t.select("symbol", F.col("at").alias("out_at"), "trade_id", "price"))
    start = lambda: joined.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    for k in range(0, 160, 40):  # a restart behind each
        spark.createDataFrame(late[k : k + 40] + odd, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        start()
    got = live.settled(spark.read.parquet(f"{tmp_path}/out")).collect()
    assert repr(sorted(map(tuple, got))) == repr(_brute(rows))
