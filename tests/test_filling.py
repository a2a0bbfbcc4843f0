"""Bars made up by timers: planted holes, a long silence, and a restart in the middle."""

from __future__ import annotations

import datetime as dt

from tidemill.streaming import filling

WIDTH = 300_000
START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
EVENTS = "event_id long, user_id long, event_type string, ts timestamp, value double, props string"


def run(spark, events, at) -> None:
    with filling.timers(spark):
        query = filling.filled_bars(events, WIDTH).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        query.awaitTermination()


def test_holes_and_restart(spark, tmp_path):
    """Buckets 3 to 5 of a, 2 to 640 of b (the last 576 of them, and the first as they pass) and all behind the last trade of c are made up, each once."""
    traded = {"a": [0, 1, 2, 6, 7, 700, 701, 702], "b": [0, 1, 641, 642, 702], "c": [0, 4]}
    rows = sorted((k, s) for s, buckets in traded.items() for k in buckets)
    events = [(i, 2 * i, s, START + dt.timedelta(seconds=300 * k + 10), 10.0 + k, '{"k": 3}') for i, (k, s) in enumerate(rows)]
    base = int(START.timestamp() * 1000)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for part in (events[:6], events[6:9], events[9:13], events[13:]):  # a restart behind each
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(spark, stream, tmp_path)
    run(spark, stream, tmp_path)  # nothing new
    found = spark.read.parquet(f"{tmp_path}/out").toPandas()
    stop = 700  # the watermark is ten minutes behind the last trade: bucket 700 is open
    assert not found.duplicated(["symbol", "open_time"]).any()
    for s, buckets in traded.items():
        own = found[found["symbol"] == s].sort_values("open_time")
        at = ((own["open_time"] - base) // WIDTH).tolist()
        real = [k for k in buckets if k < stop]
        assert [k for k, f in zip(at, own["filled"], strict=True) if not f] == real
        for k, f, close, trades in zip(at, own["filled"], own["close"], own["trades"], strict=True):
            assert close == 10.0 + max(b for b in real if b <= k)
            assert trades == (0 if f else 1)
    own = lambda s: set(((found[found["symbol"] == s]["open_time"] - base) // WIDTH).tolist())
    assert {3, 4, 5} < own("a") and own("a") >= set(range(700 - 576, 700))
    assert own("b") >= {0, 1, *range(641 - 576, 700)} and not own("b") & set(range(10, 60))
    assert max(own("c")) == 699


def test_silence_is_filled_before_a_bar_comes(spark, tmp_path):
    """A timer, not the next bar, makes up the buckets of a symbol that has gone quiet."""
    events = [(1, 1, "a", START, 5.0, '{"k": 1}'), (2, 1, "b", START + dt.timedelta(hours=1), 6.0, '{"k": 1}'), (3, 1, "b", START + dt.timedelta(hours=2), 6.0, '{"k": 1}')]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for e in events:
        spark.createDataFrame([e], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(spark, stream, tmp_path)
    found = spark.read.parquet(f"{tmp_path}/out").filter("symbol = 'a'")
    assert found.filter("filled").count() == 21 and found.filter("NOT filled").count() == 1  # 110 minutes have passed
