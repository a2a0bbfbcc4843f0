"""Decoders and sinks on small messages and tables with known answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemill.sinks import ledger as le
from tidemill.sinks import tables as tb
from tidemill.sources import feeds as fd


def one(spark, build, payload):
    return spark.createDataFrame([(payload,)], "p string").select(build(F.col("p")).alias("v")).first()["v"]


def test_order_book(spark):
    found = one(spark, fd.order_book, '{"bids": [["10", "2"], ["9", "1"]], "asks": [["11", "1"]]}').asDict()
    assert found == pytest.approx({"bid": 29.0, "ask": 11.0, "imbalance": 0.45, "best_bid": 10.0, "best_ask": 11.0, "spread": 1.0})
    for empty in ('{"bids": [], "asks": []}', "{}", None, "no json"):
        assert set(one(spark, fd.order_book, empty).asDict().values()) == {0.0}


def test_interest_delta(spark):
    bins = lambda *v: "[" + ",".join(f'{{"sumOpenInterest": "{x}"}}' for x in v) + "]"
    assert tuple(one(spark, fd.interest_delta, bins(100, 110))) == (110.0, 10.0, 0.0)
    assert tuple(one(spark, fd.interest_delta, bins(*range(100, 113)))) == (112.0, 0.901, 12.0)
    assert tuple(one(spark, fd.interest_delta, bins(0, 5))) == (5.0, 0.0, 0.0)
    assert tuple(one(spark, fd.interest_delta, "[]")) == (0.0, 0.0, 0.0)


def test_points_and_klines(spark):
    assert [tuple(x) for x in one(spark, fd.points, '{"history": [{"t": 1, "p": 0.5}, {"t": null, "p": 1}, {"p": 2}, {"t": 3}]}')] == [(1, 0.5)]
    assert [tuple(x) for x in one(spark, fd.klines, '[[1, "2", "3", "1", "2.5", "10", 9], [2, "x"]]')] == [(1, 2.0, 3.0, 1.0, 2.5, 10.0), (2, None, None, None, None, None)]


def test_trades_csv(spark, tmp_path):
    """Times in µs come out in ms; headers, short rows and unreadable numbers are left out."""
    lines = ["id,price,qty,first,last,time,maker,best", "1,10.5,2,1,1,1700000000123,true,true", "2,11,1,2,2,1700000000456789,False,true", "3,x,1,3,3,1700000000000,true,true", "4,1", ""]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    found = sorted(map(tuple, fd.trades_csv(spark, str(tmp_path)).collect()))
    assert found == [(1, 10.5, 2.0, 1700000000123, True), (2, 11.0, 1.0, 1700000000456, False)]


def test_trade_flow_without_size(spark):
    t = spark.createDataFrame([("a", 1.0, 0.0, True), ("b", 2.0, 3.0, False), ("b", 1.0, 2.0, True)], "s string, price double, qty double, is_buyer_maker boolean")
    assert sorted(map(tuple, fd.trade_flow(t, "s").collect())) == [("a", 1, 0.0, 0.0, 0.5, 0.0), ("b", 2, 6.0, 2.0, 0.75, 4.0)]


def test_table_operations_can_be_repeated(spark, tmp_path):
    t = tb.Table(spark, f"file://{tmp_path}/t", "k long, v long, d int", "d")
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v long, d int")
    read = lambda: sorted(map(tuple, t.read().collect()))
    assert read() == []
    for _ in range(2):
        t.insert_ignore(rows((1, 1, 1), (2, 1, 1), (3, 1, 2), (3, 1, 2)), ["k"])
    t.insert_ignore(rows((1, 9, 1), (4, 9, 3)), ["k"])
    assert read() == [(1, 1, 1), (2, 1, 1), (3, 1, 2), (4, 9, 3)]
    for _ in range(2):
        t.replace_range(F.col("k") >= 3, rows((5, 2, 2), (6, 2, 4)))
    assert read() == [(1, 1, 1), (2, 1, 1), (5, 2, 2), (6, 2, 4)]
    for _ in range(2):
        t.delete(F.col("d") == 1)
    assert read() == [(5, 2, 2), (6, 2, 4)]


def test_ledger_invariants(spark, tmp_path):
    """Available is cash less what is reserved; a reservation ends once, by release or by settlement; deliveries may repeat."""
    ledger = le.Ledger(spark, f"file://{tmp_path}/l")
    entries = [(1, "deposit", None, 100), (1, "reserve", 7, 30), (1, "reserve", 8, 20), (2, "deposit", None, 50)]
    add = lambda rows: ledger.add(spark.createDataFrame(rows, "account long, kind string, ref long, amount long").withColumn("amount", F.col("amount").cast("decimal(20,4)")))
    state = lambda: {r.account: (int(r.cash), int(r.reserved), int(r.available)) for r in ledger.balances().collect()}
    for _ in range(2):
        add(entries)
    assert state() == {1: (100, 50, 50), 2: (50, 0, 50)}
    for _ in range(2):
        add([(1, "release", 8, 20)])
    assert state()[1] == (100, 30, 70)
    add([(1, "settle", 7, 75)])
    assert state()[1] == (145, 0, 145)


def test_archives(spark, tmp_path):
    """Archives give the rows of the text feed; broken archives and members don't end the read; held days aren't read."""
    import zipfile

    from tidemill.sources import archives

    rows = [f"{k},{k}.5,1.0,{k},{k},{1_700_000_000_000 + k},true,true" for k in range(300)]
    (tmp_path / "text").mkdir()
    (tmp_path / "zip").mkdir()
    (tmp_path / "text" / "all.csv").write_text("\n".join(["id,price", *rows, "x,y"]))
    for day, part in (("2024-01-01", rows[:100]), ("2024-01-02", rows[100:]), ("2024-01-03", ["900,1.0,1.0,1,1,1700000000000,true,true"])):
        with zipfile.ZipFile(tmp_path / "zip" / f"A-{day}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("a.csv", "\r\n".join(["id,price", *part[:50]]))
            z.writestr("b.csv", "\n".join([*part[50:], "x,y"]))
            z.writestr("c.txt", "901,1.0,1.0,1,1,1700000000000,true,true")
    (tmp_path / "zip" / "A-2024-01-04.zip").write_bytes(b"no archive")
    (tmp_path / "zip" / "A-2024-01-05.zip").write_bytes(b"")
    held = spark.createDataFrame([("2024-01-03",)], "day string").selectExpr("CAST(day AS DATE) AS day")
    found = archives.trades(archives.load(spark, str(tmp_path / "zip"), held)).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, fd.trades_csv(spark, str(tmp_path / "text")).collect()))
    every = spark.createDataFrame([(f"2024-01-0{k}",) for k in range(1, 6)], "day string").selectExpr("CAST(day AS DATE) AS day")
    assert archives.trades(archives.load(spark, str(tmp_path / "zip"), every)).collect() == []


def test_last_row_of_a_key_counts(spark, tmp_path):
    (tmp_path / "m.csv").write_text("2024-01-01 00:00:00,a,9,9\n2024-01-01 00:00:00,a,3,1\n2024-01-01 00:05:00,a,1,1\n2024-01-01 00:00:00,a,5,\n")
    found = {r.ts_ms % 86_400_000: (r.open_interest, r.open_interest_value) for r in fd.metrics_csv(spark, str(tmp_path / "m.csv")).collect()}
    assert found == {0: (5.0, None), 300_000: (1.0, 1.0)}
