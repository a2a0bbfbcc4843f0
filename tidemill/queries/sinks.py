"""Tables written, written again, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog import query
from tidemill.queries.models import _r
from tidemill.sinks import candles as cd
from tidemill.sinks import ledger as le
from tidemill.sinks import tables as tb
from tidemill.sources import decisions as de
from tidemill.sources import market as mk
from tidemill.streaming.run import folder

_ORDERS = "o_orderkey long, o_totalprice double, year int"


def _orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))


def _table(spark, name: str) -> tb.Table:
    return tb.Table(spark, folder(spark, name), _ORDERS, "year")


@query("sink_replace_range", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS year, CASE WHEN year(o_orderdate) BETWEEN 1994 AND 1996 AND o_totalprice >= 100000 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice FROM orders WHERE NOT (year(o_orderdate) = 1993 AND o_totalprice >= 100000)")
def sink_replace_range(spark, sf_dir):
    """A range of years and prices deleted and inserted anew, twice; in one year nothing comes in its place."""
    o, t = _orders(spark, sf_dir), _table(spark, "replace")
    t.append(o)
    within = F.col("year").between(1993, 1996) & (F.col("o_totalprice").between(100_000, 1e12) | F.col("o_totalprice").between(-1e12, -100_000))
    fresh = o.filter(F.col("year").between(1994, 1996) & (F.col("o_totalprice") >= 100_000)).withColumn("o_totalprice", -F.col("o_totalprice"))
    t.replace_range(within, fresh)
    t.replace_range(within, fresh)
    return t.read()


@query("sink_insert_ignore", "SELECT o_orderkey, o_totalprice, year(o_orderdate)::INTEGER AS year FROM orders")
def sink_insert_ignore(spark, sf_dir):
    """Two thirds, then all with other prices for what is there, then all again: each key once, as it came first."""
    o, t = _orders(spark, sf_dir), _table(spark, "insert")
    first = o.filter("o_orderkey % 3 <> 0")
    t.insert_ignore(first.union(first), ["o_orderkey"])
    later = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).otherwise(-1.0))
    t.insert_ignore(later, ["o_orderkey"])
    t.insert_ignore(later, ["o_orderkey"])
    return t.read()


@query("sink_delete", "SELECT o_orderkey, o_totalprice, year(o_orderdate)::INTEGER AS year FROM orders WHERE NOT (o_totalprice < 100000 AND year(o_orderdate) >= 1995) AND year(o_orderdate) <> 1992")
def sink_delete(spark, sf_dir):
    """Rows deleted by a predicate, and a year whole."""
    t = _table(spark, "delete")
    t.append(_orders(spark, sf_dir))
    for _ in range(2):
        t.delete((F.col("o_totalprice") < 100_000) & (F.col("year") >= 1995))
        t.delete(F.col("year") == 1992)
    return t.read()


_LEDGER = """WITH e AS (SELECT o_custkey AS account, o_orderstatus AS status, CAST(floor(o_totalprice / 1000) AS DECIMAL(20, 4)) AS stake FROM orders),
b AS (SELECT account, sum(CASE WHEN status = 'O' THEN stake ELSE 0 END) AS reserved, sum(CASE WHEN status = 'F' THEN stake * 0.5 ELSE 0 END) AS won FROM e GROUP BY account)
SELECT c_custkey AS account, CAST(1000 + coalesce(won, 0) AS DOUBLE) AS cash, CAST(coalesce(reserved, 0) AS DOUBLE) AS reserved, CAST(1000 + coalesce(won, 0) - coalesce(reserved, 0) AS DOUBLE) AS available FROM customer LEFT JOIN b ON account = c_custkey"""


def _deliveries(spark, sf_dir):
    """Deposits of the customers, stakes on their orders, and how those end: open ones stay reserved, pending ones are released, filled ones pay 1.5 times the stake."""
    c, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders"))
    money = lambda x: x.cast(le.MONEY).alias("amount")
    stake = F.floor(F.col("o_totalprice") / 1000).cast(le.MONEY)
    entry = lambda df, kind, amount: df.select(F.col("o_custkey").alias("account"), F.lit(kind).alias("kind"), F.col("o_orderkey").alias("ref"), money(amount))
    deposits = c.select(F.col("c_custkey").alias("account"), F.lit("deposit").alias("kind"), F.lit(None).cast("long").alias("ref"), money(F.lit(1000)))
    ends = entry(o.filter("o_orderstatus = 'P'"), "release", stake).union(entry(o.filter("o_orderstatus = 'F'"), "settle", stake * F.lit("1.5").cast("decimal(4,2)")))
    return deposits, entry(o, "reserve", stake), ends


def _balances(ledger):
    b = ledger.balances()
    return b.select("account", *(F.col(x).cast("double").alias(x) for x in ("cash", "reserved", "available")))


@query("sink_ledger", _LEDGER)
def sink_ledger(spark, sf_dir):
    """Every delivery comes twice."""
    deposits, reserves, ends = _deliveries(spark, sf_dir)
    ledger = le.Ledger(spark, folder(spark, "ledger"))
    for batch in (deposits, reserves, reserves, ends, ends, deposits):
        ledger.add(batch)
    return _balances(ledger)


@query("sink_ledger_snapshots", _LEDGER)
def sink_ledger_snapshots(spark, sf_dir):
    """Balances carried on over snapshots: ends that come before their stakes, and stakes and ends that come again later with other amounts."""
    deposits, reserves, ends = _deliveries(spark, sf_dir)
    other = lambda df: df.withColumn("amount", (F.col("amount") + 7).cast(le.MONEY))
    ledger = le.Ledger(spark, folder(spark, "ledger"))
    for batch in (ends, reserves.union(deposits), other(reserves), other(ends).union(other(deposits))):
        ledger.add(batch)
        ledger.recompute()
    ledger.add(other(reserves))
    return _balances(ledger)


_ASKED = "SELECT o_custkey AS account, o_orderkey AS ref, floor(o_totalprice / 1000) AS amount FROM orders WHERE floor(o_totalprice / 1000) > 0"


@query(
    "sink_reserve",
    f"""WITH a AS ({_ASKED}), t AS (SELECT *, sum(amount) OVER (PARTITION BY account ORDER BY ref) AS total FROM a JOIN customer ON c_custkey = account),
g AS (SELECT account, ref, amount FROM t WHERE total <= 1000), s AS (SELECT account, sum(amount) AS spent FROM g GROUP BY account),
u AS (SELECT t.account, t.ref, t.amount, sum(t.amount) OVER (PARTITION BY t.account ORDER BY t.ref) AS total, coalesce(spent, 0) AS spent FROM t LEFT JOIN s ON s.account = t.account WHERE t.total > 1000)
SELECT account, ref, CAST(amount AS DOUBLE) AS amount, 1 AS round FROM g UNION ALL SELECT account, ref, CAST(amount AS DOUBLE), 2 FROM u WHERE total <= 1000 - spent""",
)
def sink_reserve(spark, sf_dir):
    """Each order asks for its stake while its customer can pay; all ask again, and some that were refused fit now."""
    deposits, reserves, _ = _deliveries(spark, sf_dir)
    ledger = le.Ledger(spark, folder(spark, "ledger"))
    ledger.add(deposits)
    asked = reserves.select("account", "ref", "amount")
    rounds = [ledger.reserve(asked.union(asked) if k == 1 else asked).withColumn("round", F.lit(k)) for k in (1, 2)]
    return rounds[0].union(rounds[1]).withColumn("amount", F.col("amount").cast("double"))


@query(
    "sink_reconcile",
    """WITH b AS (SELECT o_custkey AS account, sum(floor(o_totalprice / 1000)) FILTER (WHERE o_orderstatus = 'O') AS reserved FROM orders GROUP BY ALL),
w AS (SELECT c_custkey AS account, CASE WHEN c_custkey % 7 <> 0 THEN round(c_acctbal, 2) END AS wallet, coalesce(reserved, 0) AS reserved FROM customer LEFT JOIN b ON account = c_custkey)
SELECT account, CAST(wallet AS DOUBLE) AS wallet, CAST(reserved AS DOUBLE) AS reserved, round(coalesce(wallet, 0) - reserved, 4) + 0.0 AS free, round(reserved - wallet, 4) + 0.0 AS drift, coalesce(round(reserved - wallet, 4) > 0.000001, false) AS alert FROM w""",
)
def sink_reconcile(spark, sf_dir):
    """What is reserved against the customers' balances, a seventh of which isn't known."""
    ledger = le.Ledger(spark, folder(spark, "ledger"))
    for batch in _deliveries(spark, sf_dir):
        ledger.add(batch)
        ledger.recompute()
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    wallets = c.select(F.col("c_custkey").alias("account"), F.when(F.col("c_custkey") % 7 != 0, F.round("c_acctbal", 2)).alias("wallet"))
    r = ledger.reconcile(wallets)
    return mk.rounded(r.select("account", *(F.col(x).cast("double").alias(x) for x in ("wallet", "reserved", "free", "drift")), "alert"))


@query("sink_trials", f"{de.with_sql()}, t AS (SELECT symbol, unnest([0.5, 0.6, 0.7]) AS least, p_up, won FROM bets) SELECT symbol, CAST(least AS DOUBLE) AS least, count(*) AS n, {_r('avg(won::INTEGER)', 'hit')}, CAST(round(least * 10) - 4 AS BIGINT) AS trial FROM t WHERE greatest(p_up, 1 - p_up) >= least GROUP BY symbol, least")
def sink_trials(spark, sf_dir):
    """Results as Parquet, and a list of trials in JSON lines that each trial is added to."""
    b = de.bets(spark, sf_dir)
    at, log = folder(spark, "results"), folder(spark, "trials")
    for k, least in enumerate((0.5, 0.6, 0.7), 1):
        sure = b.filter(F.greatest("p_up", 1 - F.col("p_up")) >= least)
        g = mk.rounded(sure.groupBy("symbol").agg(F.count("*").alias("n"), F.avg(F.col("won").cast("double")).alias("hit")))
        g.write.parquet(f"{at}/trial={k}")
        tb.append_lines(spark.createDataFrame([(k, least)], "trial long, least double"), log)
    trials = spark.read.schema("trial long, least double").json(log)
    return spark.read.schema("symbol string, n long, hit double, trial long").parquet(at).join(F.broadcast(trials), "trial").select("symbol", "least", "n", "hit", "trial")  # a row a trial


@query("sink_import_sessions", "WITH h AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS payload FROM customer WHERE c_custkey % 2 = 0), t AS (SELECT max(id) AS top FROM h) SELECT * FROM h UNION ALL SELECT top + c_custkey, c_name, c_mktsegment FROM customer, t WHERE c_custkey % 2 <> 0")
def sink_import_sessions(spark, sf_dir):
    """A bundle that holds all sessions twice, brought to where half are: those stay as they are, the others get ids behind them."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("payload"))
    bundle = c.select(F.to_json(F.struct("id", "name", "payload")).alias("bundle"))
    return tb.import_sessions(c.filter("id % 2 = 0"), bundle.union(bundle))


_D, _H4 = cd.DAY, 4 * mk.HOUR
_REFRESH = f"""{mk.with_sql(mk.candles_sql())}, e AS (SELECT max(ts_ms) // {mk.HOUR} * {mk.HOUR} - {mk.HOUR} AS stop, (max(ts_ms) - {_D}) // {mk.HOUR} * {mk.HOUR} - {mk.HOUR} AS seen FROM trades),
s AS (SELECT symbol, ts_ms // {mk.HOUR} * {mk.HOUR} AS open_time, arg_min(price, (ts_ms, trade_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts_ms, trade_id)) AS close, sum(lots) / 50.0 AS volume, count(*) AS trades
  FROM (SELECT symbol, ts_ms, trade_id, lots, CASE WHEN trade_id % 5 = 0 THEN price * 2 ELSE price END AS price FROM trades, e WHERE ts_ms < seen + {mk.HOUR} AND trade_id % 7 <> 3 AND ts_ms // {mk.HOUR} % 11 <> 4) GROUP BY ALL),
f AS (SELECT t.symbol, t.open_time, CASE WHEN {{keep}} THEN s.open ELSE t.open END AS open, CASE WHEN {{keep}} THEN s.high ELSE t.high END AS high, CASE WHEN {{keep}} THEN s.low ELSE t.low END AS low, CASE WHEN {{keep}} THEN s.close ELSE t.close END AS close,
  CASE WHEN {{keep}} THEN s.volume ELSE t.volume END AS volume, CASE WHEN {{keep}} THEN s.trades ELSE t.trades END AS trades,
  CASE WHEN {{keep}} OR (s.open = t.open AND s.high = t.high AND s.low = t.low AND s.close = t.close AND s.volume = t.volume AND s.trades = t.trades) THEN 1 ELSE 2 END AS pass
  FROM candles t JOIN e ON t.open_time <= stop LEFT JOIN s ON s.symbol = t.symbol AND s.open_time = t.open_time),
c AS (SELECT symbol, open_time // {_H4} * {_H4} AS start, arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close, sum(volume) AS volume, sum(trades)::BIGINT AS trades, max(pass) AS pass FROM f GROUP BY ALL)
SELECT 1 AS hours, symbol, open_time, open, high, low, close, round(volume, 6) + 0.0 AS volume, trades, pass::BIGINT AS pass FROM f UNION ALL SELECT 4, symbol, start, open, high, low, close, round(volume, 6) + 0.0, trades, pass::BIGINT FROM c""".replace("{keep}", f"s.symbol IS NOT NULL AND t.open_time < stop - {cd.FRESH}")


@query("sink_refresh_candles", _REFRESH)
def sink_refresh_candles(spark, sf_dir):
    """Candles of a day ago, from trades some of which were wrong or not there yet, brought up to date, twice: the last 48 h are corrected, older holes filled, all else keeps the pass that wrote it."""
    t = mk.trades(spark, sf_dir)
    first, last = t.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    if first is None:
        first = last = 0
    symbols, store = t.select("symbol").distinct(), cd.Candles(spark, folder(spark, "candles"))
    early = t.filter((F.col("trade_id") % 7 != 3) & (F.floor(F.col("ts_ms") / mk.HOUR) % 11 != 4))
    early = early.withColumn("price", F.when(F.col("trade_id") % 5 == 0, F.col("price") * 2).otherwise(F.col("price")))
    store.refresh(early, symbols, first, last - cd.DAY, 1)
    for number in (2, 3):  # the third finds nothing to do
        store.refresh(t, symbols, first, last, number)
    rows = lambda table, hours: table.read().select(F.lit(hours).alias("hours"), *cd._KEYS, *cd._VALUES, "pass")
    return mk.rounded(rows(store.fine, 1).unionByName(rows(store.derived, 4)))
