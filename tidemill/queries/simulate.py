"""Flat backtests as windows, bust sweeps, and ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.catalog import query
from tidemill.functions import sizing as sz
from tidemill.sources import decisions as de
from tidemill.sources import market as mk

_DAY = 86_400_000
#: Bets that a stored run keeps (a fixed value).
CAP = 2000


@query(
    "sim_flat_backtest",
    f"""{de.with_sql()} SELECT symbol, target_open, won, round(1000 + sum(CASE WHEN won THEN 10 * 0.45 / 0.55 ELSE -10 END) OVER (PARTITION BY symbol ORDER BY target_open), 4) + 0.0 AS balance,
  floor(10 / 0.55 * 1000000 + 1e-7) / 1000000 AS shares FROM bets""",
)
def sim_flat_backtest(spark, sf_dir):
    """A flat stake with borrowing: the balance is a running sum, so no fold is needed."""
    w = Window.partitionBy("symbol").orderBy("target_open").rowsBetween(Window.unboundedPreceding, 0)
    gain = F.when(F.col("won"), F.lit(10 * 0.45 / 0.55)).otherwise(-10.0)
    b = de.bets(spark, sf_dir)
    return b.select("symbol", "target_open", "won", (F.round(1000 + F.sum(gain).over(w), 4) + 0.0).alias("balance"), sz.truncated(F.lit(10 / 0.55), 6).alias("shares"))


_SWEEP = f"""e AS (SELECT max(target_open) AS last FROM bets), r AS (SELECT d AS rung, last - d::BIGINT * {_DAY} AS start FROM e, (VALUES (1), (7), (14), (28)) v(d)),
b AS (SELECT b.symbol, rung, target_open, won, sum(CASE WHEN won THEN 10.0::DOUBLE ELSE -10.0 END) OVER (PARTITION BY b.symbol, rung ORDER BY target_open) + 60 AS after FROM bets b JOIN r ON target_open >= start),
c AS (SELECT *, coalesce(lag(after) OVER w, 60) AS before FROM b WINDOW w AS (PARTITION BY symbol, rung ORDER BY target_open)), d AS (SELECT *, max((before < 10)::INTEGER) OVER (PARTITION BY symbol, rung ORDER BY target_open) AS dead FROM c),
sweep AS (SELECT symbol, rung, CAST(sum(1 - dead) AS BIGINT) AS placed, min(CASE WHEN dead = 1 THEN target_open END) AS bust_at, arg_max(after, target_open) FILTER (WHERE dead = 0) AS final, bool_or(dead = 1) AS bust FROM d GROUP BY symbol, rung)"""


def flat_rungs(bets, rungs, stake: float, balance: float):
    """Flat even-money results from every start time in ``rungs`` (rung, start; a short fixed list): each bet counts for the rungs that began before it.

    A rung is bust at the first bet it can't cover; what it holds counts up to there.
    """
    b = bets.join(F.broadcast(rungs), F.col("target_open") >= F.col("start"))
    w = Window.partitionBy("symbol", "rung").orderBy("target_open")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("after", balance + F.sum(F.when(F.col("won"), stake).otherwise(-stake)).over(so_far))
    b = b.withColumn("before", F.lag("after", 1, balance).over(w))
    b = b.withColumn("dead", F.max((F.col("before") < stake).cast("int")).over(so_far) == 1)
    g = b.groupBy("symbol", "rung").agg(F.count_if(~F.col("dead")).alias("placed"), F.min(F.when(F.col("dead"), F.col("target_open"))).alias("bust_at"), F.max_by("after", F.when(~F.col("dead"), F.col("target_open"))).alias("final"))
    return g.withColumn("bust", F.col("bust_at").isNotNull())


@query("sim_bust_sweep_flat", f"{de.with_sql(_SWEEP)} SELECT * FROM sweep")
def sim_bust_sweep_flat(spark, sf_dir):
    """How long flat stakes last from each start."""
    b = de.bets(spark, sf_dir)
    last = b.agg(F.max("target_open")).first()[0] or 0
    rungs = spark.createDataFrame([(d, last - d * _DAY) for d in (1, 7, 14, 28)], "rung int, start long")
    return flat_rungs(b, rungs, 10.0, 60.0)


@query(
    "agg_bust_batch",
    f"""{de.with_sql(_SWEEP)} SELECT symbol, count(*) AS rungs, bool_or(bust) AS any_bust, min(rung) FILTER (WHERE bust) AS first_bust, max(rung) AS longest,
  arg_max(rung, (bust::INTEGER, CASE WHEN bust THEN -rung ELSE rung END)) AS shown FROM sweep GROUP BY symbol""",
)
def agg_bust_batch(spark, sf_dir):
    """A batch of rungs in one row: how many, any bust, the first bust, the longest, and the one to show (the first bust, else the longest)."""
    s = sim_bust_sweep_flat(spark, sf_dir)
    rank = F.struct(F.col("bust").cast("int").alias("bust"), F.when(F.col("bust"), -F.col("rung")).otherwise(F.col("rung")).alias("n"))
    return s.groupBy("symbol").agg(F.count("*").alias("rungs"), F.bool_or("bust").alias("any_bust"), F.min(F.when(F.col("bust"), F.col("rung"))).alias("first_bust"), F.max("rung").alias("longest"), F.max_by("rung", rank).alias("shown"))


@query(
    "sim_martingale",
    f"""{de.with_sql()}, o AS (SELECT symbol, target_open, won, row_number() OVER (PARTITION BY symbol ORDER BY target_open) AS k FROM bets),
g AS (SELECT *, coalesce(k - 1 - max(CASE WHEN won THEN k END) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), k - 1) AS losses FROM o)
SELECT symbol, target_open, won, CAST(losses AS BIGINT) AS losses, 10.0 * pow(2, losses) AS stake FROM g""",
)
def sim_martingale(spark, sf_dir):
    """Doubling after losses: the stake follows from the losses in a row, a window, as long as nothing ends the run."""
    w = Window.partitionBy("symbol").orderBy("target_open")
    b = de.bets(spark, sf_dir).withColumn("k", F.row_number().over(w))
    last_win = F.max(F.when(F.col("won"), F.col("k"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    losses = (F.col("k") - 1 - F.coalesce(last_win, F.lit(0))).cast("long")
    return b.select("symbol", "target_open", "won", losses.alias("losses"), (10.0 * F.pow(F.lit(2.0), losses)).alias("stake"))


@query("agg_chaos_percentiles", "SELECT o_orderpriority AS combo, count(*) AS n, round(quantile_cont(o_totalprice - 250000, 0.05), 4) + 0.0 AS p5, round(quantile_cont(o_totalprice - 250000, 0.5), 4) + 0.0 AS p50, round(quantile_cont(o_totalprice - 250000, 0.95), 4) + 0.0 AS p95, round(avg((o_totalprice < 20000)::INTEGER), 6) + 0.0 AS bust_rate FROM orders GROUP BY ALL")
def agg_chaos_percentiles(spark, sf_dir):
    p = F.col("o_totalprice") - 250000
    g = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderpriority").alias("combo")).agg(F.count("*").alias("n"), *(F.round(F.percentile(p, q), 4).alias(f"p{int(q * 100)}") for q in (0.05, 0.5, 0.95)), F.round(F.avg((F.col("o_totalprice") < 20000).cast("double")), 6).alias("bust_rate"))
    return mk.rounded(g)


@query("ledger_cap", f"{de.with_sql()} SELECT symbol, target_open, won FROM bets QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY target_open DESC) <= {CAP}")
def ledger_cap(spark, sf_dir):
    """The last bets of each run, as many as a stored run keeps."""
    w = Window.partitionBy("symbol").orderBy(F.desc("target_open"))
    return de.bets(spark, sf_dir).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= CAP).select("symbol", "target_open", "won")


@query("ledger_insert_ignore", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0")
def ledger_insert_ignore(spark, sf_dir):
    """Rows whose key is there already are left out."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    held = o.filter("o_orderkey % 3 <> 0")
    return held.unionByName(o.dropDuplicates(["o_orderkey"]).join(held, "o_orderkey", "left_anti"))


@query("ledger_replace_range", "SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' THEN 0.0 ELSE o_totalprice END AS price FROM orders")
def ledger_replace_range(spark, sf_dir):
    """Delete a time range and insert it anew, as often as one likes."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    within = (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    fresh = o.filter(within).select("o_orderkey", F.lit(0.0).alias("price"))
    return o.filter(~within).select("o_orderkey", F.col("o_totalprice").alias("price")).unionByName(fresh)


@query("ledger_delete", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P' AND o_totalprice < 100000)")
def ledger_delete(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").filter(~F.coalesce((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 100000), F.lit(False))).select("o_orderkey")


@query("ledger_markers", f"""{de.with_sql()} SELECT symbol, '[' || string_agg('{{"t":' || target_open || ',"hit":' || won || ',"side":"' || CASE WHEN p_up >= 0.5 THEN 'UP' ELSE 'DOWN' END || '"}}', ',' ORDER BY target_open) || ']' AS markers FROM bets GROUP BY symbol""")
def ledger_markers(spark, sf_dir):
    """A run's trades as one JSON list in time order."""
    b = de.bets(spark, sf_dir)
    item = F.struct(F.col("target_open").alias("t"), F.col("won").alias("hit"), de.side(F.col("p_up")).alias("side"))
    return b.groupBy("symbol").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("markers"))


@query("ledger_bundle", "SELECT c_custkey, '{\"id\":' || c_custkey || ',\"bets\":' || CAST(count(o_orderkey) AS VARCHAR) || '}' AS bundle FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def ledger_bundle(spark, sf_dir):
    """Sessions out to JSON, in again, without repeats, with fresh ids behind those in use."""
    c, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders"))
    s = c.join(o.groupBy("o_custkey").agg(F.count("*").alias("n")), F.col("c_custkey") == F.col("o_custkey"), "left")
    out = s.select(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.coalesce("n", F.lit(0)).alias("bets"))).alias("bundle"))
    back = out.union(out).withColumn("s", F.from_json("bundle", "id long, bets long")).dropDuplicates(["bundle"])
    return back.select(F.col("s.id").alias("c_custkey"), "bundle")
