"""Summaries of decisions and bets."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.catalog import query
from tidemill.functions import stats as st
from tidemill.sources import decisions as de
from tidemill.sources import market as mk

_H = mk.HOUR


def _y():
    return F.col("outcome_up").cast("int")



def _r(e: str, n: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) + 0.0 AS {n}"


@query(
    "agg_backtest_summary",
    f"""{de.with_sql()} SELECT symbol, count(*) FILTER (WHERE p_up <> 0.5) AS placed, count(*) FILTER (WHERE p_up <> 0.5 AND (p_up >= 0.5) = outcome_up) AS won,
  {_r("avg(CASE WHEN p_up <> 0.5 THEN CAST((p_up >= 0.5) = outcome_up AS INT) END)", "hit_rate")}, {_r("avg(CASE WHEN p_up <> 0.5 THEN (p_up - CAST(outcome_up AS INT)) ** 2 END)", "brier")},
  count(*) FILTER (WHERE abs(p_up - 0.5) >= 0.04) AS gated, count(*) FILTER (WHERE abs(p_up - 0.5) >= 0.04 AND (p_up >= 0.5) = outcome_up) AS gated_won FROM decisions GROUP BY symbol""",
)
def agg_backtest_summary(spark, sf_dir):
    """Placed, won, hit-rate (NULL without bets), Brier score, and the same behind a confidence gate."""
    bet, won, gated = F.col("p_up") != 0.5, (F.col("p_up") >= 0.5) == F.col("outcome_up"), F.abs(F.col("p_up") - 0.5) >= 0.04
    out = de.decisions(spark, sf_dir).groupBy("symbol").agg(
        F.count_if(bet).alias("placed"), F.count_if(bet & won).alias("won"), F.avg(F.when(bet, won.cast("double"))).alias("hit_rate"), F.avg(F.when(bet, F.pow(F.col("p_up") - _y(), 2))).alias("brier"),
        F.count_if(gated).alias("gated"), F.count_if(gated & won).alias("gated_won"),
    )
    return mk.rounded(out)


_LO, _HI = st.wilson_sql("won", "n")


@query("agg_wilson", f"{de.with_sql()}, g AS (SELECT symbol, count(*) AS n, count(*) FILTER (WHERE won) AS won FROM bets GROUP BY symbol) SELECT symbol, n, won, {_r(_LO, 'lo')}, {_r(_HI, 'hi')} FROM g")
def agg_wilson(spark, sf_dir):
    g = de.bets(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if("won").alias("won"))
    lo, hi = st.wilson(F.col("won"), F.col("n"))
    return mk.rounded(g.select("*", lo.alias("lo"), hi.alias("hi")))


@query(
    "agg_calibration_bins",
    f"""{de.with_sql()}, l AS (SELECT * FROM bets QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY target_open DESC) <= 200)
SELECT symbol, CAST(least(floor(p_up * 5), 4) AS BIGINT) AS bin, count(*) AS n, {_r("avg(CAST(outcome_up AS INT))", "up_rate")} FROM l GROUP BY ALL HAVING count(*) >= 20""",
)
def agg_calibration_bins(spark, sf_dir):
    """Of the last 200 resolved, five equal bins (the last includes 1) of at least 20 rows."""
    w = Window.partitionBy("symbol").orderBy(F.desc("target_open"))
    recent = de.bets(spark, sf_dir).withColumn("k", F.row_number().over(w)).filter("k <= 200")
    g = recent.groupBy("symbol", F.least(F.floor(F.col("p_up") * 5), F.lit(4)).alias("bin")).agg(F.count("*").alias("n"), F.avg(_y()).alias("up_rate"))
    return mk.rounded(g.filter("n >= 20"))


@query(
    "agg_calibration_lerp",
    f"""{de.with_sql()}, b AS (SELECT symbol, least(floor(p_up * 5), 4) AS bin, avg(CAST(outcome_up AS INT)) AS y FROM bets GROUP BY ALL HAVING count(*) >= 20),
k AS (SELECT symbol, list((bin + 0.5) / 5 ORDER BY bin) AS xs, list(y ORDER BY bin) AS ys FROM b GROUP BY symbol),
q AS (SELECT symbol, p, xs, ys, len(list_filter(xs, lambda x: x <= p)) AS i FROM k, (VALUES (0.1::DOUBLE), (0.42), (0.5), (0.58), (0.95)) v(p))
SELECT symbol, p, {_r("CASE WHEN len(xs) < 2 THEN p WHEN i = 0 THEN ys[1] WHEN i = len(xs) THEN ys[i] ELSE ys[i] + (p - xs[i]) / (xs[i + 1] - xs[i]) * (ys[i + 1] - ys[i]) END", "calibrated")} FROM q""",
)
def agg_calibration_lerp(spark, sf_dir):
    """Probabilities carried through the populated bins by straight lines; as they are where fewer than two bins are."""
    b = de.bets(spark, sf_dir).groupBy("symbol", F.least(F.floor(F.col("p_up") * 5), F.lit(4)).alias("bin")).agg(F.count("*").alias("n"), F.avg(_y()).alias("y")).filter("n >= 20")
    k = b.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(((F.col("bin") + 0.5) / 5).alias("x"), "y"))).alias("k"))
    q = k.withColumn("p", F.explode(F.array(*map(F.lit, (0.1, 0.42, 0.5, 0.58, 0.95))))).withColumn("i", F.size(F.filter("k", lambda s: s["x"] <= F.col("p"))))
    at = lambda i: F.element_at("k", i)
    a, z = at(F.greatest(F.col("i"), F.lit(1))), at(F.least(F.col("i") + 1, F.size("k")))
    mixed = a["y"] + (F.col("p") - a["x"]) / F.nullif(z["x"] - a["x"], F.lit(0.0)) * (z["y"] - a["y"])
    y = F.when(F.size("k") < 2, F.col("p")).when(F.col("i") == 0, at(1)["y"]).when(F.col("i") == F.size("k"), at(F.size("k"))["y"]).otherwise(mixed)
    return mk.rounded(q.select("symbol", "p", y.alias("calibrated")))


#: Runs of models over intervals: customers' orders stand in.
_RUNS = "runs AS (SELECT o_custkey % 20 AS model, o_orderpriority AS interval, o_orderdate AS started_at, o_orderkey AS run_id, (o_orderkey % 100) / 100.0::DOUBLE AS hit_rate FROM orders WHERE o_orderstatus <> 'P')"


def _runs(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus <> 'P'")
    return o.select((F.col("o_custkey") % 20).alias("model"), F.col("o_orderpriority").alias("interval"), F.col("o_orderdate").alias("started_at"), F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 100 / 100.0).alias("hit_rate"))


@query("agg_leaderboard", f"WITH {_RUNS}, l AS (SELECT model, interval, arg_max(hit_rate, (started_at, run_id)) AS h, count(*) AS n FROM runs GROUP BY ALL) SELECT model, {_r('avg(h)', 'score')}, CAST(sum(n) AS BIGINT) AS runs, count(*) AS intervals FROM l GROUP BY model")
def agg_leaderboard(spark, sf_dir):
    """The latest finished run of each model and interval, averaged over intervals."""
    g = _runs(spark, sf_dir).groupBy("model", "interval").agg(F.max_by("hit_rate", F.struct("started_at", "run_id")).alias("h"), F.count("*").alias("n"))
    return mk.rounded(g.groupBy("model").agg(F.avg("h").alias("score"), F.sum("n").alias("runs"), F.count("*").alias("intervals")))


@query("agg_model_score", f"WITH {_RUNS}, f AS (SELECT model, interval, min(hit_rate) AS worst, avg(hit_rate) - 0.02 AS fallback, count(*) AS n FROM runs GROUP BY ALL) SELECT model, {_r('avg(CASE WHEN n >= 3 THEN worst ELSE fallback END)', 'score')} FROM f GROUP BY model")
def agg_model_score(spark, sf_dir):
    """The worst fold of an interval, or its mean less 0.02 where folds are few, averaged over intervals."""
    f = _runs(spark, sf_dir).groupBy("model", "interval").agg(F.min("hit_rate").alias("worst"), (F.avg("hit_rate") - 0.02).alias("fallback"), F.count("*").alias("n"))
    return mk.rounded(f.groupBy("model").agg(F.avg(F.when(F.col("n") >= 3, F.col("worst")).otherwise(F.col("fallback"))).alias("score")))


@query("agg_min_max", "SELECT min(epoch_us(ts) // 1000) AS lo, max(epoch_us(ts) // 1000) AS hi FROM events")
def agg_min_max(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min(ms).alias("lo"), F.max(ms).alias("hi"))


@query("agg_exposure", "SELECT n_name, coalesce(round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2), 0) + 0.0 AS reserved, count(o_orderkey) AS bets, coalesce(bool_or(o_orderstatus = 'F'), false) AS any_settled FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey LEFT JOIN orders ON c_custkey = o_custkey GROUP BY n_name")
def agg_exposure(spark, sf_dir):
    """Sums with NULL as 0, counts and any, also for groups without rows."""
    n, c, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "customer", "orders"))
    j = n.join(c.join(o, c["c_custkey"] == o["o_custkey"], "left"), n["n_nationkey"] == c["c_nationkey"], "left")
    return j.groupBy("n_name").agg(F.coalesce(F.round(F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))), 2), F.lit(0.0)).alias("reserved"), F.count("o_orderkey").alias("bets"), F.coalesce(F.bool_or(F.col("o_orderstatus") == "F"), F.lit(False)).alias("any_settled"))


@query("agg_cross_session", f"{de.with_sql()}, s AS (SELECT 'paper' AS book, won FROM bets WHERE anchor_open % 7200000 = 0 UNION ALL SELECT 'live', won FROM bets WHERE anchor_open % 7200000 <> 0) SELECT book, count(*) AS bets, count(*) FILTER (WHERE won) AS wins, {_r('sum(CASE WHEN won THEN 10 * 0.45 / 0.55 ELSE -10 END)', 'net', 4)}, {_r('avg(CAST(won AS INT))', 'hit_rate')} FROM s GROUP BY book")
def agg_cross_session(spark, sf_dir):
    """Profit over two books put together, at a flat stake of 10."""
    b = de.bets(spark, sf_dir)
    even = F.pmod("anchor_open", F.lit(2 * _H)) == 0
    s = b.filter(even).select(F.lit("paper").alias("book"), "won").unionByName(b.filter(~even).select(F.lit("live").alias("book"), "won"))
    g = s.groupBy("book").agg(F.count("*").alias("bets"), F.count_if("won").alias("wins"), F.sum(F.when(F.col("won"), F.lit(10 * 0.45 / 0.55)).otherwise(-10.0)).alias("net"), st.share(F.col("won")).alias("hit_rate"))
    return mk.rounded(g.withColumn("net", F.round("net", 4)))


@query("agg_distinct", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events")
def agg_distinct(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("kinds"))


@query("agg_column_stats", f"{mk.with_sql(mk.candles_sql())} SELECT symbol, {_r('avg(close)', 'mean')}, {_r('stddev_pop(close)', 'std')}, {_r('avg(volume)', 'v_mean')}, {_r('stddev_pop(volume)', 'v_std')} FROM candles GROUP BY symbol")
def agg_column_stats(spark, sf_dir):
    """Means and population deviations that the out-of-distribution guard keeps."""
    c = mk.candles(mk.trades(spark, sf_dir))
    return mk.rounded(c.groupBy("symbol").agg(F.avg("close").alias("mean"), F.stddev_pop("close").alias("std"), F.avg("volume").alias("v_mean"), F.stddev_pop("volume").alias("v_std")))


@query("agg_calibration_table", f"{de.with_sql()} SELECT CAST(floor(p_up * 20) AS BIGINT) AS bin, count(*) AS n, {_r('avg(p_up)', 'mean_p')}, {_r('avg(CAST(outcome_up AS INT))', 'mean_y')} FROM decisions GROUP BY ALL")
def agg_calibration_table(spark, sf_dir):
    g = de.decisions(spark, sf_dir).groupBy(F.floor(F.col("p_up") * 20).alias("bin")).agg(F.count("*").alias("n"), F.avg("p_up").alias("mean_p"), F.avg(_y()).alias("mean_y"))
    return mk.rounded(g)


_COVERS = (0.05, 0.1, 0.25, 1.0)
_GATE = f"{de.with_sql()}, t AS ({' UNION ALL '.join(f'SELECT symbol, {c}::DOUBLE AS cov, quantile_cont(abs(p_up - 0.5), {1 - c!r}::DOUBLE) AS thr FROM bets GROUP BY symbol' for c in _COVERS)})"


def _gated(spark, sf_dir, covers=_COVERS):
    """Bets at or above the confidence that leaves each share of them."""
    b = de.bets(spark, sf_dir).withColumn("conf", F.abs(F.col("p_up") - 0.5))
    t = b.groupBy("symbol").agg(F.percentile("conf", F.array(*(F.lit(1 - c) for c in covers))).alias("q"))
    t = t.select("symbol", F.posexplode("q").alias("k", "thr")).withColumn("cov", F.element_at(F.array(*map(F.lit, covers)), F.col("k") + 1))
    return b.join(t, "symbol").filter("conf >= thr")


@query("agg_coverage_gate", f"{_GATE} SELECT t.symbol, cov, count(*) AS n, {_r('avg(CAST(won AS INT))', 'accuracy')}, {_r('avg(CASE WHEN won THEN 0.98 ELSE -1 END)', 'ev')} FROM bets b JOIN t ON b.symbol = t.symbol AND abs(p_up - 0.5) >= thr GROUP BY ALL")
def agg_coverage_gate(spark, sf_dir):
    """Accuracy and expected value (even odds, 2 % fee) of the most confident share."""
    g = _gated(spark, sf_dir).groupBy("symbol", "cov").agg(F.count("*").alias("n"), st.share(F.col("won")).alias("accuracy"), F.avg(F.when(F.col("won"), 0.98).otherwise(-1.0)).alias("ev"))
    return mk.rounded(g)


_BPS = "CASE WHEN won THEN 1 ELSE -1 END * abs(target_close / target_open_price - 1) * 10000"


@query("agg_cost_grid", f"{_GATE} SELECT cov, cost, count(*) AS n, {_r(f'avg({_BPS}) - cost', 'net_bps', 4)} FROM bets b JOIN t ON b.symbol = t.symbol AND abs(p_up - 0.5) >= thr, (VALUES (0), (2), (10)) c(cost) GROUP BY cov, cost")
def agg_cost_grid(spark, sf_dir):
    """Net result a trade by coverage and cost."""
    bps = F.when(F.col("won"), 1).otherwise(-1) * F.abs(F.col("target_close") / F.col("target_open_price") - 1) * 10000
    g = _gated(spark, sf_dir).groupBy("cov").agg(F.count("*").alias("n"), F.avg(bps).alias("gross"))
    g = g.withColumn("cost", F.explode(F.array(F.lit(0), F.lit(2), F.lit(10))))
    return mk.rounded(g.select("cov", "cost", "n", (F.col("gross") - F.col("cost")).alias("net_bps")), 4)


@query("agg_frontier", f"{_GATE}, g AS (SELECT t.symbol, cov, avg(CASE WHEN won THEN 0.98 ELSE -1 END) AS ev FROM bets b JOIN t ON b.symbol = t.symbol AND abs(p_up - 0.5) >= thr GROUP BY ALL) SELECT symbol, arg_max(cov, (round(ev, 9), cov)) AS best_cov, {_r('max(ev)', 'best_ev')} FROM g GROUP BY symbol")
def agg_frontier(spark, sf_dir):
    g = _gated(spark, sf_dir).groupBy("symbol", "cov").agg(F.avg(F.when(F.col("won"), 0.98).otherwise(-1.0)).alias("ev"))
    return mk.rounded(g.groupBy("symbol").agg(F.max_by("cov", F.struct(F.round("ev", 9), "cov")).alias("best_cov"), F.max("ev").alias("best_ev")))


@query(
    "agg_auc",
    f"""{de.with_sql()}, r AS (SELECT symbol, CAST(outcome_up AS INT) AS y, (rank() OVER (PARTITION BY symbol ORDER BY p_up) + (count(*) OVER (PARTITION BY symbol, p_up) - 1) / 2.0) AS rk FROM bets)
SELECT symbol, {_r("(sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))", "auc")}, {_r("avg(y)", "base_rate")} FROM r GROUP BY symbol""",
)
def agg_auc(spark, sf_dir):
    """Area under the curve from counts by score: ties share ranks, and only distinct scores are ordered."""
    g = de.bets(spark, sf_dir).groupBy("symbol", "p_up").agg(F.sum(_y()).alias("pos"), F.sum(1 - _y()).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("symbol").orderBy("p_up").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = g.withColumn("pairs", F.col("pos") * (below + F.col("neg") / 2.0))
    return mk.rounded(g.groupBy("symbol").agg((F.sum("pairs") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"), (F.sum("pos") / F.sum(F.col("pos") + F.col("neg"))).alias("base_rate")))


@query("agg_base_rate", f"{de.with_sql()} SELECT symbol, {_r('avg(CAST(outcome_up AS INT))', 'up_rate')}, {_r('greatest(avg(CAST(outcome_up AS INT)), 1 - avg(CAST(outcome_up AS INT)))', 'majority')}, {_r('avg(CAST(won AS INT)) - greatest(avg(CAST(outcome_up AS INT)), 1 - avg(CAST(outcome_up AS INT)))', 'edge')} FROM bets GROUP BY symbol")
def agg_base_rate(spark, sf_dir):
    """The hit-rate beside that of always betting the commoner side."""
    g = de.bets(spark, sf_dir).groupBy("symbol").agg(F.avg(_y()).alias("up_rate"), st.share(F.col("won")).alias("hit"))
    majority = F.greatest(F.col("up_rate"), 1 - F.col("up_rate"))
    return mk.rounded(g.select("symbol", "up_rate", majority.alias("majority"), (F.col("hit") - majority).alias("edge")))


_CROSS = f"s AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY open_time)) AS r FROM candles), m AS (SELECT open_time, max(r) FILTER (WHERE symbol = 'view') AS lead_r FROM s GROUP BY open_time)"


def _cross(spark, sf_dir):
    """Returns by hour in long form, with the leader's: one shuffle for any number of symbols."""
    c = mk.candles(mk.trades(spark, sf_dir)).withColumn("r", F.ln(F.col("close") / F.lag("close").over(mk.series())))
    lead = c.filter("symbol = 'view'").select("open_time", F.col("r").alias("lead_r"))
    return c.filter("symbol <> 'view'").join(lead, "open_time", "left")


@query("agg_breadth", f"{mk.with_sql(mk.candles_sql(), _CROSS)} SELECT s.open_time, {_r('avg(CAST(sign(r) = sign(lead_r) AS INT))', 'breadth')}, {_r('avg(CAST(r > 0 AS INT))', 'frac_up')} FROM s JOIN m ON s.open_time = m.open_time WHERE symbol <> 'view' AND r IS NOT NULL AND lead_r IS NOT NULL GROUP BY s.open_time")
def agg_breadth(spark, sf_dir):
    """The share of other series that move as the leader does."""
    x = _cross(spark, sf_dir).filter("r IS NOT NULL AND lead_r IS NOT NULL")
    return mk.rounded(x.groupBy("open_time").agg(st.share(F.signum("r") == F.signum("lead_r")).alias("breadth"), st.share(F.col("r") > 0).alias("frac_up")))


@query("agg_dispersion", f"{mk.with_sql(mk.candles_sql(), _CROSS)} SELECT open_time, {_r('stddev_samp(r)', 'dispersion')}, {_r('sum(r * volume) / nullif(sum(volume), 0)', 'weighted')}, {_r('avg(abs(r))', 'amplification')} FROM s WHERE symbol <> 'view' AND r IS NOT NULL GROUP BY open_time")
def agg_dispersion(spark, sf_dir):
    x = _cross(spark, sf_dir).filter("r IS NOT NULL")
    return mk.rounded(x.groupBy("open_time").agg(F.stddev_samp("r").alias("dispersion"), (F.sum(F.col("r") * F.col("volume")) / F.nullif(F.sum("volume"), F.lit(0.0))).alias("weighted"), F.avg(F.abs("r")).alias("amplification")))


_FEATS = ("close", "volume", "high", "low")


@query(
    "agg_corr_rank",
    f"""{mk.with_sql(mk.candles_sql())}, f AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY open_time) / close - 1 AS fwd FROM candles),
u AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, fwd) AS r FROM f WHERE fwd IS NOT NULL" for c in _FEATS)})
SELECT feature, {_r("r", "corr")}, row_number() OVER (ORDER BY abs(r) DESC, feature) AS rank, abs(r) > 0.10 AS alarm FROM u""",
)
def agg_corr_rank(spark, sf_dir):
    """Correlation of each feature with the next return, ranked; over 0.10 is suspicious. One pass for all features."""
    f = mk.candles(mk.trades(spark, sf_dir)).withColumn("fwd", F.lead("close").over(mk.series()) / F.col("close") - 1).filter("fwd IS NOT NULL")
    g = f.agg(*(F.corr(c, "fwd").alias(c) for c in _FEATS))
    u = g.unpivot([], list(_FEATS), "feature", "corr")  # a row a feature
    return mk.rounded(u.select("feature", "corr", F.row_number().over(Window.orderBy(F.desc(F.abs("corr")), "feature")).cast("long").alias("rank"), (F.abs("corr") > 0.10).alias("alarm")))


@query(
    "agg_regime",
    f"""{de.with_sql()}, v AS (SELECT *, stddev_samp(close) OVER (PARTITION BY symbol ORDER BY anchor_open ROWS 23 PRECEDING) / close AS vol FROM bets)
SELECT symbol, CASE WHEN vol < 0.6 THEN 'calm' WHEN vol < 1.2 THEN 'normal' ELSE 'wild' END AS regime, count(*) AS n, {_r("avg(CAST(won AS INT))", "hit")}, {_r("min(vol)", "min_vol")}, {_r("max(vol)", "max_vol")} FROM v WHERE vol IS NOT NULL GROUP BY ALL""",
)
def agg_regime(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("anchor_open").rowsBetween(-23, 0)
    v = de.bets(spark, sf_dir).withColumn("vol", F.stddev_samp("close").over(w) / F.col("close")).filter("vol IS NOT NULL")
    regime = F.when(F.col("vol") < 0.6, "calm").when(F.col("vol") < 1.2, "normal").otherwise("wild")
    return mk.rounded(v.groupBy("symbol", regime.alias("regime")).agg(F.count("*").alias("n"), st.share(F.col("won")).alias("hit"), F.min("vol").alias("min_vol"), F.max("vol").alias("max_vol")))


@query("agg_by_day", f"{de.with_sql()} SELECT anchor_open // 86400000 AS day, count(*) AS n, {_r('avg(CAST(won AS INT))', 'hit')} FROM bets GROUP BY ALL")
def agg_by_day(spark, sf_dir):
    return mk.rounded(de.bets(spark, sf_dir).groupBy(F.expr("anchor_open div 86400000").alias("day")).agg(F.count("*").alias("n"), st.share(F.col("won")).alias("hit")))


@query("agg_confidence_gap", f"{de.with_sql()} SELECT close > 50 AS bull, p_up >= 0.5 AS up, count(*) AS n, {_r('avg(greatest(p_up, 1 - p_up))', 'stated')}, {_r('avg(CAST(won AS INT))', 'realised')}, {_r('avg(greatest(p_up, 1 - p_up)) - avg(CAST(won AS INT))', 'gap')} FROM bets GROUP BY ALL")
def agg_confidence_gap(spark, sf_dir):
    g = de.bets(spark, sf_dir).groupBy((F.col("close") > 50).alias("bull"), (F.col("p_up") >= 0.5).alias("up"))
    g = g.agg(F.count("*").alias("n"), F.avg(F.greatest(F.col("p_up"), 1 - F.col("p_up"))).alias("stated"), st.share(F.col("won")).alias("realised"))
    return mk.rounded(g.withColumn("gap", F.col("stated") - F.col("realised")))


_TRIALS = 49
_Z1, _ZD = NormalDist().inv_cdf(0.95), NormalDist().inv_cdf(1 - 0.05 / _TRIALS)
_L1, _LD = st.wilson_sql("w", "n", _Z1)[0], st.wilson_sql("w", "n", _ZD)[0]


@query(
    "agg_pooled_deflated",
    f"""{de.with_sql()}, g AS (SELECT symbol, anchor_open // (5 * 86400000) AS win, count(*) AS n, count(*) FILTER (WHERE won) AS w FROM bets GROUP BY ALL),
p AS (SELECT symbol, CAST(sum(n) AS BIGINT) AS n, CAST(sum(w) AS BIGINT) AS w, count(*) FILTER (WHERE w / n > 0.5) AS above, count(*) FILTER (WHERE n < 20) AS thin FROM g GROUP BY symbol)
SELECT symbol, n, {_r("w / n", "pooled")}, {_r(_L1, "lb95")}, {_r(_LD, "deflated")}, above, thin FROM p""",
)
def agg_pooled_deflated(spark, sf_dir):
    """Hit-rate pooled over windows, with a bound that allows for the trials made."""
    g = de.bets(spark, sf_dir).groupBy("symbol", F.expr("anchor_open div (5 * 86400000)").alias("win")).agg(F.count("*").alias("n"), F.count_if("won").alias("w"))
    p = g.groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.count_if(F.col("w") / F.col("n") > 0.5).alias("above"), F.count_if(F.col("n") < 20).alias("thin"))
    return mk.rounded(p.select("symbol", "n", (F.col("w") / F.col("n")).alias("pooled"), st.wilson(F.col("w"), F.col("n"), _Z1)[0].alias("lb95"), st.wilson(F.col("w"), F.col("n"), _ZD)[0].alias("deflated"), "above", "thin"))


@query(
    "agg_equity_stats",
    f"""{de.with_sql()}, e AS (SELECT symbol, target_open, 1000 + sum(CASE WHEN won THEN 10 * 0.45 / 0.55 ELSE -10 END) OVER (PARTITION BY symbol ORDER BY target_open) AS bal FROM bets),
f AS (SELECT *, greatest(1000, max(bal) OVER (PARTITION BY symbol ORDER BY target_open)) - bal AS dd FROM e)
SELECT symbol, {_r("max(greatest(bal, 1000))", "peak", 4)}, {_r("min(least(bal, 1000))", "trough", 4)}, {_r("max(dd)", "max_drawdown", 4)} FROM f GROUP BY symbol""",
)
def agg_equity_stats(spark, sf_dir):
    """Peak, trough and worst fall of a flat-stake balance."""
    w = Window.partitionBy("symbol").orderBy("target_open").rowsBetween(Window.unboundedPreceding, 0)
    e = de.bets(spark, sf_dir).withColumn("bal", 1000 + F.sum(F.when(F.col("won"), F.lit(10 * 0.45 / 0.55)).otherwise(-10.0)).over(w))
    e = e.withColumn("dd", F.greatest(F.lit(1000.0), F.max("bal").over(w)) - F.col("bal"))
    return mk.rounded(e.groupBy("symbol").agg(F.max(F.greatest("bal", F.lit(1000.0))).alias("peak"), F.min(F.least("bal", F.lit(1000.0))).alias("trough"), F.max("dd").alias("max_drawdown")), 4)


@query(
    "agg_visible_hit_rate",
    f"""{de.with_sql()}, l AS (SELECT symbol, target_open, won FROM bets WHERE target_open % 3 = 0), p AS (SELECT symbol, target_open, (p_up >= 0.5) = (target_close > close) AS hit FROM bets WHERE abs(p_up - 0.5) >= 0.02)
SELECT coalesce(l.symbol, p.symbol) AS symbol, count(*) AS n, {_r("avg(CAST(coalesce(l.won, p.hit) AS INT))", "hit_rate")} FROM l FULL JOIN p ON l.symbol = p.symbol AND l.target_open = p.target_open GROUP BY ALL""",
)
def agg_visible_hit_rate(spark, sf_dir):
    """A ledger's outcome wins over a prediction's own score, which goes by the close before."""
    b = de.bets(spark, sf_dir)
    ledger = b.filter(F.pmod("target_open", F.lit(3)) == 0).select("symbol", "target_open", "won")
    own = b.filter(F.abs(F.col("p_up") - 0.5) >= 0.02).select("symbol", "target_open", ((F.col("p_up") >= 0.5) == (F.col("target_close") > F.col("close"))).alias("hit"))
    return mk.rounded(ledger.join(own, ["symbol", "target_open"], "full").groupBy("symbol").agg(F.count("*").alias("n"), st.share(F.coalesce("won", "hit")).alias("hit_rate")))


@query("agg_mean_corr", f"{mk.with_sql(mk.candles_sql())}, r AS (SELECT symbol, open_time, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY open_time)) AS r FROM candles), c AS (SELECT a.symbol, b.symbol AS other, corr(a.r, b.r) AS c FROM r a JOIN r b ON a.open_time = b.open_time AND a.symbol <> b.symbol GROUP BY ALL) SELECT symbol, count(*) AS others, round(avg(c), 6) + 0.0 AS mean_corr FROM c GROUP BY symbol")
def agg_mean_corr(spark, sf_dir):
    """The mean correlation of a symbol's returns with those of the others: one row a bar, symbols side by side, so no bar meets another."""
    c = mk.candles(mk.trades(spark, sf_dir))
    r = c.select("symbol", "open_time", F.ln(F.col("close") / F.lag("close").over(mk.series())).alias("r")).filter("r IS NOT NULL")
    bars = r.groupBy("open_time").agg(F.collect_list(F.struct("symbol", "r")).alias("all"))  # as many as there are symbols
    pairs = bars.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).filter("a.symbol <> b.symbol")
    g = pairs.groupBy(F.col("a.symbol").alias("symbol"), F.col("b.symbol").alias("other")).agg(F.corr("a.r", "b.r").alias("c"))
    return mk.rounded(g.groupBy("symbol").agg(F.count("*").alias("others"), F.avg("c").alias("mean_corr")))
