"""Labels, models, calibration and their evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.catalog import query
from tidemill.functions import stats as st
from tidemill.operators import packs
from tidemill.plans import models as mo
from tidemill.plans import trees as tr
from tidemill.sources import decisions as de
from tidemill.sources import market as mk

_H = mk.HOUR
_P = "PARTITION BY symbol ORDER BY open_time"


def _y():
    return F.col("outcome_up").cast("double")



def _r(e: str, n: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) + 0.0 AS {n}"


def _candles(spark, sf_dir):
    return mk.candles(mk.trades(spark, sf_dir))


@query("label_next_body", f"{de.with_sql()} SELECT symbol, anchor_open, CAST(outcome_up AS INTEGER) AS y FROM decisions")
def label_next_body(spark, sf_dir):
    """1 if the target candle closes over its own open; a doji is 0."""
    return de.decisions(spark, sf_dir).select("symbol", "anchor_open", F.col("outcome_up").cast("int").alias("y"))


@query("label_kbar_sign", f"{mk.with_sql(mk.candles_sql())} SELECT symbol, open_time, CAST(lead(close, 6) OVER ({_P}) > close AS INTEGER) AS y FROM candles")
def label_kbar_sign(spark, sf_dir):
    return _candles(spark, sf_dir).select("symbol", "open_time", (F.lead("close", 6).over(mk.series()) > F.col("close")).cast("int").alias("y"))


_TB = f"""s AS (SELECT *, close / lag(close) OVER ({_P}) - 1 AS r FROM candles), v AS (SELECT *, CASE WHEN count(r) OVER ({_P} ROWS 23 PRECEDING) = 24 THEN stddev_samp(r) OVER ({_P} ROWS 23 PRECEDING) * sqrt(6) END AS sg,
  list({{'h': high, 'l': low, 'c': close}}) OVER ({_P} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS nx FROM s),
u AS (SELECT *, list_position(list_transform(nx, lambda x: x.h >= close * (1 + 0.5 * sg)), true) AS iu, list_position(list_transform(nx, lambda x: x.l <= close * (1 - 0.5 * sg)), true) AS id FROM v WHERE sg IS NOT NULL AND len(nx) = 6)"""


@query(
    "label_triple_barrier",
    f"""{mk.with_sql(mk.candles_sql(), _TB)} SELECT symbol, open_time, CAST(CASE WHEN coalesce(iu, 0) > 0 AND (coalesce(id, 0) = 0 OR iu <= id) THEN 1 WHEN coalesce(id, 0) > 0 THEN -1 ELSE 0 END AS INTEGER) AS touched,
  CAST(CASE WHEN coalesce(iu, 0) > 0 AND (coalesce(id, 0) = 0 OR iu <= id) THEN 1 WHEN coalesce(id, 0) > 0 THEN 0 ELSE CAST(nx[6].c > close AS INTEGER) END AS INTEGER) AS y FROM u""",
)
def label_triple_barrier(spark, sf_dir):
    """Which of two barriers the next six bars touch first (the upper one in the same bar), else the sign at the end."""
    w = mk.series()
    s = _candles(spark, sf_dir).withColumn("r", F.col("close") / F.lag("close").over(w) - 1)
    frame = w.rowsBetween(-23, 0)
    v = s.withColumns({"sg": F.when(F.count("r").over(frame) == 24, F.stddev_samp("r").over(frame) * F.sqrt(F.lit(6.0))), "nx": F.collect_list(F.struct("high", "low", "close")).over(w.rowsBetween(1, 6))})
    v = v.filter("sg IS NOT NULL AND size(nx) = 6")
    first = lambda test: F.array_position(F.transform("nx", test), True)
    v = v.withColumns({"iu": first(lambda x: x["high"] >= F.col("close") * (1 + 0.5 * F.col("sg"))), "id": first(lambda x: x["low"] <= F.col("close") * (1 - 0.5 * F.col("sg")))})
    up, down = (F.col("iu") > 0) & ((F.col("id") == 0) | (F.col("iu") <= F.col("id"))), F.col("id") > 0
    end = (F.element_at("nx", 6)["close"] > F.col("close")).cast("int")
    return v.select("symbol", "open_time", F.when(up, 1).when(down, -1).otherwise(0).alias("touched"), F.when(up, 1).when(down, 0).otherwise(end).alias("y"))


@query(
    "label_weights",
    f"""{de.with_sql()}, m AS (SELECT *, max(anchor_open) OVER (PARTITION BY symbol) AS last, avg(CAST(outcome_up AS INTEGER)) OVER (PARTITION BY symbol) AS rate, abs(target_close / target_open_price - 1) AS move FROM decisions)
SELECT symbol, anchor_open, {_r("pow(0.5, (last - anchor_open) / 86400000.0 / 10)", "recency")}, {_r("CASE WHEN outcome_up THEN 0.5 / rate ELSE 0.5 / (1 - rate) END", "balance")}, move >= 0.25 AS kept FROM m""",
)
def label_weights(spark, sf_dir):
    """Weights by age (half-life ten days) and by class, and a mask of small moves; class rates are one row a symbol."""
    d = de.decisions(spark, sf_dir)
    m = d.groupBy("symbol").agg(F.max("anchor_open").alias("last"), F.avg(_y()).alias("rate"))
    d = d.join(m, "symbol")
    age = (F.col("last") - F.col("anchor_open")) / 86_400_000.0
    return mk.rounded(d.select("symbol", "anchor_open", F.pow(F.lit(0.5), age / 10).alias("recency"), F.when(F.col("outcome_up"), 0.5 / F.col("rate")).otherwise(0.5 / (1 - F.col("rate"))).alias("balance"), (F.abs(F.col("target_close") / F.col("target_open_price") - 1) >= 0.25).alias("kept")))


@query("model_logistic_score", f"{de.with_sql()} SELECT symbol, target_open, p_up, round(abs(p_up - 0.5) * 2, 6) + 0.0 AS confidence FROM decisions")
def model_logistic_score(spark, sf_dir):
    return mk.rounded(de.decisions(spark, sf_dir).select("symbol", "target_open", "p_up", (F.abs(F.col("p_up") - 0.5) * 2).alias("confidence")))


@query("model_flat_baseline", f"{de.with_sql()} SELECT symbol, target_open, 0.5::DOUBLE AS p_up, close AS predicted_close FROM decisions")
def model_flat_baseline(spark, sf_dir):
    """Always 0.5 and the last close."""
    return de.decisions(spark, sf_dir).select("symbol", "target_open", F.lit(0.5).alias("p_up"), F.col("close").alias("predicted_close"))


_VOTES = "CASE WHEN p_up = 0.5 THEN NULL ELSE p_up END AS a, CASE WHEN target_open % 5 = 0 THEN NULL ELSE 1 - p_up END AS b, CASE WHEN target_close % 1 < 0.5 THEN 0.7 ELSE 0.3 END AS c"


@query(
    "model_majority_vote",
    f"""{de.with_sql()}, v AS (SELECT symbol, target_open, {_VOTES} FROM decisions), n AS (SELECT *, (coalesce(a >= 0.5, false)::INT + coalesce(b >= 0.5, false)::INT + coalesce(c >= 0.5, false)::INT) AS u, (coalesce(a < 0.5, false)::INT + coalesce(b < 0.5, false)::INT + coalesce(c < 0.5, false)::INT) AS d FROM v)
SELECT symbol, target_open, {_r("CASE WHEN u >= d THEN 0.5 + 0.5 * u / (u + d) ELSE 0.5 - 0.5 * d / (u + d) END", "p_up")} FROM n""",
)
def model_majority_vote(spark, sf_dir):
    v = de.decisions(spark, sf_dir).select("symbol", "target_open", F.when(F.col("p_up") != 0.5, F.col("p_up")).alias("a"), F.when(F.pmod("target_open", F.lit(5)) != 0, 1 - F.col("p_up")).alias("b"), F.when(F.col("target_close") % 1 < 0.5, 0.7).otherwise(0.3).alias("c"))
    return mk.rounded(v.select("symbol", "target_open", mo.majority_vote([F.col("a"), F.col("b"), F.col("c")])[0].alias("p_up")))


@query(
    "model_agreement",
    f"{de.with_sql()}, v AS (SELECT symbol, target_open, p_up AS a, {_r('0.5 + (p_up - 0.5) * 0.8', 'b')}, CASE WHEN target_close % 1 < 0.5 THEN 0.7 ELSE 0.3 END AS c FROM decisions) SELECT symbol, target_open, {_r('CASE WHEN (a >= 0.5) = (b >= 0.5) AND (b >= 0.5) = (c >= 0.5) THEN (a + b + c) / 3 ELSE 0.5 + ((a + b + c) / 3 - 0.5) * 0.25 END', 'p_up')} FROM v",
)
def model_agreement(spark, sf_dir):
    """The mean of three models, drawn to 0.5 where they disagree."""
    p = F.col("p_up")
    v = de.decisions(spark, sf_dir).select("symbol", "target_open", p.alias("a"), F.round(0.5 + (p - 0.5) * 0.8, 6).alias("b"), F.when(F.col("target_close") % 1 < 0.5, 0.7).otherwise(0.3).alias("c"))
    mean, up = (F.col("a") + F.col("b") + F.col("c")) / 3, [F.col(x) >= 0.5 for x in "abc"]
    return mk.rounded(v.select("symbol", "target_open", F.when((up[0] == up[1]) & (up[1] == up[2]), mean).otherwise(0.5 + (mean - 0.5) * 0.25).alias("p_up")))


@query("model_gate_quantile", f"{de.with_sql()} SELECT symbol, {_r('quantile_cont(abs(p_up - 0.5), 0.9::DOUBLE)', 'threshold')} FROM bets GROUP BY symbol")
def model_gate_quantile(spark, sf_dir):
    """The confidence that the top tenth reaches."""
    return mk.rounded(de.bets(spark, sf_dir).groupBy("symbol").agg(F.percentile(F.abs(F.col("p_up") - 0.5), 0.9).alias("threshold")))


@query(
    "model_ood_guard",
    f"""{mk.with_sql(mk.candles_sql())}, h AS (SELECT symbol, (min(open_time) + max(open_time)) // 2 AS half FROM candles GROUP BY symbol),
m AS (SELECT c.symbol, half, avg(close) AS mc, stddev_pop(close) AS sc, avg(volume) AS mv, stddev_pop(volume) AS sv, avg(high) AS mh, stddev_pop(high) AS sh FROM candles c JOIN h ON c.symbol = h.symbol AND open_time < half GROUP BY c.symbol, half)
SELECT c.symbol, open_time, CASE WHEN coalesce(abs((close - mc) / nullif(sc, 0)) > 1.5, false)::INT + coalesce(abs((volume - mv) / nullif(sv, 0)) > 1.5, false)::INT + coalesce(abs((high - mh) / nullif(sh, 0)) > 1.5, false)::INT >= 2 THEN 0.5::DOUBLE ELSE 0.6::DOUBLE END AS p_up FROM candles c JOIN m ON c.symbol = m.symbol AND open_time >= half""",
)
def model_ood_guard(spark, sf_dir):
    """No opinion where features lie far out of what the earlier half of the time showed (here 1.5 deviations, to see it act)."""
    c = _candles(spark, sf_dir)
    names = ("close", "volume", "high")
    half = c.groupBy("symbol").agg(F.floor((F.min("open_time") + F.max("open_time")) / 2).alias("half"))
    c = c.join(half, "symbol")
    m = c.filter("open_time < half").groupBy("symbol").agg(*(f(n).alias(f"{k}_{n}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    p = mo.ood_guard([F.col(n) for n in names], [F.col(f"m_{n}") for n in names], [F.col(f"s_{n}") for n in names], F.lit(0.6), limit=1.5, least=2)
    return c.filter("open_time >= half").join(m, "symbol").select("symbol", "open_time", p.alias("p_up"))


@query("model_linreg_fit", f"{mk.with_sql(mk.candles_sql())} SELECT {_r('regr_intercept(close, open)', 'b0')}, {_r('regr_slope(close, open)', 'b1')} FROM candles")
def model_linreg_fit(spark, sf_dir):
    """Least squares by one aggregation of products and a small solve."""
    b = mo.linear_fit(_candles(spark, sf_dir), ["open"], "close")
    return mk.rounded(spark.createDataFrame([(float(b[0]), float(b[1]))], "b0 double, b1 double"))


def _training(spark, sf_dir):
    """Rows of features and label y, ready ones only."""
    c = _candles(spark, sf_dir)
    f = packs.volume_pack(packs.momentum_pack(c, carry=True), carry=True)
    y = F.lead(F.struct("open", "close"), de.HORIZON).over(mk.series())
    f = f.withColumn("t", y).filter("t IS NOT NULL").withColumn("y", (F.col("t.close") > F.col("t.open")).cast("int"))
    cols = ["ret_1", "ret_3", "ret_5", "vol_z20", "up_vol_ratio"]
    return f.select("symbol", "open_time", "y", *cols).dropna(), cols


@query("model_irls")
def model_irls(spark, sf_dir):
    """Logistic regression by Gram matrices, one aggregation a step."""
    rows, cols = _training(spark, sf_dir)
    beta = mo.logistic_fit(rows, cols, "y", l2=1.0)
    return mk.rounded(spark.createDataFrame([(n, float(b)) for n, b in zip(["const", *cols], beta, strict=True)], "term string, beta double"))


def _expanding(rows, first: float, size: float, n: int):
    """n folds a symbol (symbol, fold, train_to, test_from, test_to), each tested on the next ``size`` of the symbol's time, three bars kept apart."""
    w = rows.groupBy("symbol").agg(F.min("at").alias("lo"), (F.max("at") - F.min("at")).alias("span")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = lambda k: (F.col("lo") + F.floor(F.col("span") * (first + size * (F.col("fold") + k)))).cast("long")
    return w.select("symbol", "fold", (at(0) - 3 * _H).alias("train_to"), at(0).alias("test_from"), at(1).alias("test_to"))


def _tree_rows(spark, sf_dir):
    rows, cols = _training(spark, sf_dir)
    return rows.withColumnRenamed("open_time", "at").withColumn("id", F.xxhash64("symbol", "at")), cols


@query("model_gbt_bag")
def model_gbt_bag(spark, sf_dir):
    """Bags of three boosted fits for each symbol and each of three expanding folds, all grown side by side: accuracy and Brier score by fold. Leaves of 25 rows, as bars are hourly."""
    rows, cols = _tree_rows(spark, sf_dir)
    s, _ = tr.bagged(rows, ["symbol"], _expanding(rows, 0.55, 0.15, 3), cols, "y", tr.Boosting(leaf=25), 3)
    return mk.rounded(s.groupBy("symbol", "fold").agg(F.count("*").alias("n"), st.share((F.col("p") >= 0.5) == (F.col("y") == 1)).alias("accuracy"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier")))


@query("model_tree_gain")
def model_tree_gain(spark, sf_dir):
    """Each feature's share of the gain of twenty boosted trees, over all symbols, in three expanding folds, and its mean rank."""
    rows, cols = _tree_rows(spark, sf_dir)
    folds = _expanding(rows.withColumn("symbol", F.lit("all")), 0.55, 0.15, 3)
    _, ens = tr.bagged(rows.withColumn("symbol", F.lit("all")), ["symbol"], folds, cols, "y", tr.Boosting(rounds=20, leaf=100), 1)
    found = [(m, c, float(g)) for m in range(len(ens.base)) for c, g in zip(cols, ens.gain[m], strict=True)]
    g = spark.createDataFrame(found, "fold int, feature string, gain double")
    w = Window.partitionBy("fold")  # a row a feature
    g = g.withColumns({"share": F.coalesce(F.col("gain") / F.nullif(F.sum("gain").over(w), F.lit(0.0)), F.lit(0.0)), "rank": F.rank().over(w.orderBy(F.desc("gain")))})
    return mk.rounded(g.groupBy("feature").agg(F.avg("share").alias("share"), F.avg("rank").alias("mean_rank")))


_TREE_X = {"body": "close - open", "range": "high - low", "volume": "volume", "trades": "trades::DOUBLE"}
_TREE_LEAF = 25


def _level_sql(k: int) -> str:
    """The best split of each node of level k (b), and the rows one level down (r)."""
    w = "PARTITION BY l.symbol, node, j"
    score = lambda g, h: f"({g}) * ({g}) / ({h} + 1)"
    return f"""s{k} AS (SELECT l.symbol, node, j, feature, x, sum(g) OVER (w ORDER BY x) AS gl, sum(h) OVER (w ORDER BY x) AS hl, count(*) OVER (w ORDER BY x) AS nl, sum(g) OVER w AS gt, sum(h) OVER w AS ht, count(*) OVER w AS nt FROM l JOIN r{k} r ON r.symbol = l.symbol AND r.id = l.id WINDOW w AS ({w})),
c{k} AS (SELECT DISTINCT symbol, node, j, feature, x, round(0.5 * ({score("gl", "hl")} + {score("gt - gl", "ht - hl")} - {score("gt", "ht")}), 9) AS gain FROM s{k} WHERE nl >= {_TREE_LEAF} AND nt - nl >= {_TREE_LEAF}),
b{k} AS (SELECT * FROM c{k} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY symbol, node ORDER BY gain DESC, j, x) = 1),
r{k + 1} AS (SELECT r.symbol, r.id, 2 * r.node + CAST(l.x > b.x AS INTEGER) AS node FROM r{k} r JOIN b{k} b ON b.symbol = r.symbol AND b.node = r.node JOIN l ON l.symbol = r.symbol AND l.id = r.id AND l.j = b.j)"""


_TREE_LONG = " UNION ALL ".join(f"SELECT symbol, id, {j} AS j, '{n}' AS feature, ({e})::DOUBLE AS x, g, h FROM d" for j, (n, e) in enumerate(_TREE_X.items()))
_TREE = f"""t AS (SELECT *, open_time AS id, CAST(lead(close) OVER (PARTITION BY symbol ORDER BY open_time) > close AS INTEGER) AS y FROM candles QUALIFY y IS NOT NULL),
p AS (SELECT symbol, greatest(0.001::DOUBLE, least(0.999::DOUBLE, avg(y))) AS p FROM t GROUP BY symbol), d AS (SELECT t.*, p.p - y AS g, greatest(p.p * (1 - p.p), 1e-6) AS h FROM t JOIN p ON t.symbol = p.symbol),
l AS ({_TREE_LONG}), r0 AS (SELECT symbol, id, 1 AS node FROM d),
{_level_sql(0)},
{_level_sql(1)},
b AS (SELECT * FROM b0 UNION ALL SELECT * FROM b1), r AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2)"""


@query("model_one_tree", f"{mk.with_sql(mk.candles_sql(), _TREE)} SELECT r.symbol, r.node, any_value(b.feature) AS feature, {_r('-sum(d.g) / (sum(d.h) + 1)', 'value')} FROM r JOIN d ON d.symbol = r.symbol AND d.id = r.id LEFT JOIN b ON b.symbol = r.symbol AND b.node = r.node GROUP BY r.symbol, r.node")
def model_one_tree(spark, sf_dir):
    """The first tree of each symbol's boosting, two levels deep, on all rows and features: the split and Newton value of every node."""
    c = _candles(spark, sf_dir).withColumn("y", (F.lead("close").over(mk.series()) > F.col("close")).cast("int")).filter("y IS NOT NULL")
    c = c.select("symbol", F.col("open_time").alias("id"), "y", (F.col("close") - F.col("open")).alias("body"), (F.col("high") - F.col("low")).alias("range"), "volume", F.col("trades").cast("double").alias("trades"))
    names = [r.symbol for r in c.select("symbol").distinct().orderBy("symbol").collect()]  # a model each
    models = spark.createDataFrame(list(enumerate(names)), "model int, symbol string")
    ens = tr.fit(c.join(F.broadcast(models), "symbol"), list(_TREE_X), tr.Boosting(rounds=1, depth=2, leaf=_TREE_LEAF, rows=1.0, columns=1.0, bins=8192), [1] * len(names))
    return mk.rounded(spark.createDataFrame([(names[m], k, f, v) for m, _, k, f, _, v in ens.splits()], "symbol string, node int, feature string, value double"))


_FOLD = "f AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY target_open) - 1 AS k, count(*) OVER (PARTITION BY symbol) // 6 AS size FROM bets), g AS (SELECT symbol, CAST(k // size AS BIGINT) AS fold, count(*) AS n, count(*) FILTER (WHERE won) AS w, avg((p_up - CAST(outcome_up AS INTEGER)) ** 2) AS brier FROM f WHERE k // size BETWEEN 1 AND 5 GROUP BY ALL)"
_LO = st.wilson_sql("tw", "tn")[0]


@query(
    "model_walkforward",
    f"""{de.with_sql(_FOLD)}, a AS (SELECT symbol, CAST(sum(n) AS BIGINT) AS tn, CAST(sum(w) AS BIGINT) AS tw, sum(brier * n) / sum(n) AS b, count(*) FILTER (WHERE w / n > 0.5) AS above, count(*) AS folds FROM g GROUP BY symbol)
SELECT symbol, tn AS bets, {_r("tw / tn", "hit_rate")}, {_r(_LO, "ci_low")}, {_r("b", "brier")}, above, CASE WHEN tn < 300 THEN 'sample too small' WHEN {_LO} <= 0.5 THEN 'no edge over a coin' WHEN above * 2 <= folds THEN 'not robust' WHEN tw / tn < 0.6 THEN 'below target' ELSE 'pass' END AS verdict FROM a""",
)
def model_walkforward(spark, sf_dir):
    """Five expanding folds, Brier weighted by bets, and the first guard that fails."""
    w = Window.partitionBy("symbol")
    f = de.bets(spark, sf_dir).withColumns({"k": F.row_number().over(w.orderBy("target_open")) - 1, "size": F.floor(F.count("*").over(w) / 6)}).withColumn("fold", F.floor(F.col("k") / F.col("size")))
    g = f.filter("fold BETWEEN 1 AND 5").groupBy("symbol", "fold").agg(F.count("*").alias("n"), F.count_if("won").alias("w"), F.sum(F.pow(F.col("p_up") - _y(), 2)).alias("b"))
    a = g.groupBy("symbol").agg(F.sum("n").alias("bets"), F.sum("w").alias("tw"), (F.sum("b") / F.sum("n")).alias("brier"), F.count_if(F.col("w") / F.col("n") > 0.5).alias("above"), F.count("*").alias("folds"))
    hit, low = F.col("tw") / F.col("bets"), st.wilson(F.col("tw"), F.col("bets"))[0]
    verdict = F.when(F.col("bets") < 300, "sample too small").when(low <= 0.5, "no edge over a coin").when(F.col("above") * 2 <= F.col("folds"), "not robust").when(hit < 0.6, "below target").otherwise("pass")
    return mk.rounded(a.select("symbol", "bets", hit.alias("hit_rate"), low.alias("ci_low"), "brier", "above", verdict.alias("verdict")))


_PAVA = """s AS (SELECT symbol, p_up AS x, count(*) AS n, sum(outcome_up::INTEGER) AS y FROM bets GROUP BY ALL),
c AS (SELECT symbol, x, row_number() OVER w AS i, sum(n) OVER w AS n, sum(y) OVER w AS y FROM s WINDOW w AS (PARTITION BY symbol ORDER BY x)),
m AS (SELECT a.symbol, a.i AS j, b.i AS k, (b.y - coalesce(z.y, 0)) / (b.n - coalesce(z.n, 0))::DOUBLE AS mean FROM c a JOIN c b ON a.symbol = b.symbol AND a.i <= b.i LEFT JOIN c z ON z.symbol = a.symbol AND z.i = a.i - 1),
l AS (SELECT symbol, j, k AS i, min(mean) OVER (PARTITION BY symbol, j ORDER BY k DESC) AS low FROM m),
v AS (SELECT symbol, i, round(max(low), 9) AS y FROM l GROUP BY symbol, i),
e AS (SELECT v.symbol, x, v.y, lag(v.y) OVER w AS before, lead(v.y) OVER w AS after FROM v JOIN c ON v.symbol = c.symbol AND v.i = c.i WINDOW w AS (PARTITION BY v.symbol ORDER BY x))"""


@query("model_pava_fit", f"{de.with_sql(_PAVA)} SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY x) - 1 AS INTEGER) AS k, {_r('x', 'x')}, {_r('y', 'y')} FROM e WHERE before IS DISTINCT FROM y OR after IS DISTINCT FROM y")
def model_pava_fit(spark, sf_dir):
    """Isotonic breakpoints by symbol; in SQL a value is the greatest over starts of the least mean over ends."""
    fit = mo.isotonic_fit(de.bets(spark, sf_dir).withColumn("y", _y()), "symbol", "p_up", "y")
    return mk.rounded(fit.select("symbol", F.posexplode(F.arrays_zip("xs", "ys")).alias("k", "b")).select("symbol", "k", F.col("b.xs").alias("x"), F.col("b.ys").alias("y")))


_KNOTS = "(VALUES (0.2::DOUBLE, 0.3::DOUBLE), (0.45, 0.48), (0.55, 0.5), (0.8, 0.7))"


@query(
    "model_pava_apply",
    f"""{de.with_sql()}, k AS (SELECT list(x ORDER BY x) AS xs, list(y ORDER BY x) AS ys FROM {_KNOTS} v(x, y)), q AS (SELECT symbol, target_open, p_up AS p, xs, ys, len(list_filter(xs, lambda x: x <= p_up)) AS i FROM decisions, k)
SELECT symbol, target_open, {_r("CASE WHEN i = 0 THEN ys[1] WHEN i = len(xs) THEN ys[i] ELSE ys[i] + (p - xs[i]) / (xs[i + 1] - xs[i]) * (ys[i + 1] - ys[i]) END", "calibrated")} FROM q""",
)
def model_pava_apply(spark, sf_dir):
    xs, ys = (F.array(*map(F.lit, v)) for v in ((0.2, 0.45, 0.55, 0.8), (0.3, 0.48, 0.5, 0.7)))
    return mk.rounded(de.decisions(spark, sf_dir).select("symbol", "target_open", mo.piecewise(F.col("p_up"), xs, ys).alias("calibrated")))


def _regimes(spark, sf_dir):
    """Bets with the label y and their bucket: volatility of a day of closes, and side."""
    w = Window.partitionBy("symbol").orderBy("anchor_open").rowsBetween(-23, 0)
    b = de.bets(spark, sf_dir).withColumn("vol", F.stddev_samp("close").over(w) / F.col("close")).filter("vol IS NOT NULL")
    return b.withColumn("bucket", F.concat(F.when(F.col("vol") < 0.6, "calm").when(F.col("vol") < 1.2, "normal").otherwise("wild"), F.when(F.col("p_up") >= 0.5, "-up").otherwise("-down"))).withColumn("y", _y())


@query("model_mondrian")
def model_mondrian(spark, sf_dir):
    """Calibration of its own for each volatility bucket and side, fitted on the earlier seven tenths of the time and judged on the rest."""
    b = _regimes(spark, sf_dir)
    lo, hi = b.agg(F.min("anchor_open"), F.max("anchor_open")).first()
    cut = (lo or 0) + int(((hi or 0) - (lo or 0)) * 0.7)
    fits = mo.isotonic_fit(b.filter(F.col("target_open") < cut), "bucket", "p_up", "y")
    out = b.filter(F.col("anchor_open") >= cut).join(F.broadcast(fits), "bucket").withColumn("p_cal", mo.piecewise(F.col("p_up"), F.col("xs"), F.col("ys"))).drop("n")  # at most six buckets
    return mk.rounded(out.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("p_up").alias("raw"), F.avg("p_cal").alias("calibrated"), F.avg("y").alias("observed")))


_LEAST, _SHRINK = 250, 200
_CURVES = f"""v AS (SELECT *, stddev_samp(close) OVER (PARTITION BY symbol ORDER BY anchor_open ROWS 23 PRECEDING) / close AS vol FROM bets),
b AS (SELECT *, CASE WHEN vol < 0.6 THEN 'calm' WHEN vol < 1.2 THEN 'normal' ELSE 'wild' END || CASE WHEN p_up >= 0.5 THEN '-up' ELSE '-down' END AS bucket FROM v WHERE vol IS NOT NULL),
e AS (SELECT min(anchor_open) + CAST(floor((max(anchor_open) - min(anchor_open)) * 0.7) AS BIGINT) AS cut FROM b),
t AS (SELECT bucket AS k, p_up AS x, outcome_up::INTEGER AS y FROM b, e WHERE target_open < cut), u AS (SELECT * FROM t UNION ALL SELECT 'all', x, y FROM t),
s AS (SELECT k, x, count(*) AS n, sum(y) AS y FROM u GROUP BY ALL),
c AS (SELECT k, x, row_number() OVER w AS i, sum(n) OVER w AS n, sum(y) OVER w AS y FROM s WINDOW w AS (PARTITION BY k ORDER BY x)),
m AS (SELECT a.k, a.i AS j, b.i AS i, (b.y - coalesce(z.y, 0)) / (b.n - coalesce(z.n, 0))::DOUBLE AS mean FROM c a JOIN c b ON a.k = b.k AND a.i <= b.i LEFT JOIN c z ON z.k = a.k AND z.i = a.i - 1),
l AS (SELECT k, j, i, min(mean) OVER (PARTITION BY k, j ORDER BY i DESC) AS low FROM m), f AS (SELECT k, i, max(low) AS y FROM l GROUP BY k, i),
g AS (SELECT f.k, list(c.x ORDER BY c.x) AS xs, list(f.y ORDER BY c.x) AS ys, max(c.n) AS n FROM f JOIN c ON c.k = f.k AND c.i = f.i GROUP BY f.k),
h AS (SELECT b.bucket, p_up AS p, outcome_up::INTEGER AS y, o.n, o.xs AS ox, o.ys AS oy, a.xs AS ax, a.ys AS ay, len(list_filter(o.xs, lambda q: q <= p_up)) AS oi, len(list_filter(a.xs, lambda q: q <= p_up)) AS ai
  FROM b JOIN e ON anchor_open >= cut JOIN g a ON a.k = 'all' LEFT JOIN g o ON o.k = b.bucket)"""
_AT = lambda x, y, i: f"CASE WHEN {i} = 0 THEN {y}[1] WHEN {i} = len({x}) THEN {y}[{i}] ELSE {y}[{i}] + (p - {x}[{i}]) / ({x}[{i} + 1] - {x}[{i}]) * ({y}[{i} + 1] - {y}[{i}]) END"
_KEPT = lambda v: f"greatest(1e-6, least(1 - 1e-6, {v} + 1e-4 * (p - 0.5)))"


@query(
    "model_calibration_forms",
    f"""{de.with_sql(_CURVES)}, w AS (SELECT bucket, p, y, coalesce(n, 0) AS n, {_AT("ox", "oy", "oi")} AS o, {_AT("ax", "ay", "ai")} AS a FROM h)
SELECT bucket, count(*) AS rows, {_r("avg(p)", "raw")}, {_r(f"avg({_KEPT(f'CASE WHEN n >= {_LEAST} THEN o ELSE a END')})", "own")}, {_r(f"avg({_KEPT(f'CASE WHEN n >= {_LEAST} THEN 0.5 * a + 0.5 * o ELSE a END')})", "mixed")},
{_r(f"avg({_KEPT(f'CASE WHEN n > 0 THEN n / (n + {_SHRINK}.0) * o + (1 - n / (n + {_SHRINK}.0)) * a ELSE a END')})", "shrunk")}, {_r("avg(y)", "observed")} FROM w GROUP BY bucket""",
)
def model_calibration_forms(spark, sf_dir):
    """Isotonic curves of each regime and side and of all together, fitted on the earlier seven tenths of the time: own, mixed and shrunk forms on the rest."""
    b = _regimes(spark, sf_dir)
    lo, hi = b.agg(F.min("anchor_open"), F.max("anchor_open")).first()
    cut = (lo or 0) + int(((hi or 0) - (lo or 0)) * 0.7)
    early = b.filter(F.col("target_open") < cut).select("bucket", "p_up", "y")
    fits = mo.isotonic_fit(early.union(early.withColumn("bucket", F.lit("all"))), "bucket", "p_up", "y")
    out = mo.calibrated(b.filter(F.col("anchor_open") >= cut).select("bucket", "p_up", "y"), fits, "bucket", "p_up", _LEAST, _SHRINK)
    return mk.rounded(out.groupBy("bucket").agg(F.count("*").alias("rows"), F.avg("p_up").alias("raw"), *(F.avg(c).alias(c) for c in ("own", "mixed", "shrunk")), F.avg("y").alias("observed")))


@query("model_meta_label", f"{de.with_sql()}, l AS (SELECT *, avg(CAST(won AS INTEGER)) OVER (PARTITION BY symbol ORDER BY target_open ROWS BETWEEN 50 PRECEDING AND 3 PRECEDING) AS trust FROM bets) SELECT symbol, target_open, {_r('trust', 'trust')}, {_r('0.5 + (p_up - 0.5) * greatest(0.0, least(1.0, 2 * trust)) + 1e-10', 'p_meta')} FROM l WHERE trust IS NOT NULL")
def model_meta_label(spark, sf_dir):
    """A second stage that trusts the first by its own recent record, an embargo of two bets kept."""
    w = Window.partitionBy("symbol").orderBy("target_open").rowsBetween(-50, -3)
    trust = F.avg(F.when(F.col("won"), 1.0).otherwise(0.0)).over(w)
    b = de.bets(spark, sf_dir).withColumn("trust", trust).filter("trust IS NOT NULL")
    return mk.rounded(b.select("symbol", "target_open", "trust", (0.5 + (F.col("p_up") - 0.5) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * F.col("trust"))) + 1e-10).alias("p_meta")))


@query("model_event_gate", f"{mk.with_sql(mk.candles_sql())}, w AS (SELECT *, avg(volume) OVER (PARTITION BY symbol ORDER BY open_time ROWS 23 PRECEDING) AS mv FROM candles) SELECT symbol, open_time, volume > 2 * mv OR high / low > 20 OR abs(close / open - 1) > 1.5 AS event FROM w")
def model_event_gate(spark, sf_dir):
    """Any of several mechanisms marks an event."""
    w = mk.series().rowsBetween(-23, 0)
    c = _candles(spark, sf_dir).withColumn("mv", F.avg("volume").over(w))
    return c.select("symbol", "open_time", ((F.col("volume") > 2 * F.col("mv")) | (F.col("high") / F.col("low") > 20) | (F.abs(F.col("close") / F.col("open") - 1) > 1.5)).alias("event"))


_ORDER = "md5(target_open::VARCHAR || '-7'), target_open"


@query(
    "model_permutation_null",
    f"""{de.with_sql()}, k AS (SELECT symbol, p_up, outcome_up::INTEGER AS y, row_number() OVER (PARTITION BY symbol ORDER BY target_open) AS k, row_number() OVER (PARTITION BY symbol ORDER BY {_ORDER}) AS s FROM bets),
j AS (SELECT a.symbol, a.p_up AS x, a.y, b.y AS other, (0.1 + 0.8 * a.y)::DOUBLE AS leak FROM k a JOIN k b ON a.symbol = b.symbol AND a.k = b.s),
f AS (SELECT symbol, regr_slope(y, x) AS b1, regr_intercept(y, x) AS a1, regr_slope(other, x) AS b2, regr_intercept(other, x) AS a2, regr_slope(y, leak) AS b3, regr_intercept(y, leak) AS a3 FROM j GROUP BY symbol)
SELECT symbol, count(*) AS n, {_r("avg(((a1 + b1 * x >= 0.5) = (y = 1))::INT)", "true_hit")}, {_r("avg(((a2 + b2 * x >= 0.5) = (other = 1))::INT)", "null_hit")}, {_r("avg(((a3 + b3 * leak >= 0.5) = (y = 1))::INT)", "leak_hit")} FROM j JOIN f USING (symbol) GROUP BY symbol""",
)
def model_permutation_null(spark, sf_dir):
    """Hit-rates of linear fits: to the labels, to labels shuffled within the symbol by a hash, and with the label leaked into the feature."""
    w = Window.partitionBy("symbol")
    key = F.md5(F.concat(F.col("target_open").cast("string"), F.lit("-7")))
    b = de.bets(spark, sf_dir).select("symbol", F.col("p_up").alias("x"), F.col("outcome_up").cast("int").alias("y"), F.row_number().over(w.orderBy("target_open")).alias("k"), F.row_number().over(w.orderBy(key, "target_open")).alias("s"))
    j = b.join(b.select("symbol", F.col("s").alias("k"), F.col("y").alias("other")), ["symbol", "k"]).withColumn("leak", 0.1 + 0.8 * F.col("y"))
    cases = {"true_hit": ("y", "x"), "null_hit": ("other", "x"), "leak_hit": ("y", "leak")}
    fits = j.groupBy("symbol").agg(*(f(y, x).alias(f"{n}_{p}") for n, (y, x) in cases.items() for p, f in (("b", F.regr_slope), ("a", F.regr_intercept))))
    hit = lambda n, y, x: st.share((F.col(f"{n}_a") + F.col(f"{n}_b") * F.col(x) >= 0.5) == (F.col(y) == 1)).alias(n)
    return mk.rounded(j.join(fits, "symbol").groupBy("symbol").agg(F.count("*").alias("n"), *(hit(n, y, x) for n, (y, x) in cases.items())))


@query("model_permutation_importance")
def model_permutation_importance(spark, sf_dir):
    """What accuracy a fitted model loses when one feature is dealt out anew; all features in one pass over exploded copies."""
    rows, cols = _training(spark, sf_dir)
    beta = mo.logistic_fit(rows, cols, "y", l2=1.0)
    w = Window.partitionBy("symbol")
    r = rows.withColumns({"k": F.row_number().over(w.orderBy("open_time")), "s": F.row_number().over(w.orderBy(F.xxhash64("open_time", F.lit(3)), "open_time"))})
    other = r.select("symbol", F.col("s").alias("k"), *(F.col(c).alias(f"_{c}") for c in cols))
    j = r.join(other, ["symbol", "k"])
    whole = mo.linear(beta, cols)
    hit = lambda z: st.share((z >= 0) == (F.col("y") == 1))
    scored = j.agg(hit(whole).alias("base"), *(hit(whole + float(b) * (F.col(f"_{c}") - F.col(c))).alias(c) for b, c in zip(beta[1:], cols, strict=True)))
    return mk.rounded(scored.unpivot(["base"], cols, "feature", "shuffled").select("feature", (F.col("base") - F.col("shuffled")).alias("importance")))


_STAKES = (0.01, 0.02, 0.05, 0.1, 0.2)


@query(
    "model_kelly_frontier",
    f"""{de.with_sql()}, h AS (SELECT symbol, count(*) AS n, avg(won::INTEGER) AS p FROM bets GROUP BY symbol), g AS (SELECT *, unnest([{", ".join(f"{f}::DOUBLE" for f in _STAKES)}]) AS f FROM h)
SELECT symbol, n, {_r("p", "p")}, f, {_r("p * ln(1 + f * 0.98::DOUBLE) + (1 - p) * ln(1 - f)", "growth")} FROM g""",
)
def model_kelly_frontier(spark, sf_dir):
    """Expected log growth by stake at each symbol's hit-rate and a 2 % fee."""
    h = de.bets(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), st.share(F.col("won")).alias("p"))
    g = h.withColumn("f", F.explode(F.array(*map(F.lit, _STAKES))))
    return mk.rounded(g.select("symbol", "n", "p", "f", (F.col("p") * F.ln(1 + F.col("f") * 0.98) + (1 - F.col("p")) * F.ln(1 - F.col("f"))).alias("growth")))


_EMBARGO = 3
_FITTED = f"""k AS (SELECT symbol, target_open, p_up AS x, outcome_up::INTEGER AS y, row_number() OVER (PARTITION BY symbol ORDER BY target_open) - 1 AS k, count(*) OVER (PARTITION BY symbol) // 6 AS size FROM bets),
t AS (SELECT symbol, f AS fold, x, y FROM k, range(1, 6) r(f) WHERE k < f * size - {_EMBARGO}),
m AS (SELECT symbol, fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t GROUP BY ALL),
i AS (SELECT symbol, fold, avg(((a + b * x >= 0.5) = (y = 1))::INTEGER) AS hit FROM t JOIN m USING (symbol, fold) GROUP BY ALL),
o AS (SELECT k.symbol, fold, count(*) AS n, avg(((a + b * x >= 0.5) = (y = 1))::INTEGER) AS hit, avg((greatest(0, least(1, a + b * x)) - y) ** 2) AS brier FROM k JOIN m ON k.symbol = m.symbol AND k // size = fold GROUP BY ALL)"""


@query(
    "model_walkforward_fit",
    f"""{de.with_sql(_FITTED)} SELECT symbol, CAST(sum(o.n) AS BIGINT) AS n, {_r("sum(o.hit * o.n) / sum(o.n)", "hit")}, {_r("sum(brier * o.n) / sum(o.n)", "brier")}, {_r("avg(i.hit)", "in_sample")}, {_r("avg(i.hit) - avg(o.hit)", "overfit_gap")}, count(*) FILTER (WHERE o.hit > 0.5) AS above FROM o JOIN i USING (symbol, fold) GROUP BY symbol""",
)
def model_walkforward_fit(spark, sf_dir):
    """Five expanding folds, each with a linear fit of its own on the rows before it less an embargo; all folds and symbols in one aggregation."""
    w = Window.partitionBy("symbol")
    k = de.bets(spark, sf_dir).select("symbol", F.col("p_up").alias("x"), F.col("outcome_up").cast("int").alias("y"), (F.row_number().over(w.orderBy("target_open")) - 1).alias("k"), F.floor(F.count("*").over(w) / 6).alias("size"))
    t = k.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(5)))).filter(F.col("k") < F.col("fold") * F.col("size") - _EMBARGO)
    m = t.groupBy("symbol", "fold").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    p = F.col("a") + F.col("b") * F.col("x")
    hit = st.share((p >= 0.5) == (F.col("y") == 1))
    i = t.join(m, ["symbol", "fold"]).groupBy("symbol", "fold").agg(hit.alias("own"))
    o = k.withColumn("fold", F.floor(F.col("k") / F.col("size")).cast("int")).join(m, ["symbol", "fold"]).groupBy("symbol", "fold").agg(F.count("*").alias("n"), hit.alias("hit"), F.avg(F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)) - F.col("y"), 2)).alias("brier"))
    g = o.join(i, ["symbol", "fold"]).groupBy("symbol").agg(F.sum("n").alias("n"), (F.sum(F.col("hit") * F.col("n")) / F.sum("n")).alias("hit"), (F.sum(F.col("brier") * F.col("n")) / F.sum("n")).alias("brier"), F.avg("own").alias("in_sample"), (F.avg("own") - F.avg("hit")).alias("overfit_gap"), F.count_if(F.col("hit") > 0.5).alias("above"))
    return mk.rounded(g)


_DAY = 86_400_000
_PINS = f"""r AS (SELECT min(target_open) + 10 * {_DAY} AS base FROM bets), v AS (SELECT n AS win, base + n * 4 * {_DAY} AS start, base + (n + 1) * 4 * {_DAY} AS stop FROM r, range(0, 4) t(n)),
tr AS (SELECT win, symbol, p_up AS x, outcome_up::INTEGER AS y FROM bets JOIN v ON target_open < start - 6 * {_H}),
m AS (SELECT win, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM tr GROUP BY win),
te AS (SELECT v.win, symbol, target_open, a + b * p_up AS p, outcome_up::INTEGER AS y, row_number() OVER (PARTITION BY v.win ORDER BY round(abs(a + b * p_up - 0.5), 9) DESC, round(abs(p_up - 0.5), 9) DESC, target_open, symbol) AS rank, count(*) OVER (PARTITION BY v.win) AS n FROM bets JOIN v ON target_open >= start AND target_open < stop JOIN m ON m.win = v.win)"""


@query("model_pinned_windows", f"{de.with_sql(_PINS)} SELECT CAST(win AS INTEGER) AS win, max(n) AS n, count(*) AS taken, {_r('avg(((p >= 0.5) = (y = 1))::INTEGER)', 'hit')} FROM te WHERE rank <= ceil(0.1 * n) GROUP BY win")
def model_pinned_windows(spark, sf_dir):
    """Four windows of fixed bounds: in each a fit on all that lies six hours before it or more, judged on the surest tenth of the window, exactly; raw confidence and time break ties."""
    b = de.bets(spark, sf_dir).select("symbol", "target_open", F.col("p_up").alias("x"), F.col("outcome_up").cast("int").alias("y"))
    base = (b.agg(F.min("target_open")).first()[0] or 0) + 10 * _DAY
    pins = spark.createDataFrame([(k, base + k * 4 * _DAY, base + (k + 1) * 4 * _DAY) for k in range(4)], "win int, start long, stop long")
    m = b.join(F.broadcast(pins), F.col("target_open") < F.col("start") - 6 * _H).groupBy("win").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))  # four windows
    te = b.join(F.broadcast(pins), (F.col("target_open") >= F.col("start")) & (F.col("target_open") < F.col("stop"))).join(F.broadcast(m), "win").withColumn("p", F.col("a") + F.col("b") * F.col("x"))
    w = Window.partitionBy("win")
    sure = w.orderBy(F.round(F.abs(F.col("p") - 0.5), 9).desc(), F.round(F.abs(F.col("x") - 0.5), 9).desc(), "target_open", "symbol")
    te = te.withColumns({"rank": F.row_number().over(sure), "n": F.count("*").over(w)}).filter(F.col("rank") <= F.ceil(F.col("n") * 0.1))
    return mk.rounded(te.groupBy("win").agg(F.max("n").alias("n"), F.count("*").alias("taken"), st.share((F.col("p") >= 0.5) == (F.col("y") == 1)).alias("hit")))


@query(
    "model_meta_fit",
    f"""{de.with_sql()}, h AS (SELECT *, abs(p_up - 0.5) AS conf, won::INTEGER AS y, target_open < (min(target_open) OVER (PARTITION BY symbol) + max(target_open) OVER (PARTITION BY symbol)) // 2 AS early FROM bets),
m AS (SELECT symbol, regr_slope(y, conf) AS b, regr_intercept(y, conf) AS a FROM h WHERE early GROUP BY symbol), s AS (SELECT h.symbol, target_open, p_up, greatest(0.0, least(1.0, a + b * conf)) AS q FROM h JOIN m ON h.symbol = m.symbol WHERE NOT early)
SELECT symbol, target_open, {_r("q", "p_correct")}, {_r("CASE WHEN p_up >= 0.5 THEN q ELSE 1 - q END", "p_meta")} FROM s""",
)
def model_meta_fit(spark, sf_dir):
    """A second stage: how likely the first is right, a linear fit of its hits on its confidence in the earlier half of the time, for the later half."""
    w = Window.partitionBy("symbol")
    half = F.floor((F.min("target_open").over(w) + F.max("target_open").over(w)) / 2)
    h = de.bets(spark, sf_dir).withColumns({"conf": F.abs(F.col("p_up") - 0.5), "hit": F.col("won").cast("int"), "early": F.col("target_open") < half})
    m = h.filter("early").groupBy("symbol").agg(F.regr_slope("hit", "conf").alias("b"), F.regr_intercept("hit", "conf").alias("a"))
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("a") + F.col("b") * F.col("conf")))
    s = h.filter("NOT early").join(m, "symbol").withColumn("p_correct", q)
    return mk.rounded(s.select("symbol", "target_open", "p_correct", F.when(F.col("p_up") >= 0.5, F.col("p_correct")).otherwise(1 - F.col("p_correct")).alias("p_meta")))


@query(
    "label_volatility_weights",
    f"""{mk.with_sql(mk.candles_sql())}, v AS (SELECT symbol, open_time, close, avg(close) OVER w AS m, stddev_samp(close) OVER w AS sd, count(*) OVER w AS n FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS 11 PRECEDING)),
u AS (SELECT symbol, open_time, CASE WHEN close < m THEN 2.0 ELSE 1.0 END / sd AS w FROM v WHERE n = 12 AND sd > 0) SELECT symbol, open_time, {_r("w / avg(w) OVER (PARTITION BY symbol)", "weight")} FROM u""",
)
def label_volatility_weights(spark, sf_dir):
    """Weights by calm, twice for rows under their mean, one on average in a symbol; averages are one row a symbol."""
    w = mk.series().rowsBetween(-11, 0)
    c = _candles(spark, sf_dir).withColumns({"m": F.avg("close").over(w), "sd": F.stddev_samp("close").over(w), "k": F.count("*").over(w)}).filter("k = 12 AND sd > 0")
    u = c.select("symbol", "open_time", (F.when(F.col("close") < F.col("m"), 2.0).otherwise(1.0) / F.col("sd")).alias("w"))
    mean = u.groupBy("symbol").agg(F.avg("w").alias("mean"))
    return mk.rounded(u.join(mean, "symbol").select("symbol", "open_time", (F.col("w") / F.col("mean")).alias("weight")))


_GAIN = {"body": "close - open", "range": "high - low", "volume": "volume", "trades": "trades::DOUBLE"}
_GAIN_SQL = " UNION ALL ".join(f"SELECT '{n}' AS feature, ({e})::DOUBLE AS x, y FROM t" for n, e in _GAIN.items())


@query(
    "model_gain_ranking",
    f"""{mk.with_sql(mk.candles_sql())}, t AS (SELECT *, CAST(lead(close) OVER (PARTITION BY symbol ORDER BY open_time) > close AS INTEGER) AS y FROM candles QUALIFY y IS NOT NULL), l AS ({_GAIN_SQL}),
c AS (SELECT feature, quantile_cont(x, 0.5) AS cut, avg(y) AS base, count(*) AS n FROM l GROUP BY feature), s AS (SELECT l.feature, x <= cut AS low, base, n, avg(y) AS m, count(*) AS k FROM l JOIN c ON l.feature = c.feature GROUP BY ALL)
SELECT feature, {_r("sum(k * (m - base) * (m - base)) / any_value(n)", "gain", 9)} FROM s GROUP BY feature""",
)
def model_gain_ranking(spark, sf_dir):
    """What a split of each feature at its median takes off the label's variance."""
    t = _candles(spark, sf_dir).withColumn("y", (F.lead("close").over(mk.series()) > F.col("close")).cast("int")).filter("y IS NOT NULL")
    t = t.select("y", (F.col("close") - F.col("open")).alias("body"), (F.col("high") - F.col("low")).alias("range"), "volume", F.col("trades").cast("double").alias("trades"))
    l = t.unpivot(["y"], list(_GAIN), "feature", "x")
    c = l.groupBy("feature").agg(F.percentile("x", 0.5).alias("cut"), F.avg("y").alias("base"), F.count("*").alias("n"))
    s = l.join(F.broadcast(c), "feature").groupBy("feature", (F.col("x") <= F.col("cut")).alias("low")).agg(F.avg("y").alias("m"), F.count("*").alias("k"), F.first("base").alias("base"), F.first("n").alias("n"))  # a row a feature
    gain = F.sum(F.col("k") * F.pow(F.col("m") - F.col("base"), 2)) / F.first("n")
    return mk.rounded(s.groupBy("feature").agg(gain.alias("gain")), 9)
