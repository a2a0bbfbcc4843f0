"""Pinned windows judged in one plan, and lag matrices with their controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog import query
from tidemill.functions import stats as st
from tidemill.plans import harness as ha
from tidemill.plans import sequences as sq
from tidemill.queries.models import _r
from tidemill.sources import decisions as de
from tidemill.sources import market as mk
from tidemill.streaming.run import folder

_DAY = 24 * mk.HOUR
#: Windows of a day and a half from the tenth day on; hours between training, calibration and window; training rows of a window at least.
_WINDOWS, _FROM, _WIDTH, _EMBARGO, _LEAST = 12, 10 * _DAY, 36 * mk.HOUR, 6 * mk.HOUR, 100


def _rows(spark, sf_dir):
    """Bets, and their score as a whole number, which prints alike everywhere."""
    b = de.bets(spark, sf_dir).select("symbol", F.col("target_open").alias("at"), F.col("p_up").alias("x"), F.col("outcome_up").cast("int").alias("y"))
    return b.withColumn("points", F.round(F.col("x") * 100_000).cast("long"))


_DIGEST = ("symbol", "at", "points", "y")


def _judged(spark, sf_dir):
    path = folder(spark, "frozen")
    ha.frozen(_rows(spark, sf_dir), path, *_DIGEST)
    rows = ha.frozen(_rows(spark, sf_dir), path, *_DIGEST)
    base = (rows.agg(F.min("at")).first()[0] or 0) + _FROM
    pins = spark.createDataFrame([(k, base + k * _WIDTH, base + (k + 1) * _WIDTH) for k in range(_WINDOWS)], "win int, start long, stop long")
    return ha.judge(rows, pins, ha.line_model("x"), _EMBARGO, _LEAST)


_LIMITS = ", ".join(f"round(quantile_cont(s, {1 - c!r}::DOUBLE), 12) AS l{i}" for i, c in enumerate(ha.COVERAGES))
_EACH = " UNION ALL ".join(f"SELECT win, {c!r}::DOUBLE AS coverage, count(*) AS n_test, count(*) FILTER (WHERE s >= l{i}) AS n, count(*) FILTER (WHERE s >= l{i} AND up) AS won FROM te JOIN lim USING (win) GROUP BY win" for i, c in enumerate(ha.COVERAGES))
_HARNESS = f"""base AS (SELECT min(target_open) + {_FROM} AS base FROM bets), pin AS (SELECT CAST(k AS INTEGER) AS win, base + k * {_WIDTH} AS start, base + (k + 1) * {_WIDTH} AS stop FROM base, range(0, {_WINDOWS}) t(k)),
past AS (SELECT win, target_open AS t0, p_up AS x, outcome_up::INTEGER AS y FROM bets JOIN pin ON target_open < start - {_EMBARGO}),
cuts AS (SELECT win, CAST(round(quantile_cont(t0::DOUBLE, 0.9)) AS BIGINT) AS cut FROM past GROUP BY win HAVING count(*) >= {_LEAST}),
mo AS (SELECT win, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM past JOIN cuts USING (win) WHERE t0 < cut GROUP BY win),
ca AS (SELECT win, round(greatest(0.0, least(1.0, a + b * x)), 4) AS p, y FROM past JOIN cuts USING (win) JOIN mo USING (win) WHERE t0 >= cut + {_EMBARGO}),
tj AS (SELECT win, round(greatest(0.0, least(1.0, a + b * p_up)), 4) AS p, outcome_up::INTEGER AS y FROM bets JOIN pin ON target_open >= start AND target_open < stop JOIN mo USING (win)),
ps AS (SELECT win, p AS x, count(*) AS n, sum(y) AS y FROM ca GROUP BY ALL),
pc AS (SELECT win, x, row_number() OVER w AS i, sum(n) OVER w AS n, sum(y) OVER w AS y FROM ps WINDOW w AS (PARTITION BY win ORDER BY x)),
pm AS (SELECT a.win, a.i AS j, b.i AS i, (b.y - coalesce(z.y, 0)) / (b.n - coalesce(z.n, 0))::DOUBLE AS mean FROM pc a JOIN pc b ON a.win = b.win AND a.i <= b.i LEFT JOIN pc z ON z.win = a.win AND z.i = a.i - 1),
pl AS (SELECT win, j, i, min(mean) OVER (PARTITION BY win, j ORDER BY i DESC) AS low FROM pm), pf AS (SELECT win, i, max(low) AS y FROM pl GROUP BY win, i),
pg AS (SELECT pf.win, list(pc.x ORDER BY pc.x) AS xs, list(pf.y ORDER BY pc.x) AS ys FROM pf JOIN pc ON pc.win = pf.win AND pc.i = pf.i GROUP BY pf.win),
un AS (SELECT win, p, y, true AS judged FROM tj UNION ALL SELECT win, p, y, false FROM ca),
ui AS (SELECT un.*, xs, ys, len(list_filter(xs, lambda q: q <= p)) AS i FROM un JOIN pg USING (win)),
uc AS (SELECT win, y, judged, p, CASE WHEN i = 0 THEN ys[1] WHEN i = len(xs) THEN ys[i] ELSE ys[i] + (p - xs[i]) / (xs[i + 1] - xs[i]) * (ys[i + 1] - ys[i]) END AS c FROM ui),
us AS (SELECT win, judged, (c > 0.5) = (y = 1) AS up, round(abs(c - 0.5) + {ha.TIES!r} * abs(p - 0.5), 12) AS s FROM uc),
lim AS (SELECT win, {_LIMITS} FROM us WHERE NOT judged GROUP BY win), te AS (SELECT win, up, s FROM us WHERE judged), each AS ({_EACH})"""


@query("model_dataset_fingerprint", f"{de.with_sql()}, h AS (SELECT md5(symbol || '|' || target_open || '|' || CAST(round(p_up * 100000) AS BIGINT) || '|' || outcome_up::INTEGER) AS h FROM bets) SELECT count(*) || ':' || coalesce(sum(('0x' || h[1:15])::BIGINT), 0) || ':' || coalesce(sum(('0x' || h[16:30])::BIGINT), 0) AS digest FROM h")
def model_dataset_fingerprint(spark, sf_dir):
    """The digest that guards the frozen rows."""
    return spark.createDataFrame([(ha.fingerprint(_rows(spark, sf_dir), *_DIGEST),)], "digest string")


@query("model_harness", f"{de.with_sql(_HARNESS)} SELECT win, coverage, n_test, n, won, {_r('won / nullif(n, 0)', 'hit')}, {_r('n / n_test', 'real_coverage')} FROM each")
def model_harness(spark, sf_dir):
    """Twelve pinned windows: a fit, its calibration and the surest rows at five coverages, with embargoes between; the rows are frozen and looked at again before."""
    return mk.rounded(ha.by_window(_judged(spark, sf_dir)))


_LOWS = [st.wilson_sql("won", "nullif(n, 0)", z)[0] for z in ha.bounds(0)]


@query(
    "model_harness_pooled",
    f"""{de.with_sql(_HARNESS)}, g AS (SELECT coverage, CAST(sum(n) AS BIGINT) AS n, CAST(sum(won) AS BIGINT) AS won, count(*) AS windows, count(*) FILTER (WHERE n >= {ha.LEAST_WINDOW}) AS windows_enough, count(*) FILTER (WHERE n >= {ha.LEAST_WINDOW} AND won / n > 0.5) AS windows_above FROM each GROUP BY coverage)
SELECT coverage, n, {_r("won / nullif(n, 0)", "hit")}, {_r(_LOWS[0], "low")}, {_r(_LOWS[1], "low_deflated")}, windows_enough, windows_above, n >= {ha.LEAST_POOLED} AND windows_enough = windows AS enough, {_r(f"2 * won / nullif(n, 0) - 1 - {ha.FEE}", "value")} FROM g""",
)
def model_harness_pooled(spark, sf_dir):
    """All windows together by coverage: hit-rate, lower bound plain and deflated for the trials, windows that hold, value after the fee."""
    return mk.rounded(ha.pooled(ha.by_window(_judged(spark, sf_dir))))


_LAGS = 10


def _lags(spark, sf_dir):
    """Growth, body, range and volume of the last ten hourly bars, the sign of the next, and the controls; written once, as each step of a fit reads them."""
    c = mk.candles(mk.trades(spark, sf_dir))
    ratio = lambda a, b: F.ln(F.col(a) / F.col(b))
    c = c.withColumns({"before": F.lag("close").over(mk.series()), "up": (F.lead("close").over(mk.series()) > F.col("close")).cast("int")})
    c = c.withColumns({"growth": ratio("close", "before"), "body": ratio("close", "open"), "range": ratio("high", "low")})
    rows, x = sq.lagged(c, "symbol", "open_time", ["growth", "body", "range", "volume"], _LAGS)
    rows = sq.controls(rows.filter("up IS NOT NULL"), ["symbol", "open_time"], "growth_lag0", "growth_lag1")
    path = folder(spark, "lags")
    rows.select("symbol", "open_time", *x, "up", "noise", "planted").write.parquet(path)
    return spark.read.parquet(path), x


@query("model_sequence")
def model_sequence(spark, sf_dir):
    """A perceptron on forty lags over two expanding splits: the sign of the next bar, labels that are noise, and labels with a planted signal."""
    rows, x = _lags(spark, sf_dir)
    found = []
    for y in ("up", "noise", "planted"):
        said = sq.walk(rows, "open_time", x, y, 2, (_LAGS + 2) * mk.HOUR)
        got = sq.judged(said, y)
        found.append((y, got["n"], *(None if got[k] is None else round(got[k], 2) for k in ("accuracy", "auc", "surest"))))
    return spark.createDataFrame(found, "label string, n long, accuracy double, auc double, surest double")


_LAG_SQL = ", ".join(f"lag(growth, {j}) OVER w AS g{j}" for j in range(_LAGS))


@query(
    "model_lag_matrix",
    f"""{mk.with_sql(mk.candles_sql())}, c AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY open_time)) AS growth, lead(close) OVER (PARTITION BY symbol ORDER BY open_time) > close AS up FROM candles),
m AS (SELECT symbol, open_time, up, {_LAG_SQL} FROM c WINDOW w AS (PARTITION BY symbol ORDER BY open_time))
SELECT symbol, open_time, up::INTEGER AS up, {", ".join(_r(f"g{j}", f"growth_lag{j}") for j in range(_LAGS))} FROM m WHERE up IS NOT NULL AND g{_LAGS - 1} IS NOT NULL""",
)
def model_lag_matrix(spark, sf_dir):
    """The matrix that the sequence model reads, its lags of growth."""
    rows, x = _lags(spark, sf_dir)
    return mk.rounded(rows.select("symbol", "open_time", "up", *(c for c in x if c.startswith("growth"))))
