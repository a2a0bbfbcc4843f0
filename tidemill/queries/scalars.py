"""Row-wise functions: sizing, orders, alignment, strings, JSON and hashes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.catalog import query
from tidemill.functions import sizing as sz
from tidemill.functions import strings as ss
from tidemill.sources import decisions as de
from tidemill.sources import market as mk


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_Q = "SELECT o_orderkey, (o_orderkey % 101) / 100.0::DOUBLE AS q, 0.02::DOUBLE + 0.96::DOUBLE * (o_orderkey % 97) / 97 AS yes, 1 - (0.02::DOUBLE + 0.96::DOUBLE * (o_orderkey % 97) / 97) AS no, o_totalprice AS usd FROM orders WHERE o_totalprice >= 0"


def _markets(spark, sf_dir):
    yes = 0.02 + 0.96 * (F.col("o_orderkey") % 97) / 97
    return _t(spark, sf_dir, "orders").filter("o_totalprice >= 0").select("o_orderkey", (F.col("o_orderkey") % 101 / 100.0).alias("q"), yes.alias("yes"), (1 - yes).alias("no"), F.col("o_totalprice").alias("usd"))


@query(
    "scalar_kelly_sizer",
    f"""WITH m AS ({_Q}), e AS (SELECT *, q - yes AS ye, (1 - q) - no AS ne FROM m), s AS (SELECT *, CASE WHEN ye >= ne AND ye > 0 THEN 'Yes' WHEN ne > 0 THEN 'No' END AS side FROM e),
p AS (SELECT *, CASE WHEN side = 'Yes' THEN yes ELSE no END AS price, CASE WHEN side = 'Yes' THEN q ELSE 1 - q END AS win FROM s),
k AS (SELECT *, round(greatest(0.0, least(1.0, (win - price) / (1 - price) * 0.25)) * usd + 1e-9, 2) AS stake FROM p), h AS (SELECT *, floor(stake / price * 10000 + 1e-7) / 10000 AS shares FROM k)
SELECT o_orderkey, side IS NOT NULL AND stake > 0 AND shares > 0 AS trade, coalesce(side, 'Yes') AS side, CASE WHEN side IS NOT NULL AND stake > 0 AND shares > 0 THEN stake ELSE 0.0 END AS stake,
  CASE WHEN side IS NOT NULL AND stake > 0 AND shares > 0 THEN shares ELSE 0.0 END AS shares, round(CASE WHEN side IS NULL THEN greatest(ye, ne) WHEN side = 'Yes' THEN ye ELSE ne END, 6) + 0.0 AS edge FROM h""",
)
def scalar_kelly_sizer(spark, sf_dir):
    m = _markets(spark, sf_dir)
    out = m.withColumn("k", sz.kelly_sizer(F.col("q"), F.col("yes"), F.col("no"), F.col("usd"), 0.25))
    return out.select("o_orderkey", "k.trade", "k.side", "k.stake", "k.shares", (F.round("k.edge", 6) + 0.0).alias("edge"))


@query("scalar_ev_gate", f"WITH m AS ({_Q}) SELECT o_orderkey, q > yes + 0.02 AND yes > 0 AND yes < 1 AS bet_yes, abs(q - 0.5) * 2 < 0.04 AS no_bet, round(greatest(0.02, least(0.98, 0.5 + (q - 0.5) * 0.8)), 6) + 0.0 AS synthetic, CASE WHEN q >= 0.5 THEN 'UP' ELSE 'DOWN' END AS side FROM m")
def scalar_ev_gate(spark, sf_dir):
    m = _markets(spark, sf_dir)
    return mk.rounded(m.select("o_orderkey", sz.has_edge(F.col("q"), F.col("yes"), 0.02).alias("bet_yes"), sz.no_bet(F.col("q")).alias("no_bet"), sz.synthetic_price(F.col("q")).alias("synthetic"), de.side(F.col("q")).alias("side")))


@query(
    "scalar_order_math",
    """WITH m AS (SELECT l_orderkey, l_linenumber, CAST(l_discount AS DECIMAL(9,4)) + 0.4570 AS price, CAST(l_quantity AS DECIMAL(9,2)) AS size FROM lineitem), t AS (SELECT *, CAST(floor(price / 0.01) AS BIGINT) * 0.01 AS tp FROM m)
SELECT l_orderkey, l_linenumber, CAST(floor(tp * size * 1000000) AS BIGINT) AS maker, CAST(floor(size * 1000000) AS BIGINT) AS taker, CAST(tp AS DOUBLE) AS price FROM t WHERE size >= 5""",
)
def scalar_order_math(spark, sf_dir):
    """Order amounts at tick 0.01 and least size 5; rejected orders drop out."""
    dec = lambda v, p, s: F.lit(v).cast(f"decimal({p},{s})")
    li = _t(spark, sf_dir, "lineitem")
    a = sz.order_amounts(F.col("l_discount").cast("decimal(9,4)") + dec("0.4570", 9, 4), F.col("l_quantity").cast("decimal(9,2)"), dec("0.01", 9, 4), dec("5", 9, 2))
    return li.select("l_orderkey", "l_linenumber", a.alias("a")).filter("a IS NOT NULL").select("l_orderkey", "l_linenumber", "a.maker", "a.taker", "a.price")


@query(
    "scalar_alignment",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR trim(CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderpriority END) = '' THEN 'Mismatch' WHEN o_orderkey % 7 = 0 THEN 'Tolerated' WHEN lower(o_orderpriority) = '1-urgent' THEN 'Exact' ELSE 'Tolerated' END AS verdict FROM orders""",
)
def scalar_alignment(spark, sf_dir):
    k = F.col("o_orderkey")
    source = F.when(k % 5 == 0, " ").otherwise(F.col("o_orderpriority"))
    expected = F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise("1-urgent")
    return _t(spark, sf_dir, "orders").select("o_orderkey", sz.alignment(k % 3 != 0, source, expected).alias("verdict"))


@query(
    "scalar_risk_metrics",
    """WITH m AS (SELECT c_custkey, (c_custkey % 101) / 100.0::DOUBLE AS p, abs(c_acctbal) + 1 AS bankroll, 10.0::DOUBLE AS bet FROM customer), r AS (SELECT *, CAST(floor(bankroll / bet) AS BIGINT) AS lives FROM m),
k AS (SELECT *, CASE WHEN p <= 0.5 + 1e-9 OR lives <= 0 THEN 1.0 ELSE pow((1 - p) / p, lives) END AS pr FROM r)
SELECT c_custkey, lives, round(2 * p - 1, 6) + 0.0 AS edge, round(pr, 6) + 0.0 AS p_ruin, round(CASE WHEN p > 0.5 + 1e-9 AND p < 1 THEN bankroll / ceil(ln(0.01::DOUBLE) / ln((1 - p) / p)) END, 4) + 0.0 AS safe_bet,
  CASE WHEN p <= 0.5 + 1e-9 THEN 'No edge' WHEN pr < 0.01 THEN 'Safe' WHEN pr < 0.05 THEN 'Aggressive' WHEN pr < 0.2 THEN 'Risky' ELSE 'Gambling' END AS verdict FROM k""",
)
def scalar_risk_metrics(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 101 / 100.0).alias("p"), (F.abs("c_acctbal") + 1).alias("bankroll"))
    r = c.withColumn("r", sz.ruin(F.col("p"), F.col("bankroll"), F.lit(10.0)))
    return r.select("c_custkey", "r.lives", (F.round("r.edge", 6) + 0.0).alias("edge"), (F.round("r.p_ruin", 6) + 0.0).alias("p_ruin"), (F.round("r.safe_bet", 4) + 0.0).alias("safe_bet"), "r.verdict")


_STOP = ", ".join(f"'{w}'" for w in ss.STOP_WORDS)
_TOK = f"list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({_STOP}))"


@query("scalar_search_tokens", f"SELECT p_partkey, array_to_string(list_sort(list_distinct({_TOK})), ' ') AS tokens, list_has_all({_TOK}, ['part']) AS hit FROM part")
def scalar_search_tokens(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(F.array_sort(ss.tokens(F.col("p_name"))), " ").alias("tokens"), ss.matches(F.col("p_name"), F.lit("the part")).alias("hit"))


@query("scalar_synonyms", "SELECT i, trim(regexp_replace(regexp_replace(regexp_replace(t, '(?i)\\bbtc\\b', 'bitcoin', 'g'), '(?i)\\beth\\b', 'ethereum', 'g'), '(?i)\\bfed\\b', 'federal reserve', 'g')) AS expanded FROM (SELECT p_partkey AS i, CASE p_partkey % 3 WHEN 0 THEN 'BTC above ' WHEN 1 THEN 'methane ' ELSE 'Will the Fed ' END || p_name AS t FROM part)")
def scalar_synonyms(spark, sf_dir):
    lead = F.when(F.col("p_partkey") % 3 == 0, "BTC above ").when(F.col("p_partkey") % 3 == 1, "methane ").otherwise("Will the Fed ")
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.trim(ss.expanded(F.concat(lead, "p_name"))).alias("expanded"))


@query("scalar_slugify", "SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM supplier")
def scalar_slugify(spark, sf_dir):
    return _t(spark, sf_dir, "supplier").select("s_suppkey", ss.slug(F.col("s_name")).alias("slug"))


@query("scalar_describe", "SELECT c_custkey, CASE WHEN length(c_name) <= 12 THEN c_name ELSE rtrim(regexp_replace(left(c_name, 11), '\\s\\S*$', '')) || '…' END AS short, regexp_extract(c_name || '. Rest! More', '^((?s:.)*?[.!?])(\\s|$)', 1) AS first FROM customer")
def scalar_describe(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", ss.clamped(F.col("c_name"), 12).alias("short"), ss.first_sentence(F.concat("c_name", F.lit(". Rest! More"))).alias("first"))


@query("scalar_json_prices", """WITH e AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'bad' ELSE '["' || (event_id % 10) / 10.0 || '","' || (1 - (event_id % 10) / 10.0) || '"]' END AS j FROM events)
SELECT event_id, CASE WHEN j = 'bad' THEN 0.5 ELSE (event_id % 10) / 10.0::DOUBLE END AS yes, CASE WHEN j = 'bad' THEN 0.5 ELSE round(1 - (event_id % 10) / 10.0::DOUBLE, 6) END AS no FROM e""")
def scalar_json_prices(spark, sf_dir):
    """Prices from a JSON list of strings, half and half where it can't be read."""
    k = F.col("event_id") % 10
    js = F.when(F.col("event_id") % 4 == 0, "bad").otherwise(F.to_json(F.array((k / 10.0).cast("string"), F.round(1 - k / 10.0, 6).cast("string"))))
    e = _t(spark, sf_dir, "events").select("event_id", F.from_json(js, "array<string>").alias("p"))
    price = lambda i: F.coalesce(F.try_element_at("p", F.lit(i)).try_cast("double"), F.lit(0.5))
    return e.select("event_id", price(1).alias("yes"), price(2).alias("no"))


@query("scalar_json_pick", """SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events""")
def scalar_json_pick(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k"))


@query("scalar_config_hash", "SELECT s_suppkey, sha256(s_suppkey || '|' || s_nationkey || '|' || printf('%.6f', s_acctbal)) AS hash FROM supplier")
def scalar_config_hash(spark, sf_dir):
    """SHA-256 of a settings row, so that equal settings are found again."""
    s = _t(spark, sf_dir, "supplier")
    return s.select("s_suppkey", F.sha2(F.concat_ws("|", F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"), F.format_string("%.6f", "s_acctbal")), 256).alias("hash"))


@query("scalar_math", "SELECT c_custkey, round(c_acctbal, 1) + 0.0 AS away, trunc(c_acctbal) AS to_zero, floor(c_acctbal) AS down, sign(c_acctbal)::DOUBLE AS sg, round(ln(abs(c_acctbal) + 1), 6) AS ln1, round(log2(abs(c_acctbal) + 2), 6) AS lg2, greatest(-100.0::DOUBLE, least(100.0::DOUBLE, c_acctbal)) AS clip FROM customer")
def scalar_math(spark, sf_dir):
    b = F.col("c_acctbal")
    out = _t(spark, sf_dir, "customer").select("c_custkey", F.round(b, 1).alias("away"), (F.signum(b) * F.floor(F.abs(b))).alias("to_zero"), F.floor(b).cast("double").alias("down"), F.signum(b).alias("sg"), F.round(F.log1p(F.abs(b)), 6).alias("ln1"), F.round(F.log2(F.abs(b) + 2), 6).alias("lg2"), F.greatest(F.lit(-100.0), F.least(F.lit(100.0), b)).alias("clip"))
    return mk.rounded(out)


_LIM = "SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01'"


@query("scalar_winsorize", f"WITH q AS ({_LIM}), w AS (SELECT l_orderkey, l_linenumber, l_shipdate, greatest(lo, least(hi, l_extendedprice)) AS x FROM lineitem, q), s AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM w WHERE l_shipdate < TIMESTAMP '1995-01-01') SELECT l_orderkey, l_linenumber, round((x - m) / sd, 6) + 0.0 AS z FROM w, s")
def scalar_winsorize(spark, sf_dir):
    """Clipped at percentiles of the training part, then standardised by it; both sides of the joins are one row."""
    li = _t(spark, sf_dir, "lineitem")
    train = F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz")
    q = li.filter(train).agg(F.percentile("l_extendedprice", 0.01).alias("lo"), F.percentile("l_extendedprice", 0.99).alias("hi"))
    w = li.join(F.broadcast(q)).withColumn("x", F.greatest("lo", F.least("hi", "l_extendedprice")))
    s = w.filter(train).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    return mk.rounded(w.join(F.broadcast(s)).select("l_orderkey", "l_linenumber", ((F.col("x") - F.col("m")) / F.col("sd")).alias("z")))


@query("scalar_text_card", "SELECT n_nationkey, rpad(n_name, CAST((SELECT max(length(n_name)) FROM nation) AS INTEGER), ' ') || ' ' || printf('%+.2f', n_nationkey * 1.5::DOUBLE) AS card FROM nation")
def scalar_text_card(spark, sf_dir):
    """Fixed-width lines, padded to the longest name."""
    n = _t(spark, sf_dir, "nation")
    wide = n.agg(F.max(F.char_length("n_name")).alias("wide"))
    return n.join(F.broadcast(wide)).select("n_nationkey", F.concat(F.expr("rpad(n_name, wide, ' ')"), F.lit(" "), F.format_string("%+.2f", F.col("n_nationkey") * 1.5)).alias("card"))


@query("scalar_category", "SELECT p_partkey, CASE WHEN list_contains(t, 'STEEL') THEN 'STEEL' WHEN list_contains(t, 'BRASS') THEN 'BRASS' ELSE list_filter(t, lambda x: x NOT IN ('LARGE', 'SMALL'))[1] END AS category FROM (SELECT p_partkey, string_split(upper(p_type), ' ') AS t FROM part)")
def scalar_category(spark, sf_dir):
    """The first of the preferred tags that a row has, else its first tag that says something."""
    t = F.split(F.upper("p_type"), " ")
    want = F.array(F.lit("STEEL"), F.lit("BRASS"))
    hit = F.try_element_at(F.filter(want, lambda w: F.array_contains(t, w)), F.lit(1))
    return _t(spark, sf_dir, "part").select("p_partkey", F.coalesce(hit, F.try_element_at(F.filter(t, lambda x: ~x.isin("LARGE", "SMALL")), F.lit(1))).alias("category"))


@query("scalar_quoted_range", f"{de.with_sql()}, b AS (SELECT symbol, target_open, target_close, target_close - close AS delta, max(target_close) OVER w AS hi, min(target_close) OVER w AS lo FROM decisions WINDOW w AS (PARTITION BY symbol ORDER BY target_open ROWS 23 PRECEDING)) SELECT symbol, target_open, round(delta, 6) + 0.0 AS delta, round(hi + (hi - lo) * 0.05, 6) + 0.0 AS top, round(lo - (hi - lo) * 0.05, 6) + 0.0 AS bottom FROM b")
def scalar_quoted_range(spark, sf_dir):
    """Change a point, and the padded range of what is in view."""
    w = Window.partitionBy("symbol").orderBy("target_open").rowsBetween(-23, 0)
    hi, lo = F.max("target_close").over(w), F.min("target_close").over(w)
    return mk.rounded(de.decisions(spark, sf_dir).select("symbol", "target_open", (F.col("target_close") - F.col("close")).alias("delta"), (hi + (hi - lo) * 0.05).alias("top"), (lo - (hi - lo) * 0.05).alias("bottom")))


@query("sort_nulls_last", "SELECT c_custkey, o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, c_custkey) AS pos FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' AND o_totalprice > 100000 ORDER BY pos LIMIT 100")
def sort_nulls_last(spark, sf_dir):
    """The top of a list in which missing values sort last."""
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders").filter("o_orderstatus = 'P' AND o_totalprice > 100000")
    top = c.join(o, c["c_custkey"] == o["o_custkey"], "left").orderBy(F.desc_nulls_last("o_totalprice"), "c_custkey").limit(100)
    return top.select("c_custkey", "o_orderkey", F.row_number().over(Window.orderBy(F.desc_nulls_last("o_totalprice"), "c_custkey")).cast("long").alias("pos"))


@query("page_skip_take", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_skip_take(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)


@query("set_difference", "SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_difference(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).subtract(_t(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("set_intersection", "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(spark, sf_dir):
    return _t(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("nation")).intersect(_t(spark, sf_dir, "supplier").select("s_nationkey"))


@query(
    "sort_grouped",
    """WITH r AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS v FROM part), g AS (SELECT *, min(p_partkey) OVER (PARTITION BY p_brand) AS first FROM r)
SELECT p_partkey, p_brand, v, row_number() OVER (ORDER BY first, v ASC NULLS LAST, p_partkey) AS up, row_number() OVER (ORDER BY first, v DESC NULLS LAST, p_partkey) AS down FROM g ORDER BY up LIMIT 50""",
)
def sort_grouped(spark, sf_dir):
    """The first page of rows sorted within groups, which keep the order of their first appearance; nulls sink either way."""
    v = F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", v.alias("v"))
    groups = p.groupBy("p_brand").agg(F.min("p_partkey").alias("first"), F.count("*").alias("n"))
    before = groups.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # one row a group
    w = Window.partitionBy("p_brand")
    place = lambda order: F.col("before") + F.row_number().over(w.orderBy(order, "p_partkey"))
    q = p.join(before, "p_brand").select("p_partkey", "p_brand", "v", place(F.col("v").asc_nulls_last()).alias("up"), place(F.col("v").desc_nulls_last()).alias("down"))
    return q.orderBy("up").limit(50)


@query(
    "page_market_search",
    """WITH m AS (SELECT DISTINCT p_partkey, p_name, p_brand, p_retailprice FROM part WHERE contains(lower(p_name), 'a') AND p_size >= 10 AND p_brand <> 'Brand#11'),
v AS (SELECT l_partkey, sum(l_quantity) AS volume FROM lineitem GROUP BY l_partkey) SELECT p_partkey, p_name, p_brand, coalesce(volume, 0.0) AS volume FROM m LEFT JOIN v ON l_partkey = p_partkey ORDER BY volume DESC, p_partkey LIMIT 20 OFFSET 20""",
)
def page_market_search(spark, sf_dir):
    """The second page of a search: filtered by words and category, each once, with volumes, the largest first."""
    p, l = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem"))
    found = p.filter(F.lower("p_name").contains("a") & (F.col("p_size") >= 10) & (F.col("p_brand") != "Brand#11")).select("p_partkey", "p_name", "p_brand", "p_retailprice")
    volume = l.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("volume"))
    q = found.union(found).dropDuplicates().join(volume, "p_partkey", "left").select("p_partkey", "p_name", "p_brand", F.coalesce("volume", F.lit(0.0)).alias("volume"))
    return q.orderBy(F.desc("volume"), "p_partkey").offset(20).limit(20)


@query("scalar_json_variant", """SELECT event_id, coalesce(CAST(CASE WHEN event_type IN ('click', 'view') THEN 2 * CAST(json_extract_string(props, '$.k') AS BIGINT) END AS BIGINT), CAST(json_extract_string(props, '$.k') AS BIGINT)) AS w FROM events""")
def scalar_json_variant(spark, sf_dir):
    """The trained state of a variant, or of the first one where it has none, under the key of the node that asks."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    state = F.to_json(F.array(F.struct(F.lit("any").alias("variant"), F.struct(F.col("k").alias("old")).alias("weights")), *(F.struct(F.lit(v).alias("variant"), F.struct((2 * F.col("k")).alias("old")).alias("weights")) for v in ("click", "view"))))
    variants = F.from_json(state, "array<struct<variant: string, weights: map<string, long>>>")
    own = F.filter(variants, lambda v: v["variant"] == F.col("event_type"))
    renamed = F.transform_keys(F.coalesce(F.get(own, F.lit(0)), F.get(variants, F.lit(0)))["weights"], lambda k, _: F.when(k == "old", F.lit("w")).otherwise(k))
    return e.select("event_id", renamed["w"].alias("w"))


@query(
    "scalar_holdout_window",
    """WITH s AS (SELECT o_custkey, CAST(min(epoch_ms(o_orderdate)) AS BIGINT) AS train_start, CAST(max(epoch_ms(o_orderdate)) AS BIGINT) AS train_end FROM orders GROUP BY o_custkey), n AS (SELECT CAST(max(epoch_ms(o_orderdate)) AS BIGINT) AS now FROM orders),
w AS (SELECT *, now - train_end - 1 >= 2592000000 AS after, train_start - 1 - greatest(now - 31536000000, 0) >= 2592000000 AS before FROM s, n)
SELECT o_custkey, CASE WHEN after THEN 'after' WHEN before THEN 'before' END AS side, CASE WHEN after THEN train_end + 1 WHEN before THEN greatest(now - 31536000000, 0) END AS start, CASE WHEN after THEN now WHEN before THEN train_start - 1 END AS stop FROM w""",
)
def scalar_holdout_window(spark, sf_dir):
    """Where a model may be judged: behind its training if that leaves thirty days, else before it within a year, else nowhere."""
    day = 86_400_000
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("t"))
    s = o.groupBy("o_custkey").agg(F.min("t").alias("train_start"), F.max("t").alias("train_end")).crossJoin(F.broadcast(o.agg(F.max("t").alias("now"))))  # one row
    first = F.greatest(F.col("now") - 365 * day, F.lit(0))
    after, before = F.col("now") - F.col("train_end") - 1 >= 30 * day, F.col("train_start") - 1 - first >= 30 * day
    pick = lambda a, b: F.when(after, a).when(before, b)
    return s.select("o_custkey", pick(F.lit("after"), F.lit("before")).alias("side"), pick(F.col("train_end") + 1, first).alias("start"), pick(F.col("now"), F.col("train_start") - 1).alias("stop"))


_WORDS = "list_transform(string_split(regexp_replace(name, '[_-]+', ' ', 'g'), ' '), lambda w: upper(w[1]) || lower(w[2:]))"


@query("scalar_humanize", f"WITH n AS (SELECT p_partkey, lower(replace(p_type, ' ', '_')) || '-' || lower(replace(p_brand, '#', '__')) AS name FROM part) SELECT p_partkey, array_to_string({_WORDS}, ' ') AS label FROM n")
def scalar_humanize(spark, sf_dir):
    """snake_case and kebab-case names as words."""
    name = F.concat(F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))), F.lit("-"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("__"))))
    return _t(spark, sf_dir, "part").select("p_partkey", ss.humanized(name).alias("label"))


@query(
    "scalar_node_types",
    """WITH j AS (SELECT o_orderkey, to_json({'nodes': [{'type': lower(o_orderpriority)}, {'type': o_orderstatus}, {'type': lower(o_orderpriority)}]}) AS flow FROM orders)
SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_transform(CAST(json_extract_string(flow, '$.nodes[*].type') AS VARCHAR[]), lambda x: lower(x) || chr(1) || x))), ',') AS types FROM j""",
)
def scalar_node_types(spark, sf_dir):
    """The distinct node types of a flow's JSON in order whatever their case (here each behind its lower-case key)."""
    node = lambda c: F.struct(c.alias("type"))
    p = F.lower("o_orderpriority")
    flow = F.to_json(F.struct(F.array(node(p), node(F.col("o_orderstatus")), node(p)).alias("nodes")))
    types = F.from_json(F.get_json_object(flow, "$.nodes[*].type"), "array<string>")
    keyed = F.array_sort(F.array_distinct(F.transform(types, lambda x: F.concat(F.lower(x), F.lit("\x01"), x))))
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.array_join(keyed, ",").alias("types"))
