"""Market search over titles made from the parts, with volumes from their line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog import query
from tidemill.operators import search as se
from tidemill.streaming.run import folder

_LEADS = ("Will Bitcoin beat the ", "BTC daily: ", "Ethereum and USA ", "")
_TERMS = ("BTC weekly ", "bitcoin, ", "Will the US ", "eth ")


def _case(values, key):
    return "CASE " + " ".join(f"WHEN {key} % {len(values)} = {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


def _pick(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


_MARKETS = f"""m AS (SELECT p_partkey AS id, {_case(_LEADS, "p_partkey")} || p_name AS title, p_type AS category, p_partkey % 9 = 0 AS closed FROM part),
v AS (SELECT l_partkey, sum(l_quantity) AS volume FROM lineitem GROUP BY l_partkey), markets AS (SELECT m.*, coalesce(volume, 0.0) AS volume FROM m LEFT JOIN v ON l_partkey = id),
p AS (SELECT min(p_partkey) AS search, p_name AS name, min(p_type) AS category FROM part GROUP BY p_name),
s AS (SELECT search, {_case(_TERMS, "search")} || name || CASE WHEN search % 5 = 0 THEN ' nowhere' ELSE '' END AS term, CASE WHEN search % 3 = 0 THEN lower(category) END AS category, search % 2 = 0 AS include_closed, CASE WHEN search % 7 = 0 THEN 30.0 END AS least_volume, search % 4 AS skip, 5 + search % 3 AS take FROM p)"""


def _markets(spark, sf_dir):
    p, l = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem"))
    m = p.select(F.col("p_partkey").alias("id"), F.concat(_pick(_LEADS, F.col("p_partkey")), "p_name").alias("title"), F.col("p_type").alias("category"), (F.col("p_partkey") % 9 == 0).alias("closed"))
    volume = l.groupBy(F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("volume"))
    return m.join(volume, "id", "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def _searches(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_name").agg(F.min("p_partkey").alias("search"), F.min("p_type").alias("category"))
    k = F.col("search")
    term = F.concat(_pick(_TERMS, k), "p_name", F.when(k % 5 == 0, " nowhere").otherwise(""))
    return p.select("search", term.alias("term"), F.when(k % 3 == 0, F.lower("category")).alias("category"), (k % 2 == 0).alias("include_closed"), F.when(k % 7 == 0, 30.0).alias("least_volume"), (k % 4).alias("skip"), (5 + k % 3).alias("take"))


def _words(x):
    return f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"


_STOP = ", ".join(f"'{w}'" for w in se.STOP_WORDS)
_LONG = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in se.SYNONYMS.items()) + " ELSE w END"
_TRIED = [_words("term"), *(f"CASE WHEN regexp_matches(lower(term), '\\b{a}\\b') THEN {_words(f"regexp_replace(lower(term), '\\b{a}\\b', '{b}', 'g')")} END" for pair in se.SYNONYMS.items() for a, b in (pair, pair[::-1]))]
_FOUND = f"""t AS (SELECT *, list_transform(list_filter({_words("term")}, lambda w: length(w) >= {se.TELLING} AND w NOT IN ({_STOP})), lambda w: {_LONG}) AS telling FROM s),
u AS (SELECT *, list_filter(telling, lambda w: w <> telling[1])[1] AS second FROM t),
a AS (SELECT search, take, [{", ".join(_TRIED)}, CASE WHEN second IS NOT NULL THEN {_words("telling[1] || ' ' || second")} END, {_words("telling[1]")}] AS tried FROM u),
e AS (SELECT search, take, generate_subscripts(tried, 1) - 1 AS attempt, unnest(tried) AS words FROM a),
h AS (SELECT search, any_value(take) AS take, id, min(attempt) AS attempt FROM e, markets WHERE len(words) > 0 AND list_has_all({_words("title")}, words) GROUP BY search, id),
n AS (SELECT search, attempt, coalesce(sum(count(*)) OVER (PARTITION BY search ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, any_value(take) AS take FROM h GROUP BY search, attempt),
f AS (SELECT h.search, h.id, h.attempt FROM h JOIN n USING (search, attempt) WHERE before < greatest(4 * n.take, 100))"""


@query(
    "search_markets",
    f"""WITH {_MARKETS}, {_FOUND}, r AS (SELECT f.search, f.attempt, markets.*, skip, take, row_number() OVER (PARTITION BY f.search ORDER BY volume DESC, markets.id) AS place FROM f JOIN markets USING (id) JOIN s ON s.search = f.search
  WHERE (include_closed OR NOT closed) AND (s.category IS NULL OR lower(markets.category) = s.category) AND (least_volume IS NULL OR volume >= least_volume))
SELECT search, place, attempt, id, title, category, closed, volume FROM r WHERE place > skip AND place <= skip + take""",
)
def search_markets(spark, sf_dir):
    """A search for each name, in several wordings, by category, volume and state, a page of each."""
    markets = _markets(spark, sf_dir)
    index = se.Index(spark, folder(spark, "search")).build(markets.select("id", "title"))
    return index.search(_searches(spark, sf_dir), markets)


@query("search_matches", f"WITH {_MARKETS}, {_FOUND} SELECT search, attempt, count(*) AS n, min(id) AS least FROM f GROUP BY ALL")
def search_matches(spark, sf_dir):
    """How many markets each wording brought."""
    index = se.Index(spark, folder(spark, "search")).build(_markets(spark, sf_dir).select("id", "title"))
    found = index.matches(_searches(spark, sf_dir), F.greatest(F.col("take") * 4, F.lit(100)))
    return found.groupBy("search", "attempt").agg(F.count("*").alias("n"), F.min("id").alias("least"))
