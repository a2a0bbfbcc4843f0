"""Market search by an inverted index: from token to the markets whose title has it.

A search is tried in several wordings, from the whole phrase to its first
telling word. Each wording looks up the postings of its rarest token alone and
checks the other tokens on the titles found, so the work follows the shortest
list and not the number of markets. Many searches are answered in one job.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Short names with what they stand for, words that say nothing, and how many letters a telling word has at least.
SYNONYMS = {
    "btc": "bitcoin", "eth": "ethereum", "sol": "solana", "doge": "dogecoin", "ada": "cardano", "xrp": "ripple",
    "us": "usa", "uk": "united kingdom", "eu": "european union", "ai": "artificial intelligence",
}
STOP_WORDS = (
    "will with when what whom whose this that these those there their have been were does doing done into over under also than then "
    "more most much some each every very just only make made from onto before after during while still since upon next prior both other "
    "hourly daily weekly monthly yearly"
).split()
TELLING = 3


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits in order; none of NULL."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def attempts(term: Column) -> Column:
    """The wordings of a search as arrays of tokens, NULL or empty where one does not apply: the phrase, each short name written out and the reverse, the first two telling words, the first."""
    low = F.lower(F.coalesce(term, F.lit("")))
    tried = [tokens(low)]
    for short, long in SYNONYMS.items():
        for a, b in ((short, long), (long, short)):
            word = rf"\b{a}\b"
            tried.append(F.when(low.rlike(word), tokens(F.regexp_replace(low, word, b))))
    names = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    telling = F.filter(tokens(low), lambda w: (F.char_length(w) >= TELLING) & ~w.isin(*STOP_WORDS))
    telling = F.array_distinct(F.transform(telling, lambda w: F.coalesce(names[w], w)))
    phrase = lambda n: tokens(F.array_join(F.slice(telling, 1, n), " "))
    return F.array(*tried, F.when(F.size(telling) >= 2, phrase(2)), phrase(1))


class Index:
    """Postings (token, id), how many each token has, and the tokens of every title, as tables under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing written yet
            return self.spark.createDataFrame([], schema)

    def build(self, titles: DataFrame) -> Index:
        """From (id, title); of an id that comes again the least title counts. Postings lie in order of token and id, so a lookup reads few row groups and a frequent token spreads over files."""
        once = titles.filter("id IS NOT NULL").groupBy("id").agg(F.min("title").alias("title"))
        once.select("id", F.array_distinct(tokens(F.col("title"))).alias("tokens")).write.mode("overwrite").parquet(f"{self.path}/titles")
        pairs = self._read("titles", "id long, tokens array<string>").select(F.explode("tokens").alias("token"), "id")
        pairs.repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.mode("overwrite").parquet(f"{self.path}/postings")
        self._read("postings", "token string, id long").groupBy("token").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.path}/sizes")
        return self

    def matches(self, searches: DataFrame, enough: Column) -> DataFrame:
        """(search, id, attempt): every market with the first wording whose tokens its title has all; a wording is only tried while those before it found fewer than ``enough``.

        ``searches`` has search, unique, and term; ``enough`` is an expression over its columns.
        """
        tried = searches.select("search", enough.alias("enough"), F.posexplode(attempts(F.col("term"))).alias("attempt", "tokens"))
        tried = tried.filter(F.size("tokens") > 0).withColumn("tokens", F.array_distinct("tokens"))
        sized = tried.select("*", F.explode("tokens").alias("token")).join(self._read("sizes", "token string, n long"), "token", "left")
        rarest = sized.groupBy("search", "attempt").agg(F.any_value("enough").alias("enough"), F.any_value("tokens").alias("tokens"), F.bool_and(F.col("n").isNotNull()).alias("known"), F.min(F.struct("n", "token")).alias("least"))
        ask = rarest.filter("known").select("search", "attempt", "enough", "tokens", F.col("least.token").alias("token"))
        hits = ask.join(self._read("postings", "token string, id long"), "token")
        titles = self._read("titles", "id long, tokens array<string>").withColumnRenamed("tokens", "has")
        hits = hits.join(titles, "id").filter(F.size(F.array_except("tokens", "has")) == 0)
        first = hits.groupBy("search", "id").agg(F.min("attempt").alias("attempt"), F.any_value("enough").alias("enough"))
        found = first.groupBy("search", "attempt").agg(F.count("*").alias("n"), F.any_value("enough").alias("enough"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("search").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # as many rows as wordings
        open_ = found.withColumn("before", before).filter(F.col("before") < F.col("enough")).select("search", "attempt")
        return first.select("search", "id", "attempt").join(open_, ["search", "attempt"])

    def search(self, searches: DataFrame, markets: DataFrame, *order: Column) -> DataFrame:
        """(search, place, attempt and the columns of markets): the page of each search, from place skip + 1, at most ``take`` rows.

        ``searches``: search, term, category (NULL: any), include_closed, least_volume (NULL: any), skip, take.
        ``markets``: id, category, closed, volume and what else is to be shown; an id once. Order: by volume, the
        greatest first, unless given; ties by id. The rows found for one search are ranked in one task, so a search
        whose every wording names words of most titles is as large as these.
        """
        found = self.matches(searches, F.greatest(F.col("take") * 4, F.lit(100)))
        wish = searches.select("search", F.lower("category").alias("_category"), "include_closed", "least_volume", "skip", "take")
        rows = found.join(markets, "id").join(wish, "search")
        ok = (F.col("include_closed") | ~F.coalesce("closed", F.lit(False))) & (F.col("_category").isNull() | (F.lower("category") == F.col("_category")))
        ok &= F.col("least_volume").isNull() | (F.col("volume") >= F.col("least_volume"))
        w = Window.partitionBy("search").orderBy(*(order or (F.desc_nulls_last("volume"),)), "id")
        placed = rows.filter(ok).withColumn("place", F.row_number().over(w))
        return placed.filter((F.col("place") > F.col("skip")) & (F.col("place") <= F.col("skip") + F.col("take"))).select("search", "place", "attempt", *markets.columns)
