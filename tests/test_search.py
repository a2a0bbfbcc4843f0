"""Market search: wordings, synonyms both ways, words that say nothing, filters, pages and edges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemill.operators import search as se

TITLES = {1: "Bitcoin Up or Down?", 2: "BTC up", 3: "United Kingdom election", 4: "UK weather, daily", 5: "Élan vital 2024", 6: "", 7: None, 8: "bitcoin halving", 9: "Weather in the USA"}
SEARCH = "search long, term string, category string, include_closed boolean, least_volume double, skip long, take long"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(k, v) for k, v in TITLES.items()] + [(1, "bitcoin up or down?")]
    return se.Index(spark, f"file://{tmp_path_factory.mktemp('search')}/i").build(spark.createDataFrame(rows, "id long, title string"))


def _ask(spark, index, term, enough=100):
    found = index.matches(spark.createDataFrame([(0, term)], "search long, term string"), F.lit(enough))
    return {r.id: r.attempt for r in found.collect()}


def test_wordings(spark, index):
    up = _ask(spark, index, "BTC up or down hourly")
    assert up.keys() == {1, 8} and up[1] < up[8]  # "bitcoin down" has both, then "bitcoin" alone
    assert _ask(spark, index, "btc up").keys() == {1, 2, 8}
    assert _ask(spark, index, "bitcoin up").keys() == {1, 2, 8}
    assert _ask(spark, index, "uk") == {4: 0, 3: _ask(spark, index, "uk")[3]}
    assert _ask(spark, index, "united kingdom")[4] > 0
    assert _ask(spark, index, "ÉLAN").keys() == {5}
    for nothing in ("", None, "?!", "zzz", "daily hourly"):
        assert _ask(spark, index, nothing) == {}


def test_enough_stops_the_later_wordings(spark, index):
    assert _ask(spark, index, "btc up", enough=1).keys() == {2}
    assert _ask(spark, index, "btc up", enough=2).keys() == {1, 2}


def test_pages_and_filters(spark, index):
    markets = spark.createDataFrame([(k, "A" if k % 2 else "b", {8: None, 2: True}.get(k, False), 5.0 if k < 5 else None) for k in TITLES], "id long, category string, closed boolean, volume double")
    asked = [(1, "bitcoin", None, True, None, 0, 9), (2, "bitcoin", None, False, None, 0, 9), (3, "bitcoin", "a", True, None, 0, 9), (4, "bitcoin", None, True, 5.0, 0, 9), (5, "bitcoin", None, True, None, 1, 1), (6, "bitcoin", None, True, None, 9, 9)]
    got = index.search(spark.createDataFrame(asked, SEARCH), markets).collect()
    pages = {k: [r.id for r in sorted(got, key=lambda r: r.place) if r.search == k] for k in range(1, 7)}
    assert pages == {1: [1, 2, 8], 2: [1, 8], 3: [1], 4: [1, 2], 5: [2], 6: []}


def test_empty_index(spark, tmp_path):
    none = se.Index(spark, f"file://{tmp_path}/none").build(spark.createDataFrame([], "id long, title string"))
    assert _ask(spark, none, "bitcoin") == {}
    assert _ask(spark, se.Index(spark, f"file://{tmp_path}/never"), "bitcoin") == {}
