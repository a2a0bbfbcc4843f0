"""Every operator and stage on empty tables, nulls in all columns, repeated rows, and extra columns of clashing names."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.cases import DOCS, hard
from tidemill.llm import decontaminate, fingerprint, jaccard_join, labelled, language_id, line_dedup, near_dedup, packing, quality, registry, resampling, substring_dedup, suffix_dedup, toxicity

CLASH = [
    "score", "predicted", "lang_pred", "bits_per_byte", "known", "kept", "n_lines", "n_removed", "kept_text", "component_id", "_row", "_kept", "label", "a", "b", "bucket", "chunk",
    "fingerprint", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_from", "hit_to", "_key", "_n", "_from", "_to", "_items", "_parts", "_gone", "_own1", "_own9", "_letter",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Hard cases with further columns of every name the operators use, whose values tell the row."""
    mine = lambda c: F.concat_ws(" ", F.lit(c), F.col("doc_id").cast("string"))
    return spark.createDataFrame(hard(), DOCS).withColumns({c: mine(c) for c in CLASH}).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i * 3, i % 2, (i + 1) % 2) for i in range(30)] + [(6, None, None), (None, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("i1", "one two three four"), ("i2", None), ("i3", ""), ("i4", hard()[0][1]), (None, "one"), ("i5", "tail " * 40)], "item_id string, text string")


def operators(labels, items):
    everything = F.lit(True)
    return {
        "fingerprint": fingerprint.fingerprints,
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels, ~labelled.fold(5, 0))),
        "quality": lambda d: quality.score(d, quality.fit(d, labels, ~labelled.fold(3, 1))),
        "suffix": suffix_dedup.drop_repeats,
        "substring": substring_dedup.drop_repeated_windows,
        "language": lambda d: language_id.identify(d, language_id.fit(d, everything)),
        "lines": line_dedup.drop_boilerplate,
        "decontaminate": lambda d: decontaminate.find(d, items),
        "near": near_dedup.near_duplicates,
        "join": jaccard_join.join_components,
        "resample": lambda d: resampling.resample(d, items),
    }


NAMES = ["fingerprint", "toxicity", "quality", "suffix", "substring", "language", "lines", "decontaminate", "near", "join", "resample"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_a_row(odd, labels, items, name):
    found = operators(labels, items)[name](odd).select("doc_id").collect()
    assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, labels, items, name):
    empty = spark.createDataFrame([], DOCS)
    assert operators(labels, items)[name](empty).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_learned_and_listed_tables_may_be_empty(spark, odd, name):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id string, text string")
    if name in ("toxicity", "quality", "decontaminate"):
        assert operators(labels, items)[name](odd).count() == odd.count()


def test_pack_empty(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), packing.vocabulary()).collect() == []


def test_language_of_no_letter(odd):
    found = language_id.identify(odd, language_id.fit(odd, F.lit(True))).select("text", "lang_pred", "score").collect()
    for r in found:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_shards_agree(odd, items):
    """Many small shards of the benchmark find what one does."""
    columns = ["doc_id", "text", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    one, many = (decontaminate.find(odd, items, shard_words=n).select(columns).collect() for n in (10**6, 3))
    assert Counter(one) == Counter(many)


def test_exact_spread(spark):
    """Exactly at the threshold a line goes, one site below it stays."""
    line = "the very same line of boilerplate"
    rows = [(i, f"own words of {i}\n{line if i < 10 else 'another line, on nine sites only'}", "en", f"site{i}", 1) for i in range(19)]
    out = {r.doc_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, DOCS), 10).collect()}
    assert [out[i].n_removed for i in range(19)] == [0] + [1] * 9 + [0] * 9
    assert out[0].kept_text == rows[0][1] and out[1].kept_text == "own words of 1"


@pytest.mark.parametrize("at", range(len(cp.STAGES)))
def test_stages(spark, sf_dir, odd, at):
    """Columns that a stage does not own come out with the values they had, whatever their names."""
    name, stage = cp.STAGES[at]
    empty = spark.createDataFrame([], DOCS)
    assert stage(spark, empty, sf_dir).collect() == []
    out = stage(spark, odd, sf_dir)
    rows = out.collect()
    if at < len(cp.STAGES) - 1:
        assert out.schema.names == odd.schema.names
        assert [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
        whole = {(r.doc_id, r.lang, r.source) for r in odd.collect()}
        for r in rows:
            assert (r.doc_id, r.lang, r.source) in whole
            for c in CLASH:
                assert r[c] == (f"{c} {r.doc_id}" if r.doc_id is not None else c)


def test_decontaminate_replaces_its_columns_only(odd, items):
    found = decontaminate.find(odd, items)
    assert set(found.columns) == set(odd.columns)
    assert dict(found.dtypes)["n_words"] == "bigint" and dict(found.dtypes)["_from"] == "string"


def test_unknown_language_is_rejected(spark):
    """Two learned languages; texts of a third, in their script and in another, go, and held-back texts of both stay, short ones too."""
    en = "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
    de = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei prozent hatte kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine uhr seiner worden will zwischen immer millionen was sagte gibt alle".split()
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(w, k=rng.choice([3, 8, 60]))), lang, "s", 1) for i in range(400) for lang, w in [("en", en) if i % 2 else ("de", de)]]
    finnish = "Suomen kieli on uralilaisten kielten itämerensuomalaiseen ryhmään kuuluva kieli, jota puhuvat pääosin suomalaiset. Helsinki on Suomen pääkaupunki ja väkiluvultaan suurin kaupunki."
    greek = "Η ελληνική γλώσσα ανήκει στην ινδοευρωπαϊκή οικογένεια και αποτελεί το μοναδικό μέλος του ελληνικού κλάδου."
    foreign = [(1000, finnish, None, "s", 1), (1001, greek, None, "s", 1), (1002, finnish * 9, None, "s", 1)]
    unlabelled = [(2000 + i, " ".join(rng.choices(w, k=n)), None, "s", 1) for i, (w, n) in enumerate([(en, 4), (en, 30), (de, 5), (de, 200)])]
    docs = spark.createDataFrame(rows + foreign + unlabelled, DOCS)
    kept = {r.doc_id for r in cp.language(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows + unlabelled}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_of_odd_tables(spark, tmp_path, odd, labels, items, name):
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    for d in ("odd", "none"):
        labels.write.parquet(f"{tmp_path}/{d}/labels.parquet")
        items.write.parquet(f"{tmp_path}/{d}/benchmark.parquet")
    assert registry.QUERIES[name](spark, f"{tmp_path}/none").collect() == []
    found = Counter(r.doc_id for r in registry.QUERIES[name](spark, f"{tmp_path}/odd").collect())
    assert found.keys() == {r.doc_id for r in odd.collect()}
    if name != "op9_packing":
        assert found == Counter(r.doc_id for r in odd.collect())
