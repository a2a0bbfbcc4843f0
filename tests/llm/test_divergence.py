"""The source divergence audit against plain whole numbers, however it is dealt."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import DOCS, hard
from tests.oracle import check
from tidemill.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def expected(rows, min_docs: int, top: int) -> Counter:
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        found = Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text)))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out: Counter = Counter()
    for lang in docs.keys() | {g[0] for g in counts}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        of = {s: c for (x, s), c in counts.items() if x == lang}
        whole = sum(of.values(), Counter())

        def p(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept))

        shares = {s: {t: p(c, t) for t in kept} for s, c in of.items()}
        base = {t: p(whole, t) for t in kept}
        for s, own in shares.items():
            pair = sorted((-sum(abs(own[t] - o[t]) for t in kept), x.encode(), x) for x, o in shares.items() if x != s)
            term = sorted((base[t] - own[t], t.encode(), t) for t in kept if of[s][t] and own[t] > base[t])[:top]
            for part, found in (("pair", pair), ("term", term)):
                out.update((lang, s, part, x, -v, k) for k, (v, _, x) in enumerate(found, 1))
    return out


@pytest.mark.parametrize("sizes", [(4096, 16, 8), (3, 2, 2), (1, 1, 1)])
@pytest.mark.parametrize("min_docs", [1, 3, 1000])
def test_hard(spark, sizes, min_docs):
    docs = spark.createDataFrame([(d, t[:3000] if t else t, lang, s, n) for d, t, lang, s, n in hard()], DOCS).withColumns({c: F.lit("own") for c in ("term", "value", "rank", "part", "n", "block")})
    found = Counter(tuple(r) for r in dv.audit(docs, min_docs, 7, *sizes).collect())
    assert found == expected([(r.lang, r.source, r.text) for r in docs.collect()], min_docs, 7)


def test_many_sources_in_small_tiles(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = Counter(tuple(r) for r in dv.audit(docs, 5, 50, 64, 3, 2).collect())
    assert found == expected([(r.lang, r.source, r.text) for r in docs.collect()], 5, 50)


def test_empty(spark):
    assert dv.audit(spark.createDataFrame([], DOCS)).collect() == []
    alone = spark.createDataFrame([(1, None, None, None, 0)], DOCS)
    assert dv.audit(alone, 1).collect() == []


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    whole = rng.integers(1, 9 * 10**14, 2000)
    count = np.minimum(rng.integers(0, 9 * 10**13, 2000), whole)
    assert dv.share(count, whole).tolist() == [1 + 10**9 * (c + 5) // w for c, w in zip(count.tolist(), whole.tolist(), strict=True)]


def test_oracle_on_more_documents(spark):
    check(spark, "/root/testdata/sf0.01", dv.op13_source_divergence, dv.OP13_SQL)
