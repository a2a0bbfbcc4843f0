"""Importance resampling: tries of longer runs, merged totals, noise and ranks, against plain Python."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import DOCS, hard
from tidemill.llm import resampling as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, run: int) -> list[int]:
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % rs.BUCKETS for k in range(1, run + 1) for i in range(len(w) - k + 1)], len(w)


def expected(docs, target, run: int, percent: int) -> Counter:
    sums = [Counter(b for t in texts for b in features(t, run)[0]) for texts in ([t for _, t in docs], target)]
    s, t = (sum(x.values()) for x in sums)
    gain = lambda b: math.floor(1000 * math.log((sums[1][b] + 1) * (s + rs.BUCKETS) / ((sums[0][b] + 1) * (t + rs.BUCKETS))))
    rows = []
    for d, text in docs:
        found, words = features(text, run)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(sha256(f"{rs.SEED}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in rows if r[4] >= rs.MIN_WORDS), key=lambda r: (-r[3], r[0] is not None, r[0]))
    drawn = able[: percent * len(able) // 100]
    place = {id(r): k for k, r in enumerate(drawn, 1)}
    return Counter((*r[:4], place.get(id(r))) for r in rows)


@pytest.mark.parametrize("run", [1, 3])
@pytest.mark.parametrize("percent", [10, 100])
def test_hard(spark, run, percent):
    docs = spark.createDataFrame(hard(), DOCS).withColumns({c: F.lit("own") for c in ("score", "rank", "_before", "n_words")})
    target = spark.createDataFrame([(None,), ("",), ("w1 W2 w3 w4 one two",), ("été ß three four five",)], "text string")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    found = Counter(tuple(r) for r in rs.resample(docs, target, run, percent=percent).collect())
    want = expected(plain, [r.text for r in target.collect()], run, percent)
    assert Counter(k[:4] for k in found.elements()) == Counter(k[:4] for k in want.elements())
    assert Counter((k[3], k[4]) for k in found.elements()) == Counter((k[3], k[4]) for k in want.elements())


def test_small_tries_lose_nothing(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [r.text for r in docs.collect()]
    want = Counter(b for t in texts for b in features(t, 2)[0])
    monkeypatch.setattr(rs, "MOST_NODES", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    found = rs.bucket_counts(docs, 2)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {b: n for b, n in enumerate(found.tolist()) if n} == dict(want)


def test_states_continue():
    trie = rs.Trie(3)
    trie.add(np.frombuffer("A bc d".encode(), np.uint8), np.array([0, 6]))
    assert sorted(trie.state[1:]) == sorted(zlib.crc32(x) for x in (b"a", b"bc", b"d", b"a bc", b"bc d", b"a bc d"))


def test_empty(spark):
    none, texts = spark.createDataFrame([], DOCS), spark.createDataFrame([], "text string")
    assert rs.resample(none, texts).collect() == []
    one = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    assert [r.rank for r in rs.resample(one, texts, percent=100).collect()] == [1]
    assert [r.rank for r in rs.resample(one, texts).collect()] == [None]


def test_the_draw_moves_towards_the_target(spark):
    docs = spark.createDataFrame([(i, " ".join(["alpha beta", "gamma delta"][i % 2] for _ in range(15))) for i in range(2000)], "doc_id long, text string")
    target = spark.createDataFrame([("gamma delta " * 50,)], "text string")
    drawn = [r.doc_id % 2 for r in rs.resample(docs, target).filter("rank IS NOT NULL").collect()]
    assert len(drawn) == 200 and np.mean(drawn) > 0.95
