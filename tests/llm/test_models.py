"""Classifiers: accuracy on documents whose labels were never learned, and code lengths against a direct computation."""

from __future__ import annotations

import math
import random
import re
import subprocess
import sys
import tracemalloc
from collections import Counter, defaultdict
from itertools import combinations, product
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import language_id, quality, toxicity
from tidemill.llm import textkit as tk
from tidemill.llm.labelled import sample
from tidemill.llm.language_id import Ppm, op6_language_id
from tidemill.llm.quality import Field, op3_quality
from tidemill.llm.toxicity import FactorizationMachine, op2_toxicity

SF = "/root/testdata/sf0.1"  # enough toxic documents to learn from and to judge by


def auc(pairs) -> float:
    good, bad = ([s for y, s in pairs if y == k] for k in (1, 0))
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize(("query", "label", "least"), [(op2_toxicity, "toxic", 0.9), (op3_quality, "quality", 0.9)])
def test_held_out_labels(spark, query, label, least):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r[label] is not None}
    rows = query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    out = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    assert auc(out) >= least
    assert np.mean([(s >= 0.5) == y for y, s in out]) >= least


def test_held_out_languages(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in op6_language_id(spark, SF).collect() if r.held_out and langs[r.doc_id] and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows]) >= 0.95


def grams_of(text: bytes) -> np.ndarray:
    buf, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    return language_id._grams(buf, language_id._places(offsets), 0, len(buf))


class PlainPpm:
    """Contexts as tuples in dictionaries; escapes by method C with exclusion, walked byte by byte."""

    def __init__(self, texts: list[bytes]):
        self.seen: dict[tuple, Counter] = defaultdict(Counter)
        for t in texts:
            for i, byte in enumerate(t):
                for k in range(language_id.ORDER + 1):
                    self.seen[self.context(t, i, k)][byte] += 1

    @staticmethod
    def context(t: bytes, i: int, k: int) -> tuple:
        return tuple(t[j] if j >= 0 else None for j in range(i - k, i))

    def share(self, t: bytes, i: int, byte: int, k: int = language_id.ORDER) -> float:
        if k < 0:
            return 1 / 256
        here = self.seen.get(self.context(t, i, k), Counter())
        total, kinds = sum(here.values()), len(here)
        if not here or k > 2 and total < language_id.SEEN:
            return self.share(t, i, byte, k - 1)
        if here[byte]:
            return here[byte] / (total + kinds)
        rest = 1 - sum(self.share(t, i, s, k - 1) for s in here)
        return kinds / (total + kinds) / rest * self.share(t, i, byte, k - 1)


def test_code_lengths():
    """Every byte of unseen texts, hits and escapes with exclusion alike, against dictionaries; a remembered length is the same."""
    samples = {"xx": [b"abracadabra abra cadabra", b"a barbarian", b""], "yy": [b"banana bandana nab a band", b"\xc3\xa9t\xc3\xa9"]}
    counts = {}
    for lang, texts in samples.items():
        gram = np.concatenate([grams_of(t) for t in texts if t])
        counts[lang] = np.unique(gram, return_counts=True)
    model = Ppm(counts)
    for text in (b"abrakadanda bananabra", b"zzz", b"\xc3\xa9 \xff\x00 a band", b"b"):
        expected = [[-math.log2(PlainPpm(samples[lang]).share(text, i, byte)) for lang in model.langs] for i, byte in enumerate(text)]
        found = np.stack([t.bits(grams_of(text)) for t in model.trees], 1)
        assert np.allclose(found, expected, rtol=1e-5)
        for _ in range(2):
            whole = model.lengths(np.frombuffer(b"banana" + text, np.uint8), np.array([0, 6, 6, 6 + len(text)]))
            assert np.allclose(whole[2], np.sum(expected, 0), rtol=1e-4) and (whole[1] == 0).all()


def test_shares_sum_to_one():
    """In every context of the tree, and in one that it lacks."""
    text = b"abracadabra abra cadabra"
    tree = Ppm({"xx": np.unique(grams_of(text), return_counts=True)}).trees[0]
    for context in (b"abra", b"cada", b"ra a", b"zzzz", b"xxab"):
        grams = np.array([grams_of(context + bytes([s]))[-1] for s in range(256)])
        assert np.exp2(-tree.bits(grams)).sum() == pytest.approx(1, abs=1e-4)


def test_memory_of_code_lengths_is_exact(monkeypatch):
    """A table of few slots, in which most grams displace another, and blocks that cut texts."""
    rng = np.random.default_rng(8)
    text = bytes(rng.choice(np.frombuffer(b"abcde ", np.uint8), 4000))
    counts = {lang: np.unique(grams_of(text[a : a + 500]), return_counts=True) for lang, a in (("xx", 0), ("yy", 900))}
    offsets = np.array([0, 700, 701, 701, 2500, 4000])
    buf = np.frombuffer(text, np.uint8)
    model = Ppm(counts)
    grams = language_id._grams(buf, language_id._places(offsets), 0, len(buf))
    each = np.stack([t.bits(grams) for t in model.trees], 1)
    expected = [each[a:b].sum(0) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    monkeypatch.setattr(language_id, "MEMO", 600)
    monkeypatch.setattr(language_id, "BLOCK", 333)
    assert np.allclose(model.lengths(buf, offsets), expected, rtol=1e-5)


def test_code_lengths_of_a_long_text_in_bounded_memory():
    """What is held at once depends on the block and on the table of code lengths, not on the text."""
    text = np.frombuffer(b"a fairly usual line of words, again and again\n" * 200_000, np.uint8)
    model = Ppm({lang: np.unique(grams_of(text[:500].tobytes()), return_counts=True) for lang in ("xx", "yy")})
    tracemalloc.start()
    found = model.lengths(text, np.array([0, 0, 100, len(text), len(text)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0].any() == found[3].any() == False  # noqa: E712
    assert found[1].all() and found[2].all()
    assert peak < 80 << 20


def test_toxicity_against_a_sum_over_pairs():
    """Bias, a weight for each distinct known term, and a product of factors for each pair of them, from the text itself."""
    rng = np.random.default_rng(3)
    texts = ["Red red blue, green-blue!", "", "unknown words only", "été ÉTÉ red", "a " * 50]
    raw = [t.encode() for t in texts]
    ids, rows = toxicity.terms(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))

    def own(text: str) -> list[int]:
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
        hashed = lambda w: int(tk.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
        stems = [int(tk.mix(np.array([hashed(w[:4])], np.uint64))[0]) for w in words]
        return sorted({h >> (64 - toxicity.HASH_BITS) for h in [*map(hashed, words), *stems]})

    for k, t in enumerate(texts):
        assert ids[rows[k] : rows[k + 1]].tolist() == own(t)
    machine = FactorizationMachine()
    kept = [h for t in (texts[0], texts[3], texts[4]) for h in own(t)]
    kept = sorted(set(kept))
    machine.place[kept] = np.arange(len(kept))
    machine.bias, machine.weight, machine.factor = -0.3, rng.normal(size=len(kept)), rng.normal(size=(len(kept), toxicity.FACTORS))
    found = machine.score(ids, rows)
    for k, t in enumerate(texts):
        at = [kept.index(h) for h in own(t) if h in kept]
        z = machine.bias + sum(machine.weight[i] for i in at)
        z += sum(sum(machine.factor[i][f] * machine.factor[j][f] for f in range(toxicity.FACTORS)) for i, j in combinations(at, 2))
        assert found[k] == pytest.approx(1 / (1 + math.exp(-z)))


def test_quality_against_plain_lines(spark):
    """Line features from the text itself, every labelling of the lines summed, marginals weighted by bytes."""
    rng = np.random.default_rng(4)
    texts = ["Good line, here.\nBUY NOW!!! $$$ ||\n\nan an an été\t12", "", None, "one\n", "\n\nx"]
    field = Field(rng.normal(size=quality.OWN), rng.uniform(0.5, 2, quality.OWN))
    field.unary, field.pair = rng.normal(size=len(field.unary)) / 4, rng.normal(size=(2, 2))

    def features(line: bytes) -> list[float]:
        n = max(len(line), 1)
        count = [sum(b in set(c) for b in line) for c in quality._CLASSES.values()]
        words = re.findall(rb"[^\x20\x09-\x0D]+", line)
        k = max(len(words), 1)
        again = sum(a == b for a, b in zip(words, words[1:], strict=False))
        return [*(c / n for c in count), math.log1p(len(line)) / 8, math.log1p(len(words)) / 5, sum(map(len, words)) / k / 10, again / k, float(not line), float(count[0] > count[1])]

    def whole(text) -> float:
        lines = (text or "").encode().split(b"\n")
        own = (np.array([features(x) for x in lines]) - field.mean) / field.std
        blank = np.zeros(quality.OWN)
        x = [np.concatenate([own[i], own[i - 1] if i else blank, own[i + 1] if i + 1 < len(lines) else blank, [i == 0, i + 1 == len(lines), 1]]) for i in range(len(lines))]
        u = [float(v @ field.unary) for v in x]
        good, z = [0.0] * len(lines), 0.0
        for y in product((0, 1), repeat=len(lines)):
            w = math.exp(sum(a for a, b in zip(u, y, strict=True) if b) + sum(field.pair[a, b] for a, b in zip(y, y[1:], strict=False)))
            z += w
            good = [g + w * b for g, b in zip(good, y, strict=True)]
        weight = [len(x) + 1e-6 for x in lines]
        return sum(g / z * w for g, w in zip(good, weight, strict=True)) / sum(weight)

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.score, r.predicted) for r in quality.score(docs, field).collect()}
    for d, t in enumerate(texts):
        assert found[d] == (pytest.approx(whole(t), abs=1e-5), int(found[d][0] >= 0.5))


def test_fit_sees_lines_far_down(spark):
    """Documents that differ only behind their first hundred lines can be told apart."""
    head = "A plain line of words stands here.\n" * 100
    rows = [(i, head + ("More plain words follow it.\n" if i % 2 else "$$$ ||| !!! $$$\n") * 200) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    field = quality.fit(docs, labels, F.lit(True))
    found = {r.doc_id: r.score for r in quality.score(docs, field).collect()}
    assert min(found[i] for i in range(1, 40, 2)) > max(found[i] for i in range(0, 40, 2)) + 0.3


def test_sample_is_bounded_by_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (10 if i else 1000)) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    with tk.Workspace(spark, "test") as work:
        for rows, size, n in ((20, 10**6, 20), (50, 105, 10), (100, 499, 49)):
            got = sample(docs, labels, "quality", F.lit(True), rows, work, size).collect()
            assert len(got) == n
            work.drop("drawn")


def test_machine_learns_a_pair_that_no_sum_can():
    """Exclusive or of two terms: linear weights stay at chance."""
    rng = np.random.default_rng(1)
    texts, labels = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        filler = [f"f{k}" for k in rng.integers(0, 30, 6)]
        texts.append(" ".join([*filler, "apple" if a else "pear", "north" if b else "south"]))
        labels.append(int(a ^ b))
    from tidemill.llm.toxicity import terms

    raw = [t.encode() for t in texts]
    ids, rows = terms(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    split = [ids[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)]
    machine = FactorizationMachine().fit(split[:2500], np.array(labels[:2500], float))
    at = np.concatenate([[0], np.cumsum([len(x) for x in split[2500:]])])
    score = machine.score(np.concatenate(split[2500:]), at)
    assert np.mean((score >= 0.5) == np.array(labels[2500:])) > 0.9


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    field = Field()
    field.unary = rng.normal(size=len(field.unary))
    field.pair = rng.normal(size=(2, 2))
    rows = np.array([0, 1, 5, 8])
    x = rng.normal(size=(8, len(field.unary))) / 3
    found, _ = field.marginals(x, rows)
    u = x @ field.unary
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        n = b - a
        weight = {}
        for code in range(1 << n):
            y = [(code >> k) & 1 for k in range(n)]
            weight[code] = math.exp(sum(u[a + k] * y[k] for k in range(n)) + sum(field.pair[y[k], y[k + 1]] for k in range(n - 1)))
        z = sum(weight.values())
        for k in range(n):
            assert found[a + k] == pytest.approx(sum(w for c, w in weight.items() if (c >> k) & 1) / z)


def test_anchors_cover_every_window_once():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    rows = np.array([0, 12, 13, 200, 500])
    first, last, _ = tk.anchored(h, rows, 13, 4)
    covered = sorted(x for a, b in zip(first, last, strict=True) for x in range(a, b + 1))
    assert covered == [x for a, b in zip(rows[:-1], rows[1:], strict=True) for x in range(a, b - 12)]


def test_quality_in_blocks_equals_one_pass(monkeypatch):
    rng = np.random.default_rng(5)
    field = Field(rng.normal(size=quality.OWN), rng.uniform(0.5, 2, quality.OWN))
    field.unary, field.pair = rng.normal(size=3 * quality.OWN + 3), rng.normal(size=(2, 2)) * 2
    some = ["foo", "Bar", "x!", "12", "é", "", "a b b"]
    texts = ["\n".join(" ".join(rng.choice(some, rng.integers(0, 6))) for _ in range(rng.integers(0, 60))) for _ in range(120)] + [None, "", "\n", "a"]
    buf, offsets = tk.utf8(pa.array(texts))
    own, _, rows = quality.lines(buf, offsets)
    whole, _ = field.marginals(field.features(own, rows), rows)
    for segment, block, size in ((1 << 18, 1 << 14, 1 << 20), (7, 5, 40), (1, 1, 1), (64, 3, 1 << 20)):
        for name, value in (("SEGMENT", segment), ("BLOCK", block), ("BLOCK_BYTES", size)):
            monkeypatch.setattr(quality, name, value)
        begin, end, rows = quality.bounds(buf, offsets)
        assert np.allclose(field.chained(field.unaries(buf, begin, end, rows), rows), whole, rtol=0, atol=1e-12)


def test_quality_of_ten_million_lines_in_bounded_memory():
    """In a process of its own, whose peak is its own."""
    code = """
import resource, numpy as np, pyarrow as pa
from tidemill.llm import quality, textkit as tk
field = quality.Field(); field.unary[-1] = 0.3
buf, offsets = tk.utf8(pa.array(["\\n" * 10_000_000]))
begin, end, rows = quality.bounds(buf, offsets)
p = field.chained(field.unaries(buf, begin, end, rows), rows)
assert len(p) == 10_000_001 and np.allclose(p, p[0])
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 900 << 10
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, cwd=Path(__file__).parents[2])


def test_quality_sample_is_bounded_by_lines(spark):
    docs = spark.createDataFrame([(i, "x\n" * (9 if i % 2 else 99)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    with tk.Workspace(spark, "test") as work:
        got = [r.text.count("\n") + 1 for r in sample(docs, labels, "quality", F.lit(True), 40, work, lines=60).collect()]
    assert got and set(got) == {10} and sum(got) <= 60


def test_trees_are_pruned_to_fit_and_samples_bounded_by_bytes(spark):
    from tidemill.llm.language_id import GRAM_BYTES, fit

    rng = random.Random(2)
    word = {"aa": ["kala", "mato", "sina"], "bb": ["strz", "grud", "plosk"]}
    texts = [(i, " ".join(rng.choice(word[lang]) for _ in range(40)), lang) for i in range(300) for lang in [("aa", "bb")[i % 2]]]
    docs = spark.createDataFrame([*texts, (999, "kala " * 200_000, "bb")], "doc_id long, text string, lang string")
    whole = fit(docs, F.lit(True), most=120 * 2000)  # the long text of the wrong language is over a group's share
    for size in (400 * GRAM_BYTES, 40 * GRAM_BYTES):
        small = fit(docs, F.lit(True), most=120 * 2000, size=size)
        assert small.langs == whole.langs == ["aa", "bb"]
        assert sum(t.nbytes for t in small.trees) <= size + 2 * GRAM_BYTES
    for model in (whole, fit(docs, F.lit(True), most=120 * 2000, size=400 * GRAM_BYTES)):
        lengths = model.lengths(*tk.utf8(pa.array([t for _, t, _ in texts])))
        assert [model.langs[k] for k in lengths.argmin(1)] == [lang for _, _, lang in texts]
