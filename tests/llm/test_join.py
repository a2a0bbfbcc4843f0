"""The N-gram Jaccard join against brute force, whatever its boundary, and words that polynomial hashes confuse."""

from __future__ import annotations

import numpy as np
import pytest

from tests.llm.cases import DOCS, hard
from tests.llm.test_brute import components, linked, shingle_sets, texts
from tidemill.llm import jaccard_join as jj
from tidemill.llm import textkit as tk
from tidemill.llm.decontaminate import find
from tidemill.llm.linking import common
from tidemill.llm.near_dedup import near_duplicates


@pytest.fixture(params=["table", "hard"])
def docs(request, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if request.param == "table" else spark.createDataFrame(hard(), DOCS)
    return docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])


@pytest.mark.parametrize("light", [None, 0, 4, 1000])
def test_components(docs, light):
    sets = shingle_sets(texts(docs), 4)
    of = components(sets)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.join_components(docs, light).collect()}
    assert found == {d: (len(s), of[d]) for d, s in sets.items()}


@pytest.mark.parametrize("light", [None, 3])
def test_every_link(spark, light):
    """All links between unequal sets, on a thousand documents and a group of near copies that share no common centre."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    chain = [(10_000_000 + i, " ".join(f"c{k}" for k in range(3 * i, 3 * i + 120))) for i in range(60)]
    docs = docs.union(spark.createDataFrame(chain, "doc_id long, text string"))
    least: dict[frozenset, int] = {}
    for d, s in sorted(shingle_sets(texts(docs), 4).items()):
        least.setdefault(frozenset(s), d)
    links = linked({d: s for s, d in least.items() if s})
    found = {(r.a, r.b) for r in jj.similar_pairs(docs, light).collect()}
    assert found == {(min(p), max(p)) for p in links}
    assert sum(a >= 10_000_000 for a, _ in found) >= 59


def test_boundary():
    assert jj.boundary(0, 0, 0) == 0
    assert jj.boundary(100, 100, 50) == 0  # no list has two sets: lists cost least
    assert jj.boundary(100, 200, 4) == 8
    assert jj.boundary(100, 10_000, 50) == jj.LIGHT


def test_order_does_not_matter():
    """Two sets at the limit share a key whichever of their shingles are common, on either side of the boundary."""
    rng = np.random.default_rng(3)
    for n in (2, 6, 7, 13, 20, 41, 100, 260):
        for light in (0, 1, 2, 5, 15, 39):
            whole = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            less = np.sort(rng.permutation(whole)[: len(whole) - jj.slack(len(whole))])
            late = np.sort(rng.permutation(whole)[: n // 2])
            assert np.intersect1d(jj.keys(whole, late, light), jj.keys(less, late, light)).size, (n, light)


def test_bitmap_never_rules_out_a_link():
    rng = np.random.default_rng(4)
    sizes, pairs = [], []
    for n in (7, 40, 1000, 1100, 2200, 9000, 70_000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = rng.permutation(a)[jj.slack(n) :]
        sizes.append((len(a), len(b)))
        pairs.append((jj.bitmap(a), jj.bitmap(b)))
        sig = [np.frombuffer(m, np.uint64)[None, :] for m in pairs[-1]]
        assert jj.may(np.array([len(a)]), sig[0], np.array([len(b)]), sig[1]).all()
    whole, less = (np.array([p[k] for p in pairs], object) for k in (0, 1))
    n_a, n_b = np.array(sizes).T
    assert len({(len(x), len(y)) for x, y in pairs}) >= 4
    assert jj.may(n_a, whole, n_b, less).all()
    assert not jj.may(n_a, whole, n_b, np.array([bytes(len(y)) for _, y in pairs], object)).any()
    other = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    a = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert not jj.may(np.array([1000]), np.frombuffer(jj.bitmap(a), np.uint64)[None, :], np.array([1000]), np.frombuffer(jj.bitmap(other), np.uint64)[None, :]).any()


def morse(n: int = 1024) -> tuple[str, str]:
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_polynomials_confuse(spark):
    """A Thue-Morse word and its complement have one hash modulo 2**64; they are still two words."""
    one, other = morse()
    docs = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id: r.component_id for r in jj.join_components(docs).collect()} == {1: 1, 2: 2, 3: 1}
    items = spark.createDataFrame([("x", one)], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in find(docs, items).collect()} == {1: 1, 2: 0, 3: 1}


def test_half_of_a_code_is_not_enough():
    """Shingles of which only the first 64 bits agree are not common."""
    a = np.array([[1, 5, 9], [2, 6, 7]], np.uint64)
    b = np.array([[1, 5, 9], [2, 4, 7]], np.uint64)
    twice = np.array([[1, 1, 9], [2, 3, 7]], np.uint64)
    assert (common(a, a), common(a, b), common(twice, a), common(a[:, :0], a)) == (3, 2, 2, 0)


def test_word_array():
    buf = np.frombuffer("ab  cd e".encode(), np.uint8)
    start, end, _ = tk.words(buf, np.array([0, 1, 4, 8]), tk.NOT_BLANK)
    assert tk.word_array(buf, start, end).to_pylist() == [b"a", b"b", b"cd", b"e"]
    assert tk.word_array(buf, start[:0], end[:0]).to_pylist() == []


def test_word_codes():
    """Equal words have equal codes wherever they stand; words that differ in length, in zero bytes or far behind differ."""
    words = ["a", "a\0", "a\0\0", "abcdefgh", "abcdefgh\0", "abcdefghi", "x" * 64, "x" * 65, "x" * 64 + "y", "x" * 63 + "y", *morse(64), *morse()]
    text = " ".join([*words, *words[::-1]])
    buf = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = tk.words(buf, np.array([0, len(buf)]), tk.NOT_BLANK)
    codes = tk.word_codes(buf, start, end)
    assert (codes == codes[:, ::-1]).all()
    assert len(np.unique(codes[0])) == len(np.unique(codes[1])) == len(words)
    assert tk.word_codes(buf, start[:0], end[:0]).shape == (2, 0)
