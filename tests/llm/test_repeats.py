"""The substring operators at their borders: frequent anchors, colliding hashes, and an index that goes on."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import DOCS, hard
from tests.llm.test_brute import expected_bytes, expected_words, texts
from tidemill.llm import repeats, suffix_dedup
from tidemill.llm import textkit as tk
from tidemill.llm.substring_dedup import FingerprintIndex, drop_repeated_windows
from tidemill.llm.suffix_dedup import drop_repeats, maximal_repeats


@pytest.mark.parametrize("hot", [0, 41, 43])
def test_frequent_anchors(spark, hot):
    """Windows of anchors on either side of the limit: the same bytes and words go. The hard table holds a group of 40 copies and more."""
    docs = spark.createDataFrame(hard(), DOCS)
    rows = texts(docs)
    found = drop_repeats(docs, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, found)) == Counter(expected_bytes(rows))
    found = drop_repeated_windows(docs, 2, hot=hot).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, found)) == Counter(expected_words(rows))


def test_identical_by_bytes_whatever_the_hash():
    rng = random.Random(4)
    strings = [bytes(rng.choices(b"ab", k=rng.randrange(1, 6))) for _ in range(300)]
    size = np.array(list(map(len, strings)))
    buf = np.frombuffer(b"".join(strings), np.uint8)
    for hashes in (np.zeros(300, np.uint64), size.astype(np.uint64)):
        number, one = repeats.identical(buf, np.cumsum(size) - size, size, hashes)
        assert len(one) == len(set(strings)) and set(number) == set(range(len(one)))
        assert all((strings[i] == strings[j]) == (number[i] == number[j]) for i in range(300) for j in range(i))
        assert all(strings[k] == strings[i] for i, k in enumerate(one[number]))


def test_a_chunk_takes_another_base_when_hashes_meet(monkeypatch):
    """The first base hashes all to one: contents stay apart."""
    import pyarrow as pa

    true = tk.ranges
    monkeypatch.setattr(repeats.tk, "ranges", lambda s, a, b, base=tk._MUL: true(s, a, b, base) * np.uint64(base != 5))
    monkeypatch.setattr(repeats, "BASES", (5, tk._MUL))
    rng = random.Random(1)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(80))
    table = pa.table({"chunk": pa.array([7], pa.int32()), "doc_id": [1], "text": [text]})
    kind = suffix_dedup.KIND
    _, _, h = kind.runs(kind.cut(*tk.utf8(table.column("text"))))
    answers = pa.table({"shared": repeats.lists(h, np.array([0, len(h)]), pa.int64()), "hot": pa.array([[]], pa.list_(pa.int64()))})
    out = repeats.send(kind, 3)(table, answers)
    assert set(out.column("base").to_pylist()) == {1}
    assert sum(map(len, out.column("ch").to_pylist())) == len(set(h.tolist()))


def test_maximal_repeats_against_all_pairs():
    """Groups and occurrences of every maximal repeat, against its definition."""
    rng = random.Random(9)
    for least in (2, 3, 4):
        segments = [bytes(rng.choices(b"ab", k=rng.randrange(least, 12))) for _ in range(6)]
        size = np.array(list(map(len, segments)))
        group, length, seg, off = maximal_repeats(np.frombuffer(b"".join(segments), np.uint8), np.cumsum(size) - size, size, least)
        found = {}
        for g, n, s, o in zip(group.tolist(), length.tolist(), seg.tolist(), off.tolist(), strict=True):
            found.setdefault((g, segments[s][o : o + n]), set()).add((s, o))
        places: dict[bytes, set] = {}
        for s, text in enumerate(segments):
            for a in range(len(text)):
                for b in range(a + least, len(text) + 1):
                    places.setdefault(text[a:b], set()).add((s, a))
        expected = {}
        for text, at in places.items():
            before = {segments[s][a - 1] if a else None for s, a in at}
            after = {segments[s][a + len(text)] if a + len(text) < len(segments[s]) else (s, a) for s, a in at}
            if len(at) > 1 and (len(before) > 1 or None in before) and len(after) > 1:
                expected[text] = at
        assert {t: at for (_, t), at in found.items()} == expected and len(found) == len(expected)


def test_index_goes_on(spark, tmp_path):
    """A window seen once in an earlier session is found in a later batch; runs are compacted and buckets split on the way."""
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(n))
    once, other = prose(20), prose(20)
    batches = [
        [(1, f"{prose(50)} {once} {prose(50)}"), (2, prose(80)), (3, None)],
        [(10, prose(60)), (11, f"{prose(5)} {other}")],
        [(20, f"{prose(30)} {once} {prose(9)}"), (21, f"{other} {prose(3)}"), (22, f"{prose(2)} {prose(30)}")],
        [(5, f"{once} {prose(4)}"), (6, prose(40)), (7, prose(40))],
    ]
    root = f"file://{tmp_path}/index"
    seen: list[tuple] = []
    for k, rows in enumerate(batches):
        index = FingerprintIndex(spark, root, buckets=3)  # opened anew each time
        assert len(index.state["texts"]) == k
        got = {r.doc_id: (r.n_words, r.n_removed) for r in index.add(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        order = [(len(seen) + i, t or "") for i, (_, t) in enumerate(rows)]
        expected = {r[0]: r[1:3] for r in expected_words([*seen, *order])}
        assert got == {d: expected[n] for (d, _), (n, _) in zip(rows, order, strict=True)}
        seen += order
        index.close()
    assert len(FingerprintIndex(spark, root).state["runs"]) == 2 and FingerprintIndex(spark, root).state["buckets"] > 3
    assert got[5] == (24, 20)


def test_suffixes_are_told_apart_when_their_heads_collide(monkeypatch):
    """All heads under one hash: the same groups as before."""
    rng = random.Random(3)
    segments = [bytes(rng.choices(b"ab", k=rng.randrange(9, 30))) for _ in range(40)]
    size = np.array(list(map(len, segments)))
    buf, begin = np.frombuffer(b"".join(segments), np.uint8), np.cumsum(size) - size

    def groups():
        group, length, seg, off = (x.tolist() for x in maximal_repeats(buf, begin, size, 9))
        found: dict = {}
        for g, n, s, o in zip(group, length, seg, off, strict=True):
            found.setdefault(g, []).append((n, s, o))
        return sorted(sorted(x) for x in found.values())

    expected = groups()
    monkeypatch.setattr(suffix_dedup.tk, "ranges", lambda sums, a, b: np.zeros(len(a), np.uint64))
    assert expected and groups() == expected
