"""Operators that SQL cannot say, against brute force over the whole smallest table and a table of hard cases."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from hashlib import blake2b, sha256
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import DOCS, hard
from tidemill.llm import fingerprint, packing
from tidemill.llm.near_dedup import near_duplicates, op10_near_dedup
from tidemill.llm.substring_dedup import drop_repeated_windows
from tidemill.llm.suffix_dedup import drop_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(params=["table", "hard"])
def docs(request, spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet") if request.param == "table" else spark.createDataFrame(hard(), DOCS)


def texts(docs) -> list[tuple]:
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def order(doc_id) -> float:
    return float("inf") if doc_id is None else doc_id


def runs(gone) -> int:
    return sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))


def expected_bytes(rows) -> list[tuple]:
    rows = [(d, t.encode()) for d, t in rows]
    least: dict[bytes, float] = {}
    for d, b in rows:
        for s in {b[i : i + 50] for i in range(len(b) - 49)}:
            least[s] = min(least.get(s, float("inf")), order(d))
    expected = []
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < order(d):
                gone[i : i + 50] = b"\1" * 50
        expected.append((d, len(b), sum(gone), runs(gone), sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return expected


def test_suffix_dedup(docs):
    expected = expected_bytes(texts(docs))
    found = [tuple(r) for r in drop_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert Counter(found) == Counter(expected)


def expected_words(rows) -> list[tuple]:
    rows = [(d, WORD.findall(t)) for d, t in rows]
    least: dict[tuple, float] = {}
    for d, w in rows:
        for s in {tuple(w[i : i + 13]) for i in range(len(w) - 12)}:
            least[s] = min(least.get(s, float("inf")), order(d))
    expected = []
    for d, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if least[tuple(w[i : i + 13])] < order(d):
                gone[i : i + 13] = [True] * 13
        expected.append((d, len(w), sum(gone), sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return expected


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_substring_dedup(docs, batches):
    expected = expected_words(texts(docs))
    found = [tuple(r) for r in drop_repeated_windows(docs, batches).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert Counter(found) == Counter(expected)


def shingle_sets(rows, width: int = 5) -> dict:
    """Of each id that is not null, the set of its shingles."""
    sets: dict = {}
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    return sets


def components(sets: dict) -> dict:
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in combinations(sorted(d for d, s in sets.items() if s), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: root(d) for d in sets}


def test_near_dedup(docs):
    docs = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    sets = shingle_sets(texts(docs))
    of = components(sets)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert found == {d: (len(s), of[d], of[d] == d) for d, s in sets.items()}


def linked(sets: dict) -> list[tuple]:
    """All links between different sets, by an inverted index of each set's rarest shingles: two sets at 0.85 must share one of those."""
    often = Counter(x for s in sets.values() for x in s)
    index, found = defaultdict(list), []
    for d, s in sorted(sets.items(), key=lambda p: len(p[1])):
        rare = sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-85 * len(s) // 100) + 1]
        for e in {e for x in rare for e in index[x]}:
            common = len(s & sets[e])
            if 100 * common >= 85 * len(s | sets[e]):
                found.append((e, d))
        for x in rare:
            index[x].append(d)
    return found


def test_near_dedup_recall(spark):
    """No link is lost among ten thousand documents, and components are exact."""
    sets = shingle_sets(texts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")))
    least: dict[frozenset, int] = {}
    for d, s in sorted(sets.items()):
        least.setdefault(frozenset(s), d)
    links = linked({d: s for s, d in least.items() if s})
    found = {r.doc_id: r.component_id for r in op10_near_dedup(spark, "/root/testdata/sf0.1").collect()}
    assert links and all(found[a] == found[b] for a, b in links)
    parent = {d: d for d in least.values()}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert found == {d: root(least[frozenset(s)]) if s else d for d, s in sets.items()}


def test_near_dedup_keeps_every_row(docs):
    assert Counter(r.doc_id for r in near_duplicates(docs).collect()) == Counter(d for d, _ in texts(docs))


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    path = packing.vocabulary()
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path).collect()
    places, parts = defaultdict(list), defaultdict(list)
    for p in pieces:
        places[p.sequence_id].append((p.offset, p.length))
        parts[p.doc_id].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
    padding = 0
    for at in places.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert 0 < end <= 4096
        padding += 0 if end & (end - 1) == 0 else 4096 - end
    assert padding == 0
    owned = defaultdict(list)
    for d, t in texts(docs):
        owned[d].append(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4"))
    assert owned.keys() == parts.keys()
    for d, held in owned.items():
        if len(held) > 1:  # rows of one id: their tokens in sum
            assert sum(n for _, n, _, _ in parts[d]) == sum(map(len, held))
            continue
        at = 0
        for start, length, crc, total in sorted(parts[d]):
            assert (start, total, crc) == (at, len(held[0]), zlib.crc32(held[0][start : start + length].tobytes()))
            at += length
        assert at == len(held[0])


def test_hilbert_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert(grid, 3)
    path = grid[np.argsort(key)]
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def plain_tree(text: str) -> list[list[str]]:
    """Sections of paragraphs, as strings: a section ends before a blank line and behind a paragraph whose hash says so."""
    sections: list[list[str]] = [[]]
    for line in text.split("\n"):
        if not line.strip(" \t\r\x0b\x0c") and sections[-1]:
            sections.append([])
        sections[-1].append(line)
        if blake2b(line.encode(), digest_size=8).digest()[0] % 8 == 0:
            sections.append([])
    return [s for s in sections if s]


def plain_pieces(paragraph: str) -> list[bytes]:
    """Runs of up to 40 bytes that start afresh behind a run of stops."""
    out, raw, at = [], paragraph.encode(), 0
    while at < len(raw):
        to = at
        while to < len(raw) and to - at < 40 and raw[to] not in b".!?":
            to += 1
        while to < len(raw) and raw[to] in b".!?":
            to += 1
        out.append(raw[at:to])
        at = to
    return out


def plain_walk(a: str, b: str) -> tuple[float, list[int]]:
    """Likeness and touched paragraphs by comparing strings, level by level."""
    if a == b:
        return 1.0, []
    trees = [[[(n, p) for p in s] for n, s in enumerate(plain_tree(t))] for t in (a, b)]
    number, out = 0, []
    for t in trees:
        number = 0
        out.append([[(number := number + 1) - 1 for _ in s] for s in t])
    total = sum(len(plain_pieces(p)) for t in trees for s in t for _, p in s)
    common = 0
    lone: list[list[tuple[int, str]]] = []
    for k in (0, 1):
        spare = Counter(tuple(p for _, p in s) for s in trees[1 - k])
        rest = []
        for s, numbers in zip(trees[k], out[k], strict=True):
            key = tuple(p for _, p in s)
            if spare[key]:
                spare[key] -= 1
                common += sum(len(plain_pieces(p)) for p in key) if k == 0 else 0
            else:
                rest += [(n, p) for n, (_, p) in zip(numbers, s, strict=True)]
        lone.append(rest)
    both = Counter(p for _, p in lone[0]) & Counter(p for _, p in lone[1])
    common += sum(len(plain_pieces(p)) * n for p, n in both.items())
    left = []
    for rest in lone:
        spare, kept = both.copy(), []
        for n, p in rest:
            if spare[p]:
                spare[p] -= 1
            else:
                kept.append((n, p))
        left.append(kept)
    marks = [Counter(x for _, p in kept for x in plain_pieces(p)) for kept in left]
    common += sum((marks[0] & marks[1]).values())
    return min(2 * common / total if total else 0.0, 1 - 1e-9), [n for n, _ in left[0]]


def test_fingerprint_query(spark, sf_dir):
    """Likenesses and edited paragraphs against strings compared level by level; fingerprints equal for equal texts alone."""
    rows = sorted(texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    found = {r.doc_id: r for r in fingerprint.op1_fingerprint(spark, sf_dir).collect()}
    assert len(found) == len(rows)
    prints: dict[str, set] = defaultdict(set)
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        r = found[d]
        prints[t].add(r.fingerprint)
        prints[edited].add(r.edited_fingerprint)
        assert (r.n_chars, r.edited_sha256) == (len(t), sha256(edited.encode()).hexdigest())
        near, at = plain_walk(t, edited)
        assert (r.near_edited, r.edited_at) == (pytest.approx(near), at)
        assert r.near_next == pytest.approx(plain_walk(t, after)[0])
        assert (r.near_edited == 1) == (edited == t) and (r.near_next == 1) == (after == t)
    assert all(len(p) == 1 for p in prints.values())
    assert len({p for own in prints.values() for p in own}) == len(prints)
    near = [r.near_edited for r in found.values() if r.n_chars > 200]
    far = [r.near_next for r in found.values() if r.n_chars > 200]
    assert np.mean(near) > np.mean(far) + 0.3


@pytest.mark.parametrize("buckets", [1, 3])
def test_next_of_large_ids(spark, buckets):
    """Ids that doubles cannot tell apart are still taken in ascending order."""
    rows = [((1 << 60) + k, f"Text number {k} of a few. " * (k + 2)) for k in range(40)] + [(-(1 << 62) - 1, "least"), (7, "middle"), ((1 << 63) - 1, "last")]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string")
    found = {r.doc_id: r.edited_sha256 for r in fingerprint.with_next(docs, buckets).mapInArrow(fingerprint._paired, fingerprint._PAIRED).collect()}
    rows.sort()
    for k, (d, t) in enumerate(rows):
        cut = len(t) // 4
        assert found[d] == sha256((t[: len(t) - cut] + rows[(k + 1) % len(rows)][1][:cut]).encode()).hexdigest()


def test_fingerprint_locates_edits():
    text = "\n\n".join(f"Paragraph {i} says that {i * 7} things happened. They were {i * 3} in all." for i in range(40))
    a = fingerprint.encode(*fingerprint.tree(text))
    b = fingerprint.encode(*fingerprint.tree(text.replace("Paragraph 17 says", "Paragraph 17 claims")))
    assert fingerprint.differences(a, a) == ([], [])
    assert fingerprint.differences(a, b) == ([34], [34])
    assert fingerprint.likeness(a, b) > 0.8


def test_pipeline(spark, sf_dir):
    """Stage by stage: what each keeps is what brute force keeps of that stage's own input."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        rows = docs.collect()
        kept[name] = rows
        assert docs.columns == before.columns
        docs = spark.createDataFrame(rows, docs.schema)
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert all(re.search(r"[^\W\d_]", r.text or "") for r in kept["language_id"])
    assert len(kept["language_id"]) > 0.9 * sum(bool(re.search(r"[^\W\d_]", r.text or "")) for r in whole)
    assert {r.doc_id: r.text for r in kept["line_dedup"]} == without_boilerplate(kept["language_id"])
    sets = shingle_sets([(r.doc_id, r.text) for r in kept["line_dedup"]])
    assert {r.doc_id for r in kept["near_dedup"]} == {d for d, c in components(sets).items() if d == c}
    items = [contamination_words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {r.doc_id for r in kept["decontaminate"]} == {r.doc_id for r in kept["near_dedup"] if not contaminated(r.text, items)}
    packed = cp.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept["decontaminate"]}
    assert cp.run(spark, sf_dir).agg(F.sum("length")).first()[0] == packed.agg(F.sum("length")).first()[0]


def without_boilerplate(rows) -> dict:
    """Texts without the lines of ten sites or more, but for each one's first place; texts of which nothing is left then are out."""
    sites, first = defaultdict(set), {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        for n, line in enumerate(r.text.split("\n")):
            line = line.strip(" ")
            first.setdefault(line, (r.doc_id, n))
            if r.source is not None:
                sites[line].add(r.source)
    out = {}
    for r in rows:
        parts = r.text.split("\n")
        kept = [p for n, p in enumerate(parts) if not (q := p.strip(" ")) or len(sites[q]) < 10 or first[q] == (r.doc_id, n)]
        if len(kept) == len(parts) or "\n".join(kept).strip(" "):
            out[r.doc_id] = "\n".join(kept)
    return out


def contamination_words(text) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(text, items) -> bool:
    windows = {tuple(w[i : i + min(13, len(w))]) for w in items if w for i in range(len(w) - min(13, len(w)) + 1)}
    w = contamination_words(text)
    gone = [False] * len(w)
    for size in {len(x) for x in windows}:
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in windows:
                gone[i : i + size] = [True] * size
    return any(gone) and 20 * sum(gone) >= len(w)
