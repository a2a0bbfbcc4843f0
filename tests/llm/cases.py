"""A small table of hard cases: nulls, empty and long texts, ties, repeated rows, blanks, other scripts."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def hard() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, long, passage = prose(120), prose(30_000), prose(40)
    changed = base.split()
    changed[60] = "CHANGED"
    texts = [
        None, "", "   ", "one", "one", "one two three four five", "ONE two three four five", "one two three four", base, base, base.upper(), " ".join(changed),
        long, long, long[:-40], passage, f"{prose(30)} {passage} {prose(30)}", f"{passage}\n{passage}", "ab" * 400, "ba" * 400, "a" * 49, "a" * 50, "a" * 300,
        "été ß中文字符 " * 30, "中" * 60, "x\ty\nz\x0bq " * 20, "tail " * 30, "12 34 !! ??", "<s> [PAD] <|end|> " * 3, "cafés! don't — ẞİ \U0001f600\U0001f600", "word-" * 40,
    ]
    rows = [(i * 3, t, "en" if i % 2 else None, f"s{i % 4}" if i % 5 else None, len(t) if t else None) for i, t in enumerate(texts)]
    rows += [(900 + i, base, "en", "hot", len(base)) for i in range(40)]  # a large group of copies
    rows += [(None, base, "en", "s1", 1), (None, "nothing else has this text " * 9, None, None, None)]
    rows += [rows[8], rows[12]]  # repeated rows
    rng.shuffle(rows)
    return rows
