"""The stages of the pipeline do the whole job."""

from __future__ import annotations

import corpus_pipeline as cp
from tests.llm.cases import DOCS
from tidemill.llm import decontaminate


def test_spans_are_cut(spark, tmp_path):
    """Below the coverage limit whole items go out of a long document, at its ends too; what has no hit stays as it is."""
    item, other = (" ".join(f"{c}{i}" for i in range(20)) for c in "bé")
    prose = [" ".join(f"p{n}x{i}" for i in range(600)) for n in range(3)]
    long = f"{item.upper()}. {prose[0]}\n({item}) {prose[1]}; {other}, {prose[2]} — {other}!"
    texts = [long, prose[0], None, "", f"some words {item}"]
    spark.createDataFrame([("1", item), ("2", other)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", 7) for i, t in enumerate(texts)], DOCS)
    out = {r.doc_id: r for r in cp.benchmark(spark, docs, str(tmp_path)).collect()}
    assert sorted(out) == [0, 1, 2, 3]
    assert out[0].text == f"{prose[0]}\n({prose[1]}; {prose[2]} — !"
    assert out[0].n_chars == len(out[0].text)
    assert [out[i].text for i in (1, 2, 3)] == texts[1:4]
    items = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    assert not decontaminate.find(spark.createDataFrame(list(out.values()), DOCS), items).filter("n_hit > 0").count()


def test_short_lines_go(spark, tmp_path):
    """A menu line on ten sites goes however short it is; on nine sites it stays, and so do blank lines."""
    rows = [(i, f"{'Menu' if i < 10 else ' Ok '}\n\nown words of {i}\n \n", "en", f"site{i}", 1) for i in range(19)]
    out = {r.doc_id: r.text for r in cp.lines(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()}
    assert out == {i: t if i in (0, *range(10, 19)) else t.removeprefix("Menu\n") for i, t, *_ in rows}
