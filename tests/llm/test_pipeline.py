"""The pipeline's stages by brute force on a small folder."""

import re

import corpus_pipeline
import pytest
from test_corpus import components, corpus, repeats


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}", len(t or "")) for i, t in enumerate(corpus(9))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    one = steps["language_id"](spark, docs, folder)
    kept = {r.doc_id: r.text for r in one.collect()}
    assert kept == {i: t for i, t in before.items() if re.search(r"[^\W\d_]", t or "")} and one.columns == corpus_pipeline.COLUMNS
    two = steps["ngram_jaccard_join"](spark, one, folder)
    ids = sorted(kept)
    group = components([kept[i] for i in ids], ids)
    single = {r.doc_id: r.text for r in two.collect()}
    assert single == {i: kept[i] for i in ids if group[i][1] == i} and two.columns == corpus_pipeline.COLUMNS
    three = steps["suffix_array_dedup"](spark, two, folder)
    ids = sorted(single)
    want = {i: r[3].decode("utf-8", "ignore") for i, r in zip(ids, repeats([single[i] for i in ids], 100))}
    got = {r.doc_id: r.text for r in three.collect()}
    assert got == want and three.columns == corpus_pipeline.COLUMNS
    four = steps["source_mix"](spark, three, folder)
    total = sum(len(t.split()) for t in got.values())
    assert abs(sum(len(r.text.split()) for r in four.collect()) - 1.5 * total) <= 3 and four.columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.run(spark, folder).count() == four.count()
