"""The pipeline: every stage on what the one before it kept, against brute force."""

from collections import defaultdict

import helpers
from test_operators import TOKENIZER, check_packed, linked

import corpus_pipeline
from pixelloom.llm import common as C
from pixelloom.llm import mixing, quality


def test_odd_and_empty_tables(spark, tmp_path):
    for name, docs in (("odd", helpers.odd(spark)), ("empty", helpers.empty(spark))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        helpers.labels(spark, [(1, 1, 0), (2, 1, 0), (3, 1, 0), (6, 1, 1)]).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        if name == "empty":
            assert not rows
        else:  # all labels are 1, so all documents pass; copies are one, and the empty text has size 0
            assert {r.doc_id for r in rows} == {2, 3, 5, 6}
            assert sum(r.piece == 0 for r in rows if r.doc_id == 2) >= 2


def test_stages(spark):
    d = "/root/testdata/sf0.01"
    docs = C.load(spark, d, "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = C.materialize(stage(spark, docs, d), "stage")
        kept.append(docs)
        assert name == "best-fit packing" or docs.columns == columns
    good, unique, apart, mixed, packed = kept
    texts = helpers.texts(good)
    assert set(texts) == {r.doc_id for r in quality.score_quality(C.load(spark, d, "documents"), C.load(spark, d, "labels")).filter("predicted = 1").collect()}
    last = {t: k for k, t in sorted(texts.items())}
    assert helpers.texts(unique) == {k: t for t, k in last.items()}
    found = linked(helpers.texts(unique), 5, 80, 100)
    assert set(helpers.texts(apart)) == {k for k, (_, root) in found.items() if root == k}
    taken = {r.doc_id: r.taken // max(r.size, 1) for r in mixing.mix(apart).collect()}
    copies = defaultdict(int)
    for r in mixed.select("doc_id").collect():
        copies[r.doc_id] += 1
    assert copies == {k: n for k, n in taken.items() if n}
    check_packed(packed.collect(), helpers.texts(mixed))
    assert TOKENIZER and packed.filter("piece = 0").count() == mixed.count()
