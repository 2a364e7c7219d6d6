"""The pipeline's stages on a small table, each against its own rule."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from basketlens.llm import near_dedup, packing

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root, docs = tmp_path_factory.mktemp("pipeline"), spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [("documents", docs)]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(root / str(k)))
        docs = spark.read.parquet(str(root / str(k)))
        out.append((name, docs))
    return out


def test_all_but_the_last_return_documents(stages):
    columns = stages[0][1].columns
    assert all(frame.columns == columns for _, frame in stages[1:-1])
    assert [name for name, _ in stages[1:]] == [name for name, _ in corpus_pipeline.STAGES]


def test_each_stage_keeps_what_its_rule_keeps(spark, stages):
    raw, chosen, exact, near, mixed, packed = (frame for _, frame in stages)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    bad = {r.doc_id for r in labels.filter("quality = 0").collect()}
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    left = {r.doc_id for r in chosen.select("doc_id").collect()}
    assert len(good & left) > 0.99 * len(good) and len(bad & left) < 0.3 * len(bad)
    texts = Counter(r.t for r in chosen.selectExpr("lower(text) t").collect())
    assert Counter(r.t for r in exact.selectExpr("lower(text) t").collect()) == Counter(set(texts))
    kept = near_dedup.near_groups(exact).filter("kept").select("doc_id").collect()
    assert Counter(r.doc_id for r in near.collect()) == Counter(r.doc_id for r in kept)
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in near.collect()}
    encoder = packing.Encoder(packing.vocabulary())
    want = Counter()
    for row in mixed.collect():
        want[row.doc_id, len(encoder.encode(row.text)) // 4 + 1] += 1
    found = packed.collect()
    assert sum(r.length for r in found) == sum(n * k for (_, n), k in want.items())
    assert all(len(np.frombuffer(r.ids, "<u4")) == r.length for r in found)
    assert Counter((r.doc_id, r.doc_tokens) for r in found if r.start == 0) == want


def test_run_gives_the_rows_of_the_stages(spark, stages):
    columns = ["doc_id", "start", "length", "ids_crc32"]
    rows = lambda frame: Counter(tuple(r) for r in frame.select(*columns).collect())
    assert rows(corpus_pipeline.run(spark, SMALL)) == rows(stages[-1][1])


def test_stages_take_empty_and_odd_tables(spark):
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    odd = [(None, None, None, None, None), (5, "", "en", None, 0), (5, "", "en", None, 0), (6, "words " * 30_000, None, "src0", -1)]
    for data in ([], odd):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
        assert (docs.count() > 0) == bool(data)
