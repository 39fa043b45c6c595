"""The stages one after the other, and the registration."""

import importlib

import corpus_pipeline
from timekeel.llm import quality, secret_scan
from timekeel.llm.queries import QUERIES


def test_stages_are_those_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "secrets", "packing"]
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    entry = importlib.import_module("__spark_entry__")
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_pipeline_equals_the_stages_in_plain_steps(spark, docs, small):
    frame, counts = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, frame, small)
        assert after.columns == docs.columns
        frame = spark.createDataFrame(after.collect(), docs.schema)
        counts.append(frame.count())
    rows = frame.collect()
    assert counts[0] >= counts[1] >= counts[2] == counts[3] > 100
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert all(quality.counts(t)[0] >= 50 for t in texts.values())
    assert all(secret_scan.mask(t) == t for t in texts.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, small)
    assert {r["doc_id"] for r in packed.collect()} == set(texts)


def test_run_on_a_small_table(spark, small):
    out = corpus_pipeline.run(spark, small).toPandas()
    assert len(out) > 50 and (out.groupby("sequence_id").length.sum() <= 2048).all()
