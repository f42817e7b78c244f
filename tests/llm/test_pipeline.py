"""The pipeline against plain versions of its stages."""

import hashlib

import corpus_pipeline as pipeline
from txnweave.llm import quality_rules
from txnweave.llm.common import new_path

from .conftest import SCHEMA
from .test_operators import plain_components, plain_hits, plain_line_dedup, plain_metrics, words
from .test_bpe import LIBRARY


def write(spark, docs, labels, items):
    folder = new_path(spark, "input")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    return folder


def plain_pipeline(rows, items):
    ok = lambda t: (m := plain_metrics(t))[0] >= 10 and 100 * m[4] <= 20 * m[0]
    rows = [(i, t) for i, t in rows if ok(t)]
    rows = [(i, new) for (i, t), (_, new) in zip(rows, plain_line_dedup(rows), strict=True) if new == t or words(new)]
    rows = sorted({r for r, c in zip(rows, plain_components(rows, 5), strict=True) if c[3]}, key=str)
    rows = [r for r, h in zip(rows, plain_hits(rows, items), strict=True) if not h[2]]
    ids = [LIBRARY.encode_ordinary(t) for _, t in rows]
    return {(i, len(x), hashlib.sha256(b"".join(n.to_bytes(4, "little") for n in x)).hexdigest(), True) for (i, _), x in zip(rows, ids, strict=True)}


def test_pipeline(spark, docs, labels, items):
    """With so few labels the quality stage has its base rules alone."""
    docs = docs.where("doc_id IS NOT NULL")
    folder = write(spark, docs, labels, items)
    assert quality_rules.ALPHA == 0.02
    out = pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "round_trip")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {tuple(r) for r in out.collect()} == plain_pipeline(rows, [(r.item_id, r.text) for r in items.collect()])


def test_pipeline_stages_keep_columns(spark, docs, labels, items):
    folder = write(spark, docs, labels, items)
    current = docs
    for _, stage in pipeline.STAGES[:-1]:
        path = new_path(spark, "stage")
        stage(spark, current, folder).write.parquet(path)
        current = spark.read.parquet(path)
        assert current.columns == docs.columns


def test_pipeline_of_nothing(spark, labels, items):
    folder = write(spark, spark.createDataFrame([], SCHEMA), labels, items)
    assert pipeline.run(spark, folder).count() == 0
