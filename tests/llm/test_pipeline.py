"""The corpus pipeline, stage by stage, against what its operators decide."""

import corpus_pipeline
from clipsift.llm import langid, quality, queries
from clipsift.llm._common import fold_of
from pyspark.sql import functions as F

from test_corpus_operators import slow_representatives


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    learnable = fold_of(F.col("doc_id"), 4) != 2
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == columns and out.exceptAll(docs).isEmpty()
        if name == "language":
            model = langid.learn(docs, learnable)
            keeps = {r.doc_id for r in langid.predict(docs, model).where(f"lang_pred <> 'und' and score >= {corpus_pipeline.LANGUAGE_SHARE}").collect()}
        elif name == "quality":
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            keeps = {r.doc_id for r in quality.predict(docs, quality.learn(docs, labels, learnable)).where(f"score >= {corpus_pipeline.QUALITY_SCORE}").collect()}
        else:
            rows = sorted((r.doc_id, r.text) for r in docs.collect())
            keeps = [rows[k][0] for k in slow_representatives(rows, 0.8)]
            kept = [r.doc_id for r in out.collect()]
            assert len(keeps) < len(rows) and set(keeps) <= set(kept) and len(kept) - len(keeps) <= 0.1 * (len(rows) - len(keeps))
            keeps = kept  # what SimHash doesn't propose stays
        assert sorted(r.doc_id for r in out.collect()) == sorted(keeps)
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_registered(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names and len([n for n in names if n.startswith("op")]) >= 10
