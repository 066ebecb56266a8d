"""The pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

import corpus_pipeline
from turnledger.llm import decontaminate, jaccard_join, quality_rules
from turnledger.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).cache()
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()}, name
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        if name == "quality_rules":
            assert ids == {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()}
        if name == "jaccard_join":
            assert ids == {r.doc_id for r in jaccard_join.jaccard_components(docs, 5, 80).where("component_id = doc_id").collect()}
        if name == "decontamination":
            assert ids == {r.doc_id for r in decontaminate.contamination(docs, table(spark, SF, "benchmark")).where("not contaminated").collect()}
        docs = out
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(ids)
