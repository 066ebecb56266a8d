"""Every operator and stage on nulls, empty and very long texts, repeated rows, shared ids, clashing names and empty tables."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from turnledger.llm import decontaminate, jaccard_join, language_id, licenses, mixing, quality_classifier, quality_rules, substring_dedup, token_counts, toxicity
from turnledger.llm.common import free_shuffles
from turnledger.llm.queries import VOCABULARY

CLASH = ("hub", "key", "seed", "n", "norm", "items", "rep", "y", "x", "fold", "n_words", "row", "spans", "words", "id", "h", "p", "rate", "mix_copies", "mix_rate", "mix_domain", "kept", "n_tokens", "slice", "kind", "domain", "component_id", "best", "total", "score", "__spans")


def texts():
    r = random.Random(13)
    words = [f"{a}{b}" for a in ("the", "con", "re", "ist", "und") for b in ("ta", "mi", "lo", "n", "s")]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = " ".join(f"only{r.randrange(10**6)}" for _ in range(80))
    out = [(i, say(r.randint(50, 200))) for i in range(40)]
    out += [(50, f"{say(60)} {passage}"), (51, f"{passage} {say(70)}"), (52, None), (53, ""), (54, " \n\t "), (None, say(90)), (None, out[3][1]), (None, None)]
    out += [out[5], out[5], (7, say(60)), (7, out[9][1]), (60, say(100_000)), (61, "a" * 1_500_000), (62, "under the mit license " * 20_000), (63, out[4][1])]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(texts(), "doc_id long, text string").withColumn("lang", F.when(F.col("doc_id") % 5 == 0, None).otherwise("en"))
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASH)).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 3 and 1, int(i % 7 == 0)) for i in range(40)] + [(None, 1, 0), (2, None, None), (3, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).withColumn("domain", F.lit("clash"))


def rows_of(docs, out):
    assert out.count() == docs.count()
    assert sorted(map(str, (r.doc_id for r in out.select("doc_id").collect()))) == sorted(map(str, (r.doc_id for r in docs.select("doc_id").collect())))
    return out


def test_operators_give_a_row_for_each_row(spark, docs, labels):
    items = spark.createDataFrame([(1, "under the mit license under the mit license under the mit license under"), (2, None), (None, "x")], "item_id long, text string")
    calls = {
        "op2": lambda d: decontaminate.digest_columns(decontaminate.contamination(d, items)), "op3": lambda d: quality_classifier.quality_scores(d, labels), "op4": lambda d: mixing.mixing_rates(d, mixing.label_domains(labels)),
        "op5": jaccard_join.jaccard_components, "op6": language_id.detect_language, "op7": lambda d: toxicity.toxicity_scores(d, labels), "op8": quality_rules.quality_rules, "op9": lambda d: token_counts.document_token_counts(d, VOCABULARY), "op10": licenses.license_scan,
    }
    for name, call in calls.items():
        out = rows_of(docs, call(docs)).collect()
        assert call(docs.limit(0)).count() == 0, name
        by = {}
        for r in out:
            by.setdefault(r.doc_id, []).append(r)
        if name == "op10":
            assert [(r.n_base, r.labels) for r in by[62]] == [(20_000, "mit")] and by[52][0].labels == ""
        if name == "op9":
            assert by[52][0].n_tokens == 0 and by[60][0].n_tokens > 100_000
        if name == "op5":
            assert all(r.component_id is None for r in by[None]) and {r.component_id for r in by[7]} == {7} and by[9][0].component_id == 7 and by[63][0].component_id == 4
        if name == "op2":
            assert by[62][0].contaminated and by[52][0].n_words == 0


def test_passages(spark, docs):
    out = substring_dedup.repeated_passages(docs).collect()
    assert {(r.doc_id, r.src_doc_id) for r in out} >= {(51, 50), (63, 4)} and None not in {r.doc_id for r in out} and 5 not in {r.doc_id for r in out}
    assert substring_dedup.repeated_passages(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["quality", "near", "passages", "benchmarks", "mix"])
def test_stages_keep_columns_and_rows_without_an_id(spark, docs, labels, name):
    items = spark.createDataFrame([(1, texts()[2][1])], "item_id long, text string")
    call = {
        "quality": quality_rules.quality_stage, "near": lambda d: jaccard_join.near_duplicate_stage(d, n=5, percent=80), "passages": substring_dedup.passage_stage, "benchmarks": lambda d: decontaminate.decontamination_stage(d, items),
        "mix": lambda d: mixing.mixing_stage(d, mixing.label_domains(labels)),
    }[name]
    out = call(docs)
    mine = ["mix_domain", "mix_rate", "mix_copies"]
    want = docs.columns if name != "mix" else [c for c in docs.columns if c not in mine] + mine
    assert out.columns == want and call(docs.limit(0)).count() == 0
    rows = out.collect()
    assert all(r["hub"] == r["__spans"] == r["spans"] == "clash" for r in rows)
    before = {(r.doc_id, r.text) for r in docs.collect()}
    if name != "passages":
        assert {(r.doc_id, r.text) for r in rows} <= before
    if name != "mix":
        assert sum(r.doc_id is None for r in rows) == 3
    if name == "near":
        assert {63, 9} & {r.doc_id for r in rows} == set() and sum(r.doc_id == 5 for r in rows) == 3
    if name == "passages":
        kept = {r.doc_id: r.text for r in rows if r.doc_id not in (None, 7)}
        assert kept[50] == dict(texts())[50] and "only" not in kept[51] and 63 not in kept and kept[53] == "" and kept[52] is None
    if name == "benchmarks":
        assert 2 not in {r.doc_id for r in rows}
    if name == "mix":
        assert all(r.mix_copies >= 1 for r in rows)


def test_benchmark_items_without_an_id(spark, docs):
    """Items of a null id hit words, beside others and alone."""
    rows = [(1, "a b c d e"), (2, "x y z"), (3, "nothing here")]
    items = spark.createDataFrame([(None, "a b c"), (7, "b c d"), (None, "x y"), (None, "q")], "item_id long, text string")
    found = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert {r.doc_id: (r.items, r.n_hit) for r in found.collect()} == {1: ([7, None], 4), 2: ([None], 2), 3: ([], 0)}
    digest = {r.doc_id: r.n_items for r in decontaminate.digest_columns(found).collect()}
    assert digest == {1: 2, 2: 1, 3: 0}


def test_many_benchmark_blocks_share_no_task(spark):
    """A benchmark of 7 blocks: no plan holds more than two searches and the count, and nothing is lost."""
    rows = [(i, f"w{i} only{i} " + " ".join(f"c{k}" for k in range(5))) for i in range(10)]
    items = spark.createDataFrame([(i, f"w{i} only{i}") for i in range(7)], "item_id long, text string").coalesce(1)
    found = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), items, block_chars=1)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 3
    assert {r.doc_id: r.items for r in found.collect()} == {i: [i] if i < 7 else [] for i in range(10)}


def test_freed_native_memory_goes_back(spark):
    status = f"/proc/{spark._jvm.java.lang.ProcessHandle.current().pid()}/status"
    held = lambda: int(re.search(r"VmRSS:\s+(\d+)", open(status).read())[1]) >> 10
    free_shuffles(spark)
    buffers = [spark._jvm.java.nio.ByteBuffer.allocateDirect(1 << 16) for _ in range(4_000)]
    full, buffers = held(), buffers[::50]  # some stay among the freed ones
    free_shuffles(spark)
    assert full - held() > 150 and len(buffers) == 80
