"""Readers, writers, the stream and the registered queries."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from turnledger.sources import documents, tables
from turnledger.streaming import steps


def test_round_trips(spark, tmp_path):
    df = spark.range(5).select("id", (F.col("id") % 2).alias("batch_index"))
    path = str(tmp_path / "p")
    tables.write_parquet(df, path, ["batch_index"])
    assert tables.read_parquet(spark, path).count() == 5 and (tmp_path / "p" / "batch_index=1").is_dir()
    with pytest.raises(AnalysisException):
        tables.write_parquet(df, path)
    tables.append_json(df, str(tmp_path / "j"))
    tables.append_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 10
    doc = str(tmp_path / "d.json")
    tables.write_document(spark, {"b": 1, "a": [2]}, doc)
    assert json.loads(open(doc).read()) == {"a": [2], "b": 1}
    with pytest.raises(FileExistsError):
        tables.write_document(spark, {}, doc)
    assert tables.file_hashes(spark, doc).first().length > 0
    turns = spark.range(20).select(F.col("id").cast("string").alias("turn_id"))
    assert tables.sampled_turns(turns, 2, (2,)).count() == 20 and tables.sampled_turns(turns, 3, (2,)).count() == 8


def test_each_step(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "global_step int, turn_id string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("global_step int, turn_id string").parquet(str(tmp_path / "in"))
    got = {}
    q = steps.each_step(stream, lambda df, step: got.__setitem__(step, df.count()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert got == {1: 2, 2: 1}


def test_windowed_rates(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2026-01-01 00:10:00' AS ts, 'search' AS action_type, 1.0D AS utility UNION ALL SELECT timestamp'2026-01-01 00:50:00', 'search', 2.0D UNION ALL SELECT timestamp'2026-01-01 01:10:00', 'answer', 4.0D")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, action_type string, utility double").parquet(str(tmp_path / "in"))
    q = steps.windowed_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.action_type, r.n, r.utility) for r in spark.table("rates").collect()) == [("answer", 1, 4.0), ("search", 2, 3.0)]


def test_file_hash_query(spark):
    import hashlib

    from turnledger.plans import registry

    sf = "/root/testdata/sf0.001"
    for r in registry.s6_f16_file_hashes(spark, sf).collect():
        raw = open(f"{sf}/{r.name}", "rb").read()
        assert (r.length, r.sha256) == (len(raw), hashlib.sha256(raw).hexdigest())


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_documents_of_any_number_of_rows(spark, tmp_path):
    """Canonical documents, one a batch, all or none, and none over another."""
    path = str(tmp_path / "documents")
    heads = spark.createDataFrame([('a"/1', 0.5), ("b", None)], "batch_id string, x double").select("batch_id", F.struct("x").alias("numeric_reference"))
    rows = spark.range(500).select(F.when(F.col("id") % 5 == 0, 'a"/1').otherwise("b").alias("batch_id"), F.col("id").cast("string").alias("turn_id"), (F.col("id") / 2).alias("g_directed"))
    documents.write_batch_documents(heads, {"search": rows, "answer": rows.limit(0)}, path)
    files = sorted(p.name for p in (tmp_path / "documents").iterdir())
    assert files == ["batch-a%22%2F1.json", "batch-b.json"]
    texts = {f: (tmp_path / "documents" / f).read_text() for f in files}
    for text in texts.values():
        value = json.loads(text)
        assert list(value) == sorted(value) and value["search"]["rows"] == sorted(value["search"]["rows"], key=json.dumps)
    read = tables.read_documents(spark, path).select("batch_id", F.size("search.rows").alias("n"), "numeric_reference.same_shape_repeat_max_abs_difference").collect()
    assert {r.batch_id: r.n for r in read} == {'a"/1': 100, "b": 400}
    with pytest.raises(Exception, match="FileExists|documents"):
        documents.write_batch_documents(heads, {"search": rows}, path)
    assert {f: (tmp_path / "documents" / f).read_text() for f in files} == texts


def test_a_failed_document_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "documents")
    heads = spark.createDataFrame([("a", 1), ("a", 2)], "batch_id string, x int")  # a value that is there twice
    with pytest.raises(Exception, match="twice"):
        documents.write_batch_documents(heads, {}, path)
    assert not [p for p in (tmp_path / "documents").rglob("*") if p.is_file()]


def test_a_step_written_again_is_one_line(spark, tmp_path):
    path = str(tmp_path / "log")
    steps_of = lambda mark, *ids: spark.createDataFrame([(i, f"{mark}{i}") for i in ids], "global_step int, payload string").repartition(3)
    documents.append_steps(steps_of("a", 1, 2, 3), path)
    documents.append_steps(steps_of("b", 3, 4), path)
    assert sorted(tuple(r) for r in documents.read_steps(spark, path).collect()) == [(1, "a1"), (2, "a2"), (3, "b3"), (4, "b4")]
    with pytest.raises(Exception, match="twice|two tasks"):
        documents.append_steps(steps_of("c", 5, 5), path)
    assert documents.read_steps(spark, path).count() == 4
    assert documents.read_steps(spark, str(tmp_path / "none")).count() == 0
