"""Readers and writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.functions.scalars import hash_order
from turnledger.schema import CALIBRATION_DOCUMENT


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Zstandard Parquet that refuses to overwrite; the committer publishes all files at once."""
    out = df.write.option("compression", "zstd").mode("errorifexists")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """Calibration documents, one JSON object a file, under a declared schema."""
    return spark.read.schema(CALIBRATION_DOCUMENT).option("multiLine", True).json(list(paths))


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines; refuses to overwrite."""
    df.write.mode("errorifexists").json(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_document(spark: SparkSession, value: dict, path: str) -> None:
    """One small JSON document with sorted keys: written beside its place, then renamed; refuses to overwrite."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if system.exists(target):
        raise FileExistsError(path)
    part = spark._jvm.org.apache.hadoop.fs.Path(path + ".writing")
    stream = system.create(part, True)
    stream.write(bytearray(json.dumps(value, sort_keys=True, indent=2).encode() + b"\n"))
    stream.close()
    if not system.rename(part, target):
        raise OSError(f"can't rename to {path}")


def sampled_turns(turns: DataFrame, step: int, full_steps: tuple[int, ...] = (), n: int = 8) -> DataFrame:
    """All turns on listed steps, else n of them in the order of a hash."""
    return turns if step in full_steps else turns.orderBy(hash_order("turn-sample", F.col("turn_id"))).limit(n)


def file_hashes(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, length, sha256) of whole files."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "length", F.sha2("content", 256).alias("sha256"))
