"""Operator 9: token counts by a separator scan over flat token files.

A flat file is a run of fixed-width token identifiers, with an end-of-document
identifier after each document and no index.  It is read in blocks of bytes;
each block is searched for the separator in one vectorised comparison, and a
prefix scan over the blocks' summaries, a few numbers a block, stitches the
documents that cross block boundaries: within chunks of blocks side by side, then
over the chunks of a file.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnledger.llm.common import Scratch, only, shared_dir
from turnledger.llm.words import pieces

#: The pre-tokenisation pattern of the public byte-level vocabulary, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCKS = "file string, block long, data binary"


def encoder(ranks: list[tuple[bytes, int]]):
    import tiktoken

    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=dict(ranks), special_tokens={})


def load_ranks(path: str) -> list[tuple[bytes, int]]:
    """The vocabulary file, read by the driver; of a fixed size, so it can be broadcast."""
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]


def layout(ranks: list[tuple[bytes, int]]) -> tuple[int, int]:
    """(end-of-document identifier, bytes of an identifier): the first number that the vocabulary leaves free, and as many bytes as it needs, two or four."""
    end = max((r for _, r in ranks), default=-1) + 1
    return end, 2 if end < 1 << 16 else 4


def flat_blocks(docs: DataFrame, vocabulary: str, block_bytes: int = 1 << 20) -> DataFrame:
    """(file, block, data, ids): the documents as flat files of identifiers of the vocabulary's :func:`layout`, in blocks.

    One file for each task, in the order of its rows.  ``ids`` is the file's table
    of contents, kept beside the flat data and never read by the scan: the doc_ids
    whose separators lie in the block, in order.  Null and empty texts are a
    separator alone; an empty table has no file and no block.
    """
    listed = load_ranks(vocabulary)
    end, width = layout(listed)
    if block_bytes % width:
        raise ValueError("a block has to hold whole identifiers")
    ranks = docs.sparkSession.sparkContext.broadcast(listed)
    kind = {2: np.uint16, 4: np.uint32}[width]

    def run(batches):
        encode = encoder(ranks.value).encode_ordinary
        file = f"{TaskContext.get().partitionId():08d}"
        rest, ids, block = bytearray(), [], 0
        waiting: list[tuple[int, int]] = []  # (end of the document in the file, doc_id)
        done = 0
        for batch in pieces(batches):
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rest += np.array([*encode(text or ""), end], kind).tobytes()
                waiting.append((done + len(rest), d))
                while len(rest) >= block_bytes:
                    done += block_bytes
                    here = [x for e, x in waiting if e <= done]
                    waiting = [(e, x) for e, x in waiting if e > done]
                    yield _block(file, block, bytes(rest[:block_bytes]), here)
                    del rest[:block_bytes]
                    block += 1
        if rest:
            yield _block(file, block, bytes(rest), [x for _, x in waiting])

    return only(docs, doc_id="long", text="string").mapInArrow(run, f"{BLOCKS}, ids array<long>")


def _block(file: str, block: int, data: bytes, ids: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"file": pa.array([file]), "block": pa.array([block], pa.int64()), "data": pa.array([data], pa.binary()), "ids": pa.array([ids], pa.list_(pa.int64()))})


def read_flat_files(spark: SparkSession, path: str, block_bytes: int = 1 << 20, whole_bytes: int = 1 << 28) -> DataFrame:
    """(file, block, data) of the flat files under a path.

    Files of at most ``whole_bytes`` are read through Hadoop's file system, so from
    any store, and cut into blocks.  Of larger ones byte ranges are dealt out, which
    needs a path that the executors' Python opens; raises for any other.  Empty files
    have no block, and an empty folder gives no rows.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [(s.getPath().toUri(), int(s.getLen())) for s in system.listStatus(hadoop) if s.isFile()]
    large = [(str(u.getPath()), n) for u, n in found if n > whole_bytes]
    if large and any(u.getScheme() not in (None, "file") for u, n in found if n > whole_bytes):
        raise ValueError(f"files over {whole_bytes} bytes have to lie where the executors' Python opens them")
    at = F.posexplode(F.sequence(F.lit(1), F.length("content"), F.lit(block_bytes))).alias("block", "at")
    small = spark.read.format("binaryFile").load(path).where((F.col("length") > 0) & (F.col("length") <= whole_bytes)).select(F.regexp_replace("path", "^[a-z]+:/*", "/").alias("file"), at, "content")
    small = small.select("file", F.col("block").cast("long").alias("block"), F.expr(f"substring(content, at, {block_bytes})").alias("data"))
    if not large:
        return small
    listed = spark.createDataFrame(large, "file string, size long")
    ranges = listed.select("file", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / block_bytes))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for file, block in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
                with open(file, "rb") as f:
                    f.seek(block * block_bytes)
                    data = f.read(block_bytes)
                yield pa.RecordBatch.from_pydict({"file": pa.array([file]), "block": pa.array([block], pa.int64()), "data": pa.array([data], pa.binary())})

    return small.unionByName(ranges.repartition(spark.sparkContext.defaultParallelism * 2).mapInArrow(run, BLOCKS))


def scan_separators(blocks: DataFrame, end: int, width: int = 2, chunk: int = 1024) -> DataFrame:
    """(file, ordinal, block, place, n_tokens): the documents of flat files, in order.

    blocks: file, block and data, the blocks of a file numbered from 0, each but the
    last a multiple of ``width`` bytes; other columns are ignored.  ordinal numbers
    a file's documents from 0, place those that end in a block.  n_tokens leaves
    the separator out.  Tokens after the last separator are a document too, with
    a null place.  Empty blocks and empty files have no documents.  ``chunk`` blocks
    are scanned by one task, and then the chunks of a file.
    """
    kind = {2: np.uint16, 4: np.uint32}[width]

    def run(batches):
        for batch in batches:
            out = []
            for data in batch.column("data"):
                tokens = np.frombuffer(data.as_buffer(), kind) if data.is_valid else np.zeros(0, kind)
                out.append((len(tokens), np.flatnonzero(tokens == end)))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array([n for n, _ in out], pa.int64()), pa.array([p for _, p in out], pa.list_(pa.int64()))], ["file", "block", "n", "ends"])

    found = blocks.select("file", "block", "data").mapInArrow(run, "file string, block long, n long, ends array<long>")
    found = Scratch(blocks.sparkSession, "separators").write(found, "ends")
    own = Window.partitionBy("file", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    summary = found.select("file", "block", F.floor(F.col("block") / chunk).alias("chunk"), "n", F.size("ends").alias("count"), F.array_max("ends").alias("top"))
    summary = summary.withColumn("start", zero(F.sum("n").over(own))).withColumn("first", zero(F.sum("count").over(own)))
    summary = summary.withColumn("open", F.max(F.col("start") + F.col("top") + 1).over(own))
    chunks = summary.groupBy("file", "chunk").agg(F.sum("n").alias("all"), F.sum("count").alias("docs"), F.max(F.col("start") + F.col("top") + 1).alias("top"), F.max("block").alias("last"))
    before = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("from", zero(F.sum("all").over(before))).withColumn("number", zero(F.sum("docs").over(before)))
    chunks = chunks.withColumn("closed", F.max(F.col("from") + F.col("top")).over(before))
    tail = chunks.groupBy("file").agg(F.sum("all").alias("all"), zero(F.max(F.col("from") + F.col("top"))).alias("closed"), F.sum("docs").alias("docs"), F.max("last").alias("block")).where("all > closed")
    tail = tail.select("file", F.col("docs").alias("ordinal"), "block", F.lit(None).cast("int").alias("place"), (F.col("all") - F.col("closed")).alias("n_tokens"))
    summary = summary.join(chunks.select("file", "chunk", "from", "number", "closed"), ["file", "chunk"])
    summary = summary.select("file", "block", (F.col("from") + F.col("start")).alias("start"), (F.col("number") + F.col("first")).alias("first"), zero(F.greatest(F.col("from") + F.col("open"), "closed")).alias("open"))
    each = found.join(summary, ["file", "block"]).select("file", "block", "start", "first", "open", "ends", F.posexplode("ends").alias("place", "at"))
    begin = F.when(F.col("place") > 0, F.col("start") + F.get("ends", F.col("place") - 1) + 1).otherwise(F.col("open"))
    each = each.select("file", (F.col("first") + F.col("place")).alias("ordinal"), "block", "place", (F.col("start") + F.col("at") - begin).alias("n_tokens"))
    return each.unionByName(tail)


def document_token_counts(docs: DataFrame, vocabulary: str, block_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, n_tokens) for each row of docs, through flat files in the shared folder.

    docs: doc_id and text; other columns are ignored.  Null and empty texts have no
    tokens.  Repeated rows are counted each for itself, rows without an id too.  An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    end, width = layout(load_ranks(vocabulary))
    path = f"{shared_dir(spark)}/flat-{uuid.uuid4().hex}"
    flat_blocks(docs, vocabulary, block_bytes).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.schema(f"{BLOCKS}, ids array<long>").parquet(path)
    ids = blocks.select("file", "block", F.posexplode("ids").alias("place", "doc_id"))
    return scan_separators(blocks, end, width).join(ids, ["file", "block", "place"]).select("doc_id", "n_tokens")
