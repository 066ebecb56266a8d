"""Data sources for calibration documents and for the log of steps.

Both are written by tasks into files of their own beside the target, which the
driver renames when all tasks have ended: a task that runs again leaves one file,
a job that fails none.  Files are reached through Arrow's file systems, so a path
needs a scheme that Arrow opens on driver and executors (a shared mount, an
object store).
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

DOCUMENTS, STEPS = "turnledger_documents", "turnledger_steps"


def _opened(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def _files(path: str) -> list[str]:
    system, root = _opened(path)
    return sorted(i.path for i in system.get_file_info(FileSelector(root, allow_not_found=True)) if i.type == FileType.File)


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written: the names that its files get, by where they lie now."""

    files: dict[str, str]


class _StagedWriter(DataSourceWriter):
    """Files of a task, renamed by the driver; the staging folder goes in any case."""

    def __init__(self, path: str, replace: bool):
        self.path, self.replace, self.staging = path, replace, f"_staging-{uuid.uuid4().hex}"

    def task_files(self) -> tuple[FileSystem, str]:
        system, root = _opened(self.path)
        folder = posixpath.join(root, self.staging, uuid.uuid4().hex)
        system.create_dir(folder, recursive=True)
        return system, folder

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = _opened(self.path)
        try:
            done = [m for m in messages if m]
            names = [n for m in done for n in m.files]
            if len(names) != len(set(names)):
                raise ValueError("two tasks have written the same document")
            system.create_dir(root, recursive=True)
            for m in done:
                for name, at in m.files.items():
                    to = posixpath.join(root, name)
                    if not self.replace and system.get_file_info(to).type != FileType.NotFound:
                        raise FileExistsError(to)
                    system.move(at, to)
        finally:
            self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        system, root = _opened(self.path)
        folder = posixpath.join(root, self.staging)
        if system.get_file_info(folder).type != FileType.NotFound:
            system.delete_dir(folder)


class _DocumentWriter(_StagedWriter):
    """Rows of (batch_id, section, value), sorted, as one JSON object a batch with sorted keys: written value by value."""

    def write(self, iterator: Iterator) -> Staged:
        system, folder = self.task_files()
        files: dict[str, str] = {}
        out = batch = section = None
        for row in iterator:
            if row.batch_id != batch or out is None:
                if out:
                    out.write(b"]}}\n" if section in SECTIONS else b"}\n")
                    out.close()
                name = f"batch-{quote(row.batch_id, safe='')}.json"
                if name in files:
                    raise ValueError("rows of a batch have to come together")
                files[name] = posixpath.join(folder, name)
                out, batch, section = system.open_output_stream(files[name]), row.batch_id, None
            if row.section != section:
                before = b"{" if section is None else b"]}, " if section in SECTIONS else b", "
                out.write(before + json.dumps(row.section).encode() + (b': {"rows": [' if row.section in SECTIONS else b": ") + row.value.encode())
                section = row.section
            elif section in SECTIONS:
                out.write(b", " + row.value.encode())
            else:
                raise ValueError(f"{section} is there twice")
        if out:
            out.write(b"]}}\n" if section in SECTIONS else b"}\n")
            out.close()
        return Staged(files)


#: Sections that hold rows; the others hold one value.
SECTIONS = ("answer", "responsibility", "search")


class DocumentSource(DataSource):
    """One canonical JSON document a batch; refuses a folder that holds documents already."""

    @classmethod
    def name(cls) -> str:
        return DOCUMENTS

    def schema(self) -> str:
        return "batch_id string, section string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        path = self.options["path"]
        if overwrite:
            raise ValueError("documents aren't overwritten")
        if _files(path):
            raise FileExistsError(path)
        return _DocumentWriter(path, False)


class _StepWriter(_StagedWriter):
    """A file of one line for each step, named by the step: a step written again takes its place."""

    def write(self, iterator: Iterator) -> Staged:
        system, folder = self.task_files()
        files: dict[str, str] = {}
        for row in iterator:
            name = f"step-{row.global_step:012d}.jsonl"
            if name in files:
                raise ValueError(f"step {row.global_step} is there twice")
            files[name] = posixpath.join(folder, name)
            with system.open_output_stream(files[name]) as out:
                out.write(row.payload.replace("\n", " ").encode() + b"\n")
        return Staged(files)


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _StepReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        found = [f for f in _files(self.path) if posixpath.basename(f).startswith("step-")]
        return [_Part(found[i : i + 256]) for i in range(0, len(found), 256)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple[int, str]]:
        system, _ = _opened(self.path)
        for f in partition.paths:
            with system.open_input_stream(f) as stream:
                yield int(posixpath.basename(f)[5:-6]), stream.read().decode().rstrip("\n")


class StepSource(DataSource):
    """The log of steps, (global_step, payload): appending a step again leaves one line of it."""

    @classmethod
    def name(cls) -> str:
        return STEPS

    def schema(self) -> str:
        return "global_step int, payload string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("the log is only appended to")
        return _StepWriter(self.options["path"], True)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _StepReader(self.options["path"])


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(DocumentSource)
    spark.dataSource.register(StepSource)
    return spark


def write_batch_documents(heads: DataFrame, sections: dict[str, DataFrame], path: str) -> None:
    """A document for each batch, under ``path``: refuses to overwrite, all or none.

    heads: batch_id and any further columns, each a value of the document; sections:
    by name (of SECTIONS), batch_id and further columns, a row of the section.  A
    batch's rows come sorted by their JSON and are written one by one, so a batch may
    have any number of them.
    """
    spark = _registered(heads.sparkSession)
    text = lambda c: F.to_json(F.array(F.col(c)))
    value = lambda c: F.when(F.col(c).isNotNull(), F.substring(text(c), F.lit(2), F.length(text(c)) - 2))
    parts = [heads.select("batch_id", F.lit(c).alias("section"), value(c).alias("value")) for c in heads.columns]
    for name, rows in sections.items():
        if name not in SECTIONS:
            raise ValueError(f"{name} isn't a section")
        parts.append(rows.select("batch_id", F.lit(name).alias("section"), F.to_json(F.struct(*(c for c in sorted(rows.columns) if c != "batch_id"))).alias("value")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every.where("value is not null").repartition("batch_id").sortWithinPartitions("batch_id", "section", "value").write.format(DOCUMENTS).mode("append").save(path)


def append_steps(steps: DataFrame, path: str) -> None:
    """(global_step, payload) added to the log under ``path``."""
    _registered(steps.sparkSession)
    steps.select(F.col("global_step").cast("int").alias("global_step"), "payload").write.format(STEPS).mode("append").save(path)


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    return _registered(spark).read.format(STEPS).load(path)
