"""Operator 2: benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of the benchmark items.
A table gives, for each block of two words, how far the search may shift; blocks
that end a pattern have shift 0 and lead to a bucket of test strings, which are
compared word by word.  Unknown blocks shift by the whole pattern less one.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.common import Scratch, free_shuffles, keep_ids, only
from turnledger.llm.words import byte_table, pieces

#: Separators become spaces and A-Z lower case; bytes from 0x80 belong to words.
_TABLE = bytes(x or 32 for x in byte_table("alnum").tolist())


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class WuManber:
    """Finds all occurrences of word sequences of at least ``shortest`` words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]]):
        self.shortest = min(map(len, patterns))
        self.block = b = min(2, self.shortest)
        self.far = self.shortest - b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[list[bytes], list[int]]]] = defaultdict(list)
        for p, items in patterns.items():
            for end in range(b, self.shortest + 1):
                key = p[end - b : end]
                self.shift[key] = min(self.shift.get(key, self.far), self.shortest - end)
            self.buckets[p[self.shortest - b : self.shortest]].append((list(p), items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, list[int]]]:
        """(start, end, items) of each occurrence, by rising start."""
        n, at, far, get = len(words), self.shortest - 1, self.far, self.shift.get
        single = self.block == 1
        while at < n:
            key = (words[at],) if single else (words[at - 1], words[at])
            if move := get(key, far):
                at += move
                continue
            start = at - self.shortest + 1
            for pattern, items in self.buckets[key]:
                if words[start : start + len(pattern)] == pattern:
                    yield start, start + len(pattern), items
            at += 1


_TABLES: dict[str, list[WuManber]] = {}


def _built(name: str, items: list[tuple[int, str | None]], window: int) -> list[WuManber]:
    """The tables of a block of the benchmark, made once in a worker; it holds those of two blocks at most."""
    if name not in _TABLES:
        while len(_TABLES) > 1:
            _TABLES.pop(next(iter(_TABLES)))
        _TABLES[name] = [WuManber(p) for p in pattern_sets(items, window)]
    return _TABLES[name]


def windows(text: str | None, window: int) -> set[tuple[bytes, ...]]:
    w = split_words(text)
    return {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()


def pattern_sets(items: list[tuple[int, str | None]], window: int) -> list[dict[tuple[bytes, ...], list[int]]]:
    """Whole windows, and apart from them shorter items, which would shorten the shifts."""
    kinds: tuple[dict, dict] = defaultdict(list), defaultdict(list)
    for item, text in items:
        for p in windows(text, window):
            kinds[len(p) < window][p].append(item)
    return [dict(k) for k in kinds if k]


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str | None]]]:
    part, size = [], 0
    for r in benchmark.toLocalIterator():
        part.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= block_chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_chars: int = 1_000_000) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) for each row of docs.

    docs: doc_id and text; benchmark: item_id and text; other columns are
    ignored.  A word is hit inside any occurrence of a window; an item of fewer
    words, but not none, is one window.  Items are the distinct ids with an
    occurring window, in order.  contaminated: n_hit > 0 and
    20 * n_hit >= n_words.  Null and empty texts have no words and no hits; null
    and empty items have no windows; items of a null id hit words and come last among
    items, together as one null; repeated rows give repeated rows; an empty table
    gives no rows, and with an empty benchmark nothing is hit.  Very long texts are
    searched whole.  The benchmark is a query set: it is taken in
    blocks of ``block_chars`` characters, each of which passes over all rows, so
    no worker holds more than a block's windows and tables, some 130 MB for a
    million characters.  After every second block the rows are written to the shared
    folder.
    """
    spark = docs.sparkSession
    free_shuffles(spark)
    out = only(docs, doc_id="long", text="string").withColumn("items", F.array().cast("array<long>")).withColumn("hits", F.lit(None).cast("binary"))

    def scan(shared, name):
        def run(batches):
            found = _built(name, shared.value, window)
            for batch in pieces(batches):
                texts, items, hits = (batch.column(c).to_pylist() for c in ("text", "items", "hits"))
                for i, text in enumerate(texts):
                    words = split_words(text)
                    mask, seen = None, set()
                    for m in found:
                        for start, end, ids in m.find(words):
                            if mask is None:
                                mask = np.frombuffer(hits[i], bool).copy() if hits[i] else np.zeros(len(words), bool)
                            mask[start:end] = True
                            seen.update(ids)
                    if mask is not None:
                        hits[i], items[i] = mask.tobytes(), sorted({*items[i], *seen}, key=lambda x: (x is None, x or 0))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(items, pa.list_(pa.int64())), pa.array(hits, pa.binary())], ["doc_id", "text", "items", "hits"])

        return run

    scratch, taken = Scratch(spark, "contamination"), 0
    for block in _blocks(only(benchmark, item_id="long", text="string"), block_chars):
        if any(text for _, text in block):
            if taken and taken % 2 == 0:  # so that a task never holds more than two blocks' tables
                out = scratch.write(out, f"blocks-{taken}")
                if taken > 2:
                    scratch.drop(f"blocks-{taken - 2}")
            taken += 1
            out = out.mapInArrow(scan(spark.sparkContext.broadcast(block), uuid.uuid4().hex), "doc_id long, text string, items array<long>, hits binary")

    def count(batches):
        for batch in pieces(batches):
            n = [len(split_words(x)) for x in batch.column("text").to_pylist()]
            hit = [sum(x) if x else 0 for x in batch.column("hits").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), batch.column("items")], ["doc_id", "n_words", "n_hit", "items"])

    out = out.mapInArrow(count, "doc_id long, n_words long, n_hit long, items array<long>")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest_columns(found: DataFrame) -> DataFrame:
    """The rows of :func:`contamination` with the items as a count and a SHA-256."""
    text = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(text, 256).alias("items_sha256"), "contaminated")


def decontamination_stage(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones; all columns stay.

    Of rows with one doc_id all go when one is contaminated; rows without an id
    stay, as nothing can name them, and so do null and empty texts.  An empty
    table gives an empty one; with an empty benchmark all stay.
    """
    bad = contamination(docs, benchmark, **options).where("contaminated").select("doc_id").distinct()
    return keep_ids(docs, Scratch(docs.sparkSession, "contaminated").write(bad, "ids"), "left_anti")
