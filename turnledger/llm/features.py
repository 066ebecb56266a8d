"""Dense features of whole texts, for classifiers; a slice of texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.common import BROADCAST_IDS, only
from turnledger.llm.words import byte_table, hash_words, mix, slices

_SPACE = byte_table("space")
_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".?", "comma": b",;:",
    "bang": b"!", "pipe": b"|", "symbol": b"#*$%&<>@^~=+_\\", "quote": b"\"'()[]{}-/", "line": b"\n",
}
NAMES = (*(f"{k}_share" for k in _KINDS), "wide_share", "log_words", "log_chars", "mean_word", "distinct", "adjacent", "repeat3", "dup_lines", "stop_per_word", "longest_run")


def dense(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text; zeros for an empty one."""
    d = len(bounds) - 1
    out = np.zeros((d, len(NAMES)), np.float64)
    size = np.maximum(np.diff(bounds), 1)
    h, s, e, first = hash_words(data, bounds, _SPACE)
    n = np.diff(first)
    for j, (_, chars) in enumerate(_KINDS.items()):
        lut = np.zeros(256, bool)
        lut[list(chars)] = True
        c = np.r_[0, np.cumsum(lut[data])]
        out[:, j] = (c[bounds[1:]] - c[bounds[:-1]]) / size
    wide = np.r_[0, np.cumsum(data >= 128)]
    j = len(_KINDS)
    out[:, j] = (wide[bounds[1:]] - wide[bounds[:-1]]) / size
    out[:, j + 1], out[:, j + 2] = np.log1p(n), np.log1p(np.diff(bounds))
    length = np.r_[0, np.cumsum(e - s)]
    words = np.maximum(n, 1)
    out[:, j + 3] = np.log1p((length[first[1:]] - length[first[:-1]]) / words)
    same = np.r_[0, np.cumsum(np.r_[h[1:] == h[:-1], False])] if len(h) else np.zeros(1, np.int64)
    out[:, j + 5] = (same[np.maximum(first[1:] - 1, first[:-1])] - same[first[:-1]]) / words
    g = mix(mix(h[:-2] * np.uint64(3) + h[1:-1]) + h[2:]) if len(h) > 2 else np.zeros(0, np.uint64)
    stops = out[:, list(_KINDS).index("stop")] * size
    out[:, j + 8] = stops / words
    for i in range(d):
        a, b = int(first[i]), int(first[i + 1])
        if b > a:
            out[i, j + 4] = len(np.unique(h[a:b])) / np.sqrt(b - a)
        if b - a > 3:
            out[i, j + 6] = 1 - len(np.unique(g[a : b - 2])) / (b - a - 2)
        if b > a and out[i, list(_KINDS).index("line")]:
            lines = [x for x in data[bounds[i] : bounds[i + 1]].tobytes().split(b"\n") if x.strip()]
            out[i, j + 7] = 1 - len(set(lines)) / max(1, len(lines))
            out[i, j + 9] = np.log1p(max(map(len, lines), default=0))
        elif b > a:
            out[i, j + 9] = np.log1p(size[i])
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, bound: int | None) -> DataFrame:
    """(doc_id, text, y) of the labelled rows outside the held-out fold, at most ``bound`` of them if one is given.

    Rows are chosen by a hash of doc_id, so the choice is the same in each run.
    Ids are broadcast where a bound or a count keeps them few.  Null labels are left out.
    """
    rows = only(labels, doc_id="long", **{label: "int"}).where(F.col(label).isNotNull()).withColumnRenamed(label, "y")
    rows = rows.where(F.crc32(F.col("doc_id").cast("string")) % modulus != held).groupBy("doc_id").agg(F.max("y").alias("y"))
    if bound is not None:
        rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    few = bound is not None or rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return only(docs, doc_id="long", text="string").join(F.broadcast(rows) if few else rows, "doc_id")
