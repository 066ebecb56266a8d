"""Operator 6: hierarchical language identification with linear support vector machines.

One-versus-one machines first choose the family, then the language within it.
Features are hashed counts of character n-grams of the lower-cased text.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnledger.llm.common import Scratch, keep_ids, only
from turnledger.llm.words import pieces

#: ISO 639-1 codes by family; a code that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sr", "hr", "sk", "sl"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
WIDTH, ORDERS, CHUNK = 4096, 3, 1 << 18
_LETTER = re.compile(r"[^\W\d_]")


def features(text: str) -> np.ndarray:
    """Square roots of hashed 1- to 3-gram counts, of unit length; whole texts, a chunk at a time."""
    out = np.zeros(WIDTH, np.float64)
    low = text.lower()
    for at in range(0, len(low), CHUNK):
        part = low[max(0, at - ORDERS + 1) : at + CHUNK]
        cp = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        cp = np.where(cp < 65, np.uint32(32), cp)  # digits and signs are no part of a language
        h = np.zeros(len(cp), np.uint32)
        for n in range(1, ORDERS + 1):
            h = (h[: len(cp) - n + 1] if n > 1 else h) * np.uint32(0x01000193) + cp[n - 1 :] * np.uint32(0x9E3779B1)
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out += np.bincount(((mixed >> np.uint32(17)) + np.uint32(n * 911)) % WIDTH, minlength=WIDTH)
    out = np.sqrt(out)
    return (out / max(1e-9, np.linalg.norm(out))).astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 120) -> tuple[np.ndarray, float]:
    """A linear machine for y of -1 and 1: squared hinge loss by accelerated gradients.

    Either side has half of the weight, whatever its size.
    """
    w, b = np.zeros(x.shape[1]), 0.0
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    v, c, rate = w.copy(), b, 0.2
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v + c))
        g = -2 * share * slack * y
        w2, b2 = v - rate * (g @ x + penalty * v), c - rate * g.sum()
        move = t / (t + 3)
        v, c = w2 + move * (w2 - w), b2 + move * (b2 - b)
        w, b = w2, b2
    return w.astype(np.float32), float(b)


class Duels:
    """One machine for each pair of classes; the class with most wins, then the larger margin."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.classes = sorted(set(y.tolist()))
        self.machines = {}
        for a, b in combinations(range(len(self.classes)), 2):
            pick = (y == self.classes[a]) | (y == self.classes[b])
            self.machines[a, b] = train_svm(x[pick], np.where(y[pick] == self.classes[a], 1.0, -1.0))

    def choose(self, x: np.ndarray) -> tuple[str, float]:
        wins, margin = np.zeros(len(self.classes)), np.zeros(len(self.classes))
        least: dict[int, float] = {}
        for (a, b), (w, c) in self.machines.items():
            s = float(x @ w + c)
            wins[a if s >= 0 else b] += 1
            margin[a] += s
            margin[b] -= s
            for k, v in ((a, s), (b, -s)):
                least[k] = min(least.get(k, 50.0), v)
        best = max(range(len(self.classes)), key=lambda i: (wins[i], margin[i], -i))
        return self.classes[best], 1 / (1 + np.exp(-4 * least.get(best, 2.0)))


class Hierarchy:
    def __init__(self, x: np.ndarray, lang: list[str]):
        lang_, family = np.array(lang, object), np.array([_FAMILY.get(v, v) for v in lang], object)
        self.families = Duels(x, family) if len(lang) else None
        self.within = {f: Duels(x[family == f], lang_[family == f]) for f in sorted(set(family.tolist()))}

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or self.families is None or not any(m.group().isalpha() for m in _LETTER.finditer(text)):
            return "und", 0.0
        x = features(text)
        family, p = self.families.choose(x)
        lang, q = self.within[family].choose(x)
        return lang, float(p * q)


def detect_language(docs: DataFrame, modulus: int = 3, held: int = 1, per_language: int = 500, sample: int = 8_000, least: int = 20) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs.

    docs: doc_id, text and lang; other columns are ignored.  Learned from at
    most ``per_language`` texts, the smallest by a hash of doc_id, for each
    non-null value of lang among rows whose crc32(doc_id) modulo ``modulus`` isn't
    ``held``.  With many languages each has fewer texts, ``sample`` in all, but never
    a bound under ``least``: the documented bound of the fit; no language is left out.
    Every row is predicted from its whole text.  ``und`` with score 0 for a null
    text, one without a letter, or when nothing could be learned.  Of languages
    with equal wins the one of the larger summed margin is taken, of equal ones the
    first by name.  Repeated rows are predicted alike.  An empty table gives no rows.
    """
    docs = only(docs, doc_id="long", text="string", lang="string")
    fold = F.crc32(F.col("doc_id").cast("string")) % modulus == held
    known = docs.where("lang is not null").where(~fold)
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    each = min(per_language, max(least, sample // max(1, languages)))
    # three times as many as are wanted lie under a hash threshold of their language, so its window is small whatever its rows
    even = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    near = known.select("doc_id", "lang").join(counts, "lang").where(even * F.col("n") <= 3.0 * each + 60).select("doc_id", "lang").distinct()
    first = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id")
    picked = near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= each) if languages else None

    def gather(batches):
        for batch in pieces(batches):
            text = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([features(t).tobytes() for t in text], pa.binary())], ["doc_id", "lang", "x"])

    if picked is None:
        model = Hierarchy(np.zeros((0, WIDTH), np.float32), [])
    else:
        ids = Scratch(docs.sparkSession, "language").write(picked.select("doc_id").distinct(), "ids")  # at most ``sample``, or ``least`` a language
        t = keep_ids(known, ids).where(F.rlike("text", F.lit(r"\p{L}"))).mapInArrow(gather, "doc_id long, lang string, x binary").toArrow().sort_by("doc_id")
        model = Hierarchy(np.frombuffer(b"".join(t.column("x").to_pylist()), np.float32).reshape(-1, WIDTH), t.column("lang").to_pylist())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in pieces(batches):
            found = [m.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([v for v, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", fold.alias("held_out"), "lang_pred", "score")
