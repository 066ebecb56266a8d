"""Operator 3: document quality by Bradley-Terry pairwise ranking.

Preference pairs set a document of label 1 over one of label 0.  The chance that
the first wins is the logistic of the difference of two scores that are linear
in the features, so the weights come from a logistic loss on feature
differences.  A quantile of the learned scores is the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.common import Scratch, only
from turnledger.llm.features import NAMES, dense, labelled_sample
from turnledger.llm.words import slices
from turnledger.operators import ordinals, quantiles

CUT = 0.3


def expand(x: np.ndarray) -> np.ndarray:
    """The features, their square roots and squares, so that a linear score can bend."""
    return np.hstack([x, np.sqrt(np.abs(x)), x * x])


def loss_sums(diff: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Gradient and curvature of the logistic loss of differences, summed up, and their number."""
    p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
    return -(diff * p[:, None]).sum(0), (diff * (p * (1 - p))[:, None]).T @ diff, len(diff)


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, int]], size: int, ridge: float, steps: int) -> np.ndarray:
    """The weights of the least mean loss, by Newton steps on what ``sums`` adds up for given weights."""
    w = np.zeros(size)
    for _ in range(steps):
        gradient, curve, n = sums(w)
        step = np.linalg.solve(curve / n + ridge * np.eye(size), gradient / n + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as an array."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _joined(a: tuple, b: tuple) -> tuple:
    """(number, mean, sum of squared distances from it) of two parts together."""
    n = a[0] + b[0]
    away = b[1] - a[1]
    return (n, a[1] + away * (b[0] / n), a[2] + b[2] + away**2 * (a[0] * b[0] / n)) if n else a


class PairwiseRanker:
    """Weights learned from ``pairs`` preference pairs, drawn with ``seed``, and a threshold: the score's quantile at the share of label 0.

    Made from arrays, or by ``fit`` from a table of any size.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = 60_000, ridge: float = 1e-3, steps: int = 25, seed: int = 7):
        z = expand(x)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self._begin(len(z), len(good), len(bad), *((z.mean(0), z.std(0)) if len(z) else (np.zeros(z.shape[1]), np.ones(z.shape[1]))))
        if not self.trained:
            return
        z = self._scaled(z)
        pick = np.random.default_rng(seed)
        diff = z[pick.choice(good, pairs)] - z[pick.choice(bad, pairs)]
        self.weights = newton(lambda w: loss_sums(diff, w), z.shape[1], ridge, steps)
        raw = z @ self.weights
        q = np.quantile(raw, self._about()).mean()
        self._cut(q, np.quantile(np.abs(raw - q), 0.5))

    def _begin(self, n: int, good: int, bad: int, mean: np.ndarray, deviation: np.ndarray) -> None:
        self.mean, self.scale = mean, deviation + 1e-6
        self.weights, self.threshold, self.spread = np.zeros(len(mean)), 0.0, 1.0
        self.share, self.trained = bad / max(1, n), good > 0 and bad > 0

    def _about(self) -> list[float]:
        """The threshold is the quantile at the share of label 0, as the mean of those a little under and over it, so that it doesn't stick to one document."""
        near = 0.05 * min(self.share, 1 - self.share)
        return [self.share - near, self.share + near]

    def _cut(self, q: float, middle: float) -> None:
        self.threshold, self.spread = float(q), float(max(1e-6, middle / 3))

    @classmethod
    def fit(cls, rows: DataFrame, scratch: Scratch, pairs: int = 60_000, ridge: float = 1e-3, steps: int = 25) -> PairwiseRanker:
        """The model of all rows (doc_id, y, x), of any number: sums of partitions are all that the driver sees.

        There are as many pairs as rows of the more frequent label, at least ``pairs``.
        The rows of each label are numbered by a hash and taken in turn, so that each
        row is in a pair.
        """
        self, size = cls.__new__(cls), 3 * len(NAMES)

        def moments(batches):
            n, good, bad, mean, square = 0, 0, 0, np.zeros(size), np.zeros(size)
            for batch in batches:
                if not batch.num_rows:
                    continue
                z, y = expand(_matrix(batch.column("x"))), batch.column("y").to_numpy()
                n, mean, square = _joined((n, mean, square), (len(z), z.mean(0), ((z - z.mean(0)) ** 2).sum(0)))
                good, bad = good + int((y == 1).sum()), bad + int((y == 0).sum())
            yield pa.RecordBatch.from_pydict({"n": [n], "good": [good], "bad": [bad], "mean": [mean.tolist()], "square": [square.tolist()]})

        n, good, bad, mean, square = 0, 0, 0, np.zeros(size), np.zeros(size)
        for r in rows.select("y", "x").mapInArrow(moments, "n long, good long, bad long, mean array<double>, square array<double>").collect():
            n, mean, square = _joined((n, mean, square), (r.n, np.array(r.mean), np.array(r.square)))
            good, bad = good + r.good, bad + r.bad
        self._begin(n, good, bad, mean, np.sqrt(square / n) if n else np.ones(size))
        if not self.trained:
            return self
        turn = math.lcm(good, bad)  # after so many pairs the same ones would come again
        count = max(pairs, good, bad)
        numbered = ordinals.numbered(rows.where("y in (0, 1)"), ["y"], [F.xxhash64("doc_id"), F.col("doc_id")])
        each = rows.sparkSession.range(count).select((F.col("id") % good).alias("i"), ((F.col("id") + F.floor(F.col("id") / turn)) % bad).alias("j"))
        of = lambda y, place, name: numbered.where(F.col("y") == y).select(F.col("position").alias(place), F.col("x").alias(name))
        both = scratch.write(each.join(of(1, "i", "a"), "i").join(of(0, "j", "b"), "j").select("a", "b"), "pairs")

        def sums(w):
            def run(batches):
                gradient, curve, m = np.zeros(size), np.zeros((size, size)), 0
                for batch in batches:
                    if batch.num_rows:
                        g, c, k = loss_sums(self._scaled(expand(_matrix(batch.column("a")))) - self._scaled(expand(_matrix(batch.column("b")))), w)
                        gradient, curve, m = gradient + g, curve + c, m + k
                yield pa.RecordBatch.from_pydict({"g": [gradient.tolist()], "c": [curve.ravel().tolist()], "m": [m]})

            parts = both.mapInArrow(run, "g array<double>, c array<double>, m long").toArrow()
            g, c = (_matrix(parts.column(x).combine_chunks()).sum(0) for x in "gc")
            return g, c.reshape(size, size), sum(parts.column("m").to_pylist())

        self.weights = newton(sums, size, ridge, steps)

        def scored(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_pydict({"raw": self._scaled(expand(_matrix(batch.column("x")))) @ self.weights})

        raw = scratch.write(rows.select("x").mapInArrow(scored, "raw double"), "raw")
        found = quantiles.exact_quantiles(raw, [], "raw", dict(zip(("under", "over"), self._about(), strict=True))).first()
        q = (found.under + found.over) / 2
        self._cut(q, quantiles.exact_quantiles(raw.select(F.abs(F.col("raw") - q).alias("away")), [], "away", {"middle": 0.5}).first().middle)
        return self

    def _scaled(self, z: np.ndarray) -> np.ndarray:
        return np.clip((z - self.mean) / self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; CUT at the threshold."""
        if not self.trained:
            return np.full(len(x), 1 - self.share)
        raw = self._scaled(expand(x)) @ self.weights
        return 1 / (1 + np.exp(-np.clip((raw - self.threshold) / self.spread + np.log(CUT / (1 - CUT)), -30, 30)))


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    docs: doc_id and text; labels: doc_id and quality; other columns are
    ignored.  Labels are learned only from rows whose crc32(doc_id) modulo
    ``modulus`` isn't ``held``, from all of them; every row is scored by its whole text.  Null and empty texts are
    scored by their zero features.  Without labels of both kinds every score is
    the share of label 1.  Repeated rows get equal scores.  Very long texts are
    read whole, a slice of rows at a time.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality-labels")

    def gather(batches):
        for rows, data, bounds in slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("y"), pa.array(list(dense(data, bounds)), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    labelled = labelled_sample(docs, labels, "quality", modulus, held, None)
    model = PairwiseRanker.fit(scratch.write(labelled.mapInArrow(gather, "doc_id long, y int, x array<double>"), "labelled"), scratch)

    def run(batches):
        for rows, data, bounds in slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(model.score(dense(data, bounds)), pa.float64())], ["doc_id", "score"])

    out = only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double")
    fold = F.crc32(F.col("doc_id").cast("string")) % modulus == held
    return out.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
