"""Operator 4: mixing sources to target weights with soft domain membership.

A multinomial classifier, learned from a labelled table, gives every document a
posterior over the domains.  Document rates r >= 0 are then fitted by projected
gradients so that the expected tokens of each domain, the sum over documents of
rate * tokens * posterior, meet the targets.  Only as many sums as there are
domains reach the driver in an iteration; a document's rate is a function of
its own posterior and of the residuals so far, so no state is shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from turnledger.llm.common import Scratch, free_shuffles, only
from turnledger.llm.features import dense
from turnledger.llm.words import byte_table, hash_words, slices

_SPACE = byte_table("space")

#: Domains of the labels table, and the share of tokens that each shall have.
TARGETS = {"general": 0.90, "low_quality": 0.07, "toxic": 0.03}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table with quality and toxic marks; rows without marks go."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low_quality").when(F.col("quality") == 1, "general")
    return only(labels, doc_id="long", quality="int", toxic="int").select("doc_id", domain.alias("domain")).where("domain is not null")


class Posterior:
    """Multinomial logistic regression on standardised features and hashed words."""

    WORDS = 1024

    def __init__(self, x: np.ndarray, y: np.ndarray, classes: int, ridge: float = 3e-4, steps: int = 150):
        """x: 32-bit features, scaled in place; y: classes."""
        width = x.shape[1]
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)
        self.weights, self.bias = np.zeros((width, classes), np.float32), np.zeros(classes, np.float32)
        if not len(x):
            return
        self.mean = x.mean(0, dtype=np.float64).astype(np.float32)
        x -= self.mean
        self.scale = np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)) + np.float32(1e-6)
        x /= self.scale
        np.clip(x, -5, 5, out=x)
        x /= 4
        hot = np.eye(classes, dtype=np.float32)[y]
        rate, v, c = 0.5, self.weights.copy(), self.bias.copy()
        for t in range(steps):
            p = self._soft(x @ v + c) - hot
            w2, b2 = v - rate * (x.T @ p / len(x) + ridge * v), c - rate * p.mean(0)
            move = t / (t + 3)
            v, c = w2 + move * (w2 - self.weights), b2 + move * (b2 - self.bias)
            self.weights, self.bias = w2.astype(np.float32), b2.astype(np.float32)
            v, c = v.astype(np.float32), c.astype(np.float32)

    @staticmethod
    def _soft(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -5, 5) / 4

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._soft(self._scaled(x) @ self.weights + self.bias)


def rows_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, words) of each text: the dense ones and log counts of hashed words."""
    h, _, _, first = hash_words(data, bounds, _SPACE)
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    cells = np.bincount(text * Posterior.WORDS + (h >> np.uint64(54)).astype(np.int64), minlength=len(n) * Posterior.WORDS) if len(h) else np.zeros(len(n) * Posterior.WORDS)
    return np.hstack([dense(data, bounds), np.log1p(cells.reshape(len(n), Posterior.WORDS)) / np.sqrt(np.maximum(n, 1))[:, None]]), n


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], max_labels: int = 6_000) -> Broadcast:
    """The posterior over ``domains``, learned from at most ``max_labels`` labelled rows, the documented bound of the fit."""
    rows = labelled.where(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    docs = only(docs, doc_id="long", text="string")
    width = rows_of(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0].shape[1]

    def gather(batches):
        for part, data, bounds in slices(batches):
            x = rows_of(data, bounds)[0].astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("domain"), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "domain", "x"])

    t = docs.join(F.broadcast(rows), "doc_id").mapInArrow(gather, "doc_id long, domain string, x binary").toArrow()
    order, place = np.argsort(t.column("doc_id").to_numpy(), kind="stable"), {d: i for i, d in enumerate(domains)}
    y = np.array([place[d] for d in t.column("domain").to_pylist()], np.int64)[order]
    x, at = np.empty((t.num_rows, width), np.float32), 0
    for chunk in t.column("x").chunks:  # the features reach the driver once, and are copied once
        for v in chunk:
            x[at] = np.frombuffer(v.as_buffer(), np.float32)
            at += 1
    del t
    x = x[order]
    pa.default_memory_pool().release_unused()
    return docs.sparkSession.sparkContext.broadcast(Posterior(x, y, len(domains)))


def memberships(docs: DataFrame, model: Broadcast) -> DataFrame:
    """(row, n_tokens, p) with row a struct of all columns of docs and p the posterior; one for each row of docs."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    only(docs, text="string")

    def run(batches):
        m = model.value
        for part, data, bounds in slices(batches):
            f, n = rows_of(data, bounds)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(n, pa.int64()), pa.array(list(m.predict(f)), pa.list_(pa.float64()))], ["row", "n_tokens", "p"])

    return whole.mapInArrow(run, StructType([StructField("row", docs.schema), StructField("n_tokens", LongType()), StructField("p", ArrayType(DoubleType()))]))


class Fit(NamedTuple):
    """Moves of the rates, the domains in order, and what was reached: shares of the present tokens."""

    domains: list[str]
    moves: list[np.ndarray]
    target: dict[str, float]
    reached: dict[str, float]

    def rate(self) -> Column:
        """A document's rate after the moves, from its n_tokens and p: each takes p-weighted tokens off and stops at zero."""
        if not self.moves:
            return F.lit(1.0)
        listed = F.array(*(F.array(*(F.lit(float(v)) for v in m)) for m in self.moves))
        a = [F.col("n_tokens") * F.col("p")[i] for i in range(len(self.domains))]
        return F.aggregate(listed, F.lit(1.0), lambda r, m: F.greatest(F.lit(0.0), r - sum(x * m[i] for i, x in enumerate(a))))

    def domain(self) -> Column:
        """The likeliest domain, the first of equals."""
        return F.array(*(F.lit(n) for n in self.domains))[(F.array_position("p", F.array_max("p")) - 1).cast("int")]

    def off(self) -> float:
        """By how much the worst domain misses its target, as a share of the present tokens."""
        return max(abs(self.reached[d] - self.target[d]) for d in self.domains)


def fitted(table: DataFrame, targets: dict[str, float], tolerance: float = 1e-6, steps: int = 40) -> Fit:
    """Fits the rates of a table with n_tokens and p; as many sums as there are pairs of domains reach the driver in a step."""
    targets = dict(sorted(targets.items()))
    names, k = list(targets), len(targets)
    a = [F.col("n_tokens") * F.col("p")[i] for i in range(k)]
    total = np.array([x or 0.0 for x in table.agg(*(F.sum(x) for x in a)).first()])
    share = np.array(list(targets.values())) / sum(targets.values())
    want = share * total.sum()
    fit = Fit(names, [], dict(zip(names, share.tolist(), strict=True)), dict.fromkeys(names, 0.0))
    for _ in range(steps + 1):
        if not total.sum():
            break
        live = F.col("r") > 0
        sums = [F.sum(F.col("r") * F.col(f"a{i}")) for i in range(k)] + [F.sum(F.when(live, F.col(f"a{i}") * F.col(f"a{j}")).otherwise(0.0)) for i in range(k) for j in range(k)]
        now = np.array(table.select(fit.rate().alias("r"), *(x.alias(f"a{i}") for i, x in enumerate(a))).agg(*sums).first(), float)
        off, gram = now[:k] - want, now[k:].reshape(k, k)
        fit.reached.update(zip(names, (now[:k] / total.sum()).tolist(), strict=True))
        if np.abs(off).max() <= tolerance * total.sum() or len(fit.moves) == steps:
            break
        fit.moves.append(np.linalg.pinv(gram, rcond=1e-10) @ off)
    return fit


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, tolerance: float = 1e-6, steps: int = 40, **options) -> DataFrame:
    """(doc_id, n_tokens, domain, p, rate, off) for each row of docs.

    docs: doc_id and text; labelled: doc_id and domain; other columns are
    ignored.  ``targets`` maps each domain to its share of the present number of
    tokens (words).  Rates start at 1 and stay nonnegative; a step goes along the
    gradient of half the squared residual, in the metric of the Gram matrix of
    the domains' token vectors over documents with a positive rate, is projected
    on rates of at least zero, and ends when no domain is off by more than
    ``tolerance`` of all tokens, or after ``steps``.  ``off``, the same in every row,
    is what the worst domain misses its target by, as a share of all tokens: over
    ``tolerance`` where a target can't be met, as when no document may belong to
    its domain; the rates are then those of the last step.  Documents without
    words have rate 1, whatever the residuals; null texts have none.  Domain is the
    likeliest, the first of equals.  Without labelled rows posteriors are equal.
    Repeated rows count as often as they occur.  An empty table gives no rows.
    """
    targets = targets or TARGETS
    docs = only(docs, doc_id="long", text="string")
    members = memberships(docs, classifier(docs, labelled, sorted(targets), **options))
    table = Scratch(docs.sparkSession, "mixing").write(members.select("row.doc_id", "n_tokens", "p"), "members")
    fit = fitted(table, targets, tolerance, steps)
    return table.select("doc_id", "n_tokens", fit.domain().alias("domain"), "p", fit.rate().alias("rate"), F.lit(fit.off()).alias("off"))


def mixing_stage(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, tolerance: float = 1e-6, steps: int = 40, **options) -> DataFrame:
    """docs with their domain, rate and number of copies in the mix; those with no copy go.

    copies is the rate rounded down, plus one where a hash of doc_id and text, even
    on 0 to 1, falls under its fraction, so that copies have the rate as their
    mean.  Each row has the rate of its own text, so repeated rows, and rows
    without an id, have the copies of any other.  Columns mix_domain, mix_rate and
    mix_copies that docs has are replaced.  A rate is a function of a row's own
    posterior, so the stage joins and shuffles no texts.
    """
    targets = targets or TARGETS
    free_shuffles(docs.sparkSession)
    model = classifier(docs, labelled, sorted(targets), **options)
    members = memberships(docs, model)
    table = Scratch(docs.sparkSession, "mixing").write(memberships(only(docs, text="string"), model).select("n_tokens", "p"), "members")
    fit = fitted(table, targets, tolerance, steps)
    mixed = members.select("row", fit.rate().alias("rate"), fit.domain().alias("domain"))
    even = F.pmod(F.xxhash64("row.doc_id", "row.text", F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
    copies = (F.floor("rate") + F.when(even < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    mine = ("mix_domain", "mix_rate", "mix_copies")
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in mine]
    return mixed.select(*kept, F.col("domain").alias(mine[0]), F.col("rate").alias(mine[1]), copies.alias(mine[2])).where("mix_copies > 0")
