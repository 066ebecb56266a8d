"""Operator 7: toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon, whole words and word beginnings, is learned from the labelled
sample: entries whose share of toxic texts is high even at the lower end of
their confidence interval.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.common import Scratch, only
from turnledger.llm.features import dense, labelled_sample
from turnledger.llm.words import _ODD, _powers, SLICE_BYTES, byte_table, mix, slices

CUT, FOLDS = 0.3, 4
#: Word beginnings of so many bytes are entries beside whole words.
STEMS = (4, 5, 6)
#: Words of the second person.
SECOND = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "tu", "toi", "te", "ton", "ta", "vous", "votre", "usted", "tú", "ti", "vosotros", "vuestro")
_WORD = byte_table("alnum")
#: Signs that stand for letters inside an obfuscated word.
_PLAIN = _WORD.copy()
for _sign, _letter in zip(b"013457@$!*", b"oleastasii", strict=True):
    _PLAIN[_sign] = _letter


def _spans(data: np.ndarray, bounds: np.ndarray, lut: np.ndarray):
    """(prefix sums, inverse powers, starts, ends, first word of each text)."""
    n = len(data)
    low = lut[data]
    inside = low != 0
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1] | cut[1:-1]
        ends[:-1] &= ~inside[1:] | cut[1:-1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down, letters = _powers(max(2 * SLICE_BYTES, 1 << int(n).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(letters[low] * up[:n], out=sums[1:])
    return sums, down, s, e, np.searchsorted(s, bounds)


def _hash(sums: np.ndarray, down: np.ndarray, s: np.ndarray, e: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of byte ranges; ``kind`` keeps whole words (0) apart from beginnings of so many bytes."""
    return mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _ODD + np.uint64(kind * 0xC2B2AE3D27D4EB4F % (1 << 64)))


def entries(data: np.ndarray, bounds: np.ndarray, lut: np.ndarray = _WORD):
    """(first word of each text, starts, ends, {kind: (word numbers, hashes)})."""
    sums, down, s, e, first = _spans(data, bounds, lut)
    out = {0: (np.arange(len(s)), _hash(sums, down, s, e, 0))}
    for k in STEMS:
        long = np.flatnonzero(e - s >= k)
        out[k] = long, _hash(sums, down, s[long], s[long] + k, k)
    return first, s, e, out


def _hash_listed(words: tuple[str, ...]) -> np.ndarray:
    raw = [w.encode() for w in words]
    bounds = np.cumsum([0, *map(len, raw)])
    return np.sort(entries(np.frombuffer(b"".join(raw), np.uint8), bounds)[3][0][1])


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def toxic_features(data: np.ndarray, bounds: np.ndarray, lexicon: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Lexicon densities, second-person proximity, obfuscation rates and the dense features."""
    first, s, e, found = entries(data, bounds)
    n = np.maximum(np.diff(first), 1)
    hit = np.zeros(len(s), bool)
    whole = _among(found[0][1], lexicon)
    hit |= whole
    for k in STEMS:
        at, h = found[k]
        hit[at[_among(h, lexicon)]] = True
    per = lambda m, f: (c := np.r_[0, np.cumsum(m)])[f[1:]] - c[f[:-1]]
    you = np.flatnonzero(_among(found[0][1], second))
    at = np.flatnonzero(hit)
    near = np.zeros(len(s), bool)
    if len(you) and len(at):
        text = np.repeat(np.arange(len(n)), np.diff(first))
        right = np.minimum(np.searchsorted(you, at), len(you) - 1)
        left = np.maximum(right - 1, 0)
        close = np.zeros(len(at), bool)
        for side in (left, right):
            close |= (np.abs(you[side] - at) <= 5) & (text[you[side]] == text[at])
        near[at[close]] = True
    first2, s2, e2, plain = entries(data, bounds, _PLAIN)
    masked = np.zeros(len(s2), bool)
    for k in (0, *STEMS):
        i, h = plain[k]
        masked[i[_among(h, lexicon)]] = True
    sign = np.r_[0, np.cumsum(_PLAIN[data] != _WORD[data])] if len(data) else np.zeros(1, np.int64)
    letters = np.r_[0, np.cumsum((_WORD[data] >= 97))] if len(data) else np.zeros(1, np.int64)
    odd = ((sign[np.maximum(e2 - 1, s2)] - sign[s2]) > 0) & ((letters[e2] - letters[s2]) > 0) if len(s2) else np.zeros(0, bool)
    hits, close, hidden = per(hit, first), per(near, first), per(masked & odd, first2)
    return np.column_stack([
        np.log1p(hits), hits / n, np.log1p(per(whole, first)), np.log1p(close), close / n, np.log1p(hidden), hidden / n, per(odd, first2) / np.maximum(np.diff(first2), 1), dense(data, bounds),
    ])


class BoostedTrees:
    """Logistic gradient boosting of shallow trees over quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: int = 10):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.start, self.trees = float(np.log(share / (1 - share))), []
        self._pack(depth)
        if len(y) < 2 * least or len(set(y.tolist())) < 2:
            return
        b = self._binned(x)
        f = np.full(len(y), self.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            tree: dict[int, tuple] = {}
            node = np.zeros(len(y), np.int64)
            for level in range(depth + 1):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    if not len(rows):
                        continue
                    best = self._split(b[rows], g[rows], h[rows], bins, least) if level < depth else None
                    if best is None:
                        tree[k] = (-1, 0, rate * g[rows].sum() / (h[rows].sum() + 1.0))
                        f[rows] += tree[k][2]
                        node[rows] = -1
                    else:
                        tree[k] = (*best, 0.0)
                        node[rows] = np.where(b[rows, best[0]] <= best[1], 2 * k + 1, 2 * k + 2)
            self.trees.append(tree)
        self._pack(depth)

    def _pack(self, depth: int) -> None:
        """The nodes of all trees as arrays of (tree, node): split feature or -1, last bin to the left, value."""
        self.depth, shape = depth, (len(self.trees), 2 ** (depth + 1) - 1)
        self.feature, self.cut, self.value = np.full(shape, -1), np.zeros(shape, np.int64), np.zeros(shape)
        for t, tree in enumerate(self.trees):
            for k, (j, cut, value) in tree.items():
                self.feature[t, k], self.cut[t, k], self.value[t, k] = j, cut, value

    @staticmethod
    def _split(b, g, h, bins, least):
        best, gain = None, 1e-3
        total_g, total_h, n = g.sum(), h.sum(), len(g)
        for j in range(b.shape[1]):
            cg, ch, cn = (np.cumsum(np.bincount(b[:, j], v, bins))[:-1] for v in (g, h, np.ones(n)))
            ok = (cn >= least) & (n - cn >= least)
            if ok.any():
                s = np.where(ok, cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1), 0)
                if s.max() > gain:
                    best, gain = (j, int(np.argmax(s))), float(s.max())
        return best

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)]) if len(self.cuts) else np.zeros((len(x), 0), np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, tree = self._binned(x), np.arange(len(self.trees))
        node, row = np.zeros((len(x), len(tree)), np.int64), np.arange(len(x))[:, None]
        for _ in range(self.depth if len(tree) else 0):
            j = self.feature[tree, node]
            right = b[row, np.maximum(j, 0)] > self.cut[tree, node]
            node = np.where(j < 0, node, 2 * node + 1 + right)
        return self.start + self.value[tree, node].sum(1)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit by pooling adjacent violators; each pool also holds a half of either label."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        pools.append([m, float(v), 1.0, m])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            a = pools.pop()
            pools[-1] = [pools[-1][0], pools[-1][1] + a[1], pools[-1][2] + a[2], a[3]]
    at = np.array([v for p in pools for v in (p[0], p[3])])
    to = np.array([(p[1] + 0.05) / (p[2] + 0.1) for p in pools for _ in range(2)])
    return at, np.maximum.accumulate(to)


class ToxicModel:
    """Trees on all rows; the calibration from margins of trees that hadn't seen a row's fold."""

    def __init__(self, lexicon: np.ndarray, x: np.ndarray, y: np.ndarray, fold: np.ndarray):
        self.lexicon, self.second = np.sort(lexicon), _hash_listed(SECOND)
        self.trees = BoostedTrees(x, y)
        margin = np.zeros(len(y))
        for k in range(FOLDS):
            margin[fold == k] = BoostedTrees(x[fold != k], y[fold != k]).margin(x[fold == k])
        self.at, self.to = isotonic(margin, y) if len(y) else (np.zeros(1), np.zeros(1))

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.margin(toxic_features(data, bounds, self.lexicon, self.second)), self.at, self.to), 0, 1)


def _learn_lexicon(sample: DataFrame, least: int = 4, sure: float = 0.5) -> list[np.ndarray]:
    """Sorted hashes of the lexicon without each fold, and of the whole one at the end.

    An entry stands in at least ``least`` texts, and its toxic share is above
    ``sure`` at the lower end of a confidence interval of 97 %.
    """

    def run(batches):
        for rows, data, bounds in slices(batches):
            first, _, _, found = entries(data, bounds)
            y, fold = np.array(rows.column("y").to_pylist()), np.array(rows.column("fold").to_pylist())
            texts = [np.unique(np.concatenate([h[np.searchsorted(at, first[i]) : np.searchsorted(at, first[i + 1])] for at, h in found.values()])) for i in range(len(y))]
            key = np.concatenate(texts)
            owner = np.repeat(np.arange(len(y)), [len(t) for t in texts])
            _, index, inverse = np.unique(key ^ mix(fold[owner].astype(np.uint64) + np.uint64(1)), return_index=True, return_inverse=True)
            n, t = np.bincount(inverse, minlength=len(index)), np.bincount(inverse, y[owner], len(index))
            yield pa.RecordBatch.from_pydict({"key": pa.array(key[index].view(np.int64)), "fold": pa.array(fold[owner[index]].astype(np.int32)), "n": pa.array(n.astype(np.int64)), "t": pa.array(t.astype(np.int64))})

    def lower(n, t, z=2.17):
        n = F.greatest(n, F.lit(1))
        p = t / n
        return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)

    each = [(F.sum(F.when(F.col("fold") != k, F.col("n")).otherwise(0)), F.sum(F.when(F.col("fold") != k, F.col("t")).otherwise(0))) for k in range(FOLDS)]
    each.append((F.sum("n"), F.sum("t")))
    counts = sample.mapInArrow(run, "key long, fold int, n long, t long").groupBy("key").agg(*(c.alias(f"{x}{i}") for i, pair in enumerate(each) for x, c in zip("nt", pair, strict=True)))
    counts = counts.where(F.col(f"n{FOLDS}") >= least)
    sure_ = [(F.col(f"n{i}") >= least) & (lower(F.col(f"n{i}"), F.col(f"t{i}")) > sure) for i in range(FOLDS + 1)]
    counts = counts.select("key", lower(F.col(f"n{FOLDS}"), F.col(f"t{FOLDS}")).alias("low"), F.array(*sure_).alias("in")).where(F.exists("in", lambda x: x))
    top = counts.orderBy(F.desc("low"), "key").limit(8000).toArrow()
    if not top.num_rows:
        return [np.zeros(0, np.uint64)] * (FOLDS + 1)
    key, inside = top.column("key").to_numpy().view(np.uint64), np.array(top.column("in").to_pylist())
    return [np.sort(key[inside[:, i]]) for i in range(FOLDS + 1)]


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, max_labels: int = 12_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    docs: doc_id and text; labels: doc_id and toxic; other columns are ignored.
    Labels are learned only from rows whose crc32(doc_id) modulo ``modulus`` isn't
    ``held``, at most ``max_labels`` of them, the documented bound of the fit; the
    lexicon keeps its 8,000 surest entries.  A row's lexicon features come from the
    other folds' lexicon, and the calibration from trees without its fold, so
    neither is tuned to what it has seen.  Every row is scored by its whole
    text, by the isotonic fit at its margin; null and empty texts have zero
    features.  Without labels every score is that of an empty fit, 0.  Repeated
    rows get equal scores.  Very long texts are read whole.  An empty table gives no
    rows.
    """
    spark = docs.sparkSession
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(FOLDS))
    sample = Scratch(spark, "toxicity").write(labelled_sample(docs, labels, "toxic", modulus, held, max_labels).withColumn("fold", fold.cast("int")), "sample")
    lexicons, second = _learn_lexicon(sample), _hash_listed(SECOND)

    def gather(lexicon):
        def run(batches):
            for rows, data, bounds in slices(batches):
                x = toxic_features(data, bounds, lexicon, second)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("y"), rows.column("fold"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "fold", "x"])

        return run

    parts = [sample.where(F.col("fold") == k).mapInArrow(gather(lexicons[k]), "doc_id long, y int, fold int, x array<double>") for k in range(FOLDS)]
    t = reduce(DataFrame.unionByName, parts).toArrow().sort_by("doc_id")
    x = np.array(t.column("x").to_pylist(), float).reshape(t.num_rows, -1) if t.num_rows else toxic_features(np.zeros(0, np.uint8), np.zeros(2, np.int64), lexicons[-1], second)[:0]
    model = spark.sparkContext.broadcast(ToxicModel(lexicons[-1], x, t.column("y").to_numpy(), t.column("fold").to_numpy()))

    def run(batches):
        m = model.value
        for rows, data, bounds in slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(m.score(data, bounds), pa.float64())], ["doc_id", "score"])

    out = only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double")
    held_out = F.crc32(F.col("doc_id").cast("string")) % modulus == held
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
