"""Operators that learn: held-out accuracy, edge cases and invariants."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnledger.llm import language_id, mixing, quality_classifier, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(90001, None), (90002, ""), (90003, " \n"), (90004, "123 456 !!"), (90005, "x" * 300_000), (90006, "same"), (90006, "same")]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    return base.unionByName(odd).withColumn("y", F.lit("clash")).withColumn("x", F.lit("clash")).withColumn("fold", F.lit("clash")).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").withColumn("y", F.lit("clash")).withColumn("text", F.lit("clash"))


def held(out, labels, column):
    return [(r.score, r.predicted, r[column]) for r in out.where("held_out").join(labels.select("doc_id", column), "doc_id").collect()]


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


def test_quality(docs, labels):
    out = quality_classifier.quality_scores(docs, labels).cache()
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count() == 0
    rows = held(out, labels, "quality")
    assert auc([(s, y) for s, _, y in rows]) > 0.97 and np.mean([p == y for _, p, y in rows]) > 0.95


def test_toxicity(docs, labels):
    out = toxicity.toxicity_scores(docs, labels).cache()
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count() == 0
    rows = held(out, labels, "toxic")
    assert auc([(s, y) for s, _, y in rows]) > 0.85 and np.mean([p == y for _, p, y in rows]) > 0.9


def test_learning_without_labels(docs, labels):
    assert quality_classifier.quality_scores(docs, labels.limit(0)).where("score is null").count() == 0
    assert toxicity.toxicity_scores(docs, labels.limit(0)).where("score is null").count() == 0
    assert quality_classifier.quality_scores(docs.limit(0), labels).count() == 0 and toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


def test_held_out_labels_are_not_read(docs, labels):
    fold = F.crc32(F.col("doc_id").cast("string"))
    flipped = labels.withColumn("quality", F.when(fold % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.when(fold % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    for f in (quality_classifier.quality_scores, toxicity.toxicity_scores):
        assert sorted(f(docs, labels).collect()) == sorted(f(docs, flipped).collect())


def test_language(docs):
    out = language_id.detect_language(docs).cache()
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    got = {r.doc_id: r.lang_pred for r in out.collect()}
    assert all(got[d] == "und" for d in (90001, 90002, 90003, 90004)) and got[90005] != "und"
    rows = out.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert language_id.detect_language(docs.limit(0)).count() == 0


def test_every_language_is_learned(spark):
    """More languages than 64, each in letters of its own; the rarest are learned too."""
    r, rows = random.Random(8), []
    for i in range(68):
        letters = [chr(0x4E00 + 40 * i + j) for j in range(12)]
        rows += [(len(rows) + j, " ".join("".join(r.choice(letters) for _ in range(4)) for _ in range(30)), f"l{i:02d}") for j in range(8 if i < 64 else 7)]
    out = language_id.detect_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=4).collect()
    lang = {d: v for d, _, v in rows}
    assert {x.lang_pred for x in out} == set(lang.values()) and all(x.lang_pred == lang[x.doc_id] for x in out)


def test_isotonic_is_monotone():
    r = np.random.default_rng(0)
    m = r.normal(size=300)
    at, to = toxicity.isotonic(m, (r.random(300) < 1 / (1 + np.exp(-2 * m))).astype(float))
    assert (np.diff(to) >= 0).all() and (np.diff(at) >= 0).all()


def test_mixing_meets_targets(docs, labels):
    out = mixing.mixing_rates(docs, mixing.label_domains(labels)).toPandas()
    assert len(out) == docs.count() and (out.rate >= 0).all() and (out[out.n_tokens == 0].rate == 1).all()
    p = np.array(out.p.tolist())
    got = (p * (out.n_tokens * out.rate).to_numpy()[:, None]).sum(0) / out.n_tokens.sum()
    assert got == pytest.approx([mixing.TARGETS[d] for d in sorted(mixing.TARGETS)], abs=1e-3)
    none = mixing.mixing_rates(docs, mixing.label_domains(labels.limit(0))).toPandas()
    assert (none.rate >= 0).all()
    assert mixing.mixing_rates(docs.limit(0), mixing.label_domains(labels)).count() == 0


def test_mixing_is_the_projected_gradient(spark):
    """Rates equal the plain iteration on a driver-side matrix."""
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(("aa", "bb") if i % 2 else ("cc", "dd")) for _ in range(r.randint(3, 40)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 1, "u").otherwise("v").alias("domain"))
    out = mixing.mixing_rates(docs, labelled, {"u": 0.9, "v": 0.1}).toPandas().sort_values("doc_id")
    a = (np.array(out.p.tolist()) * out.n_tokens.to_numpy()[:, None]).T
    want, rate = np.array([0.9, 0.1]) * a.sum(), np.ones(a.shape[1])
    for _ in range(40):
        off = a @ rate - want
        if np.abs(off).max() <= 1e-6 * a.sum():
            break
        rate = np.maximum(0, rate - a.T @ (np.linalg.pinv((a * (rate > 0)) @ a.T, rcond=1e-10) @ off))
    assert out.rate.to_numpy() == pytest.approx(rate, abs=1e-9)


def test_mixing_stage(docs, labels):
    out = mixing.mixing_stage(docs, mixing.label_domains(labels))
    assert out.where("mix_copies < 1").count() == 0 and set(docs.columns) < set(out.columns)


def test_dense_features_against_plain_python():
    import re

    from turnledger.llm import features

    texts = ["The cat; the CAT!!  the cat\nthe cat\n\nthe cat", "", " \n", "a", "éa b\tc? 12|3 *x* a b c a b c", "x" * 5000 + "\n" + "y z"]
    raw = [t.encode() for t in texts]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    got = features.dense(data, bounds)
    for t, b, row in zip(texts, raw, got, strict=True):
        words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0d]+", t)]
        n, lines = len(words), [x for x in b.split(b"\n") if x.strip()]
        grams = [tuple(words[i : i + 3]) for i in range(n - 2)]
        want = dict.fromkeys(features.NAMES, 0.0)
        for kind, chars in features._KINDS.items():
            want[f"{kind}_share"] = sum(c in chars for c in b) / max(1, len(b))
        want |= {"wide_share": sum(c >= 128 for c in b) / max(1, len(b)), "log_words": np.log1p(n), "log_chars": np.log1p(len(b)), "mean_word": np.log1p(sum(len(w.encode()) for w in words) / max(1, n))}
        want |= {"distinct": len(set(words)) / np.sqrt(n) if n else 0, "adjacent": sum(x == y for x, y in zip(words, words[1:], strict=False)) / max(1, n), "repeat3": 1 - len(set(grams)) / len(grams) if n > 3 else 0}
        want["stop_per_word"] = sum(c in b".?" for c in b) / max(1, n)
        if n and b"\n" in b:
            want |= {"dup_lines": 1 - len(set(lines)) / len(lines), "longest_run": np.log1p(max(map(len, lines)))}
        elif n:
            want["longest_run"] = np.log1p(len(b))
        assert row == pytest.approx([want[k] for k in features.NAMES])


def test_ranker_against_plain_python():
    """Weights make the mean logistic loss of the drawn pairs' differences smallest; scores follow from them."""
    r = np.random.default_rng(3)
    x = r.normal(size=(80, 3))
    y = (x[:, 0] + 0.7 * r.normal(size=80) > 0).astype(int)
    m = quality_classifier.PairwiseRanker(x, y, pairs=500)
    z = np.clip((quality_classifier.expand(x) - m.mean) / m.scale, -8, 8)
    pick = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    a, b = pick.choice(good, 500), pick.choice(bad, 500)
    slope = np.mean([-(z[i] - z[j]) / (1 + np.exp((z[i] - z[j]) @ m.weights)) for i, j in zip(a, b, strict=True)], axis=0) + 1e-3 * m.weights
    assert np.abs(slope).max() < 1e-5
    raw = [sum(v * w for v, w in zip(row, m.weights, strict=True)) for row in z]
    share = np.mean(y == 0)
    near = 0.05 * min(share, 1 - share)
    assert m.threshold == pytest.approx((np.quantile(raw, share - near) + np.quantile(raw, share + near)) / 2)
    cut = quality_classifier.CUT
    assert m.score(x) == pytest.approx([1 / (1 + (1 - cut) / cut * np.exp(-(v - m.threshold) / m.spread)) for v in raw])
    assert ((m.score(x) >= cut) == (np.array(raw) >= m.threshold)).all()


def test_trees_against_plain_python():
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 6))
    m = toxicity.BoostedTrees(x, (x[:, 0] * x[:, 1] + x[:, 2] > 0.3).astype(int))
    new = r.normal(size=(50, 6))
    for row, got in zip(new, m.margin(new), strict=True):
        want = m.start
        for tree in m.trees:
            k = 0
            while tree[k][0] >= 0:
                j, last, _ = tree[k]
                k = 2 * k + 1 + (sum(c < row[j] for c in m.cuts[j]) > last)
            want += tree[k][2]
        assert got == pytest.approx(want)
    assert len(m.trees) == 60 and np.mean((m.margin(x) > 0) == (x[:, 0] * x[:, 1] + x[:, 2] > 0.3)) > 0.9


def test_isotonic_against_the_max_min_formula():
    r = np.random.default_rng(1)
    y = (r.random(40) < np.linspace(0.1, 0.8, 40)).astype(float)
    at, to = toxicity.isotonic(np.arange(40.0), y)
    mean = [max(min(y[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    want, i = [], 0
    while i < 40:
        n = sum(abs(v - mean[i]) < 1e-12 for v in mean)
        want += [(n * mean[i] + 0.05) / (n + 0.1)] * n
        i += n
    assert np.interp(np.arange(40.0), at, to) == pytest.approx(np.maximum.accumulate(want))


def test_language_features_and_duels_against_plain_python():
    def plain(text):
        out = [0.0] * language_id.WIDTH
        cp = [ord(c) if ord(c) >= 65 else 32 for c in text.lower()]
        for n in range(1, language_id.ORDERS + 1):
            for i in range(len(cp) - n + 1):
                h = 0
                for c in cp[i : i + n]:
                    h = (h * 0x01000193 + c * 0x9E3779B1) % 2**32
                h = (h ^ (h >> 15)) * 0x2C1B3C6D % 2**32
                out[((h >> 17) + n * 911) % language_id.WIDTH] += 1
        root = [v**0.5 for v in out]
        return [v / sum(w * w for w in root) ** 0.5 for v in root]

    for t in ("Ein Text, 12 Wörter.", "漢字 and é", "a"):
        assert language_id.features(t) == pytest.approx(plain(t), abs=1e-6)
    r = np.random.default_rng(2)
    x, y = r.normal(size=(90, 5)) + np.repeat(np.eye(5)[:3] * 4, 30, 0), np.repeat(["a", "b", "c"], 30)
    duels = language_id.Duels(x, y)
    for row in r.normal(size=(30, 5)) * 3:
        score = {(a, b): float(row @ w + c) for (a, b), (w, c) in duels.machines.items()}
        wins = [sum((s >= 0) == (k == a) for (a, b), s in score.items() if k in (a, b)) for k in range(3)]
        margin = [sum(s if k == a else -s for (a, b), s in score.items() if k in (a, b)) for k in range(3)]
        best = max(range(3), key=lambda k: (wins[k], margin[k]))
        least = min(s if best == a else -s for (a, b), s in score.items() if best in (a, b))
        assert duels.choose(row) == ("abc"[best], pytest.approx(1 / (1 + np.exp(-4 * least))))


def test_ranker_learns_from_every_labelled_row(spark, tmp_path):
    """No label is left out, and the fit over partitions is that of the arrays."""
    from turnledger.llm.common import Scratch

    r = np.random.default_rng(11)
    n = 13_000
    x = r.normal(size=(n, len(quality_classifier.NAMES)))
    y = (x[:, 0] + 0.5 * x[:, 1] + r.normal(size=n) > -0.5).astype(int)
    rows = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(n)], "doc_id long, y int, x array<double>")
    scratch = Scratch(spark, "ranker")
    m = quality_classifier.PairwiseRanker.fit(rows, scratch)
    z = quality_classifier.expand(x)
    assert m.share == np.mean(y == 0) and m.mean == pytest.approx(z.mean(0)) and m.scale == pytest.approx(z.std(0) + 1e-6)
    pairs = spark.read.parquet(scratch.paths["pairs"])
    assert pairs.select("a").distinct().count() == y.sum() and pairs.select("b").distinct().count() == n - y.sum() and pairs.count() == pairs.distinct().count() == 60_000
    z = np.clip((z - m.mean) / m.scale, -8, 8)
    raw, near = z @ m.weights, 0.05 * min(m.share, 1 - m.share)
    assert m.threshold == pytest.approx(np.quantile(raw, [m.share - near, m.share + near]).mean())
    assert m.spread == pytest.approx(np.quantile(np.abs(raw - m.threshold), 0.5) / 3)
    diff = np.array([p.a for p in pairs.collect()]), np.array([p.b for p in pairs.collect()])
    diff = np.subtract(*(np.clip((quality_classifier.expand(d) - m.mean) / m.scale, -8, 8) for d in diff))
    slope, _, k = quality_classifier.loss_sums(diff, m.weights)
    assert np.abs(slope / k + 1e-3 * m.weights).max() < 1e-5

