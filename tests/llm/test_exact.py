"""Operators with exact results, against brute force on small texts and edge cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnledger.llm import decontaminate, jaccard_join, licenses, quality_rules, substring_dedup, token_counts
from turnledger.llm.common import Scratch
from turnledger.llm.components import connected_components
from turnledger.llm.queries import VOCABULARY

W5, W2 = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def corpus(seed=3, n=80):
    """Random texts, near and exact copies, shared passages, and every odd case."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Été", "naïve", "x-y", "A,b"]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    out = [text(r.randint(1, 160)) for _ in range(n)]
    for i in range(0, n, 3):
        w = out[i].split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    passage = text(70)
    out += [f"{text(30)}\n{passage} {text(20)}" for _ in range(4)]
    out += [out[0], out[0].upper(), None, "", " \t\n", "one", "one", "one two", "TWO one", " ", "under the MIT License", text(3000), "a\x00b c", "line\nline\nline\nother"]
    return [(i * 7, t) for i, t in enumerate(out)]


def frame(spark, rows, **extra):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    for name in ("hub", "key", "seed", "chain", "n", "norm", "slot", "items", "rep", "y", "x", "fold", "n_words", "source"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def docs():
    return corpus()


def brute_components(rows, n, percent):
    sets = {}
    for d, t in rows:
        w = W5.findall(low(t))
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (len(sets[d]), top(d)) for d in sets}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_jaccard_components(spark, docs, n, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, docs), n, percent, block_docs=5).collect()}
    assert got == brute_components(docs, n, percent)


def test_jaccard_edges(spark, docs):
    assert jaccard_join.jaccard_components(frame(spark, docs[:0])).count() == 0
    twice = frame(spark, docs[:9] * 2)
    got = jaccard_join.jaccard_components(twice).collect()
    want = brute_components(docs[:9], 4, 85)
    assert len(got) == 18 and {(r.doc_id, (r.n_shingles, r.component_id)) for r in got} == set(want.items())
    stage = jaccard_join.near_duplicate_stage(frame(spark, docs), n=5, percent=80)
    assert {r.doc_id for r in stage.collect()} == {d for d, (_, c) in brute_components(docs, 5, 80).items() if c == d} and stage.columns == frame(spark, docs).columns


def test_allocation_finds_every_similar_pair():
    import numpy as np

    r, bands = np.random.default_rng(1), jaccard_join.Bands(85)
    missed = 0
    for _ in range(3000):
        n = int(r.integers(2, 200))
        a = r.integers(0, 1 << 62, n).astype(np.uint64)
        cut = int(r.integers(0, n))
        b = np.concatenate([a[cut // 7 :], r.integers(0, 1 << 62, cut // 9).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if len(a) != both and 100 * both >= 85 * (len(a) + len(b) - both):
            missed += not len(np.intersect1d(bands.keys(a), bands.keys(b)))
    assert missed == 0


def brute_contamination(rows, items, window):
    out = {}
    wins = [(i, {tuple(w[j : j + window]) for j in range(max(1, len(w) - window + 1))}) for i, t in items if (w := W2.findall(low(t)))]
    for d, t in rows:
        w, hit, found = W2.findall(low(t)), set(), set()
        for i, ps in wins:
            for p in ps:
                for j in range(len(w) - len(p) + 1):
                    if tuple(w[j : j + len(p)]) == p:
                        hit |= set(range(j, j + len(p)))
                        found.add(i)
        out[d] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize(("window", "block"), [(13, 8_000_000), (3, 50), (1, 10**6)])
def test_contamination(spark, docs, window, block):
    items = [(1, docs[3][1]), (2, "one"), (3, None), (4, ""), (10, "TWO, one"), (11, " ".join(docs[9][1].split()[:20]) + " zzz"), (12, "line line")]
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), window, block).collect()}
    want = brute_contamination(docs, items, window)
    assert got == want
    if window == 13:
        found = decontaminate.digest_columns(decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")))
        for r in found.collect():
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, want[r.doc_id][2]))).encode()).hexdigest() and r.n_items == len(want[r.doc_id][2])
        stage = decontaminate.decontamination_stage(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
        assert {r.doc_id for r in stage.collect()} == {d for d, x in want.items() if not x[3]}


def test_contamination_edges(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.contaminated and r["items"] == [] for r in decontaminate.contamination(frame(spark, docs), none).collect())
    assert decontaminate.contamination(frame(spark, docs[:0]), none).count() == 0


def test_quality_base(spark, docs):
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, docs)).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        w, r = W5.findall(t or ""), got[d]
        seen, lines, mark = set(), 0, set()
        for line in (t or "").split("\n"):
            if W5.search(line):
                lines += line in seen
                seen.add(line)
        count = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        for i in range(len(w) - 2):
            if count[tuple(w[i : i + 3])] > 1:
                mark |= {i, i + 1, i + 2}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), lines, len(mark))
        assert r.base_failed == (len(w) < 50 or 100 * len(mark) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(frame(spark, docs[:0])).count() == 0
    assert quality_rules.quality_stage(frame(spark, docs)).columns == frame(spark, docs).columns


def plain_characters(text):
    """Runs of white space as one space, runs of one ASCII mark as one."""
    out = ""
    for c in text:
        c = " " if c in "\0\t\n\v\f\r " else c
        if not (out.endswith(c) and ord(c) < 128 and not c.isalnum()):
            out += c
    return out


def plain_kneser_ney(texts, order=5):
    """The probability of a character after others, by modified Kneser-Ney over one language's texts."""
    count = {order: collections.Counter()}
    for t in texts:
        t = " " * (order - 1) + plain_characters(t)
        count[order].update(t[i : i + order] for i in range(len(t) - order + 1))
    for o in range(order - 1, 0, -1):
        count[o] = collections.Counter(g[1:] for g in count[o + 1])
    cut, total, left = {}, {}, {}
    for o, c in count.items():
        n = [max(1, sum(v == i for v in c.values())) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        cut[o] = [0] + [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i) for i in (1, 2, 3)]
        for g, v in c.items():
            total[o, g[:-1]] = total.get((o, g[:-1]), 0) + v
            left[o, g[:-1]] = left.get((o, g[:-1]), 0) + cut[o][min(v, 3)]

    def p(g):
        o = len(g)
        if not o:
            return 1 / (len(count[1]) + 1)
        h = (o, g[:-1])
        if h not in total:
            return p(g[1:])
        v = count[o].get(g, 0)
        return (v - cut[o][min(v, 3)]) / total[h] + left[h] / total[h] * p(g[1:])

    return p


def test_kneser_ney_against_plain_python(spark, monkeypatch, tmp_path):
    """Scores under the own and another language's model, with one shard and with several."""
    import numpy as np

    texts = {"en": ["the cat sat on the mat. the cat!!!", "a dog sat\n\n\tdown", "Été 漢字 the", "the cat sat on the mat. the cat!!!"], "xx": ["zz the zaz zzz", "", "mat 漢"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for size in (4_000_000, 60):
        monkeypatch.setattr(quality_rules, "SHARD", size)
        scratch = quality_rules.Scratch(spark, "test")
        table, count = quality_rules.sharded(scratch, quality_rules.train(scratch, docs))
        assert (count > 2) == (size == 60)
        shards = [s.value for s in quality_rules._shards(spark, table, count)]
        for lang, ts in texts.items():
            p = plain_kneser_ney(ts)
            assert sum(p("the " + c) for c in {c for t in ts for c in plain_characters(t)}) + p("the \u4e01") == pytest.approx(1)
            for t in (*texts["en"], *texts["xx"], "qqq unseen the catz"):
                data = np.frombuffer(t.encode(), np.uint8)
                c, begin = quality_rules.characters(data, np.array([0, len(data)]))
                chars = plain_characters(t)
                assert "".join(map(chr, c)) == " " * 4 + chars
                at, _ = quality_rules.positions(begin)
                got = sum(float(s.score(c, s.mine(c, at), quality_rules.seed(lang)).sum()) for s in shards)
                padded = " " * 4 + chars
                assert got == pytest.approx(sum(np.log(p(padded[i : i + 5])) for i in range(len(chars))), abs=1e-3)
        out = {r.doc_id: r.log_ppl for r in quality_rules.quality_rules(docs).collect()}
        for d, t, lang in rows:
            half = lambda x: zlib.crc32(x.encode()) % 2
            others = sorted({x for x in texts[lang] if half(x) != half(t) and x})
            p, padded = plain_kneser_ney(others), " " * 4 + plain_characters(t)
            n = len(padded) - 4
            assert out[d] is None if not n or not others else out[d] == pytest.approx(-sum(np.log(p(padded[i : i + 5])) for i in range(n)) / n, abs=1e-4)


@pytest.mark.parametrize("copies", [1, 3, 20, 200])
def test_copies_do_not_speak_for_a_text(spark, copies):
    """The verdict on noise, on a clean text and on all others is the same with any number of copies."""
    r = random.Random(15)
    words = [f"{a}{b}{c}" for a in ("the", "con", "re", "in") for b in ("ta", "mi", "lo") for c in ("n", "tion", "s")]
    texts = [" ".join(r.choice(words) for _ in range(120)) for _ in range(60)]
    noise = [" ".join("".join(chr(97 + r.randrange(26)) for _ in range(6)) for _ in range(300)) for _ in range(2)]
    rows = list(enumerate(texts)) + [(1000 + i, noise[0]) for i in range(copies)] + [(2000, noise[1])] + [(3000 + i, texts[5]) for i in range(copies)]
    kept = {x.doc_id: x.kept for x in quality_rules.quality_rules(frame(spark, rows)).collect()}
    assert not any(kept[1000 + i] for i in range(copies)) and not kept[2000]
    assert all(kept[3000 + i] for i in range(copies)) and all(kept[i] for i in range(60))


def brute_verdicts(rows, langs_of, under=5.0, over=3.0, floor=0.02):
    """kept by plain Python where no text is over its band: halves, bands over different texts, widths by words."""
    import numpy as np

    half = lambda x: zlib.crc32((x or "").encode()) % 2
    ppl, base, models = {}, {}, {}
    for d, t in rows:
        w = W5.findall(t or "")
        count = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        mark = {i + k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in range(3)}
        base[d] = len(w) < 50 or 100 * len(mark) > 50 * len(w)
        key = langs_of[d], half(t)
        if key not in models:
            models[key] = plain_kneser_ney(sorted({x for e, x in rows if x and langs_of[e] == key[0] and half(x) != key[1]}))
        padded = " " * 4 + plain_characters(t or "")
        n = len(padded) - 4
        ppl[d] = -sum(np.log(models[key](padded[i : i + 5])) for i in range(n)) / n if n else None
    out = {}
    for lang in set(langs_of.values()):
        different = {t: ppl[d] for d, t in rows if langs_of[d] == lang and not base[d] and ppl[d] is not None}
        q = sorted(round(v * 1000) for v in different.values())
        lower = lambda x: x[(len(x) - 1) // 2] if x else 0
        mid = lower(q)
        spread = max(floor, 1.4826 * lower(sorted(abs(x - mid) for x in q)) / 1000)
        for d, t in rows:
            if langs_of[d] == lang:
                wide = (1 + 60 / max(1, len(W5.findall(t or "")))) ** 0.5 * spread
                out[d] = not base[d] and (ppl[d] is None or mid / 1000 - under * wide <= ppl[d] <= mid / 1000 + over * wide)
    return out


def test_verdicts_against_plain_python(spark):
    """One language, so that no window can be read under another; bands, widths and verdicts of all rows."""
    r = random.Random(21)
    parts = ("ta", "mi", "lo", "ne", "ru", "ka")
    texts = [" ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(r.choice([20, 60, 150]))) for _ in range(70)]
    texts += [" ".join("".join(r.choice("qzxjwv") for _ in range(5)) for _ in range(90)), " ".join(["tami lone"] * 3 + [f"ka{i}" for i in range(60)]), texts[3], texts[3], None, "", "ta " * 80]
    rows = list(enumerate(texts))
    kept = {x.doc_id: x.kept for x in quality_rules.quality_rules(frame(spark, rows)).collect()}
    want = brute_verdicts(rows, dict.fromkeys(range(len(rows)), "en"))
    assert kept == want and 20 < sum(want.values()) < len(rows) - 5


def test_perplexity_band_rejects_noise(spark):
    r = random.Random(5)
    words = [f"{a}{b}{c}" for a in ("the", "con", "re") for b in ("ta", "mi", "lo") for c in ("n", "tion", "s")]
    rows = [(i, " ".join(r.choice(words) for _ in range(120))) for i in range(60)] + [(100, " ".join("".join(r.choice("qzxjk#$%") for _ in range(6)) for _ in range(120)))]
    kept = {x.doc_id: x.kept for x in quality_rules.quality_rules(frame(spark, rows)).collect()}
    assert not kept[100] and all(kept[i] for i in range(60))


def test_bands_are_by_language(spark):
    """cs and lv shared a model once; a text wholly in another language doesn't pass under its own."""
    r = random.Random(6)
    text = lambda parts: " ".join("".join(r.choice(parts) for _ in range(3)) for _ in range(120))
    a, b = ("ta", "mi", "lo", "ne"), ("szk", "czr", "wyx", "gjq")
    rows = [(i, text(a), "cs") for i in range(80)] + [(100 + i, text(b), "lv") for i in range(8)] + [(200, text(b), "cs")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {x.doc_id: x.kept for x in quality_rules.quality_rules(docs).collect()}
    assert all(kept[i] for i in (*range(80), *range(100, 108))) and not kept[200]
    scratch = quality_rules.Scratch(spark, "test")
    assert {r.lang for r in quality_rules.train(scratch, docs).select("lang").distinct().collect()} == {"cs", "lv"}


def test_licenses(spark, docs):
    rows = [
        *docs, (1001, "Licensed under the Apache License, Version 2.0."), (1002, "cc by-nc CC  BY NC. x"), (1003, "This work is licensed under the GNU General Public License, version 3."), (1004, "Licensed under CC BY-NC-SA 4.0"),
        (1005, "permit under the mit licensed"), (1006, "ALL RIGHTS RESERVED"), (1007, "a " * 2000 + "under the mit license " * 300),
    ]
    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, rows)).collect()}
    for d, t in rows:
        w, starts, base = W2.findall(low(t)), [], []
        for label, phrase in licenses.BASE:
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            starts += at
            base += [label] * bool(at)
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert {d: got[d].labels for d in range(1001, 1008)} == {1001: "apache-2", 1002: "cc-by-nc", 1003: "gpl-3", 1004: "cc-by-nc,cc-by-nc-sa", 1005: "", 1006: "all-rights-reserved", 1007: "mit"}
    assert licenses.license_scan(frame(spark, rows[:0])).count() == 0 and len(licenses.rules()) > 200
    one = frame(spark, [rows[-1]] * 2)
    assert [r.labels for r in licenses.license_scan(one).collect()] == ["mit"] * 2


def test_license_suppression_against_brute_force(spark, docs):
    rows = [(i, t) for i, t in enumerate(["licensed under cc by nc 4 0 and spdx license identifier mit", "gnu lesser general public license version 3", "general public license under the bsd 2 clause license", "x"])]
    norm = frame(spark, rows).select("doc_id", licenses.normal(F.col("text")).alias("norm"))
    got = {(r.doc_id, r.label, r.start_word, r.end_word) for r in licenses.detections(norm).collect()}
    want = set()
    for d, t in rows:
        t = " ".join(W2.findall(low(t)))
        found = {}
        for label, _, pattern, priority, _ in licenses.rules():
            for m in re.finditer(pattern, t):
                a = t[: m.start()].count(" ")
                found[label, priority, a, a + m.group().count(" ") + 1] = 1
        order = sorted(found, key=lambda f: (f[2], -f[3], -f[1], f[0]))
        for i, (label, priority, a, b) in enumerate(order):
            if not any(p >= priority and y >= b for _, p, _, y in order[:i]):
                want.add((d, label, a, b))
    assert got == want


def spelled(pattern):
    """Texts that spell every alternative and every optional part of a rule."""
    parse = re._parser

    def every(items):
        out = [""]
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                part = [chr(arg)]
            elif name == "ANY":
                part = ["x"]
            elif name == "IN":
                part = [chr(c) for o, v in arg for c in ([v] if str(o) == "LITERAL" else range(v[0], v[1] + 1))]
            elif name == "BRANCH":
                part = [t for b in arg[1] for t in every(b)]
            elif name == "SUBPATTERN":
                part = every(arg[3])
            elif name == "MAX_REPEAT":
                part = [t * n for n in {arg[0], min(arg[1], 1)} for t in every(arg[2])]
            else:
                assert name == "ASSERT_NOT", name
                part = [""]
            out = [a + b for a in out for b in part]
        return out

    return every(parse.parse(pattern))


def test_license_keywords_pass_every_alternative(spark):
    texts = []
    for label, keywords, pattern, _, _ in licenses.rules():
        for t in spelled(pattern):
            assert re.search(pattern, t) and all(k in f" {t} " for k in keywords), (label, t)
            texts.append((len(texts), t.upper().replace(" ", "-\n")))
    assert spark.createDataFrame(texts, "doc_id long, text string").where(~licenses.gate(F.lower("text"))).collect() == []
    assert len(licenses.rules()) == len({p for _, _, p, _, _ in licenses.rules()}) > 200
    rows = [(1, "Licensed under CDDL 1.0"), (2, "released under the FreeBSD license"), (3, "Licensed under the Common Development and Distribution 1.0 license")]
    assert {r.doc_id: r.labels for r in licenses.license_scan(frame(spark, rows)).collect()} == {1: "cddl-1", 2: "bsd-2-clause", 3: "cddl-1"}


def test_token_counts(spark, docs):
    e = token_counts.encoder(token_counts.load_ranks(VOCABULARY))
    for block in (64, 1 << 20):
        got = sorted((r.doc_id, r.n_tokens) for r in token_counts.document_token_counts(frame(spark, docs).repartition(3), VOCABULARY, block).collect())
        assert got == sorted((d, len(e.encode_ordinary(t or ""))) for d, t in docs)
    assert token_counts.document_token_counts(frame(spark, docs[:0]), VOCABULARY).count() == 0


def test_flat_files(spark, tmp_path):
    import numpy as np

    files = {"a": [5, 6, 0, 0, 7, 0, 8, 9], "b": [0], "c": [1] * 40 + [0], "d": []}
    for name, tokens in files.items():
        (tmp_path / name).write_bytes(np.array(tokens, np.uint16).tobytes())
    for whole in (1 << 20, 10):  # through Hadoop's file system, and the larger file by ranges
        for chunk in (1024, 2):
            blocks = token_counts.read_flat_files(spark, str(tmp_path), 6, whole)
            got = {}
            for r in token_counts.scan_separators(blocks, 0, chunk=chunk).orderBy("file", "ordinal").collect():
                got.setdefault(r.file[-1], []).append(r.n_tokens)
            assert got == {"a": [2, 0, 1, 2], "b": [0], "c": [40]}


def test_layout_follows_the_vocabulary(spark, docs, tmp_path):
    import base64

    assert token_counts.layout(token_counts.load_ranks(VOCABULARY)) == (50256, 2)
    wide = tmp_path / "wide"
    wide.write_bytes(b"".join(base64.b64encode(bytes([i])) + b" %d\n" % (i if i else 70_000) for i in range(256)))
    ranks = token_counts.load_ranks(str(wide))
    assert token_counts.layout(ranks) == (70_001, 4)
    got = sorted((r.doc_id, r.n_tokens) for r in token_counts.document_token_counts(frame(spark, docs[:20]), str(wide), 64).collect())
    assert got == sorted((d, len((t or "").encode())) for d, t in docs[:20])


def brute_repeats(rows, k):
    """Words inside k-word runs that an earlier document holds."""
    first, out = {}, {}
    for d, t in sorted(rows, key=lambda x: x[0]):
        w = W5.findall(low(t))
        m = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first.get(tuple(w[i : i + k]), d) != d:
                m[i : i + k] = [True] * k
        out[d] = m
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), d)
    return out


def test_repeated_passages(spark, docs):
    rows = substring_dedup.repeated_passages(frame(spark, docs)).collect()
    covered = {}
    for r in rows:
        assert r.src_doc_id < r.doc_id and r.n_words == r.end_word - r.start_word >= 50 and r.n_matched >= 0.8 * r.n_words
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    for d, m in brute_repeats(docs, 50).items():
        assert {i for i, x in enumerate(m) if x} <= covered.get(d, set())
    near = brute_repeats(docs, 12)
    assert all(any(near[d]) for d in covered)
    stage = {r.doc_id: r.text for r in substring_dedup.passage_stage(frame(spark, docs)).collect()}
    for d, t in docs:
        want = " ".join(w for i, w in enumerate(W5.findall(t or "")) if i not in covered.get(d, set()))
        if d not in covered:
            assert stage[d] == t
        elif want:
            assert " ".join(W5.findall(stage[d])) == want
        else:
            assert d not in stage
    assert substring_dedup.repeated_passages(frame(spark, docs[:0])).count() == 0


def test_chains_against_all_subsets():
    r = random.Random(2)
    for _ in range(60):
        n = r.randint(1, 7)
        x, y = [r.randint(0, 60) for _ in range(n)], [r.randint(0, 60) for _ in range(n)]
        best = 0.0
        for mask in range(1, 1 << n):
            part = sorted((x[i], y[i]) for i in range(n) if mask >> i & 1)
            if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(part, part[1:], strict=False)):
                best = max(best, 5 * len(part) - sum(0.25 * ((b[0] - a[0] - 5) + (b[1] - a[1] - 5)) / 2 for a, b in zip(part, part[1:], strict=False)))
        got = substring_dedup.chains(x, y, 5, 0.25, 0.0)
        assert got[0][1] == pytest.approx(best)


def test_fuzzy_passages(spark):
    r = random.Random(9)
    p = [f"t{r.randrange(5000)}" for _ in range(120)]
    q = p[:40] + ["changed"] + p[41:80] + p[83:]
    rows = [(1, " ".join(["head"] * 3 + p)), (2, " ".join(q + ["tail"] * 5)), (3, " ".join(f"u{r.randrange(5000)}" for _ in range(120)))]
    got = substring_dedup.repeated_passages(frame(spark, rows)).collect()
    assert [(x.doc_id, x.src_doc_id) for x in got] == [(2, 1)] and got[0].start_word == 0 and got[0].end_word == len(q)


def covered_words(spark, rows):
    out = {}
    for r in substring_dedup.repeated_passages(frame(spark, rows)).collect():
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out


def test_passages_of_frequent_lines_and_large_families(spark):
    """Runs of 50 words are found whatever the frequency of their seeds, and so is every member of a family."""
    r = random.Random(21)
    own = iter(range(10**6))
    fresh = lambda n: [f"v{next(own)}" for _ in range(n)]
    lines = [fresh(10) for _ in range(20)]
    texts = []
    for _ in range(250):  # every line stands in many documents, in no order
        texts.append([w for _ in range(5) for w in fresh(8) + r.choice(lines) + r.choice(lines)])
    passages = [[w for line in r.sample(lines, 6) for w in line] for _ in range(40)]
    texts += [fresh(30) + p + fresh(30) for p in passages] + [fresh(20) + p + fresh(9) for p in passages]
    root = fresh(70)
    for _ in range(80):
        w = list(root)
        for i in r.sample(range(70), 4):
            w[i] = next(iter(fresh(1)))
        texts.append(fresh(5) + w)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = covered_words(spark, rows)
    for d, m in brute_repeats(rows, 50).items():
        assert {i for i, x in enumerate(m) if x} <= got.get(d, set())
    assert set(range(291, 330)) <= set(got) and set(range(331, 410)) <= set(got)


@pytest.mark.parametrize("percent", [80, 85, 90, 95])
def test_fuzzy_recall_against_brute_force(spark, percent):
    """Pairs of a lone source and a substituted copy; the truth is a scan of every stretch of the diagonal."""
    r = random.Random(percent)
    own = iter(range(10**6))
    fresh = lambda n: [f"v{next(own)}" for _ in range(n)]
    rows, truth = [], set()
    for i in range(120):
        n = r.choice((50, 60, 120))
        p, bad = fresh(n), set(r.sample(range(n), n * (100 - percent) // 100))
        m = [j not in bad for j in range(n)]
        if any(m[a] and m[b] and 100 * sum(m[a : b + 1]) >= 80 * (b + 1 - a) for a in range(n) for b in range(a + 49, n)):
            truth.add(2 * i + 1)
        rows += [(2 * i, " ".join(fresh(20) + p + fresh(20))), (2 * i + 1, " ".join(fresh(15) + [w if m[j] else f"z{next(own)}" for j, w in enumerate(p)] + fresh(15)))]
    got = set(covered_words(spark, rows))
    assert got <= truth and len(got) >= 0.95 * len(truth), (len(got), len(truth))


def test_frequent_pairs_of_seeds_are_matched_in_all_surroundings(spark):
    """Every short run of a passage stands in many earlier documents, first among other words; its source is found all the same."""
    r = random.Random(11)
    new = iter(f"u{i}" for i in range(1_000_000))
    passage = [f"p{i}" for i in range(80)]
    rows = []
    for i in range(20):  # pieces of 12 words among words of their own
        text = []
        for at in r.sample(range(0, 69), 69):
            text += passage[at : at + 12] + [next(new) for _ in range(20)]
        rows.append((i, " ".join(text)))
    rows.append((100, " ".join(["a", *passage, "b"])))
    for i in range(3):
        rows.append((200 + i, " ".join(next(new) if j % 5 == i else w for j, w in enumerate(passage))))
    got = {x.doc_id: x for x in substring_dedup.repeated_passages(frame(spark, rows)).collect() if x.doc_id >= 200}
    assert {i: x.src_doc_id for i, x in got.items()} == dict.fromkeys((200, 201, 202), 100)
    assert all(x.n_words >= 76 for x in got.values())


def test_covering_sources_have_all_words_that_any_has():
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, 1, np.uint64)
    near = base ^ np.bitwise_or.reduce([(r.random(120) < 0.15).astype(np.uint64) << np.uint64(2 * j) for j in range(32)])
    doc = np.sort(r.integers(0, 50, 120))
    for cells in (1, 500, 1 << 18):
        t, s = substring_dedup.covering(near, doc, np.zeros(120, np.int64), np.arange(120), np.zeros(120, np.uint32), 4, cells)
        assert len(set(zip(t.tolist(), s.tolist()))) == len(t)
        for i in range(120):
            same = substring_dedup.agreement(near[i], near[doc < doc[i]])
            same = same[substring_dedup.alike(same, 4)]
            mine = substring_dedup.agreement(near[i], near[s[t == i]])
            assert (doc[s[t == i]] < doc[i]).all() and substring_dedup.alike(mine, 4).all()
            assert np.bitwise_or.reduce(mine, initial=np.uint32(0)) == np.bitwise_or.reduce(same, initial=np.uint32(0))
            assert not len(same) or len(mine) and np.bitwise_count(mine).max() == np.bitwise_count(same).max()


def test_components_take_one_join_and_no_broadcast_a_plan(spark):
    plans = []

    class Watched(Scratch):
        def write(self, df, name):
            plans.append(df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")))
            return super().write(df, name)

    rng = random.Random(5)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(30)] + [(300, 301 + i) for i in range(40)]
    got = {r.node: r.component for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long"), Watched(spark, "watched")).collect()}
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert got == least
    assert max(p.count("Join") for p in plans) == 1 and not any("Broadcast" in p for p in plans) and max(p.count("Exchange") for p in plans) <= 4


def test_likely_words_against_a_loop_over_the_words_around(spark):
    def loop(x, same, k):
        out = np.zeros(int(x.max()) + k + 17, bool)
        for j in range(k):
            out[x + j] = True
        for shift, step in ((0, 1), (16, -1)):
            side = same >> np.uint32(shift) & np.uint32(0xFFFF)
            side = np.where(np.bitwise_count(side) >= 10, side, side & ~(side + np.uint32(1)))
            for j in range(16):
                at = x[(side >> np.uint32(j) & np.uint32(1)) == 1]
                at = at + (k + j if step > 0 else -1 - j)
                out[at[at >= 0]] = True
        return out

    def seconds(f, rows):
        began = time.process_time()
        for x, same in rows:
            f(x, same, 4)
        return time.process_time() - began

    rng = np.random.default_rng(3)
    rows = [(rng.integers(0, 400, n).astype(np.int32), rng.integers(0, 1 << 32, n, np.uint32) | rng.integers(0, 1 << 32, n, np.uint32)) for n in [1, 2, 40_000] + [80] * 200]
    assert all(np.array_equal(substring_dedup.likely(x, same, 4), loop(x, same, 4)) for x, same in rows)
    assert min(seconds(substring_dedup.likely, rows[3:]) for _ in range(5)) < 0.6 * min(seconds(loop, rows[3:]) for _ in range(5))


def test_covering_counts_words_alike_as_agreement_does(spark):
    rng = np.random.default_rng(4)
    n, k = 300, 4
    near = rng.integers(0, 1 << 63, n, np.uint64)
    near = np.where(rng.random(n) < 0.7, near[rng.integers(0, 9, n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), near)
    doc, start = np.arange(n) // 2, np.where(np.arange(n) < 200, 0, 200)
    had = np.where(rng.random(n) < 0.5, rng.integers(0, 1 << 32, n), 0).astype(np.uint32)
    want = []
    for t in range(n):
        left, sources = ~had[t], [s for s in range(start[t], n) if start[s] == start[t] and doc[s] < doc[t]]
        same = substring_dedup.agreement(near[[t] * len(sources)], near[sources])
        found = [(s, x) for s, x, ok in zip(sources, same, substring_dedup.alike(same, k), strict=True) if ok]
        while found and (best := max(found, key=lambda y: (int(np.bitwise_count(y[1] & left)), -y[0]))) and best[1] & left:
            want.append((t, best[0]))
            left &= ~best[1]
    for cells in (1, 1000, 1 << 16):
        t, s = substring_dedup.covering(near, doc, start, np.arange(n), had, k, cells)
        assert sorted(zip(t.tolist(), s.tolist(), strict=True)) == sorted(want) and len(want) > 200


def test_an_ngram_of_a_slice_is_looked_up_once(spark, monkeypatch, tmp_path):
    rows = [(i, t, "en") for i, t in enumerate(["the cat sat on the mat. " * 40, "a dog sat on the cat"])]
    scratch = quality_rules.Scratch(spark, "test")
    table, count = quality_rules.sharded(scratch, quality_rules.train(scratch, spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    shard = next(iter(quality_rules._shards(spark, table, count))).value
    text = "the mat sat on a zebra, the dog! " * 300
    c, begin = quality_rules.characters(np.frombuffer(text.encode(), np.uint8), np.array([0, 40, len(text)]))
    at, _ = quality_rules.positions(begin)
    starts = [quality_rules.seed(x) for x in ("en", "xx")]
    alone = [np.concatenate([shard.score(c, at[i : i + 1], s) for i in range(200)]) for s in starts]
    asked, find = [], quality_rules.Shard.find
    monkeypatch.setattr(quality_rules.Shard, "find", lambda self, kind, h: asked.append(len(h)) or find(self, kind, h))
    got = list(shard.scores(c, at, starts))
    assert max(asked) == len({c[i - 4 : i + 1].tobytes() for i in at}) and sum(asked) < len(at) / 5
    assert all(np.array_equal(x[:200], y) for x, y in zip(got, alone, strict=True))


def test_equal_hashes_stand_together():
    rng = np.random.default_rng(5)
    close = np.uint64(7 << 40) + rng.integers(0, 3, 999).astype(np.uint64)  # all bits but the lowest are alike
    for h in (rng.integers(0, 50, 999).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), close, close[:1], close[:0]):
        order, start = quality_rules.repeats(h)
        assert sorted(order.tolist()) == list(range(len(h))) and h[order[start]].tolist() == list(dict.fromkeys(h[order].tolist())) and len(start) == len(set(h.tolist()))
        assert all((np.diff(x) > 0).all() for x in np.split(order, start[1:]))


def test_repeated_words_are_counted_by_text():
    texts = ["a b c", "a b c", "", "a b c d a b c", "x x x x", "x x", "d a b c\nq\nq\n\nq", "a b c a b", "e f"]
    data, bounds = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    got = quality_rules.base_counts(data, bounds, *quality_rules.hash_words(data, bounds, quality_rules._EXACT))
    assert got["n_repeat_words"].tolist() == [0, 0, 0, 6, 4, 0, 0, 0, 0] and got["n_dup_lines"].tolist() == [0, 0, 0, 0, 0, 0, 2, 0, 0]


def test_matches_of_one_place_are_marked_together():
    rng = np.random.default_rng(6)
    x, same = rng.integers(0, 90, 60_000).astype(np.int32), rng.integers(0, 1 << 32, 60_000, np.uint32) & rng.integers(0, 1 << 32, 60_000, np.uint32)
    want = np.zeros(int(x.max()) + 4 + 17, bool)
    for i in range(0, len(x), 100):
        part = substring_dedup.likely(x[i : i + 100], same[i : i + 100], 4)
        want[: len(part)] |= part
    assert np.array_equal(substring_dedup.likely(x, same, 4), want)

    def seconds(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    each = lambda: (x[:, None] + np.arange(32))[np.unpackbits(same.view(np.uint8).reshape(-1, 4), axis=1).view(bool)]  # noqa: E731  the words around every match
    assert min(seconds(lambda: substring_dedup.likely(x, same, 4)) for _ in range(5)) < 0.6 * min(seconds(each) for _ in range(5))


def test_windows_and_alignments_against_loops():
    rng = np.random.default_rng(7)
    for n in (0, 1, 30, 49, 50, 51, 400, 2000):
        for share in (0.3, 0.7, 0.9):
            mask = rng.random(n) < share
            want = np.zeros(n, bool)
            for i in range(max(1, n - 49)):
                if mask[i : i + 50].sum() >= 35:
                    want[max(0, i - 48) : i + 98] = True
            assert np.array_equal(substring_dedup.around(mask, 50, 35, 48), want)
            s, e = substring_dedup.edges(mask)
            assert [j for a, b in zip(s, e, strict=True) for j in range(a, b)] == np.flatnonzero(mask).tolist() and (s[1:] > e[:-1]).all()
    for _ in range(200):
        a = rng.integers(0, 9, 80).astype(np.uint32)
        b = np.where(rng.random(80) < rng.choice([0.1, 0.4]), 9, a).astype(np.uint32)
        b[30:34] = a[30:34]
        hit = np.zeros(80, bool)
        for places in (range(30, 80), range(29, -1, -1)):
            gain, top, n, found = 0, 0, 0, []
            for j in places:
                gain += 1 if a[j] == b[j] else -1
                if top - gain >= 8:
                    break
                found.append(j)
                if gain >= top and gain > 0:
                    top, n = gain, len(found)
            hit[[j for j in found[:n] if a[j] == b[j]]] = True
        assert np.array_equal(substring_dedup.align(a, b, [(30, 30)], 4), hit)
