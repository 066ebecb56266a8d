"""Divergence, periodic runs and packing against brute force, and on odd input."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnledger.llm import divergence, packing, periodic_runs
from turnledger.llm.queries import PACKING_VOCABULARY, op12_periodic_runs

TERM, WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path(PACKING_VOCABULARY)


# divergence


def audited():
    r = random.Random(5)
    words = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"] + ["Été", "ÉTÉ", "x-y", "a1b", "Ab_cD", "ﬀ", "𝒳y"]
    out = []
    for i in range(160):
        source = r.choice(["s0"] * 6 + ["s1", "s2", "s3", "é", "", "s10", None])
        lang = r.choice(["en", "en", "de", None])
        mine = words[: r.choice([4, 12, len(words)])] if source != "s2" else words[-3:]
        out.append((i, " ".join(r.choice(mine) for _ in range(r.randint(0, 30))), lang, source))
    out += [(900, None, "en", "silent"), (901, "", "xx", "alone"), (902, "q q q", "yy", "a"), (903, "1 2", "yy", "b"), (904, "wa " * 50_000, "en", "long"), (1, out[1][1], "en", "s1"), (None, "wa wb", "de", "s3")]
    return out


def brute_divergence(rows, least, top=50):
    rows = [(t or "", la or "", s or "") for _, t, la, s in rows]
    df, n = collections.Counter(), collections.Counter()
    groups = {(la, s) for _, la, s in rows}
    for t, la, s in rows:
        found = [low(w) for w in TERM.findall(t)]
        df.update({(la, w) for w in found})
        n.update((la, s, w) for w in found)
    kept = collections.defaultdict(list)
    for (la, w), k in df.items():
        if k >= least:
            kept[la].append(w)
    share = lambda c, total, v: 1 + 10**9 * (c + 5) // (total + 5 * v)
    p, q = {}, {}
    for la, s in groups:
        total = sum(n[la, s, w] for w in kept[la])
        p[la, s] = {w: share(n[la, s, w], total, len(kept[la])) for w in kept[la]}
    for la in kept:
        every = {w: sum(n[la, s, w] for x, s in groups if x == la) for w in kept[la]}
        q[la] = {w: share(c, sum(every.values()), len(every)) for w, c in every.items()}
    out = set()
    for la, s in groups:
        pairs = [(sum(abs(p[la, s][w] - p[la, o][w]) for w in kept[la]), o) for x, o in groups if x == la and o != s]
        terms = [(p[la, s][w] - q[la][w], w) for w in kept[la] if n[la, s, w] and p[la, s][w] > q[la][w]]
        for part, listed, most in (("pair", pairs, 10**9), ("term", terms, top)):
            for i, (v, item) in enumerate(sorted(listed, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                out.add((la, s, part, item, v, i))
    return out


@pytest.mark.parametrize(("least", "light", "side", "wide"), [(3, 1, 64, 512), (3, 3, 2, 4), (2, 100, 3, 8), (60, 2, 1, 1), (10**6, 8, 2, 4)])
def test_divergence_against_brute_force(spark, monkeypatch, least, light, side, wide):
    monkeypatch.setattr(divergence, "SIDE", side)
    monkeypatch.setattr(divergence, "WIDE", wide)
    rows = audited()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("*", *(F.lit("clash").alias(c) for c in ("term", "n", "p", "q", "side", "block", "kept", "total", "a", "v", "rank")))
    out = divergence.source_divergence(docs, least=least, top=5, light=light).collect()
    assert {tuple(r) for r in out} == brute_divergence(rows, least, 5) and len(out) == len({tuple(r) for r in out})
    assert out[0].asDict().keys() == {"lang", "source", "part", "item", "value", "rank"}


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


# periodic runs


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                stretch = w[i : j + q]
                if not any(all(stretch[x] == stretch[x + s] for x in range(len(stretch) - s)) for s in range(1, q)):
                    out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(d, text, plant=True):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(d).encode()) if d is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return d, len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, digest("".join(f"{s},{x},{q}\n" for s, x, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in drop))


def test_runs_against_brute_force():
    r = random.Random(1)
    for _ in range(1500):
        n, k = r.randint(0, 70), r.choice([1, 2, 3, 6])
        w = [r.randrange(k) for _ in range(n)]
        for _ in range(r.randint(0, 3)):
            if n > 8:
                a, p = r.randrange(n), r.randint(1, 7)
                for i in range(a, min(n, a + r.randint(1, n))):
                    w[i] = w[a + (i - a) % p]
        assert [tuple(map(int, x)) for x in zip(*periodic_runs.runs(np.array(w, np.int64), n // 4), strict=True)] == brute_runs(w), w


def test_long_runs_take_no_square():
    w = np.random.default_rng(0).integers(0, 500, 300_000)
    w[1000:200_000] = np.arange(199_000) % 1_700
    w[210_000:] = 7
    got = {tuple(map(int, x)) for x in zip(*periodic_runs.runs(w, 75_000), strict=True)}
    assert any(abs(s - 1000) <= 2 and q == 1_700 and length >= 199_000 for s, length, q in got) and any(q == 1 and length >= 90_000 for _, length, q in got)


def periodic_texts():
    r = random.Random(9)
    words = [f"w{i}" for i in range(40)] + ["É", "x,", "A"]
    out = [(i, " ".join(r.choice(words[: r.choice([2, 5, 43])]) for _ in range(r.randint(0, 90)))) for i in range(160)]
    out += [(200 + i, " ".join(r.choice(words) for _ in range(30)) + "\t" + f"{r.choice(words)}  {r.choice(words)}\n" * r.randint(4, 9)) for i in range(30)]
    out += [(400, None), (401, ""), (402, " \t\n"), (403, "a"), (404, "a " * 6), (405, "a\x00 " * 5), (None, "b " * 7), (None, None), (404, "a " * 6), (406, "x y " * 40_000), (407, "c" * 300_000)]
    return out


def test_periodic_runs_of_documents(spark):
    rows = periodic_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("clash").alias(c) for c in ("start", "length", "period", "n_runs", "n_words", "collapsed")))
    out = periodic_runs.periodic_runs(docs.repartition(3), plant=True)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda t: tuple(map(str, t))
    small = [x for x in rows if len(x[1] or "") < 10_000]
    want = sorted((brute_row(*x) for x in small), key=key)
    got = out.collect()
    assert len(got) == len(rows) and sorted((tuple(r[c] for c in names) for r in got if r.doc_id not in (406, 407)), key=key) == want
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in small) > 8 and sum(w[1] > 0 for w in want) > 30
    plain = {r.doc_id: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert (plain[406].length, plain[406].period, plain[406].collapsed) == (80_000, 2, "x y") and plain[407].n_words == 1 and plain[400].collapsed == ""
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_query_of_periodic_runs(spark, tmp_path):
    rows = periodic_texts()[:190]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op12_periodic_runs(spark, str(tmp_path))
    assert {tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in out.collect()} == {brute_row(*x) for x in rows}


# packing


ODD = ["café don't ,'s A1b22  x", "a<|endoftext|>b", "<|ENDOFTEXT|>", "y é́ 'sound ΣΑΣ 1̀ \x00\x1cz", "", "it's'll 've're", "Straße ﬀ İI ſs K", "a b c\u0085d", "naïve NAÏVE Naïve", "«x» — “y”…", "1,234.5%", "x" * 3000, "日本語 ไทย", "éé"]


def test_identifiers_are_those_of_the_tokenizer():
    r = random.Random(2)
    letters = "abcXYZ019 '.,-\né́ßΣ <|"
    texts = ODD + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    encoder = packing.Encoder(vocabulary())
    for i in range(0, len(texts), 37):
        some = [t.encode() for t in texts[i : i + 37]]
        ids, starts = encoder.encode(np.frombuffer(b"".join(some), np.uint8), np.r_[0, np.cumsum([len(t) for t in some])])
        for t, a, b in zip(texts[i : i + 37], starts[:-1], starts[1:], strict=True):
            assert ids[a:b].tolist() == [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1], t


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    r = np.random.default_rng(seed)
    tokens = int(r.choice([16, 64, 300]))
    h = np.zeros(tokens + 1, np.int64)
    h[1:] = r.integers(0, 1 + r.choice([1, 3, 400]), tokens)
    rows = packing.plan(h, tokens)
    assert (np.bincount(rows[:, 0], rows[:, 2], tokens + 1) == h).all()
    held = collections.defaultdict(list)
    numbers = collections.defaultdict(list)
    for length, first, n, sequence, offset in rows.tolist():
        numbers[length] += range(first, first + n)
        for i in range(n):
            held[sequence + i].append((offset, length))
    assert all(sorted(x) == list(range(len(x))) for x in numbers.values()) and sorted(held) == list(range(len(held)))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= tokens
    least = math.ceil(int((h * np.arange(tokens + 1)).sum()) / tokens)
    if len(held) > max(least * 1.02 + 1, int(h[tokens // 2 + 1 :].sum()) + 1):
        pytest.xfail(f"known gap: {len(held)} sequences against a bound of {least} on an even histogram")


def test_patterns_fit_the_histogram():
    h = np.zeros(101, np.int64)
    h[[60, 40, 30, 70, 50]] = [90, 50, 80, 60, 40]  # 60+40, 70+30 and 50+50 fill a sequence
    rows = packing.patterns(np.flatnonzero(h), 100)
    assert all(sum(r) == 100 for r in rows.tolist()) and [60, 40, 0] in rows.tolist()
    x = packing.fitted(rows, h)
    left = h - sum(np.bincount(r, minlength=101)[:101] * v for r, v in zip(rows, x, strict=True))
    left[0] = 0
    assert (x >= 0).all() and np.abs(left[[70, 50]]).max() < 1 and (left**2).sum() < (h**2).sum() / 4


def test_packed_documents(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["one", "three", "Wörter", "x1"]) for _ in range(r.choice([3, 40, 700])))) for i in range(250)]
    rows += [(500 + i, t) for i, t in enumerate(ODD)] + [(600, None), (601, ""), (None, "a b"), (None, "a b"), (3, rows[3][1]), (602, "w " * 9000), (603, "z " * 4095), (604, "z " * 4096)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("clash").alias(c) for c in ("length", "piece", "nth", "part", "offset", "before")))
    out = packing.packed(docs.repartition(3), vocabulary()).collect()
    tokenizer = packing.Encoder(vocabulary()).tokenizer
    want = collections.Counter()
    total = 0
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for k in range(0, len(ids), 4096):
            want[d, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())] += 1
    assert collections.Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in out) == want
    held = collections.defaultdict(list)
    for x in out:
        held[x.sequence_id].append((x.offset, x.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) <= math.ceil(total / 4096) + 1
    assert packing.packed(docs.limit(0), vocabulary()).count() == 0


def test_numbers_over_several_ranges(spark, monkeypatch):
    """A frequent length lies in several parts, and is numbered across them."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    monkeypatch.setattr(packing, "RANGE_ROWS", 400)
    out = packing.packed(docs, vocabulary()).collect()
    assert len({(x.sequence_id, x.offset) for x in out}) == 3000 and len({x.sequence_id for x in out}) == math.ceil(3000 / 1024)
