"""Control index, prefix-scan ordinals and parallel packing against sequential versions."""

from __future__ import annotations

import collections
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from turnledger import schema
from turnledger.functions import spans
from turnledger.operators import checks, controls, ordinals, requests


def greedy(groups, budget, most, divisor):
    """(batch, padded) of groups of (width, n) in order."""
    up = lambda c: -(-c // divisor) * divisor
    out, batch, width, count, cost = [], 0, 0, 0, {}
    for w, n in groups:
        wide, many = max(width, w), count + n
        if count and ((most is not None and many > most) or wide * up(many) > budget):
            batch, wide, many = batch + 1, w, n
        width, count = wide, many
        cost[batch] = width * up(count)
        out.append(batch)
    return [(b, cost[b]) for b in out]


@pytest.mark.parametrize(("budget", "most", "divisor", "block"), [(400, 16, 4, 1024), (400, None, 3, 8), (1000, 7, 1, 4), (2000, 64, 8, 1)])
def test_packing_is_that_of_a_sequential_fold(spark, monkeypatch, budget, most, divisor, block):
    monkeypatch.setattr(requests, "BLOCK", block)
    r = random.Random(budget + block)
    rows = []
    for queue, size in (("long", 60 if block == 1 else 300), ("one", 1), ("short", 9)):
        for g in range(size):
            rows += [(queue, f"{queue}-{g}-{k}", f"g{g}", r.randint(1, 40)) for k in range(r.choice([1, 1, 2, 5]))]
    df = spark.createDataFrame(rows, "queue string, request_id string, comparison_group_id string, length long").repartition(5)
    want = {}
    for queue in ("long", "one", "short"):
        held = collections.defaultdict(list)
        for q, _, g, n in rows:
            if q == queue:
                held[g].append(n)
        order = sorted(held, key=lambda g: (-max(held[g]), g))
        for g, x in zip(order, greedy([(max(held[g]), len(held[g])) for g in order], budget, most, divisor), strict=True):
            want[queue, g] = x
    assert {(x.queue, x.comparison_group_id): (x.batch_id, x.padded_tokens) for x in requests.pack(df, budget, most, divisor).collect()} == want


def test_a_group_over_the_budget_raises(spark):
    df = spark.createDataFrame([("q", "a", "g", 10), ("q", "b", "g", 11)], "queue string, request_id string, comparison_group_id string, length long")
    with pytest.raises(checks.CheckFailed):
        requests.pack(df, 40, None, 4).collect()
    with pytest.raises(checks.CheckFailed):
        requests.pack(df, 400, 1, 1).collect()
    assert requests.pack(df, 44, 2, 4).first().padded_tokens == 44 and requests.pack(df.limit(0), 44).count() == 0


def test_running_sums_of_one_large_group(spark):
    r = random.Random(7)
    rows = [(g, r.randrange(50), r.randrange(-5, 9)) for g in ["a"] * 2000 + ["b"] * 3 + [f"c{i}" for i in range(40)] for _ in range(2)]
    df = spark.createDataFrame(rows, "g string, x int, v long").repartition(6)
    out = ordinals.running(df.withColumn("one", F.lit(1)), ["g"], ["x"], {"n": "one", "s": "v"}).collect()
    assert len(out) == len(rows)
    held = collections.defaultdict(list)
    for x in out:
        held[x.g].append((x.n, x.s, x.x, x.v))
    for listed in held.values():
        total = 0
        for i, (n, s, _, v) in enumerate(sorted(listed)):
            assert (n, s) == (i, total)
            total += v
        assert [x for _, _, x, _ in sorted(listed)] == sorted(x for _, _, x, _ in listed)
    alone = ordinals.numbered(df, [], [F.desc("x"), "v"], "k").collect()
    assert sorted(x.k for x in alone) == list(range(len(rows))) and [x.x for x in sorted(alone, key=lambda x: x.k)] == sorted((x.x for x in alone), reverse=True)


def candidate(r, i):
    signature = r.choice([[], [], ["s1"], ["s1", "s2"], [f"t{r.randrange(9)}"]])
    text = r.choice([f"text {r.randrange(60)}", f"text {r.randrange(60)}", " "])
    return (r.choice([1, 1, 2]), f"o{i:03}", r.choice("qrs"), r.choice("xy"), r.choice(["1", "2+"]), text, r.choice([0, 10, 12, 13, 50, 62, 63, 100, 80, 1000]), r.choice([1, 1, 3]), signature, r.random() < 0.9)


def brute_controls(anchor, pool, count=3):
    names = schema.CANDIDATE.fieldNames()
    a = dict(zip(names, anchor, strict=True))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    point = lambda *p: int(sha("|".join(p))[:15], 16)
    mark = lambda c: sha(json.dumps(c["document_signature"], separators=(",", ":"))) if c["document_signature"] else sha("serialized|" + c["serialized_observation"])
    best = {}
    for row in pool:
        c = dict(zip(names, row, strict=True))
        if not c["valid"] or not c["serialized_observation"].strip() or c["global_step"] != a["global_step"] or c["document_count"] != a["document_count"] or c["question_id"] == a["question_id"] or c["serialized_observation"] == a["serialized_observation"]:
            continue
        if a["document_signature"] and c["document_signature"] == a["document_signature"]:
            continue
        near = a["token_length"] > 0 and c["token_length"] > 0 and 0.75 <= c["token_length"] / a["token_length"] <= 1.25
        source, bucket = c["data_source"] == a["data_source"], c["call_bucket"] == a["call_bucket"]
        tier = 0 if near and source and bucket else 1 if near and source else 2 if near else 3
        f = mark(c)
        best[f] = min(best.get(f, (9, "")), (tier, c["observation_id"]))
    own = point(schema.REVISION, "anchor", a["observation_id"])
    ranked = sorted((tier, (point(f) - own) % controls.CIRCLE, f, i) for f, (tier, i) in best.items())[:count]
    return [(k, ranked[k % len(ranked)][3], ranked[k % len(ranked)][0], len(ranked) < count) for k in range(count)] if ranked else []


@pytest.mark.parametrize(("window", "n"), [(1, 90), (8, 260)])
def test_controls_by_index_are_those_of_all_pairs(spark, window, n):
    r = random.Random(n)
    pool = [candidate(r, i) for i in range(n)]
    # signatures follow from texts: equal texts have equal ones
    first = {}
    pool = [(*c[:8], first.setdefault(c[5], c[8]), c[9]) for c in pool]
    pool += [(1, f"copy{i}", "qrs"[i % 3], "x", "1", "the same", 10, 1, [], True) for i in range(120)]
    df = spark.createDataFrame(pool, schema.CANDIDATE).repartition(3)
    got = collections.defaultdict(list)
    for x in controls.next_controls(df, df, window=window).collect():
        got[x.anchor_id].append((x.control_index, x.observation_id, x.tier, x.used_replacement))
    for anchor in pool:
        assert sorted(got[anchor[1]]) == brute_controls(anchor, pool), anchor
    assert {t for v in got.values() for _, _, t, _ in v} == {0, 1, 2, 3}


def test_barrier_runs_answer_for_every_cell(spark):
    r = random.Random(8)
    rows = [(i, [int(r.random() < 0.8) for _ in range(n)], [k for k in range(n) if r.random() < r.choice([0, 0.3, 0.9])]) for i, n in enumerate([1, 2, 5, 5, 9, 20, 40] * 4)] + [(99, [1, 1, 1, 1, 0], [1]), (100, [0, 1, 1, 1, 1], [2])]
    df = spark.createDataFrame(rows, "request_id long, attention_mask array<int>, blocked_key_positions array<int>")
    runs = spans.barrier_runs(F.col("attention_mask"), F.col("blocked_key_positions"))
    pairs = collections.defaultdict(set)
    for x in spans.information_barrier(df).collect():
        pairs[x.request_id].add((x.q, x.k))
    for x in df.select("request_id", runs.alias("runs"), spans.barrier_sums(runs).alias("s")).collect():
        mask, blocked = next((m, set(b)) for i, m, b in rows if i == x.request_id)
        want = {(q, k) for q in range(len(mask)) for k in range(q + 1) if mask[q] and mask[k] and (q == k or q in blocked or k not in blocked)}
        assert pairs[x.request_id] == want and (x.s.pairs, x.s.q, x.s.k) == (len(want), sum(q for q, _ in want), sum(k for _, k in want))
        assert len(x.runs) <= 2 * len(blocked) + mask.count(0) + 1


def test_links_are_doubled_only_where_a_block_is_entered(spark, monkeypatch):
    """Beyond the first table of jumps, with all positions, few are left; a19's packing is read, not made again."""
    tables = []

    def written(df, keep=requests.written):
        out = keep(df)
        tables.append((set(out.columns), out.count()))
        return out

    rng = random.Random(5)
    rows = [("q", f"r{i}-{j}", f"{i:05d}", rng.randint(1, 50)) for i in range(5000) for j in range(rng.randint(1, 7))]
    df = spark.createDataFrame(rows, "queue string, request_id string, comparison_group_id string, length long")
    monkeypatch.setattr(requests, "written", written)
    packed = requests.pack(df, 1000, 32, 4)
    jumps = [n for c, n in tables if "leaves" in c]
    assert jumps[0] == 5000 and len(jumps) > 2 and max(jumps[1:]) < 500
    assert requests.packing_cost(df, packed).first().item_count == len(rows) and "padded_tokens" in tables[-1][0]



def test_places_of_a_tier_are_written_once(spark, monkeypatch):
    """Index and anchors are ranked in one shuffle, which two writes made twice."""
    tables = []

    def written(df, keep=controls.written):
        tables.append(set(df.columns))
        return keep(df)

    monkeypatch.setattr(controls, "written", written)
    r = random.Random(5)
    df = spark.createDataFrame([candidate(r, i) for i in range(20)], schema.CANDIDATE)
    placed = controls._placed(controls.control_index(df), df.select("global_step", F.lit(0).cast("long").alias("point"), F.col("observation_id").alias("anchor_id")), ["global_step"])
    assert {x.total for x in placed[1].collect()} and placed[0].count() and sum("is_index" in x for x in tables) == 1
