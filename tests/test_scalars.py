"""Golden values of the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from turnledger.functions import scalars as S
from turnledger.functions import spans as P


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["x"])
    return df.select(column.alias("r")).first().r


def utility(spark, real, empty, controls, delta=0.1, scale=0.5, **kw):
    lit = F.lit
    return one(spark, S.search_utility(lit(real), lit(empty), [lit(c) for c in controls], delta, scale, **kw))


def test_word_fbeta(spark):
    rows = spark.createDataFrame([("1", "red red red", "red"), ("2", "The Cat!", "cat"), ("3", "", "x"), ("4", "a b", "c"), ("5", None, "x")], "k string, p string, t string")
    got = {r.k: r.fbeta for r in S.fbeta_scores(rows, "k", "p", "t").collect()}
    assert got["1"] == pytest.approx(5 / 13)
    assert got["2"] == 1.0 and got["3"] == 0 and got["4"] == 0 and got["5"] == 0


@pytest.mark.parametrize(("a", "b", "want"), [(0.7, 0.4, (0.4, False)), (-0.7, -0.4, (-0.4, False)), (0.7, -0.4, (0.0, True)), (0.0, 0.4, (0.0, False))])
def test_directed_agreement(spark, a, b, want):
    r = one(spark, S.directed_agreement(F.lit(a), F.lit(b)))
    assert (r.directed, r.conflict) == want


def test_search_utility(spark):
    assert utility(spark, 1.0, 0.0, [0.2] * 3).utility == pytest.approx(math.tanh(1.4))
    assert utility(spark, 0.0, 1.0, [0.5] * 3).utility == pytest.approx(-0.1 * math.tanh(0.8))
    r = utility(spark, 1.0, 0.0, [0.2] * 3, repeat=F.lit(True))
    assert (r.utility, r.zero_reason) == (0.0, "visible_exact_repeat")
    r = utility(spark, 0.0, 1.0, [0.5] * 3, repeat=F.lit(True))
    assert r.utility < 0 and r.zero_reason is None
    assert utility(spark, 0.5, 0.0, [1.0] * 3).zero_reason == "contrast_sign_conflict"
    assert utility(spark, 0.5, 0.45, [0.45] * 3).zero_reason == "dead_zone"
    assert utility(spark, 1.0, 0.0, [0.2] * 3, valid=F.lit(False)).zero_reason == "invalid_search"
    assert utility(spark, 1.0, 0.0, [0.2] * 3, consumable=F.lit(False)).zero_reason == "unconsumable_observation"
    r = utility(spark, float("nan"), 0.0, [0.2] * 3)
    assert (r.utility, r.scored, r.zero_reason, r.g_directed) == (0.0, False, "score_unavailable", None)


def test_responsibility(spark):
    assert one(spark, S.responsibility_strength(F.lit(0.6), F.lit(0.2), 0.1, 0.3)) == pytest.approx(1 - math.exp(-1))
    w = one(spark, S.chunk_weights(F.lit(1.0), F.array(F.lit(0.0), F.lit(0.5), F.lit(2.0)), 0.0))
    assert w == pytest.approx([0.8, 0.2, 0.0], abs=1e-6)
    assert one(spark, S.chunk_weights(F.lit(0.0), F.array(F.lit(1.0)), 0.0)) == [0.0]
    r = one(spark, S.route_credit(F.lit(2.0), F.lit(0.5), F.array(F.lit(0.25), F.lit(0.75)), 0.5))
    assert (r.action, r.chunks) == (1.0, [0.125, 0.375])
    assert one(spark, S.absolute_mass(F.lit(-1.0), F.array(F.lit(-0.5), F.lit(0.25)))) == 1.75


def test_texts(spark):
    doc = "<documents>\nDoc 1: Same\nBody  text\nDoc 2: Other\nMore</documents>"
    assert one(spark, S.document_passages(F.lit(doc))) == ["Same\nBody  text", "Other\nMore"]
    assert one(spark, S.visible_passages(F.lit(f"x {doc} y <DOCUMENTS>Doc 1: Z\nq</DOCUMENTS>"))) == ["Same\nBody  text", "Other\nMore", "Z\nq"]
    assert one(spark, S.exact_repeat(F.array(F.lit("a  b"), F.lit(" ")), F.array(F.lit("a\nb"))))
    assert not one(spark, S.exact_repeat(F.array(F.lit("")), F.array(F.lit(""))))
    assert one(spark, S.observation_slot(F.lit(" "))) == "<documents></documents>"
    assert one(spark, S.observation_slot(F.lit(" x "))) == "<documents>x</documents>"
    assert one(spark, S.observation_slot(F.lit("<Documents>x</Documents>"))) == "<Documents>x</Documents>"
    assert one(spark, S.normalize_answer(F.lit("The  New-York,"))) == "newyork"
    assert one(spark, S.question_id(F.lit(None), F.lit(None), F.lit(3))) == "unknown:train:row:3"


@pytest.mark.parametrize(("step", "want"), [(1, 0.004), (30, 0.12), (300, 0.12)])
def test_effective_lambda(spark, step, want):
    assert one(spark, S.effective_lambda(0.12, F.lit(step))) == pytest.approx(want)


def test_positions(spark):
    ints = lambda *v: F.array(*(F.lit(x) for x in v)) if v else F.array().cast("array<int>")
    assert one(spark, P.positions(F.col("m")), m=[0, 1, 0, 1]) == [1, 3]
    assert one(spark, P.positions(ints())) == []
    assert [one(spark, P.contiguous(x)) for x in (ints(), ints(4), ints(4, 5), ints(4, 6), ints(5, 4))] == [False, True, True, False, False]
    r = one(spark, P.split_positions(ints(5, 4, 3), ints(3, 9)))
    assert (r.boundary, r.content) == ([3], [4, 5])
    r = one(spark, P.teacher_forced(ints(1, 2), ints(3), ints(4, 5), ints(1, 0, 1)))
    assert (r.input_ids, r.target_positions, r.predictor_positions, r.blocked_key_positions) == ([1, 2, 3, 4, 5], [3, 4], [2, 3], [0, 1])
    assert one(spark, P.request_problem(ints(1), ints(), ints(), ints())) == "empty_target"
    assert one(spark, P.request_problem(ints(), ints(), ints(1), ints())) == "no_causal_predecessor"
    assert one(spark, P.request_problem(ints(1), ints(), ints(1), ints(1))) == "blocked_outside_prefix"
    assert one(spark, P.request_problem(ints(1), ints(), ints(1), ints(), 1)) == "score_context_overflow"


def test_barrier_is_the_masked_matrix(spark):
    rows = spark.createDataFrame([("r", [1, 1, 1, 0], [1])], "request_id string, attention_mask array<int>, blocked_key_positions array<int>")
    got = {(r.q, r.k) for r in P.information_barrier(rows).collect()}
    assert got == {(0, 0), (1, 0), (1, 1), (2, 0), (2, 2)}


def test_word_overlap_sorts_stretches_of_bounded_size(spark, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"p": [[1] * n for n in (3, 0, 9, 2, 2)], "t": [[2], [], [3], None, [4, 4]]})
    parts = list(S._by_words([batch, batch.slice(0, 0)], ("p", "t"), 5))
    assert [b.num_rows for b in parts] == [2, 1, 1, 1] and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    rows = [(i, "x y " * (i % 7), "y z y" if i % 3 else "") for i in range(200)]
    df = spark.createDataFrame(rows, "k long, p string, t string")
    whole = S.fbeta_scores(df, "k", "p", "t").sort("k").collect()
    monkeypatch.setattr(S, "FBETA_WORDS", 10)
    assert S.fbeta_scores(df, "k", "p", "t").sort("k").collect() == whole and whole[2].overlap == 2

