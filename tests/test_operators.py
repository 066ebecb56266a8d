"""Operators against hand-made rows and the reference's invariants."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnledger import schema
from turnledger.functions import actions, spans
from turnledger.operators import answers, calibration, checks, controls, credits, governance, objective, requests, sampling, turns


def rollout(i, uid, traj, turn, action, em=1.0, text="Paris", **kw):
    row = dict(
        batch_row_index=i, responses=[1, 2, 3, 4, 5, 6], response_mask=[1, 1, 1, 1, 1, 0], prompt_ids=[0, 7], prompt_mask=[0, 1], old_log_probs=[0.0, 1.0, 2.0, 3.0, 4.0, 5.0], data_source="nq", uid=uid, traj_uid=traj,
        extra_info=(3, "train", "q?"), env_kwargs=((["Paris"],), ""), reward_model=((["x"],), "rule"), turn_step=turn, episode_lengths=2.0, terminal_binary_em=em, is_action_valid=None, is_adjustment_copy=False, search_feedback=None,
        turn_context_text=None, action_type=action, action_text=text, invalid_action=False, empty_action=False, unclosed_action=False, think_mask=[1, 0, 0, 0, 0], action_mask=[0, 0, 1, 1, 1], tag_mask=[0, 0, 0, 0, 1], think_chunks=[[0]],
    )
    return tuple((row | kw)[f.name] for f in schema.ROLLOUT.fields)


def records(spark, rows, **kw):
    return turns.turn_records(spark.createDataFrame(rows, schema.ROLLOUT), 1, **kw)


def test_turn_records(spark):
    got = records(spark, [rollout(0, "u", "b", 0, "search"), rollout(1, "u", "b", 1, "answer"), rollout(2, "u", "a", 0, "answer", 0.0), rollout(3, "v", "c", 0, "answer")]).orderBy("batch_row_index").collect()
    assert [r.turn_id for r in got] == [f"step:1:nq:train:row:3:group:{g}:rollout:{o}:turn:{t}" for g, o, t in ((0, 0, 0), (0, 0, 1), (0, 1, 0), (1, 0, 0))]
    r = got[0]
    assert (r.action_content_positions, r.action_boundary_positions, r.old_action_target_log_probs) == ([2, 3], [4], [2.0, 3.0, 4.0])
    assert (r.visible_prompt_token_ids, r.sampled_response_token_ids, r.answer_aliases, r.question) == ([7], [1, 2, 3, 4, 5], ["Paris"], "q?")
    assert (r.valid_action, r.observation_consumable, got[1].observation_consumable) == (True, True, False)


@pytest.mark.parametrize(("rows", "kw"), [
    ([rollout(0, "u", "b", 0, "answer", 0.5)], {}), ([rollout(0, "u", "b", -1, "answer")], {}), ([rollout(0, "u", "b", 0, "answer"), rollout(1, "u", "b", 0, "answer")], {}),
    ([rollout(0, "u", "b", 0, "answer"), rollout(1, "u", "b", 1, "answer", 0.0)], {}), ([rollout(0, "u", "b", 0, "answer")], {"rollouts_per_group": 2}), ([rollout(0, "u", "b", 0, "answer", think_mask=[0, 0, 1, 0, 0])], {}),
])
def test_bad_rollouts_raise(spark, rows, kw):
    with pytest.raises(checks.CheckFailed):
        records(spark, rows, **kw)


def test_forbidden_fields(spark):
    kind = schema._struct("a array<struct<Metadata:int,ok:int>>, new_fact_x int, b struct<c:struct<support_hits:int>>")
    assert checks.forbidden_paths(kind) == ["a.element.Metadata", "b.c.support_hits", "new_fact_x"]
    with pytest.raises(checks.CheckFailed):
        checks.require_allowed(spark.createDataFrame([], kind))


def test_answer_residuals(spark):
    rows = [("a", "g", 1, True, "x", ["y"]), ("b", "g", 1, True, "x", ["x"]), ("c", "g", 0, True, "red red red", ["red"]), ("d", "g", 0, True, "blue", ["red", "blue"]), ("e", "g", 0, False, "red", ["red"]), ("f", "h", 0, True, "red", ["red"])]
    df = answers.checked_answers(spark.createDataFrame(rows, schema.ANSWER))
    got = {r.trajectory_id: r for r in answers.answer_residuals(answers.best_quality(df)).collect()}
    assert got["a"].residual == got["b"].residual == 0 and got["a"].quality == 1
    assert got["c"].quality == pytest.approx(5 / 13) and got["c"].residual + got["d"].residual == pytest.approx(0)
    assert (got["e"].eligible, got["e"].residual, got["e"].stratum_size) == (False, 0, 0)
    assert (got["f"].eligible, got["f"].residual, got["f"].stratum_size) == (True, 0, 1)
    with pytest.raises(checks.CheckFailed):
        answers.checked_answers(df.unionByName(df))


def test_probe_aliases(spark):
    rows = [("t", a, a == "NYC") for a in ("the New York", "New York", "NYC", "", "Big Apple")]
    got = answers.probe_aliases(spark.createDataFrame(rows, "turn_id string, alias string, is_primary boolean")).orderBy("alias_index").collect()
    assert [r.alias for r in got] == ["NYC", "Big Apple", "New York"]


def pool(spark, *rows):
    names = schema.CANDIDATE.fieldNames()
    base = dict(global_step=1, question_id="q", data_source="s", call_bucket="1", token_length=100, document_count=1, document_signature=[], valid=True)
    return spark.createDataFrame([tuple((base | r | {"serialized_observation": r.get("serialized_observation", r["observation_id"])})[n] for n in names) for r in rows], schema.CANDIDATE)


def test_control_tiers(spark):
    p = pool(
        spark, {"observation_id": "a"}, {"observation_id": "same", "call_bucket": "1", "question_id": "r"}, {"observation_id": "bucket", "call_bucket": "2+", "question_id": "r"}, {"observation_id": "source", "data_source": "z", "question_id": "r"},
        {"observation_id": "far", "token_length": 300, "question_id": "r"}, {"observation_id": "own", "serialized_observation": "w"}, {"observation_id": "bad", "valid": False, "question_id": "r"}, {"observation_id": "two", "document_count": 2, "question_id": "r"},
    )
    anchors = p.where("observation_id = 'a'")
    best = controls.best_by_fingerprint(controls.candidate_pairs(anchors, p))
    assert {r.observation_id: r.tier for r in best.collect()} == {"same": 0, "bucket": 1, "source": 2, "far": 3}
    for found in (controls.hashed_controls(best), controls.drawn_controls(best)):
        rows = found.orderBy("control_index").collect()
        assert [r.tier for r in rows] == [0, 1, 2] and not rows[0].used_replacement
    few = controls.best_by_fingerprint(controls.candidate_pairs(anchors, p.where("observation_id in ('a', 'same')")))
    for found in (controls.hashed_controls(few), controls.drawn_controls(few)):
        rows = found.collect()
        assert [r.observation_id for r in rows] == ["same"] * 3 and rows[0].used_replacement
    none = controls.candidate_pairs(anchors, anchors)
    assert controls.control_failures(anchors, controls.hashed_controls(controls.best_by_fingerprint(none))).first().control_failure == "no_other_question_control"


def test_equal_signatures_are_no_control(spark):
    p = pool(spark, {"observation_id": "a", "document_signature": ["x"]}, {"observation_id": "b", "question_id": "r", "document_signature": ["x"]})
    assert controls.candidate_pairs(p.where("observation_id = 'a'"), p).count() == 0


def test_sampling(spark):
    rows = spark.createDataFrame([(s, i) for s in ("nq", "hotpotqa") for i in range(40)], "data_source string, row_index int")
    first, again = (sampling.stratified_sample(rows, 8, 5, "data_source", "row_index").collect() for _ in range(2))
    assert sorted(first) == sorted(again) and len(first) == 16
    out = sampling.disjoint_batches(rows, rows.where("row_index < 10"), 3, 5, 7)
    assert out.groupBy("batch_index", "data_source").count().where("count <> 5").count() == 0 and out.count() == 30
    assert checks.shared_rows(out, ["data_source", "row_index"]).count() == 0 and out.where("row_index < 10").count() == 0
    assert sampling.hash_subset(rows, 0, "row_index").count() == 0 and sampling.hash_subset(rows, 100, "row_index").count() == 80
    lay = sampling.interleaved_layout(spark.range(5).select(F.col("id").alias("row_index"), F.col("id").alias("ordinal")), 8, 4).collect()
    assert len(lay) == 8 and sum(r.is_original for r in lay) == 5
    assert sorted((r.block, r.place, r.row_index) for r in lay if not r.is_original) == [(0, 3, 0), (1, 2, 1), (1, 3, 1)]
    assert sampling.pad_with_copies(rows, 32, 1, "row_index").where("is_adjustment_copy").count() == 16
    assert sampling.trim_to_divisor(rows.where("data_source = 'nq'"), 32, 1, "row_index").count() == 32


def test_packing(spark):
    rows = [("q", "tiny", "g1", 2), ("q", "mid", "g2", 7), ("q", "short", "g3", 5), ("q", "long", "g0", 10)]
    df = spark.createDataFrame(rows, "queue string, request_id string, comparison_group_id string, length long")
    got = {r.comparison_group_id: (r.batch_id, r.padded_tokens) for r in requests.pack(df, 20, 3).collect()}
    assert got == {"g0": (0, 20), "g2": (0, 20), "g3": (1, 10), "g1": (1, 10)}
    cost = requests.packing_cost(df, requests.pack(df, 20, 3)).first()
    assert (cost.item_count, cost.true_token_count, cost.padded_token_count, cost.padding_token_count) == (4, 24, 30, 6)
    with pytest.raises(Exception, match="fits no batch"):
        requests.pack(df, 9).collect()


def test_deduplication_keeps_groups_apart(spark):
    df = spark.createDataFrame([("a", "g", [1], 0), ("b", "g", [1], 1), ("c", "h", [1], 2)], "request_id string, comparison_group_id string, input_ids array<int>, ordinal int")
    keyed = requests.cache_keys(df, ["comparison_group_id", "input_ids"])
    assert {r.request_id: r.representative_request_id for r in keyed.collect()} == {"a": "a", "b": "a", "c": "c"}
    scores = spark.createDataFrame([("a", 0.5), ("c", 0.7)], schema.SCORE)
    assert {r.request_id: r.score for r in requests.expand_scores(keyed, scores).collect()} == {"a": 0.5, "b": 0.5, "c": 0.7}
    with pytest.raises(checks.CheckFailed):
        requests.expand_scores(keyed, scores.limit(1))


def test_responsibility_requests(spark):
    t = records(spark, [rollout(0, "u", "b", 0, "answer", think_mask=[1, 1, 0, 0, 0], think_chunks=[[0], [1], [4]])])
    got = {r.view: r for r in requests.responsibility_requests(t, plain=True).collect()}
    assert set(got) == {"plain", "whole_mask", "chunk_mask_0", "chunk_mask_1"}
    assert got["whole_mask"].blocked_key_positions == [1, 2] and got["whole_mask"].input_ids == [7, 1, 2, 3, 4, 5] and got["plain"].full_score == 3.0
    assert got["chunk_mask_1"].request_id.endswith(":chunk_mask:1")


def test_credit_assembly(spark):
    base = records(spark, [rollout(i, "u", "b", i, "search", episode_lengths=9.0) for i in range(2)] + [rollout(2, "u", "b", 2, "answer", episode_lengths=9.0), rollout(3, "u", "c", 0, "other"), rollout(4, "u", "b", 0, "search", is_adjustment_copy=True)])
    ids = {r.batch_row_index: r.turn_id for r in base.collect()}
    utilities = spark.createDataFrame([(ids[0], 1.0, None), (ids[1], -1.0, None)], "turn_id string, utility double, zero_reason string")
    found = spark.createDataFrame([(ids[0], 1.0, [1.0]), (ids[1], 1.0, [1.0]), (ids[2], 0.5, [1.0])], "turn_id string, rho double, weights array<float>")
    residuals = spark.createDataFrame([("x", 0.0)], "trajectory_id string, residual double")
    out = credits.assemble(base, utilities, found, residuals)
    got = {r.batch_row_index: r for r in out.collect()}
    assert got[0].search_cap_scale == 0.5 and got[0].action_coefficient == 0.5 and got[0].think_chunk_coefficients == [0.5] and got[1].action_coefficient == -0.5
    assert got[3].zero_reason == "invalid_or_other_action" and got[4].zero_reason == "adjustment_copy" and got[4].action_coefficient == 0
    mass = {r.trajectory_id: r.mass for r in credits.trajectory_mass(out).collect()}
    assert mass[got[0].trajectory_id] == pytest.approx(2.0)
    s = spans.credit_spans(out)
    assert {(r.slot, r.channel) for r in s.where("batch_row_index = 0").collect()} == {(0, 0), (1, 1)}
    assert spans.span_overlaps(s).count() == 0 and spans.spans_outside(s, base.select("batch_row_index", F.lit(5).alias("n_valid"))).count() == 0
    with pytest.raises(checks.CheckFailed):
        credits.assemble(base, utilities.limit(1), found, residuals)


def test_calibration(spark):
    rows = spark.createDataFrame([("b", 0.1, 0.0, False, 0.5)] * 8 + [("b", 0.1, 0.0, False, 0.0)] * 2, "b string, control_0 double, control_1 double, used_replacement boolean, g_directed double")
    numeric = spark.createDataFrame([("b", 0.01)] * 10, "b string, difference double")
    r = calibration.search_scale(rows, numeric, ["b"]).first()
    assert (r.delta, r.scale, r.active) == (pytest.approx(0.1), pytest.approx(0.4), 8)
    assert calibration.search_scale(rows.limit(7), numeric, ["b"]).first().scale == 1.0
    g = spark.createDataFrame([("b", 2.0, 10.0), ("b", 1.0, 10.0)], "b string, global_norm double, local_norm double")
    r = calibration.gradient_scale(g, ["b"]).first()
    assert r.lambda_max == pytest.approx(0.015)
    with pytest.raises(checks.CheckFailed):
        calibration.gradient_scale(g.limit(1), ["b"])
    rows = spark.createDataFrame([("b", "search", 1.0, 1.0, 0.5, 0.0)] * 3, "b string, action_type string, old_full double, plain double, whole_masked double, repeat_error double")
    r = calibration.responsibility_scale(rows, ["b"]).first()
    assert (r.delta, r.scale, r.limited) == (0.01, 0.6201, True)


def documents(spark, *batches):
    rows = []
    for b in batches:
        search = [(f"{b}q{i}", f"{b}t{i}", False, (1.0, 0.0, 0.3, 0.1, 0.2), 1.0, 0.8, 0.8, False, False) for i in range(4)]
        rows.append((b, (0.0,), (search, ({"dead_zone": 1},)), ([(f"{b}t0", "search", False, 1.0, 1.0, 0.5, [0.2, 0.9]), (f"{b}t9", "answer", True, 1.0, 1.0, 0.9, [])],), ([(f"{b}t9", "g", 1, True, 0.0)],)))
    return spark.createDataFrame(rows, schema.CALIBRATION_DOCUMENT)


def test_pooled_documents(spark):
    docs = governance.validate_batches(calibration.pooled([documents(spark, "a"), documents(spark, "b")]), 2)
    search, scale, rows = calibration.finalize(docs)
    r = search.first()
    assert (r.delta, r.active) == (pytest.approx(0.2), 8) and r.scale == pytest.approx(0.6)
    assert scale.count() == 2 and rows.count() == 4
    with pytest.raises(checks.CheckFailed):
        governance.validate_batches(calibration.pooled([documents(spark, "a"), documents(spark, "a")]))


def test_objective(spark):
    import math

    tokens = spark.createDataFrame([(0, s, 0.0, math.log(r), c) for s, (r, c) in enumerate([(1.5, 2.0), (1.5, -2.0), (0.5, 2.0), (0.5, -2.0)])], "row int, slot int, old_log_prob double, log_prob double, coefficient double")
    got = [r.loss for r in objective.signed_span_losses(tokens, 0.2, 0.2).orderBy("slot").collect()]
    assert got == pytest.approx([-2.4, 3.0, -1.0, 1.6])
    rows = spark.createDataFrame([(i, float(i + 1), m) for i, m in enumerate((0, 0, 1, 1, 1, 2, 2))], "row int, numerator double, minibatch int")
    est = objective.minibatch_estimates(rows, 7, 4).collect()
    assert sum(r.estimate * r.n_rows / 7 for r in est) == pytest.approx(28 / 4) and objective.trajectory_mean(rows, 4).first().objective == 7.0


def test_governance(spark, tmp_path):
    numbers = dict.fromkeys(governance.NUMBERS, 0.1)
    source = {"a": 1}
    doc, _ = governance.freeze(numbers, {"s": source}, {"s": governance.document_hash(source)})
    assert governance.validate_method(doc) == numbers | {"local_objective.warmup_outer_steps": 30.0}
    altered = {}
    for path, value in (governance.PINNED | numbers).items():
        other = json.loads(json.dumps(doc))
        *head, last = path.split(".")
        at = other
        for part in head:
            at = at[part]
        at[last] = (not value) if isinstance(value, bool) else value + "x" if isinstance(value, str) else -1
        if path not in governance.PINNED and path.endswith("delta"):
            at[last] = "x"
        altered[path] = other
    altered |= {"legacy.old": doc | {"legacy": {"old": True}}, "metadata.more": doc | {"metadata": doc["metadata"] | {"more": 1}}, "legacy": {k: v for k, v in doc.items() if k != "legacy"}}
    for path, other in altered.items():
        assert governance.method_faults(other) == [path]
        with pytest.raises(checks.CheckFailed):
            governance.validate_method(other)
    told = [(p, json.dumps(x)) for p, x in altered.items() if not p.startswith("legacy") and p != "metadata.more"] + [("fine", json.dumps(doc))]
    found = governance.method_findings(spark.createDataFrame(told, "document_id string, document string")).collect()
    assert sorted((r.document_id, r.path) for r in found) == sorted((p, p) for p, _ in told if p != "fine")
    with pytest.raises(checks.CheckFailed):
        governance.freeze(numbers, {"s": source}, {"s": "0"})
    (tmp_path / "f").write_bytes(b"x")
    import hashlib

    manifest = {"files": {"f": hashlib.sha256(b"x").hexdigest()}}
    assert governance.verify_manifest(spark, str(tmp_path), manifest, governance.document_hash(manifest)).count() == 1
    with pytest.raises(checks.CheckFailed):
        governance.verify_manifest(spark, str(tmp_path), {"files": {"f": "0"}})
    for bad in ("../f", "/f", ""):
        with pytest.raises(checks.CheckFailed):
            governance.safe_relative(bad)


def test_step_health(spark):
    fine = dict.fromkeys(governance.HEALTH, 1.0) | {"urcr_v4/original_trajectory_count": 8.0, "other": float("nan")}

    def findings(step, **changed):
        rows = [(step, m, x) for m, x in (fine | {k.replace("__", "/"): v for k, v in changed.items()}).items() if x is not None]
        return [(r.metric, r.finding) for r in governance.health_findings(spark.createDataFrame(rows, "global_step int, metric string, value double"), 8).collect()]

    assert findings(1) == [] and findings(1, actor__lr=0.0) == []
    assert findings(2, actor__lr=0.0) == [("actor/lr", "not_positive")]
    assert findings(1, actor__lr=-1.0) == [("actor/lr", "not_positive")]
    assert findings(1, actor__pg_loss=float("nan")) == [("actor/pg_loss", "not_finite")]
    assert findings(1, actor__kl_loss=None) == [("actor/kl_loss", "missing")]
    assert findings(1, actor__grad_norm=0.0) == [("actor/grad_norm", "not_positive")]
    assert findings(1, urcr_v4__lambda_effective=0.0) == [("urcr_v4/lambda_effective", "not_positive")]
    assert findings(1, urcr_v4__original_trajectory_count=9.0) == [("urcr_v4/original_trajectory_count", "other_count")]
    with pytest.raises(checks.CheckFailed):
        governance.step_health(spark.createDataFrame([(1, "actor/lr", 1.0)], "global_step int, metric string, value double"), 8)


def test_population_findings(spark):
    entry = "batch_index int, batch_count int, selected_rows array<int>, manifest_rows array<int>, question_ids array<string>, data_sha256 string, found_sha256 string"
    kind = "batch_index int, artifact string, pass boolean, temperature double, world_size int, scorer_micro_batch_size_per_gpu int, model string, question_group_count int, original_trajectory_count int, optimizer_update_executed boolean, calibration_batch_index int, method_revision string, reference_sha256 string, observed_questions array<string>"
    names = [c.split()[0] for c in kind.split(", ")]
    entries = [(i, 3, [2 * i, 2 * i + 1], [2 * i, 2 * i + 1], [f"q{i}", f"p{i}"], "h", "h") for i in (1, 2, 3)]
    documents = [(i, "urcr_v4_s150_frozen_calibration", True, 1.0, 4, 32, "m", 128, 1024, False, i, "r", "n", [f"q{i}"]) for i in (1, 2, 3)]

    def findings(entries=entries, documents=documents):
        out = governance.population_findings(spark.createDataFrame(entries, entry), spark.createDataFrame(documents, kind), "m").collect()
        return sorted((r.batch_index, r.finding) for r in out)

    assert findings() == []
    for name, value, finding in [
        ("artifact", "x", "other_artifact"), ("pass", False, "other_pass"), ("temperature", 0.5, "other_temperature"), ("world_size", 2, "other_world_size"), ("scorer_micro_batch_size_per_gpu", 16, "other_scorer_micro_batch_size_per_gpu"),
        ("model", "x", "other_model"), ("question_group_count", 1, "other_question_group_count"), ("original_trajectory_count", 1, "other_original_trajectory_count"), ("optimizer_update_executed", True, "other_optimizer_update_executed"),
        ("calibration_batch_index", 9, "other_batch_index"), ("method_revision", "x", "other_revision"), ("reference_sha256", "x", "other_reference"), ("observed_questions", ["z"], "unexpected_question"),
    ]:
        changed = list(documents[1])
        changed[names.index(name)] = value
        assert findings(documents=[documents[0], tuple(changed), documents[2]]) == [(2, finding)]
    shift = lambda at, value: [entries[0], (*entries[1][:at], value, *entries[1][at + 1 :]), entries[2]]
    assert findings(shift(6, None)) == [(2, "changed_data")] and findings(shift(3, [0])) == [(2, "other_manifest")]
    assert findings(shift(4, ["q1", "q2"])) == [(1, "shared_question"), (2, "shared_question")]
    assert findings(entries[:2], documents[:2]) == [(3, "missing_index")]


def test_prepare_batches(spark):
    rows = spark.createDataFrame([(s, (i, "train"), ((["a"],),), (["x"],)) for s in ("nq", "hotpotqa") for i in range(30)], schema.TRAINING)
    out = governance.prepare_batches(rows, rows.limit(0).select("data_source", F.col("extra_info.index").alias("row_index")), 2, 8, 3)
    assert out.count() == 32 and "metadata" not in out.columns


def test_packing_queries_cover_the_whole_table(spark):
    from turnledger.plans import registry

    sf = "/root/testdata/sf0.001"
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert registry.a19_packing_cost(spark, sf).first().item_count == items.count()
    assert {r[0] for r in registry.t9_token_packing(spark, sf).select("comparison_group_id").collect()} == {str(r[0]) for r in items.select("l_orderkey").distinct().collect()}


def test_drawn_controls_follow_the_published_stream(spark):
    import hashlib

    import numpy as np

    kind = "global_step int, anchor_id string, fingerprint string, tier int, observation_id string"
    best = [(3, "a", f"f{i}", t, f"o{i}") for i, t in enumerate((2, 0, 0, 1, 0))] + [(3, "b", "f", 3, "only"), (4, "c", "f1", 1, "y"), (4, "c", "f2", 1, "x")]
    got = {(r.anchor_id, r.control_index): (r.observation_id, r.tier, r.used_replacement) for r in controls.drawn_controls(spark.createDataFrame(best, kind)).collect()}
    want = {}
    for step, anchor in ((3, "a"), (3, "b"), (4, "c")):
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{schema.CONTROL_STREAM}|{schema.REVISION}|{step}|{anchor}".encode()).digest()[:16], "big"))
        order = []
        for tier in range(4):
            ids = sorted(o for _, a, _, t, o in best if a == anchor and t == tier)
            if ids:
                order += [(ids[i], tier) for i in rng.permutation(len(ids))]
        order, short = order[:3], len(order) < 3
        n = len(order)
        order += [order[int(rng.integers(0, n))] for _ in range(3 - n)]
        want |= {(anchor, i): (*x, short) for i, x in enumerate(order)}
    assert got == want


def test_pools_repeats_and_masked_scores(spark):
    docs = "<documents>\nDoc 1: T\nbody\nDoc 2: U\nmore\n</documents>"
    made = [rollout(0, "u", "b", 0, "search", search_feedback=docs, turn_context_text=f"seen {docs}"), rollout(1, "u", "b", 1, "answer"), rollout(2, "u", "c", 0, "search", search_feedback="<documents>Doc 1: new</documents>", turn_context_text=docs), rollout(3, "u", "c", 0, "search", is_adjustment_copy=True)]
    t = records(spark, made)
    seen = {r.turn_id[-18:]: r.visible_exact_repeat for r in turns.visible_repeats(checks.originals(t).where("action_type = 'search'")).collect()}
    assert sorted(seen.values()) == [False, True]
    pool = turns.observation_pool(t).orderBy("observation_id").collect()
    assert [(r.document_count, r.valid, r.call_bucket) for r in pool] == [(2, True, "1"), (1, True, "1")] and turns.trajectory_count(t).first()[0] == 2
    scored = [("t", "whole_mask", -1.0, -2.0), ("t", "chunk_mask_10", -1.0, -0.5), ("t", "chunk_mask_2", -1.0, -0.25), ("s", "whole_mask", 0.0, 0.0)]
    got = {r.turn_id: (r.full_score, r.whole_masked, r.chunk_masked) for r in credits.masked_scores(spark.createDataFrame(scored, "turn_id string, view string, full_score double, score double")).collect()}
    assert got == {"t": (-1.0, -2.0, [-0.25, -0.5]), "s": (0.0, 0.0, [])}
    assert credits.answer_residuals_of(t).select("trajectory_id", "residual").collect()[0].residual == 0.0


def test_hooks_and_small_checks(spark):
    rows = spark.createDataFrame([("a", 2), ("b", 5)], "request_id string, length int")
    assert sorted(tuple(r) for r in requests.score_with(rows, lambda pdf: -1.0 * pdf["length"]).collect()) == [("a", -2.0), ("b", -5.0)]
    maps = spark.createDataFrame([({"Metadata": 1, "ok": 2},), ({"fact_1": 1},), ({"x": 1},)], "m map<string,int>")
    assert {r.key for r in checks.forbidden_keys(maps, "m").collect()} <= {"Metadata", "metadata", "fact_1"} and checks.forbidden_keys(maps, "m").count() >= 1
    held = spark.createDataFrame([(1, 0, 2.0, [0, 1])], "batch_row_index int, slot int, coefficient double, positions array<int>")
    logs = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, 0.0), (1, 2, 0.0, 0.0)], "batch_row_index int, position int, old_log_prob double, log_prob double")
    assert objective.signed_span_losses(objective.span_tokens(held, logs), 0.2, 0.2).first().loss == -2.0
    turns_ = spark.createDataFrame([("a",), ("b",)], "traj_uid string")
    one = spark.createDataFrame([("a", 1), ("b", 0)], "traj_uid string, outcome int")
    assert sorted(r.terminal_binary_em for r in checks.outcome_joined(turns_, one).collect()) == [0.0, 1.0]
    for bad in (one.where("outcome = 1"), one.withColumn("outcome", F.lit(2))):
        with pytest.raises(checks.CheckFailed):
            checks.outcome_joined(turns_, bad)
    rows = spark.createDataFrame([(i, i) for i in range(5)], "row_index int, ordinal int")
    assert sampling.interleaved_layout(rows, 8, 4).count() == 8
    for target, micro, given in ((4, 4, rows), (24, 4, rows), (8, 4, rows.unionByName(rows.limit(1))), (8, 4, rows.withColumn("row_index", F.col("row_index") - 1))):
        with pytest.raises(checks.CheckFailed):
            sampling.interleaved_layout(given, target, micro)


PIECES = {2: "<think>", 3: "reason", 4: "</think>", 5: "<search>", 6: "query", 7: "</search>", 8: "<answer>", 9: "Paris", 10: "</answer>", 11: "No</answer>", 0: ""}


def brute_spans(pieces):
    """Tags by a scan of characters, tokens by the characters that they hold."""
    text, owner = "".join(pieces), [i for i, p in enumerate(pieces) for _ in p]
    mode, begin, act, think, tags, invalid, closed = "out", 0, None, set(), set(), False, False
    n = len(text)
    tagged = {c for m in re.finditer(r"</?(?:think|search|answer)>", text) for c in range(*m.span())}
    of = lambda a, b: {owner[c] for c in range(a, b)}

    def thought(a, b, edges):
        return {t for t in of(a, b) if not any(owner[c] == t for c in edges)}

    for m in re.finditer(r"</?(?:think|search|answer)>", text):
        name, end = m.group().strip("</>"), m.group().startswith("</")
        if mode == "out":
            if end:
                invalid = True
            elif name == "think":
                mode, begin, opened = "think", m.end(), m.span()
            elif act is None:
                mode, begin, act = name, m.end(), [name, m.end(), n]
                tags |= of(*m.span())
            else:
                invalid = True
        elif mode == "think":
            if end and name == "think":
                think |= thought(begin, m.start(), [*range(*opened), *range(*m.span())])
                mode = "out"
        elif end and name == mode:
            act[2], closed, mode = m.start(), True, "out"
            tags |= of(*m.span())
        else:
            invalid = True
    if mode == "think":
        think |= thought(begin, n, range(*opened))
    kind, core, target = "other", None, set()
    if act:
        kind, core = act[0], text[act[1] : act[2]].strip()
        lead = act[1] + len(text[act[1] : act[2]]) - len(text[act[1] : act[2]].lstrip())
        target = of(lead, lead + len(core))
    assert tagged or not act
    return kind, core, invalid, act is not None and not core, act is not None and not closed, sorted(think), sorted(target), sorted(tags)


def test_action_spans_against_a_scan_of_characters(spark):
    r = random.Random(6)
    tags = [f"<{e}{t}>" for t in ("think", "search", "answer") for e in ("", "/")]
    rows = []
    for _ in range(600):
        text = "".join(r.choice([*tags, *tags, "a b", " ", "\n", "x.", "</thin", "<", "éß"]) for _ in range(r.randint(0, 9)))
        if r.random() < 0.5:
            kind = r.choice(["search", "answer"])
            text = f"<think>{r.choice(['', 'why ', 'a. b'])}</think>{r.choice(['', ' '])}<{kind}>{r.choice(['', ' ', 'x', ' two words '])}</{kind}>{text[: r.choice([0, 9])]}"
        cuts = sorted({0, len(text), *(r.randrange(len(text) + 1) for _ in range(r.choice([0, 3, 40])))})
        rows.append([text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
    rows += [[], ["no tag"], ["<think>", "a" * 3000]]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, p array<string>").repartition(4)
    got = {x.id: x.a for x in df.select("id", actions.action_spans(F.col("p")).alias("a")).collect()}
    for i, pieces in enumerate(rows):
        a = got[i]
        assert (a.action_type, a.action_text, a.invalid_action, a.empty_action, a.unclosed_action, a.think, sorted(a.search + a.answer), a.tags) == brute_spans(pieces), pieces
    assert len({(x.action_type, x.invalid_action, x.empty_action, x.unclosed_action) for x in got.values()}) >= 10


def brute_chunks(words, positions, least=8, aim=64, most=6):
    chunks, now = [], []
    for p in positions:
        now.append(p)
        if (len(now) >= least and words[p].rstrip(" ")[-1:] in actions.STOPS and words[p].rstrip(" ")) or len(now) >= aim:
            chunks, now = [*chunks, now], []
    if now:
        chunks = [*chunks[:-1], chunks[-1] + now] if chunks and len(now) < least else [*chunks, now]
    while len(chunks) > most:
        i = min(range(len(chunks) - 1), key=lambda k: (len(chunks[k]) + len(chunks[k + 1]), k))
        chunks[i : i + 2] = [chunks[i] + chunks[i + 1]]
    return chunks


def test_chunks_cover_all_thinking(spark):
    r = random.Random(3)
    rows = [(i, [r.choice(["a ", "b", "c. ", "d,", "\n", "", "？"] + ["w "] * r.choice([0, 30])) for _ in range(r.choice([0, 5, 40, 400, 900]))]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, p array<string>").repartition(4)
    every = F.when(F.size("p") > 0, F.sequence(F.lit(0), F.greatest(F.size("p") - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    for x in df.select("id", "p", every.alias("t"), actions.think_chunks(F.col("p"), every).alias("c")).collect():
        assert x.c == brute_chunks(x.p, x.t) and [p for c in x.c for p in c] == x.t and len(x.c) <= 6
        assert all(len(c) >= 8 for c in x.c) or len(x.t) < 8


def test_turn_records_from_pieces(spark):
    """Rollouts without parsed columns: the published case, and one token that holds an answer and its end."""
    raw = [f for f in schema.ROLLOUT.fields if f.name not in ("action_type", "action_text", "invalid_action", "empty_action", "unclosed_action", "think_mask", "action_mask", "tag_mask", "think_chunks")]
    ids = [[2, 3, 4, 5, 6, 7], [2, 3, 4, 8, 9, 10], [2, 3, 4, 8, 11, 0]]
    names, rows = [f.name for f in schema.ROLLOUT.fields], []
    for i, (traj, turn, em) in enumerate((("traj-a", 0, 1.0), ("traj-a", 1, 1.0), ("traj-b", 0, 0.0))):
        full = dict(zip(names, rollout(i, "group", traj, turn, "x", em, responses=ids[i], response_mask=[1, 1, 1, 1, 1, int(i < 2)], old_log_probs=[float(6 * i + k) for k in range(6)]), strict=True))
        rows.append((*(full[f.name] for f in raw), [PIECES[t] for t in ids[i]]))
    kind = T.StructType([*raw, T.StructField("response_pieces", T.ArrayType(T.StringType()))])
    search, first, short = turns.turn_records(spark.createDataFrame(rows, kind), 4, rollouts_per_group=2).orderBy("batch_row_index").collect()
    assert (search.action_type, search.think_content_positions, search.action_target_positions, search.action_content_positions, search.action_boundary_positions, search.old_action_target_log_probs) == ("search", [1], [4], [4], [], [4.0])
    assert search.observation_consumable and search.valid_action and first.action_type == "answer" and first.action_text == "Paris" and first.think_chunks == [[1]]
    assert (short.valid_action, short.action_text, short.action_target_positions, short.action_content_positions, short.action_boundary_positions, short.old_action_target_log_probs) == (True, "No", [4], [], [4], [16.0])
    made = requests.responsibility_requests(spark.createDataFrame([search], schema.TURN)).collect()
    assert {x.view: x.blocked_key_positions for x in made} == {"whole_mask": [2], "chunk_mask_0": [2]}


def test_a_manifest_goes_by_relative_paths(spark, tmp_path):
    """a/b isn't x/a/b, in whatever order they are listed."""
    import hashlib

    files = {"a/b": b"one", "x/a/b": b"two", "b": b"three"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    hashes = {n: hashlib.sha256(d).hexdigest() for n, d in files.items()}
    assert {tuple(r) for r in governance.verify_manifest(spark, str(tmp_path), {"files": hashes}).collect()} == set(hashes.items())
    with pytest.raises(checks.CheckFailed):
        governance.verify_manifest(spark, str(tmp_path), {"files": hashes | {"a/b": hashes["x/a/b"]}})


def test_evidence_in_documents(spark):
    rows = [(1, '{"a": [{"METADATA": {"context": 1}}, [{"doc_only_x": 2}]], "ok": "metadata"}'), (2, None), (3, "5"), (4, '{"gold_evidence": null}')]
    got = checks.forbidden_document_paths(spark.createDataFrame(rows, "id int, j string"), "id", "j").collect()
    assert sorted(tuple(r) for r in got) == [(1, "a.element.METADATA"), (1, "a.element.METADATA.context"), (1, "a.element.element.doc_only_x"), (4, "gold_evidence")]


def test_health_findings_need_one_shuffle_and_no_join(spark):
    rows = spark.createDataFrame([(s, m, 1.0) for s in range(3) for m in governance.HEALTH], "global_step int, metric string, value double")
    plan = governance.health_findings(rows, 8)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_responsibility_weights_round_as_their_sql(spark, tmp_path):
    """A share of 785.49997 thousandths, which single precision rounds up."""
    from turnledger.plans import registry

    values = (30.82, 1.25, 175.04, 8.19, 47.24, 46.28, 14.22, 63.83)
    spark.createDataFrame([(i, v) for i, v in enumerate(values)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    mass = [max(values[0] / 200 - v / 200 - 0.05, 0) ** 2 for v in values[2:]]
    want = ",".join(str(round(1000 * m / sum(mass))) for m in mass)
    assert registry.f6_responsibility(spark, str(tmp_path)).first().weights == want == "0,785,0,0,215,0"
