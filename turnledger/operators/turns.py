"""Turn records from rollout rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions import actions, scalars, spans
from turnledger.operators import checks
from turnledger.schema import TURN


def appearance_ids(rows: DataFrame, step: Column | int, order: str = "batch_row_index") -> DataFrame:
    """rows with question_id, rollout_group_id, rollout_index, trajectory_id and turn_id.

    Groups of a question, and trajectories of a group, are numbered by the row in
    which they first appear, so two samplings of one question stay apart.
    """
    step = F.lit(step) if isinstance(step, int) else step
    rows = rows.withColumn("question_id", scalars.question_id(F.col("data_source"), F.col("extra_info.split"), F.col("extra_info.index")))
    rows = rows.withColumn("global_step", step.cast("int"))
    first = F.min(order)
    rows = rows.withColumn("__g", first.over(Window.partitionBy("global_step", "question_id", "uid"))).withColumn("__t", first.over(Window.partitionBy("global_step", "question_id", "uid", "traj_uid")))
    rows = rows.withColumn("__gi", F.dense_rank().over(Window.partitionBy("global_step", "question_id").orderBy("__g")) - 1)
    rows = rows.withColumn("rollout_index", (F.dense_rank().over(Window.partitionBy("global_step", "question_id", "uid").orderBy("__t")) - 1).cast("int"))
    group = F.format_string("step:%d:%s:group:%d", "global_step", "question_id", "__gi")
    rows = rows.withColumn("rollout_group_id", group).withColumn("trajectory_id", F.format_string("%s:rollout:%d", "rollout_group_id", "rollout_index"))
    return rows.withColumn("turn_id", F.format_string("%s:turn:%d", "trajectory_id", "turn_step")).drop("__g", "__t", "__gi")


def valid_action() -> Column:
    flag = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    return F.col("action_type").isin("search", "answer") & (F.size("action_target_positions") > 0) & flag("is_action_valid", True) & ~flag("invalid_action", False) & ~flag("empty_action", False) & ~flag("unclosed_action", False)


def consumable() -> Column:
    return (F.col("action_type") == "search") & (F.col("turn_step") + 1 < F.floor(F.coalesce("episode_lengths", F.lit(0.0))))


def parsed(rollouts: DataFrame) -> DataFrame:
    """Rollout rows with the texts of their response tokens, response_pieces, as rows with spans parsed (schema.ROLLOUT).

    Only pieces that response_mask keeps are read, and masks are of those.
    """
    rows = rollouts.withColumn("__p", spans.masked(F.col("response_pieces"), F.col("response_mask"))).withColumn("__a", actions.action_spans(F.col("__p")))
    mask = lambda c: actions.mask_of(c, F.size("__p"))
    found = {c: F.col("__a")[c] for c in ("action_type", "action_text", "invalid_action", "empty_action", "unclosed_action")}
    found |= {"think_mask": mask(F.col("__a.think")), "action_mask": mask(F.concat("__a.search", "__a.answer")), "tag_mask": mask(F.col("__a.tags")), "think_chunks": actions.think_chunks(F.col("__p"), F.col("__a.think"))}
    return rows.withColumns(found).drop("__p", "__a", "response_pieces")


def turn_records(rollouts: DataFrame, global_step: int, rollouts_per_group: int | None = None, check: bool = True) -> DataFrame:
    """Rollout rows as turn records; see schema.ROLLOUT and schema.TURN.

    Spans are columns of the rows, or are parsed from response_pieces where they have that instead.
    Raises for an evidence column, an outcome other than 0 or 1, a negative turn,
    a missing alias, overlapping action and think tokens, a group of two questions,
    a repeated original turn, mixed outcomes or a group of the wrong size.
    """
    checks.require_allowed(rollouts)
    rollouts = parsed(rollouts) if "response_pieces" in rollouts.columns else rollouts
    env, reward = F.col("env_kwargs.ground_truth.target"), F.col("reward_model.ground_truth.target")
    rows = appearance_ids(rollouts, global_step)
    rows = rows.select(
        "*", spans.masked(F.col("responses"), F.col("response_mask")).alias("sampled"), spans.masked(F.col("prompt_ids"), F.col("prompt_mask")).alias("prompt"), spans.masked(F.col("old_log_probs"), F.col("response_mask")).alias("logs"),
        F.when(F.col("action_type").isin("search", "answer"), spans.positions(F.col("action_mask"))).otherwise(F.array().cast("array<int>")).alias("action_target_positions"),
        spans.positions(F.col("tag_mask")).alias("action_tag_positions"), spans.positions(F.col("think_mask")).alias("think_content_positions"), scalars.aliases_of(env, reward).alias("answer_aliases"),
    )
    rows = rows.withColumn("parts", spans.split_positions(F.col("action_target_positions"), F.col("action_tag_positions")))
    if check:
        checks.require_none(checks.group_questions(rows), "a group of two questions")
        checks.require_none(checks.not_binary(rows).select("turn_id"), "an outcome other than 0 or 1")
        checks.require_none(rows.where("turn_step is null or turn_step < 0").select("turn_id"), "a negative turn")
        checks.require_none(rows.where(F.size("answer_aliases") == 0).select("turn_id"), "no accepted answer")
        checks.require_none(rows.where(F.arrays_overlap("parts.content", "think_content_positions")).select("turn_id"), "action and think overlap")
    out = rows.select(
        "global_step", "batch_row_index", F.coalesce("is_adjustment_copy", F.lit(False)).alias("is_adjustment_copy"), "question_id", "rollout_group_id", "trajectory_id", "turn_id", "rollout_index", F.col("turn_step").alias("turn_index"),
        F.coalesce("data_source", F.lit("unknown")).alias("data_source"), F.coalesce(F.nullif("env_kwargs.question", F.lit("")), "extra_info.question", F.lit("")).alias("question"), "answer_aliases",
        F.coalesce("turn_context_text", F.lit("")).alias("visible_context_text"), F.col("prompt").alias("visible_prompt_token_ids"), F.col("sampled").alias("sampled_response_token_ids"), "action_type", "action_text",
        F.coalesce("search_feedback", F.lit("")).alias("observation_text"), valid_action().alias("valid_action"), consumable().alias("observation_consumable"), F.col("terminal_binary_em").cast("int").alias("terminal_binary_em"),
        "think_content_positions", "action_target_positions", F.col("parts.content").alias("action_content_positions"), F.col("parts.boundary").alias("action_boundary_positions"), "action_tag_positions", "think_chunks",
        F.transform("action_target_positions", lambda i: F.get("logs", i)).alias("old_action_target_log_probs"),
    ).select(*(F.col(f.name).cast(f.dataType) for f in TURN.fields))
    if check:
        checks.require_none(checks.duplicate_turns(out), "a repeated original turn")
        checks.require_none(checks.mixed_outcomes(out), "mixed outcomes")
        if rollouts_per_group:
            checks.require_none(checks.group_sizes(out, rollouts_per_group), "a group of the wrong size")
    return out


def trajectory_count(turns: DataFrame) -> DataFrame:
    return checks.originals(turns).agg(F.count_distinct("trajectory_id").alias("trajectories"))


def visible_repeats(turns: DataFrame) -> DataFrame:
    """(turn_id, visible_exact_repeat)"""
    return turns.select("turn_id", scalars.exact_repeat(scalars.document_passages(F.col("observation_text")), scalars.visible_passages(F.col("visible_context_text"))).alias("visible_exact_repeat"))


def observation_pool(turns: DataFrame) -> DataFrame:
    """Search turns as control candidates.  Copies are left out first, so that none hides its original."""
    passages = scalars.document_passages(F.col("observation_text"))
    rows = checks.originals(turns).where("action_type = 'search'").withColumn("passages", passages)
    valid = F.col("valid_action") & (F.size("passages") > 0) & (F.trim("observation_text") != "")
    return rows.select(
        "global_step", F.col("turn_id").alias("observation_id"), "question_id", "data_source", scalars.call_bucket(F.col("turn_index")).alias("call_bucket"), F.col("observation_text").alias("serialized_observation"),
        scalars.token_length(F.col("observation_text")).alias("token_length"), F.size("passages").alias("document_count"), scalars.document_signature(F.col("passages")).alias("document_signature"), valid.alias("valid"),
    )


def search_anchors(turns: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    rows = checks.originals(turns).where("action_type = 'search' and valid_action and observation_consumable")
    return rows if allowed is None else rows.join(allowed.select("trajectory_id").distinct(), "trajectory_id", "left_semi")


def zero_reasons(turns: DataFrame, population: DataFrame | None = None, chosen: DataFrame | None = None, pool: DataFrame | None = None, failures: DataFrame | None = None, overflows: DataFrame | None = None) -> DataFrame:
    """(turn_id, zero_reason) of original search turns that get no utility: the first reason that holds.

    population: trajectory_id of the diagnostic subset; chosen: turn_id within the
    cap; pool: observation_id and valid; failures: turn_id and control_failure;
    overflows: turn_id.  A table that isn't given never excludes a turn.
    """
    rows = checks.originals(turns).where("action_type = 'search'").select("turn_id", "trajectory_id", "valid_action", "observation_consumable")
    mark = lambda df, key, name: df.select(F.col(key).alias("turn_id"), F.lit(True).alias(name)).distinct()
    rows = rows.withColumn("in_population", F.lit(True)) if population is None else rows.join(population.select("trajectory_id", F.lit(True).alias("in_population")).distinct(), "trajectory_id", "left")
    rows = rows.withColumn("in_cap", F.lit(True)) if chosen is None else rows.join(mark(chosen, "turn_id", "in_cap"), "turn_id", "left")
    rows = rows.withColumn("observed", F.lit(True)) if pool is None else rows.join(mark(pool.where("valid"), "observation_id", "observed"), "turn_id", "left")
    rows = rows.withColumn("control_failure", F.lit(None).cast("string")) if failures is None else rows.join(failures.select("turn_id", "control_failure"), "turn_id", "left")
    rows = rows.withColumn("overflow", F.lit(None).cast("boolean")) if overflows is None else rows.join(mark(overflows, "turn_id", "overflow"), "turn_id", "left")
    reason = (
        F.when(~F.col("valid_action"), "invalid_search").when(~F.col("observation_consumable"), "unconsumable_observation").when(F.col("in_population").isNull(), "diagnostic_trajectory_subset")
        .when(F.col("in_cap").isNull(), "diagnostic_anchor_cap").when(F.col("observed").isNull(), "invalid_observation").when(F.col("control_failure").isNotNull(), F.col("control_failure")).when(F.col("overflow"), "score_context_overflow")
    )
    return rows.select("turn_id", reason.alias("zero_reason")).where("zero_reason is not null")
