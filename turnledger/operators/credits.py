"""From scores to local credits of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions import scalars
from turnledger.operators import answers, checks
from turnledger.schema import ANSWER_ALPHA, CHANNELS, SEARCH_CAP, TRAJECTORY_BUDGET, VIEWS


def view_means(scored: DataFrame) -> DataFrame:
    """(turn_id, real, empty, control_0, control_1, control_2, alias_count): each view's mean over the aliases.

    scored: turn_id, view and score.  alias_count is null unless all five views
    have the same number of scores.
    """
    each = [F.avg(F.when(F.col("view") == v, F.col("score"))).alias(v) for v in VIEWS]
    counts = [F.count(F.when(F.col("view") == v, F.col("score"))).alias(f"n_{v}") for v in VIEWS]
    rows = scored.groupBy("turn_id").agg(*each, *counts, F.count("*").alias("n"))
    same = F.lit(True)
    for v in VIEWS:
        same = same & (F.col(f"n_{v}") * len(VIEWS) == F.col("n"))
    return rows.select("turn_id", *VIEWS, F.when(same, F.col("n_real")).alias("alias_count"))


def search_utilities(scored: DataFrame, delta: float, scale: float, repeats: DataFrame | None = None, check: bool = True) -> DataFrame:
    """(turn_id, views, utility, g_incremental, g_control, g_directed, conflict, scored, zero_reason) of scored turns."""
    means = view_means(scored)
    if check:
        checks.require_none(means.where("alias_count is null").select("turn_id"), "views that don't share the aliases")
    means = means.withColumn("visible_exact_repeat", F.lit(False)) if repeats is None else means.join(repeats.select("turn_id", "visible_exact_repeat"), "turn_id", "left")
    result = scalars.search_utility(F.col("real"), F.col("empty"), [F.col(v) for v in VIEWS[2:]], delta, scale, repeat=F.coalesce("visible_exact_repeat", F.lit(False)))
    return means.withColumn("r", result).select("turn_id", *VIEWS, "alias_count", "r.*")


def action_utilities(turns: DataFrame, utilities: DataFrame, residuals: DataFrame) -> DataFrame:
    """(turn_id, action_type, utility): a search turn's utility, an answer's residual; 0 where there is none."""
    rows = checks.originals(turns).select("turn_id", "trajectory_id", "action_type")
    rows = rows.join(utilities.select("turn_id", F.col("utility").alias("u")), "turn_id", "left").join(residuals.select("trajectory_id", "residual"), "trajectory_id", "left")
    value = F.when(F.col("action_type") == "search", F.col("u")).when(F.col("action_type") == "answer", F.col("residual"))
    return rows.select("turn_id", "action_type", F.coalesce(value, F.lit(0.0)).alias("utility"))


def responsibilities(rows: DataFrame, delta: Column | float, scale: Column | float, chunk_delta: Column | float, precision: str = "float") -> DataFrame:
    """(turn_id, full_score, whole_masked, dependency, rho, weights) from turn_id, full_score, whole_masked and chunk_masked; ``precision`` is that of the weights."""
    full, whole = F.col("full_score"), F.col("whole_masked")
    return rows.select("turn_id", "full_score", "whole_masked", (full - whole).alias("dependency"), scalars.responsibility_strength(full, whole, delta, scale).alias("rho"), scalars.chunk_weights(full, F.col("chunk_masked"), chunk_delta, precision=precision).alias("weights"))


def masked_scores(scored: DataFrame) -> DataFrame:
    """(turn_id, full_score, whole_masked, chunk_masked) of scored responsibility requests: turn_id, view, full_score, score."""
    chunk = F.regexp_extract("view", r"chunk_mask_(\d+)", 1)
    chunks = F.collect_list(F.when(chunk != "", F.struct(F.nullif(chunk, F.lit("")).cast("int").alias("i"), "score")))
    rows = scored.groupBy("turn_id").agg(F.max("full_score").alias("full_score"), F.max(F.when(F.col("view") == "whole_mask", F.col("score"))).alias("whole_masked"), F.sort_array(chunks).alias("c"))
    return rows.select("turn_id", "full_score", "whole_masked", F.transform("c", lambda x: x["score"]).alias("chunk_masked"))


def zero_filled(turns: DataFrame, found: DataFrame) -> DataFrame:
    """found and zeros, one weight for each chunk, for the turns without a responsibility."""
    rest = turns.join(found.select("turn_id"), "turn_id", "left_anti").select("turn_id", F.lit(0.0).alias("rho"), F.array_repeat(F.lit(0.0).cast("float"), F.size("think_chunks")).alias("weights"))
    return found.select("turn_id", "rho", F.col("weights").cast("array<float>").alias("weights")).unionByName(rest)


def trajectory_cap(credits: DataFrame, cap: float = SEARCH_CAP) -> DataFrame:
    """credits with raw_mass, cap_scale and capped action and chunks: a trajectory's search credits are scaled to ``cap``.

    credits: trajectory_id, action (double) and chunks (array of double).
    """
    rows = credits.withColumn("__mass", scalars.absolute_mass(F.col("action"), F.col("chunks")))
    total = rows.groupBy("trajectory_id").agg(F.sum("__mass").alias("raw_mass"))
    scale = F.when(F.col("raw_mass") > 0, F.least(F.lit(1.0), cap / F.nullif("raw_mass", F.lit(0.0)))).otherwise(1.0)
    rows = rows.join(total, "trajectory_id").withColumn("cap_scale", scale).drop("__mass")
    return rows.withColumn("action", F.col("action") * F.col("cap_scale")).withColumn("chunks", F.transform("chunks", lambda c: c * F.col("cap_scale")))


def assemble(turns: DataFrame, utilities: DataFrame, found: DataFrame, residuals: DataFrame, population: DataFrame | None = None, check: bool = True) -> DataFrame:
    """One credit row for each turn, copies included with zeros.

    utilities: turn_id, utility and zero_reason; found: turn_id, rho and weights;
    residuals: trajectory_id and residual.  Raises where an active turn with
    chunks has no responsibility, where the numbers of chunks differ, and where a
    trajectory's mass exceeds its budget.
    """
    rows = turns.join(utilities.select("turn_id", F.col("utility").alias("su"), F.col("zero_reason").alias("sr"), F.lit(True).alias("has_su")), "turn_id", "left")
    rows = rows.join(found.select("turn_id", "rho", "weights"), "turn_id", "left").join(residuals.select("trajectory_id", "residual"), "trajectory_id", "left")
    rows = rows.withColumn("inside", F.lit(True)) if population is None else rows.join(population.select("trajectory_id", F.lit(True).alias("inside")).distinct(), "trajectory_id", "left")
    kind, copy, inside = F.col("action_type"), F.coalesce("is_adjustment_copy", F.lit(False)), F.coalesce("inside", F.lit(False))
    search = ~copy & inside & (kind == "search") & F.coalesce("has_su", F.lit(False))
    answer = ~copy & inside & (kind == "answer") & F.col("valid_action")
    utility = F.when(search, F.col("su")).when(answer, F.coalesce("residual", F.lit(0.0))).otherwise(0.0)
    alpha = F.when(kind == "answer", F.lit(ANSWER_ALPHA)).otherwise(F.lit(1.0))
    zeros = F.transform("think_chunks", lambda _: F.lit(0.0).cast("float"))
    weights = F.when(search | answer, F.coalesce(F.col("weights").cast("array<float>"), zeros)).otherwise(zeros)
    bare = F.size("action_content_positions") == 0
    reason = (
        F.when(copy, "adjustment_copy").when(~inside, "diagnostic_trajectory_subset").when((kind == "search") & ~search, "ineligible_search").when((kind == "answer") & ~answer, "ineligible_answer")
        .when(~kind.isin("search", "answer"), "invalid_or_other_action").when(search & F.col("sr").isNotNull(), F.col("sr")).when(bare, "action_boundary_only")
    )
    rows = rows.withColumn("raw_utility", utility).withColumn("responsibility", F.when(search | answer, F.coalesce("rho", F.lit(0.0))).otherwise(0.0)).withColumn("w", weights).withColumn("reason", reason)
    if check:
        due = ~copy & inside & (kind == "search") & F.col("valid_action") & F.col("observation_consumable")
        checks.require_none(rows.where(due & F.col("has_su").isNull()).select("turn_id"), "a search turn without a utility")
        checks.require_none(rows.where((F.col("raw_utility") != 0) & (F.size("think_chunks") > 0) & F.col("rho").isNull()).select("turn_id"), "an active turn without a responsibility")
        checks.require_none(rows.where((search | answer) & (F.size("w") != F.size("think_chunks"))).select("turn_id"), "weights that don't fit the chunks")
    routed = scalars.route_credit(F.col("raw_utility"), F.col("responsibility"), F.col("w"), alpha)
    rows = rows.withColumn("r", routed).withColumn("action", F.when(bare, 0.0).otherwise(F.col("r.action"))).withColumn("chunks", F.col("r.chunks")).withColumn("searching", search)
    mass = rows.where("searching").groupBy("trajectory_id").agg(F.sum(scalars.absolute_mass(F.col("action"), F.col("chunks"))).alias("raw_mass"))
    capped = F.col("action_type").eqNullSafe("search") & ~copy & F.col("raw_mass").isNotNull()
    scale = F.when(capped & (F.col("raw_mass") > 0), F.least(F.lit(1.0), SEARCH_CAP / F.nullif("raw_mass", F.lit(0.0)))).otherwise(1.0)
    rows = rows.join(mass, "trajectory_id", "left").withColumn("search_cap_scale", scale)
    out = rows.select(
        "batch_row_index", "turn_id", "trajectory_id", "action_type", F.col("action_content_positions").alias("action_positions"), (F.col("action") * F.col("search_cap_scale")).alias("action_coefficient"),
        F.col("think_chunks").alias("think_chunk_positions"), F.transform("chunks", lambda c: c * F.col("search_cap_scale")).alias("think_chunk_coefficients"), "raw_utility", "responsibility", "search_cap_scale", F.col("reason").alias("zero_reason"),
    )
    if check:
        checks.require_none(checks.over_budget(trajectory_mass(out), TRAJECTORY_BUDGET), "a trajectory over its budget")
    return out


def trajectory_mass(credits: DataFrame) -> DataFrame:
    live = credits.where("zero_reason is null or zero_reason <> 'adjustment_copy'")
    return live.groupBy("trajectory_id").agg(F.sum(scalars.absolute_mass(F.col("action_coefficient"), F.col("think_chunk_coefficients"))).alias("mass"))


def channel_mass(spans: DataFrame) -> DataFrame:
    """(channel, spans, mass): nonzero spans and the sum of their magnitudes."""
    c = F.col("coefficient").cast("double")
    return spans.groupBy("channel").agg(F.count_if(c != 0).alias("spans"), F.sum(F.abs(c)).alias("mass"))


def answer_residuals_of(turns: DataFrame) -> DataFrame:
    rows = checks.originals(turns).where("action_type = 'answer'")
    rows = rows.select("trajectory_id", "rollout_group_id", F.col("terminal_binary_em").alias("binary_em"), F.col("valid_action").alias("valid_terminal_answer"), F.col("action_text").alias("answer"), F.col("answer_aliases").alias("aliases"))
    return answers.answer_residuals(answers.best_quality(rows))


def step_metrics(turns: DataFrame, credits: DataFrame) -> DataFrame:
    """One row of counts and sums of a step."""
    live = credits.join(turns.select("batch_row_index", "valid_action", "observation_consumable"), "batch_row_index")
    kind, mass = F.col("action_type"), scalars.absolute_mass(F.col("action_coefficient"), F.col("think_chunk_coefficients"))
    own = ~F.col("zero_reason").eqNullSafe("adjustment_copy")
    counts = {
        "rows": F.lit(True), "copies": ~own, "search_turns": own & (kind == "search"), "answer_turns": own & (kind == "answer"), "valid_actions": own & F.col("valid_action"), "consumable": own & F.col("observation_consumable"),
        "positive": own & (F.col("raw_utility") > 0), "negative": own & (F.col("raw_utility") < 0), "active_action": F.col("action_coefficient") != 0, "active_think": F.exists("think_chunk_coefficients", lambda c: c != 0),
        "capped": own & (F.col("search_cap_scale") < 1), "boundary_only": F.col("zero_reason").eqNullSafe("action_boundary_only"), "dead_zone": F.col("zero_reason").eqNullSafe("dead_zone"), "sign_conflict": F.col("zero_reason").eqNullSafe("contrast_sign_conflict"),
        "visible_repeat": F.col("zero_reason").eqNullSafe("visible_exact_repeat"),
    }
    sums = [F.sum(F.when(own & (kind == k), mass).otherwise(0.0)).alias(f"{k}_mass") for k in ("search", "answer")]
    return live.agg(*(F.count_if(v).alias(k) for k, v in counts.items()), F.count_distinct(F.when(own, F.col("trajectory_id"))).alias("trajectories"), *sums, F.max("search_cap_scale").alias("largest_cap_scale"), F.min("search_cap_scale").alias("smallest_cap_scale"))


# Names that a step's metrics have, less their common prefix.
METRIC_PREFIX = "urcr_v4/"


def training_metrics(turns: DataFrame, utilities: DataFrame, responsibilities: DataFrame, reasons: DataFrame, spans: DataFrame, masses: DataFrame, search_items: DataFrame, responsibility_items: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(metric, value) of a training step, one aggregate over each table.

    turns: TURN rows; utilities: turn_id, action_type, utility; responsibilities:
    turn_id, action_type, rho; reasons: turn_id, zero_reason of those without a
    responsibility; spans: channel, coefficient; masses: trajectory_id, raw_mass,
    capped_mass; items: requests with comparison_group_id; groups: the selected
    question groups, none counting as 0.
    """
    own = checks.originals(turns)
    kind, u, rho, c = F.col("action_type"), F.col("utility"), F.col("rho"), F.coalesce(F.col("coefficient").cast("double"), F.lit(0.0))
    boundary_only = F.col("valid_action") & (F.size("action_boundary_positions") > 0) & (F.size("action_content_positions") == 0)
    tables = [
        (own, {"original_turn_row_count": F.count("*"), "original_trajectory_count": F.count_distinct("trajectory_id"), "boundary_only_action_count": F.count_if(boundary_only), "no_think_valid_action_count": F.count_if(F.col("valid_action") & (F.size("think_chunks") == 0))}),
        (utilities, {"search_utility_positive_count": F.count_if((kind == "search") & (u > 0)), "search_utility_negative_count": F.count_if((kind == "search") & (u < 0)), "search_zero_reason_count": F.count_if((kind == "search") & (u == 0)),
                     "action_utility_positive_count": F.count_if(u > 0), "action_utility_negative_count": F.count_if(u < 0), "action_utility_zero_count": F.count_if(u == 0)}),
        (responsibilities, {"responsibility_positive_count": F.count_if(rho > 0), "search_responsibility_positive_count": F.count_if((kind == "search") & (rho > 0)), "answer_responsibility_positive_count": F.count_if((kind == "answer") & (rho > 0))}),
        (reasons, {"responsibility_zero_reason_count": F.count("*")}),
        (spans, {"local_nonzero_span_count": F.count_if(c != 0), "local_absolute_coefficient_sum": F.sum(F.abs(c))} | {f"{n}_span_count": F.count_if((F.col("channel") == i) & (c != 0)) for n, i in CHANNELS.items()} | {f"{n}_absolute_mass": F.sum(F.when(F.col("channel") == i, F.abs(c))) for n, i in CHANNELS.items()}),
        (masses, {"trajectory_cap_active_count": F.count_if(F.col("capped_mass") < F.col("raw_mass"))}),
        (search_items, {"search_bundle_count": F.count_distinct("comparison_group_id"), "search_item_count": F.count("*")}),
        (responsibility_items, {"responsibility_bundle_count": F.count_distinct("comparison_group_id"), "responsibility_item_count": F.count("*")}),
    ]
    if groups is not None:
        tables.append((groups, {"selected_question_group_count": F.count("*")}))
    out = reasons.groupBy("zero_reason").agg(F.count("*").cast("double").alias("value")).select(F.concat(F.lit(f"{METRIC_PREFIX}responsibility_zero_reason/"), "zero_reason").alias("metric"), "value")
    if groups is None:
        out = out.unionByName(turns.sparkSession.createDataFrame([(f"{METRIC_PREFIX}selected_question_group_count", 0.0)], "metric string, value double"))
    for rows, values in tables:
        one = rows.agg(*(F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in values.items()))
        out = out.unionByName(one.select(F.explode(F.create_map(*(x for k in values for x in (F.lit(METRIC_PREFIX + k), F.col(k))))).alias("metric", "value")))
    return out
