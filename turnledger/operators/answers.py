"""Answer quality and its residual within a stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions import scalars
from turnledger.operators import checks
from turnledger.schema import MAX_ALIASES


def best_quality(answers: DataFrame, key: str = "trajectory_id") -> DataFrame:
    """answers with quality: 1 for an exact match, else the best F0.5 over the aliases."""
    each = answers.where("binary_em = 0 and answer is not null").select(key, "answer", F.posexplode("aliases").alias("i", "alias"))
    each = each.withColumn("pair", F.concat_ws("#", key, "i"))
    best = scalars.fbeta_scores(each, "pair", "answer", "alias").join(each.select("pair", key), "pair").groupBy(key).agg(F.max("fbeta").alias("best"))
    return answers.join(best, key, "left").withColumn("quality", scalars.answer_quality(F.col("binary_em"), F.col("best"))).drop("best")


def answer_residuals(answers: DataFrame, quality: Column | None = None) -> DataFrame:
    """(trajectory_id, eligible, quality, residual, stratum_size).

    The residual is the quality less its mean over valid answers of the same
    group and outcome; 0 in a stratum of one.  Answers that aren't valid are not
    eligible, with zeros.  Means are aggregates joined back, so a group of any
    size is combined before the shuffle.
    """
    q = (F.col("quality") if quality is None else quality).cast("double")
    rows = answers.select("trajectory_id", "rollout_group_id", "binary_em", F.coalesce("valid_terminal_answer", F.lit(False)).alias("valid"), q.alias("q"))
    strata = rows.where("valid").groupBy("rollout_group_id", "binary_em").agg(F.avg("q").alias("mean"), F.count("*").alias("n"))
    rows = rows.join(strata, ["rollout_group_id", "binary_em"], "left")
    return rows.select(
        "trajectory_id", F.col("valid").alias("eligible"), F.when(F.col("valid"), F.col("q")).otherwise(0.0).alias("quality"),
        F.when(F.col("valid") & (F.col("n") > 1), F.col("q") - F.col("mean")).otherwise(0.0).alias("residual"), F.when(F.col("valid"), F.col("n")).otherwise(0).cast("long").alias("stratum_size"),
    )


def checked_answers(answers: DataFrame) -> DataFrame:
    checks.require_none(answers.where("coalesce(trajectory_id, '') = '' or coalesce(rollout_group_id, '') = ''"), "an answer without ids")
    checks.require_none(checks.repeated_ids(answers, "trajectory_id"), "a repeated trajectory")
    checks.require_none(answers.where("binary_em is null or binary_em not in (0, 1)"), "an outcome other than 0 or 1")
    checks.require_none(answers.where("valid_terminal_answer and answer is null"), "a valid answer without text")
    return answers


def probe_aliases(aliases: DataFrame, key: str = "turn_id", limit: int = MAX_ALIASES) -> DataFrame:
    """(key, alias_index, alias): at most ``limit`` accepted answers that differ when normalised.

    aliases: key, alias and is_primary.  The primary comes first, the others by
    their normal form; of equal forms the smallest spelling stays.
    """
    rows = aliases.withColumn("form", scalars.normalize_answer(F.col("alias"))).where("form <> ''")
    forms = rows.groupBy(key, "form").agg(F.min("alias").alias("least"), F.min(F.when(F.col("is_primary"), F.col("alias"))).alias("primary"))
    order = Window.partitionBy(key).orderBy(F.col("primary").isNull(), "form")
    out = forms.select(key, F.coalesce("primary", "least").alias("alias"), (F.row_number().over(order) - 1).alias("alias_index"))
    return out.where(F.col("alias_index") < limit).select(key, "alias_index", "alias")
