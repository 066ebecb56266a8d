"""Forward values of the signed span objective."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signed_span_losses(tokens: DataFrame, clip_low: float, clip_high: float, key: tuple[str, ...] = ("row", "slot")) -> DataFrame:
    """(key, loss, tokens) of each span: minus the mean of the smaller of r * c and clip(r) * c.

    tokens: key, old_log_prob, log_prob and coefficient, a row for each token of a
    span; a span without tokens has no row and so a loss of 0 in any sum.
    """
    r, c = F.exp(F.col("log_prob") - F.col("old_log_prob")), F.col("coefficient").cast("double")
    kept = F.least(r * c, F.greatest(F.lit(1.0 - clip_low), F.least(F.lit(1.0 + clip_high), r)) * c)
    return tokens.groupBy(*key).agg((-F.avg(kept)).alias("loss"), F.count("*").alias("tokens"))


def span_tokens(spans: DataFrame, log_probs: DataFrame) -> DataFrame:
    """Spans joined with (batch_row_index, position, old_log_prob, log_prob)."""
    each = spans.select("batch_row_index", "slot", "coefficient", F.explode("positions").alias("position"))
    return each.join(log_probs, ["batch_row_index", "position"]).withColumnRenamed("batch_row_index", "row")


def row_numerators(losses: DataFrame) -> DataFrame:
    return losses.groupBy("row").agg(F.sum("loss").alias("numerator"))


def minibatch_estimates(rows: DataFrame, sampling_rows: int, trajectories: int, ranks: int = 1) -> DataFrame:
    """(minibatch, estimate): the sum of a minibatch's numerators, scaled so that row-weighted means meet the trajectory mean."""
    return rows.groupBy("minibatch").agg((F.sum("numerator") * (ranks * sampling_rows / trajectories) / F.count("*")).alias("estimate"), F.count("*").alias("n_rows"))


def trajectory_mean(rows: DataFrame, trajectories: int) -> DataFrame:
    return rows.agg((F.sum("numerator") / trajectories).alias("objective"))


def dot_products(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, norm_a, norm_b, cosine) of two vectors in long form, with values a and b."""
    norm = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    out = pairs.groupBy(*by).agg(norm("a").alias("norm_a"), norm("b").alias("norm_b"), F.sum(F.col("a") * F.col("b")).alias("dot"))
    return out.select(*by, "norm_a", "norm_b", (F.col("dot") / F.nullif(F.col("norm_a") * F.col("norm_b"), F.lit(0.0))).alias("cosine"))


def clipped(ratio: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(1.0 - low), F.least(F.lit(1.0 + high), ratio))
