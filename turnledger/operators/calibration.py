"""Scales from distributions of scores, pooled over batches of raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions import scalars
from turnledger.operators import checks
from turnledger.operators.quantiles import BROADCAST_GROUPS, exact_quantiles, few, matched, ranks_of, select_ranks, spread_out


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def summary(df: DataFrame, column: str, by: list[str] | None = None, check: bool = False) -> DataFrame:
    """count, min, p25, median, p75, p95 and max; nulls but for the count of an empty group."""
    if check:
        checks.require_none(checks.not_finite(df.where(F.col(column).isNotNull()), column), f"{column} isn't finite")
    return exact_quantiles(df, by or [], column, {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}).select(*(by or []), "n", "low", "p25", "median", "p75", "p95", "high")


def search_scale(rows: DataFrame, numeric: DataFrame, by: list[str]) -> DataFrame:
    """(by, delta, scale, active, limited) of search utilities.

    rows: by, control_0, control_1, used_replacement and g_directed; numeric: by and
    difference.  delta is the larger of three times the 95th percentile of the
    numeric differences and the clipped 75th of the first two controls'
    differences, of turns without replacement.  The scale is the clipped 75th
    percentile of the gaps beyond delta, 1 with fewer than eight.
    """
    small = few(rows, by)
    pair = F.when(~F.col("used_replacement"), F.abs(F.col("control_0") - F.col("control_1")))
    first = _wide(_series(rows, by, {"control_p75": pair}).unionByName(_series(numeric, by, {"numeric_p95": F.abs("difference")})), by, {"control_p75": 0.75, "numeric_p95": 0.95}, small)
    delta = _search_delta(matched(rows.select(*by).distinct(), first, by, "left"))
    gap = F.when(F.abs("g_directed") > F.col("delta"), F.abs("g_directed") - F.col("delta"))
    over = matched(rows, F.broadcast(delta) if small else delta, by).select(*by, gap.alias("gap"))
    return _search_scale(matched(delta, exact_quantiles(over, by, "gap", {"q": 0.75}, small).withColumnRenamed("n", "active"), by), by)


def _series(rows: DataFrame, by: list[str], columns: dict[str, Column]) -> DataFrame:
    """(by, series, value): several columns one below the other."""
    return rows.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("series"), c.cast("double").alias("value")) for k, c in columns.items()))).alias("x")).select(*by, "x.*")


def _wide(series: DataFrame, by: list[str], qs: dict[str, float], small: bool) -> DataFrame:
    """(by, one column a series): the quantile of each series."""
    every = exact_quantiles(series, [*by, "series"], "value", {str(q): q for q in sorted(set(qs.values()))}, small)
    return every.groupBy(*by).agg(*(F.max(F.when(F.col("series") == k, F.col(f"`{q}`"))).alias(k) for k, q in qs.items()))


def _search_delta(first: DataFrame) -> DataFrame:
    first = first.withColumn("numeric_p95", F.coalesce("numeric_p95", F.lit(0.0)))
    return first.withColumn("delta", F.greatest(3 * F.col("numeric_p95"), clip(F.col("control_p75"), 0.05, 0.5)))


def _search_scale(rows: DataFrame, by: list[str]) -> DataFrame:
    limited = F.col("active") < 8
    return rows.select(*by, "delta", F.when(limited, 1.0).otherwise(clip(F.col("q"), 0.25, 2.0)).alias("scale"), "numeric_p95", "control_p75", "active", limited.alias("limited"))


def prefix_search_scales(rows: DataFrame, batch: str = "batch") -> DataFrame:
    """(prefix, delta, scale, numeric_p95, control_p75, active, limited): search_scale of the first batches, for each number of them.

    rows: batch, control_0, control_1, used_replacement, g_directed and difference.
    Prefix k has the batches up to the k-th.  A row is counted once, in its batch;
    what is added up over the batches of a prefix are counts of values.  The number
    of batches is that of a calibration, and its square bounds the summaries.
    """
    prefixes = rows.select(F.col(batch).alias("prefix")).where("prefix is not null").distinct()
    small = prefixes.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    held = prefixes.select(F.col("prefix").alias(batch)).join(F.broadcast(prefixes) if small else prefixes, F.col(batch) <= F.col("prefix"))

    def of_prefixes(series: DataFrame, qs: dict[str, float], below: DataFrame | None = None) -> DataFrame:
        def wanted(total: DataFrame) -> DataFrame:
            under = F.lit(0)
            if below is not None:
                total, under = matched(total, below, ["prefix"]).withColumn("n", F.col("n") - F.col("below")), F.col("below")
            return total.withColumn("ranks", ranks_of(F.col("n"), list(qs.values()), under))

        units = [batch, "series"]
        members = series.select("series").distinct().join(held)  # a few series
        found = select_ranks(series, units, "value", wanted, members, ["prefix", "series"], small)
        return spread_out(found, ["prefix", "series"], list(qs.values()), list(qs))

    pair = F.when(~F.col("used_replacement"), F.abs(F.col("control_0") - F.col("control_1")))
    both = of_prefixes(_series(rows, [batch], {"control_p75": pair, "numeric_p95": F.abs("difference")}), {"a": 0.75, "b": 0.95})
    first = both.groupBy("prefix").agg(F.max(F.when(F.col("series") == "control_p75", F.col("a"))).alias("control_p75"), F.max(F.when(F.col("series") == "numeric_p95", F.col("b"))).alias("numeric_p95"))
    delta = _search_delta(first)
    gaps = _series(rows, [batch], {"gap": F.abs("g_directed")})
    cuts = delta.agg(F.array_sort(F.collect_set("delta")).alias("cuts"))  # at most one a prefix
    part = gaps.where("value is not null").join(F.broadcast(cuts) if small else cuts).groupBy(batch, F.size(F.filter("cuts", lambda c: c < F.col("value"))).alias("cut")).agg(F.count("*").alias("m"), F.max("cuts").alias("cuts"))
    at = matched(part.join(held, batch), delta, ["prefix"])
    below = at.groupBy("prefix").agg(F.coalesce(F.sum(F.when(F.col("cut") < F.array_position("cuts", F.col("delta")), F.col("m"))), F.lit(0)).alias("below"))
    over = of_prefixes(gaps, {"q": 0.75}, below)
    out = matched(delta, over.select("prefix", F.col("n").alias("active"), (F.col("q")).alias("at")), ["prefix"])
    return _search_scale(out.withColumn("q", F.col("at") - F.col("delta")), ["prefix"])


def responsibility_scale(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, action_type, delta, scale, active, limited).

    rows: by, action_type, old_full, plain, whole_masked and repeat_error.  The
    numeric error of an action type is the larger 95th percentile of the repeat
    errors and of |old_full - plain|; a dependency is old_full - whole_masked.
    """
    key, small = [*by, "action_type"], few(rows, by)
    errors = {"repeat": F.abs("repeat_error"), "apart": F.abs(F.col("old_full") - F.col("plain"))}
    error = _wide(_series(rows, key, errors), key, dict.fromkeys(errors, 0.95), small)
    error = error.select(*key, F.coalesce(F.greatest("repeat", "apart"), F.lit(0.0)).alias("numeric_p95"))
    delta = error.withColumn("delta", F.greatest(F.lit(0.01), 3 * F.col("numeric_p95")))
    dependency = F.col("old_full") - F.col("whole_masked")
    over = F.when(dependency > F.col("delta"), dependency - F.col("delta"))
    over = matched(rows, F.broadcast(delta) if small else delta, key).select(*key, over.alias("over"))
    out = matched(delta, exact_quantiles(over, key, "over", {"q": 0.5}, small).withColumnRenamed("n", "active"), key)
    fallback = F.when(F.col("action_type") == "search", 0.6201).otherwise(0.2)
    return out.select(*key, "delta", F.when(F.col("active") < 8, fallback).otherwise(clip(F.col("q"), 0.1, 2.0)).alias("scale"), "numeric_p95", "active", (F.col("active") < 8).alias("limited"))


def gradient_scale(rows: DataFrame, by: list[str], check: bool = True) -> DataFrame:
    """(by, lambda_0, lambda_max) from global_norm and local_norm of at least two subbatches."""
    if check:
        checks.require_none(rows.where("not (global_norm > 0 and local_norm > 0)"), "a norm that isn't positive")
        checks.require_none(rows.groupBy(*by).count().where("count < 2"), "fewer than two subbatches")
    ratio = F.col("global_norm") / F.col("local_norm")
    out = exact_quantiles(rows.select(*by, ratio.alias("ratio")), by, "ratio", {"median": 0.5})
    lambda_0 = clip(0.1 * F.col("median"), 1e-4, 0.2)
    return out.select(*by, lambda_0.alias("lambda_0"), F.least(lambda_0, 0.3 * F.col("low")).alias("lambda_max"))


def shadow_ceiling(lambda_max: Column, global_norm: Column, local_norm: Column) -> Column:
    """lambda_max, lowered only where it would let the local share exceed 0.3."""
    return F.when((local_norm > 0) & (lambda_max * local_norm / global_norm > 0.3), F.least(lambda_max, 0.3 * global_norm / F.nullif(local_norm, F.lit(0.0)))).otherwise(lambda_max)


def reason_counts(rows: DataFrame, column: str = "zero_reason") -> DataFrame:
    return rows.groupBy(F.coalesce(column, F.lit("unspecified")).alias("reason")).agg(F.count("*").alias("n")).orderBy("reason")


def sign_counts(rows: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return rows.agg(F.count_if(c > 0).alias("positive"), F.count_if(c < 0).alias("negative"), F.count_if(c == 0).alias("zero"))


def residual_sums(residuals: DataFrame) -> DataFrame:
    """(groups, largest): strata, and the largest magnitude of a stratum's sum, which is zero but for rounding."""
    each = residuals.where("eligible").groupBy("rollout_group_id", "binary_em").agg(F.sum("residual").alias("s"))
    return each.agg(F.count("*").alias("groups"), F.max(F.abs("s")).alias("largest"))


def distinct_counts(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.agg(*(F.count_distinct(c).alias(f"n_{c}") for c in columns))


def pooled(documents: list[DataFrame]) -> DataFrame:
    """Raw rows of several batches, put together; scales are estimated anew, never averaged."""
    out = documents[0]
    for d in documents[1:]:
        out = out.unionByName(d)
    return out


def search_rows(documents: DataFrame) -> DataFrame:
    """Raw search rows of calibration documents."""
    rows = documents.select("batch_id", F.explode("search.rows").alias("r")).select("batch_id", "r.*")
    return rows.select("batch_id", "question_id", "turn_id", F.col("control_used_replacement").alias("used_replacement"), "view_scores.control_0", "view_scores.control_1", "g_directed", "visible_exact_repeat", "contrast_sign_conflict")


def responsibility_rows(documents: DataFrame) -> DataFrame:
    rows = documents.select("batch_id", F.col("numeric_reference.same_shape_repeat_max_abs_difference").alias("repeat_error"), F.explode("responsibility.rows").alias("r")).select("batch_id", "repeat_error", "r.*")
    return rows.select("batch_id", "turn_id", "action_type", "is_zero_utility_shadow", F.col("old_full_score").alias("old_full"), F.col("plain_scorer_score").alias("plain"), F.col("whole_masked_score").alias("whole_masked"), F.col("chunk_masked_scores").alias("chunk_masked"), "repeat_error")


def numeric_rows(documents: DataFrame) -> DataFrame:
    return documents.select("batch_id", F.col("numeric_reference.same_shape_repeat_max_abs_difference").alias("difference"))


def last_range(scales: DataFrame, column: str, order: str = "prefix", n: int = 3) -> DataFrame:
    """(spread, ratio): the range of the last n values, and its share of the last one's magnitude."""
    last = scales.orderBy(F.desc(order)).limit(n)
    out = last.agg((F.max(column) - F.min(column)).alias("spread"), F.max_by(column, order).alias("last"))
    return out.select("spread", (F.col("spread") / F.greatest(F.abs("last"), F.lit(1e-12))).alias("ratio"))


def cost_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(key, total, ...): the sum and distribution of each cost; a missing one counts as 0."""
    long = rows.select(F.explode(F.create_map(*(x for k in keys for x in (F.lit(k), F.coalesce(F.col(k).cast("double"), F.lit(0.0)))))).alias("key", "value"))
    return summary(long, "value", ["key"]).join(long.groupBy("key").agg(F.sum("value").alias("total")), "key")  # a row a key


def finalize(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scales of saved rows, and each responsibility row under them: (search, responsibility, rows)."""
    everything = documents.withColumn("batch_id", F.lit("all"))
    search = search_scale(search_rows(everything), numeric_rows(everything), ["batch_id"])
    rows = responsibility_rows(everything)
    scale = responsibility_scale(rows, ["batch_id"])
    joined = rows.join(F.broadcast(scale.select("batch_id", "action_type", "delta", "scale")), ["batch_id", "action_type"])  # two rows
    rho = scalars.responsibility_strength(F.col("old_full"), F.col("whole_masked"), F.col("delta"), F.col("scale"))
    out = joined.select("turn_id", "action_type", (F.col("old_full") - F.col("whole_masked")).alias("dependency"), rho.alias("rho"), scalars.chunk_weights(F.col("old_full"), F.col("chunk_masked"), F.col("delta")).alias("weights"))
    return search, scale, out
