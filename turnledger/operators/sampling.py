"""Stable samples, batches and layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions.scalars import hash_order
from turnledger.operators.checks import CheckFailed
from turnledger.schema import REVISION


def hash_subset(rows: DataFrame, n: int, key: str = "turn_id", purpose: str = "diagnostic-anchor") -> DataFrame:
    """The n rows first by SHA-256 of revision, purpose and key; none for n <= 0, all where n isn't less than all."""
    if n <= 0:
        return rows.limit(0)
    return rows.orderBy(hash_order(REVISION, purpose, F.col(key)), key).limit(n)


def hash_groups(rows: DataFrame, n: int) -> DataFrame:
    """n rollout groups that have a nonzero masked advantage, by hash."""
    live = rows.where(F.exists(F.zip_with("advantages", "response_mask", lambda a, m: F.abs(a) * m), lambda x: x > 0)).select("rollout_group_id").distinct()
    return hash_subset(live, n, "rollout_group_id", "gradient-group")


def ranked(rows: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def stratified_sample(rows: DataFrame, each: int, seed: int, by: str = "data_source", key: str = "extra_info.index") -> DataFrame:
    """``each`` rows of every stratum without replacement, by a seeded hash.

    A stable selection; a seeded permutation of another library selects other rows.
    """
    return ranked(rows, [by], hash_order(str(seed), F.col(by), F.col(key)), key).where(F.col("rn") <= each).drop("rn")


def disjoint_batches(rows: DataFrame, excluded: DataFrame, batches: int, each: int, seed: int, by: str = "data_source", key: str = "row_index") -> DataFrame:
    """rows with batch_index from 1: balanced batches, disjoint from each other and from the excluded rows."""
    rest = rows.join(excluded.select(by, key).distinct(), [by, key], "left_anti")
    return ranked(rest, [by], hash_order(str(seed), F.col(by), F.col(key)), key).where(F.col("rn") <= each * batches).withColumn("batch_index", F.ceil(F.col("rn") / each).cast("int")).drop("rn")


def active_then_shadow(rows: DataFrame, limit: int) -> DataFrame:
    """Up to ``limit`` turns of each action type: those with utility first, then zero ones as shadows."""
    zero = F.col("utility") == 0
    return ranked(rows, ["action_type"], zero, hash_order(REVISION, "responsibility", F.col("turn_id")), "turn_id").where(F.col("rn") <= limit).withColumn("is_zero_utility_shadow", zero).drop("rn")


def interleaved_layout(rows: DataFrame, target: int, micro: int, order: str = "ordinal") -> DataFrame:
    """(block, place, row_index, is_original): rows dealt round-robin over target / micro blocks.

    A block that isn't full repeats its first row.  ``order`` numbers the rows from
    0.  Raises for a row that is repeated or negative, for more rows than
    ``target`` and for fewer than blocks.
    """
    if target <= 0 or micro <= 0 or target % micro:
        raise ValueError("rows must divide into microbatches")
    blocks = target // micro
    seen = rows.agg(F.count("*").alias("n"), F.count_distinct("row_index").alias("distinct"), F.min("row_index").alias("least")).first()
    if seen.n != seen.distinct or (seen.n and seen.least < 0):
        raise CheckFailed("row indices have to be distinct and not negative")
    if not blocks <= seen.n <= target:
        raise CheckFailed(f"{seen.n} rows don't make {blocks} blocks of at most {micro}")
    dealt = rows.select("row_index", F.pmod(F.col(order), F.lit(blocks)).cast("int").alias("block"), F.floor(F.col(order) / blocks).cast("int").alias("place"))
    real = dealt.select("block", "place", "row_index", F.lit(True).alias("is_original"))
    held = dealt.groupBy("block").agg(F.count("*").alias("n"), F.min_by("row_index", "place").alias("row_index"))
    fill = held.where(F.col("n") < micro).select("block", F.explode(F.sequence(F.col("n").cast("int"), F.lit(micro - 1))).alias("place"), "row_index", F.lit(False).alias("is_original"))
    return real.unionByName(fill)


def pad_with_copies(rows: DataFrame, divisor: int, seed: int, key: str) -> DataFrame:
    """rows and flagged copies of some of them, so that the number divides by ``divisor``."""
    short = -rows.count() % divisor
    flagged = rows.withColumn("is_adjustment_copy", F.lit(False))
    return flagged.unionByName(rows.orderBy(hash_order(str(seed), F.col(key)), key).limit(short).withColumn("is_adjustment_copy", F.lit(True)))


def trim_to_divisor(rows: DataFrame, divisor: int, seed: int, key: str) -> DataFrame:
    """rows without some of them, so that the number divides by ``divisor``."""
    extra = rows.count() % divisor
    return rows.join(rows.orderBy(hash_order(str(seed), F.col(key)), key).limit(extra).select(key), key, "left_anti")


def take_rows(rows: DataFrame, indices: DataFrame, key: str = "row_index") -> DataFrame:
    return rows.join(indices.select(key), key)
