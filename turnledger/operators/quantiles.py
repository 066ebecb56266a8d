"""Exact quantiles of groups of any size, by radix selection.

A double is mapped to a 64-bit integer of the same order.  Its top bits are
counted for each group, which tells in which bucket each wanted rank lies; only
rows of these buckets are counted by the next bits, and then by all bits.  Every
step is a count with partial sums before the shuffle, so no group meets in one
task: what meets is a histogram of at most 2**22 buckets, in practice thousands.
Three passes read the rows, the first two of which run when a function is called.

Counts can be added up before ranks are looked for.  ``members`` says which
groups a unit of rows belongs to, as the batches of each prefix of a calibration:
a row is read and counted once, however many groups hold it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.operators.stages import written

#: Groups of which a table of wanted buckets is broadcast; beyond it the join is shuffled.
BROADCAST_GROUPS = 20_000
#: Bits below the first and the second histogram.
FIRST, SECOND = 44, 22


def order_key(value: Column) -> Column:
    """A long that orders as the double does, 0.0 as -0.0, NaN above all: sign, exponent and mantissa, by exact arithmetic."""
    x = value.cast("double") + 0.0
    a, two = F.abs(x), F.lit(2.0)
    near = F.greatest(F.least(F.floor(F.log2(a)), F.lit(1023)), F.lit(-1022))
    e = near + F.when(a >= F.pow(two, near + 1), 1).when((a < F.pow(two, near)) & (near > -1022), -1).otherwise(0)
    bits = (e + 1022) * F.lit(2**52) + (a / F.pow(two, e) * F.lit(2.0**52)).cast("long")
    size = F.when(a == 0, F.lit(0)).when(F.isnan(x) | (a == float("inf")), F.lit(2047 * 2**52) + F.isnan(x).cast("int")).otherwise(bits)
    return F.when(x < 0, -size).otherwise(size)


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys that may be null; the keys are those of left."""
    names = {k: f"__right_{k}" for k in keys}
    renamed = right.withColumnsRenamed(names)
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(renamed, condition, how).drop(*names.values())


def few(df: DataFrame, by: list[str]) -> bool:
    return not by or df.select(*by).distinct().limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS


def kept(df: DataFrame, small: bool) -> DataFrame:
    """A table that several steps use, made once: a few rows for each of a counted number of groups by way of the driver, more in the checkpoint folder."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema) if small else written(df)


def select_ranks(rows: DataFrame, unit: list[str], value: str, wanted: Callable[[DataFrame], DataFrame], members: DataFrame | None = None, group: list[str] | None = None, small: bool | None = None) -> DataFrame:
    """(group, n, k, value): the values of some ranks of each group.

    ``wanted`` gets (group, n), n the number of values that aren't null, and gives
    (group, n, ranks), ranks an array of structs of k and r, a rank from 0.  members:
    unit and group, the groups that hold a unit; without it each unit is a group.  A
    group without a wanted rank has a row of a null k.
    """
    group = group or unit
    small = (few(rows, unit) and (members is None or few(members, group))) if small is None else small
    hint = F.broadcast if small else lambda df: df
    members = members if members is None else kept(members, small)
    key = order_key(F.col(value))
    rows = rows.select(*unit, F.col(value).cast("double").alias("__v"), key.alias("__key"), F.shiftright(key, FIRST).alias("__b1"), F.shiftright(key, SECOND).alias("__b2"))

    def counted(rows: DataFrame, level: list[str], *more: Column) -> DataFrame:
        """Counts of each group by level, units added up."""
        out = rows.groupBy(*unit, *level).agg(F.count("*").alias("__n"), *more)
        if members is None:
            return out
        again = [F.min(c).alias(c) for c in out.columns if c == "__v"]
        return matched(out, hint(members), unit).groupBy(*group, *level).agg(F.sum("__n").alias("__n"), *again)

    def narrowed(counts: DataFrame, level: list[str], bucket: str) -> DataFrame:
        """The buckets that hold a wanted rank, with what of it is left within them."""
        before = F.sum("__n").over(Window.partitionBy(*level).orderBy(bucket)) - F.col("__n")
        counts = counts.withColumn("__before", before)
        inside = F.filter("__ranks", lambda x: (x["r"] >= F.col("__before")) & (x["r"] < F.col("__before") + F.col("__n")))
        held = counts.withColumn("__ranks", F.transform(inside, lambda x: F.struct(x["k"].alias("k"), (x["r"] - F.col("__before")).alias("r"))))
        return held.where(F.size("__ranks") > 0).drop("__before", "__n")

    def of_units(buckets: DataFrame, level: list[str]) -> DataFrame:
        """The wanted buckets by unit: rows are kept or left by these."""
        if members is None:
            return buckets.select(*unit, *level)
        return matched(buckets, hint(members), group).select(*unit, *level).distinct()

    first = counted(rows, ["__b1"])  # a histogram
    total = first.groupBy(*group).agg(F.sum(F.when(F.col("__b1").isNotNull(), F.col("__n")).otherwise(0)).alias("n"))
    ranks = wanted(total).withColumnRenamed("ranks", "__ranks")
    level1 = narrowed(matched(first.where("__b1 is not null"), hint(ranks), group), group, "__b1")
    both = kept(level1.unionByName(ranks.withColumn("__b1", F.lit(None).cast("long"))), small)  # in one pass
    ranks, level1 = both.where("__b1 is null").drop("__b1"), both.where("__b1 is not null").select(*group, "__b1", "__ranks")
    rows = matched(rows, hint(of_units(level1, ["__b1"])), [*unit, "__b1"], "left_semi")
    level2 = kept(narrowed(matched(counted(rows, ["__b1", "__b2"]), hint(level1), [*group, "__b1"]), [*group, "__b1"], "__b2").drop("__b1"), small)
    rows = matched(rows, hint(of_units(level2, ["__b2"])), [*unit, "__b2"], "left_semi")
    level3 = narrowed(matched(counted(rows, ["__b2", "__key"], F.min("__v").alias("__v")), hint(level2), [*group, "__b2"]), [*group, "__b2"], "__key")
    found = level3.select(*group, F.explode("__ranks").alias("__x"), F.col("__v").alias("value")).select(*group, F.col("__x.k").alias("k"), "value")
    return matched(ranks.drop("__ranks"), found, group, "left")  # without values or wanted ranks a group has a row of nulls


def ranks_of(n: Column, qs: list[float], below: Column | int = 0) -> Column:
    """The ranks about each quantile of n values that come after ``below`` others, and the first and last."""
    at = lambda k, r: F.struct(F.lit(k).alias("k"), (r + below).cast("long").alias("r"))
    listed = [at(f"{kind}{i}", f(q * (n - 1))) for i, q in enumerate(qs) for kind, f in (("a", F.floor), ("b", F.ceil))]
    return F.when(n > 0, F.array(at("low", F.lit(0)), at("high", n - 1), *listed)).otherwise(F.array().cast("array<struct<k:string,r:bigint>>"))


def spread_out(found: DataFrame, group: list[str], qs: list[float], names: list[str], *keep: str) -> DataFrame:
    """(group, keep, n, low, high, names): the selected ranks as columns, quantiles interpolated between two ranks."""
    of = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    n = F.col("n")
    wide = found.groupBy(*group, *keep, "n").agg(of("low").alias("low"), of("high").alias("high"), *(of(f"{x}{i}").alias(f"__{x}{i}") for i in range(len(qs)) for x in "ab"))
    value = lambda i, q: F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * (q * (n - 1) - F.floor(q * (n - 1)))
    return wide.select(*group, *keep, "n", "low", "high", *(F.when(n > 0, value(i, q)).alias(name) for i, (q, name) in enumerate(zip(qs, names, strict=True))))


def exact_quantiles(rows: DataFrame, by: list[str], value: str, qs: dict[str, float], small: bool | None = None) -> DataFrame:
    """(by, n, low, high, one column for each of qs): exact quantiles with linear interpolation; nulls don't count.

    A group without values has n = 0 and nulls; without ``by`` there is one row, for
    an empty table too.
    """
    if not by:
        one = rows.sparkSession.range(1).select(F.lit(0).alias("__all"))
        out = exact_quantiles(rows.withColumn("__all", F.lit(0)), ["__all"], value, qs, True)
        return matched(one, out, ["__all"], "left").drop("__all").fillna(0, ["n"])
    found = select_ranks(rows, by, value, lambda total: total.withColumn("ranks", ranks_of(F.col("n"), list(qs.values()))), small=small)
    return spread_out(found, by, list(qs.values()), list(qs))
