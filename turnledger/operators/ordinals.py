"""Running sums and row numbers of ordered groups of any size: range partitions, and a prefix scan over their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.operators.stages import written

#: monotonically_increasing_id has the partition above these bits.
_ROW_BITS = 33


def running(rows: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """rows with, for each of ``sums`` (new column: column), the sum over the rows before, in the order of their group.

    Rows are dealt out by ranges of group and order and sorted there, once, and
    written.  A part of a group is summed up by itself; the parts' totals, a row for
    each part, are added up before it.  Ties of the order are broken once, as written.
    """
    keys = [F.col(c) for c in by]
    parts = written(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__id", F.monotonically_increasing_id()))
    parts = parts.withColumn("__part", F.shiftright("__id", _ROW_BITS))
    own = Window.partitionBy(*by, "__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = parts.groupBy(*by, "__part").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*by, "__part", *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums))
    inside = parts.withColumns({n: F.sum(c).over(own) - F.col(c) for n, c in sums.items()})
    out = inside.join(bases, [*by, "__part"])
    return out.select(*rows.columns, *((F.col(n) + F.col(f"__{n}")).alias(n) for n in sums))


def numbered(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "position") -> DataFrame:
    """rows with their number in the order of their group, from 0.

    A window over one group needs all of it in one task; here a part of a range
    numbers its rows by itself.
    """
    return running(rows.withColumn("__one", F.lit(1)), by, order, {name: "__one"}).drop("__one")
