"""Stepwise processing of a stream of turn rows; an extension beside the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def each_step(turns: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ``handle`` with the rows of every global_step of a micro-batch.

    Steps are few in a batch; a step whose rows arrive in two batches is handled
    twice, so ``handle`` has to be idempotent by (global_step, turn_id).
    """

    def run(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        for (step,) in batch.select("global_step").distinct().orderBy("global_step").collect():
            handle(batch.where(F.col("global_step") == step), step)
        batch.unpersist()

    return turns.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def windowed_rates(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, action_type, n, utility): turns by event time, late ones dropped after ``delay``."""
    rows = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "action_type").agg(F.count("*").alias("n"), F.sum("utility").alias("utility"))
    return rows.select(F.col("w.start").alias("start"), "action_type", "n", "utility")
