"""Scorer requests: building, deduplication, packing and expansion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions import scalars, spans
from turnledger.operators import checks, ordinals
from turnledger.operators.stages import written
from turnledger.schema import EMPTY_SLOT


def search_requests(anchors: DataFrame, controls: DataFrame, aliases: DataFrame) -> DataFrame:
    """(request_id, comparison_group_id, turn_id, view, alias_index, alias, observation): five views for each alias.

    anchors: turn_id and observation_text; controls: anchor_id, control_index and
    serialized_observation; aliases: turn_id, alias_index and alias.
    """
    own = anchors.select("turn_id", F.explode(F.array(F.struct(F.lit("real").alias("view"), scalars.observation_slot(F.col("observation_text")).alias("observation")), F.struct(F.lit("empty").alias("view"), F.lit(EMPTY_SLOT).alias("observation")))).alias("v")).select("turn_id", "v.*")
    other = controls.select(F.col("anchor_id").alias("turn_id"), F.concat(F.lit("control_"), F.col("control_index").cast("string")).alias("view"), scalars.observation_slot(F.col("serialized_observation")).alias("observation"))
    rows = own.unionByName(other.join(anchors.select("turn_id"), "turn_id", "left_semi")).join(aliases, "turn_id")
    return rows.select(F.concat_ws(":", "turn_id", "view", F.lit("alias"), F.col("alias_index").cast("string")).alias("request_id"), F.col("turn_id").alias("comparison_group_id"), "turn_id", "view", "alias_index", "alias", "observation")


def responsibility_eligible(turns: DataFrame, utilities: DataFrame) -> DataFrame:
    """turns with a nonzero utility and something to mask; raises for a utility that isn't finite."""
    checks.require_none(checks.not_finite(utilities, "utility"), "a utility that isn't finite")
    rows = checks.originals(turns).join(utilities.select("turn_id", "utility"), "turn_id")
    return rows.where(F.col("valid_action") & F.col("action_type").isin("search", "answer") & (F.col("utility") != 0) & (F.size("think_content_positions") > 0) & (F.size("think_chunks") > 0))


def unavailable_reason() -> Column:
    target = F.col("action_target_positions")
    return (
        F.when(~spans.contiguous(target), "noncontiguous_action_target").when(F.size("old_action_target_log_probs") != F.size(target), "old_action_log_probs_misaligned")
        .when(~F.exists("think_content_positions", lambda p: p < F.get(target, F.lit(0))), "no_preceding_think_target")
    )


def responsibility_requests(turns: DataFrame, plain: bool = False) -> DataFrame:
    """(request_id, comparison_group_id, turn_id, view, full_score, ... forced request): the same action, parts of the thinking masked.

    One request with all thinking before the action masked, one for each chunk that
    has any, and with ``plain`` one without a mask.  full_score is the mean of the
    old log-probabilities, so it needs no request.
    """
    first = F.get("action_target_positions", F.lit(0))
    n = F.size("visible_prompt_token_ids")
    before = F.filter("think_content_positions", lambda p: p < first)
    rows = turns.where(unavailable_reason().isNull()).withColumn("before", before)
    view = lambda name, blocked: F.struct(name.alias("view"), F.transform(blocked, lambda p: p + n).alias("blocked"))
    chunks = F.transform("think_chunks", lambda c, i: view(F.concat(F.lit("chunk_mask_"), i.cast("string")), F.array_intersect(c, F.col("before"))))
    views = F.concat(F.array(view(F.lit("whole_mask"), F.col("before"))), F.filter(chunks, lambda v: F.size(v["blocked"]) > 0))
    if plain:
        views = F.concat(F.array(view(F.lit("plain"), F.array().cast("array<int>"))), views)
    full = F.aggregate("old_action_target_log_probs", F.lit(0.0), lambda a, x: a + x) / F.size("old_action_target_log_probs")
    rows = rows.select("*", F.explode(views).alias("v"), full.alias("full_score"))
    context = F.concat("visible_prompt_token_ids", F.slice("sampled_response_token_ids", 1, first))
    target = F.transform("action_target_positions", lambda p: F.get("sampled_response_token_ids", p))
    item = spans.teacher_forced(context, F.array().cast("array<int>"), target, F.col("v.blocked"))
    name = F.regexp_replace("v.view", r"chunk_mask_(\d+)", "chunk_mask:$1")
    return rows.select(F.concat_ws(":", "turn_id", name).alias("request_id"), F.col("turn_id").alias("comparison_group_id"), "turn_id", "action_type", "v.view", "full_score", item.alias("i")).select("*", "i.*").drop("i")


def cache_keys(requests: DataFrame, columns: list[str], order: str = "ordinal") -> DataFrame:
    """requests with cache_key and representative_request_id, the first of an equal key in queue order.

    The comparison group has to be among the columns: equal requests of two groups
    keep a forward of their own.
    """
    keyed = requests.withColumn("cache_key", scalars.request_key({c: F.col(c) for c in columns}))
    first = keyed.groupBy("cache_key").agg(F.min_by("request_id", order).alias("representative_request_id"))
    return keyed.join(first, "cache_key")


def unique_requests(keyed: DataFrame) -> DataFrame:
    return keyed.where("request_id = representative_request_id")


def expand_scores(keyed: DataFrame, scores: DataFrame, check: bool = True) -> DataFrame:
    """(request_id, score) of all requests from those of their representatives; raises for a missing one."""
    out = keyed.select("request_id", "representative_request_id").join(scores.select(F.col("request_id").alias("representative_request_id"), "score"), "representative_request_id", "left").select("request_id", "score")
    if check:
        checks.require_none(out.where("score is null or isnan(score)"), "a representative without a score")
    return out


def scored(requests: DataFrame, scores: DataFrame, check: bool = True) -> DataFrame:
    """requests with their score; raises where one is missing or not finite."""
    out = requests.join(scores.select("request_id", "score"), "request_id", "left")
    if check:
        checks.require_none(checks.not_finite(out, "score").select("request_id"), "a request without a finite score")
    return out


def length_buckets(requests: DataFrame) -> DataFrame:
    """(queue, comparison_group_id, width, n, tokens, position): complete groups, longest first, then by id."""
    return _buckets(requests).drop("before")


def _buckets(requests: DataFrame) -> DataFrame:
    """The groups of length_buckets with the number of requests before each, from the same scan."""
    groups = requests.groupBy("queue", "comparison_group_id").agg(F.max("length").alias("width"), F.count("*").alias("n"), F.sum("length").alias("tokens"))
    return ordinals.running(groups.withColumn("__one", F.lit(1)), ["queue"], [F.desc("width"), F.asc("comparison_group_id")], {"position": "__one", "before": "n"}).drop("__one")


#: Positions of a block, within which starts of batches are followed in one step.
BLOCK = 1024


def _exits(table: pa.Table) -> pa.Table:
    """For each position of a block the first start of a batch beyond it, if a batch starts there."""
    table = table.sort_by("position")
    position, leaves = table.column("position"), table.column("follow").to_pylist()
    first, n = position[0].as_py(), len(position)
    for i in range(n - 1, -1, -1):
        if leaves[i] - first < n:
            leaves[i] = leaves[leaves[i] - first]
    return pa.table({"queue": table.column("queue"), "position": position, "leaves": pa.array(leaves, pa.int64())})


def _walk(table: pa.Table) -> pa.Table:
    """The starts of batches in a block from the one at which it is entered."""
    table = table.sort_by("position")
    position, follow, entry = table.column("position").to_numpy(), table.column("follow").to_numpy(), table.column("entry")[0].as_py()
    first, at, starts = int(position[0]), entry, []
    while at - first < len(position):
        starts.append(at - first)
        at = int(follow[at - first])
    return table.select(["queue", "position", "follow"]).take(pa.array(starts, pa.int64()))


def pack(requests: DataFrame, token_budget: int, max_items: int | None = None, divisor: int = 1) -> DataFrame:
    """(queue, comparison_group_id, batch_id, padded_tokens): groups packed greedily, longest first, under a token budget.

    requests: queue, request_id, comparison_group_id and length.  A batch costs its
    width times its number of requests, rounded up to ``divisor``; a group is never
    split, and one that fits no batch raises.

    The widest group of a batch is its first, so where the next batch begins follows
    from the running number of requests, by a search among these.  Which groups
    begin a batch then is a walk along these links from the first group: links are
    followed within blocks of positions, and from block to block by doubling, for
    which only the positions matter at which a block can be entered.  A queue may
    have any length.
    """
    groups = _buckets(requests)
    limit = F.floor(F.lit(token_budget) / F.col("width") / divisor) * divisor
    limit = limit if max_items is None else F.least(limit, F.lit(max_items))
    groups = written(groups.withColumn("limit", F.when(F.col("width") > 0, limit).otherwise(F.lit(max_items if max_items is not None else 2**62)).cast("long")))
    checks.require_none(groups.where(F.col("n") > F.col("limit")).select("comparison_group_id"), "a group that fits no batch")
    rows = groups
    ends = rows.select("queue", (F.col("before") + F.col("n")).alias("value"), F.lit(1).alias("group"), *(F.lit(None).cast("long").alias(c) for c in ("position", "before", "width")))
    asked = rows.select("queue", (F.col("before") + F.col("limit")).alias("value"), F.lit(0).alias("group"), F.col("position").cast("long"), F.col("before").cast("long"), F.col("width").cast("long"))
    links = ordinals.running(ends.unionByName(asked), ["queue"], [F.col("value"), F.desc("group")], {"follow": "group"}).where("group = 0")
    links = written(links.select("queue", "position", F.col("follow").cast("long").alias("follow"), "before", "width").withColumn("block", F.floor(F.col("position") / BLOCK)))
    kind = links.schema["queue"].dataType.simpleString()
    jumps = written(links.select("queue", "block", "position", "follow").groupBy("queue", "block").applyInArrow(_exits, f"queue {kind}, position long, leaves long"))
    blocks = int(links.agg(F.max("block")).first()[0] or 0) + 1
    doors = jumps.select("queue", F.col("leaves").alias("position")).distinct()
    jumps = written(jumps.where("position = 0").unionByName(jumps.where("position > 0").join(doors, ["queue", "position"], "left_semi")))
    entered, levels = links.where("position = 0").select("queue", "position"), [jumps]
    for _ in range(max(0, (blocks - 1).bit_length() - 1)):
        far = jumps.select("queue", F.col("position").alias("leaves"), F.col("leaves").alias("far"))
        jumps = written(jumps.join(far, ["queue", "leaves"]).select("queue", "position", F.col("far").alias("leaves")))
        levels.append(jumps)
    for jumps in reversed(levels if blocks > 1 else []):
        there = entered.join(jumps, ["queue", "position"]).select("queue", F.col("leaves").alias("position"))
        entered = written(entered.unionByName(there))
    entered = entered.join(links.select("queue", "position"), ["queue", "position"])  # without the end of a queue
    entries = entered.select("queue", F.floor(F.col("position") / BLOCK).alias("block"), F.col("position").alias("entry"))
    walked = links.join(entries, ["queue", "block"]).select("queue", "block", "position", "follow", "entry").groupBy("queue", "block").applyInArrow(_walk, f"queue {kind}, position long, follow long")
    starts = ordinals.numbered(walked, ["queue"], ["position"], "batch_id")
    held = links.select("queue", F.col("position").alias("follow"), F.col("before").alias("after"))
    total = groups.groupBy("queue").agg(F.sum("n").alias("total"))
    starts = starts.join(links.select("queue", "position", "before", "width"), ["queue", "position"]).join(held, ["queue", "follow"], "left").join(total, "queue")
    count = F.coalesce("after", "total") - F.col("before")
    batches = starts.select("queue", F.col("batch_id").cast("int").alias("batch_id"), (F.col("width") * F.ceil(count / divisor) * divisor).cast("long").alias("padded_tokens"), F.explode(F.sequence("position", F.col("follow") - 1)).alias("position"))
    return groups.select("queue", "comparison_group_id", "position").join(batches, ["queue", "position"]).select("queue", "comparison_group_id", "batch_id", "padded_tokens")


def request_slices(requests: DataFrame, size: int, order: str = "request_id") -> DataFrame:
    """Rows with the number of the contiguous slice of ``size`` requests they fall in, within their batch."""
    rows = ordinals.numbered(requests, ["batch_id"], [order], "__at")
    return rows.withColumn("slice", F.floor(F.col("__at") / size).cast("int")).drop("__at")


def packing_cost(requests: DataFrame, packed: DataFrame) -> DataFrame:
    """item and batch counts, true, padded and padding tokens and the padding's share; raises if a request has no batch."""
    packed = written(packed.select("queue", "comparison_group_id", "batch_id", "padded_tokens"))
    groups = requests.groupBy("queue", "comparison_group_id").agg(F.min("request_id").alias("request_id"))
    checks.require_none(groups.join(packed, ["queue", "comparison_group_id"], "left_anti").select("request_id"), "a request without a batch")
    true = requests.agg(F.count("*").alias("item_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("true_token_count"))
    padded = packed.select("queue", "batch_id", "padded_tokens").distinct().agg(F.count("*").alias("forward_microbatch_count"), F.coalesce(F.sum("padded_tokens"), F.lit(0)).alias("padded_token_count"))
    both = true.join(F.broadcast(padded))  # one row each
    padding = F.col("padded_token_count") - F.col("true_token_count")
    return both.select("item_count", "forward_microbatch_count", "true_token_count", "padded_token_count", padding.alias("padding_token_count"), F.coalesce(padding / F.nullif("padded_token_count", F.lit(0)), F.lit(0.0)).alias("padding_fraction"))


def score_with(requests: DataFrame, score: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """(request_id, score) by a caller's model, applied to Arrow batches of requests."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"request_id": pdf["request_id"], "score": score(pdf)})

    return requests.mapInPandas(run, "request_id string, score double")
