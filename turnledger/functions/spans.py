"""Array and span functions over token positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.schema import CHANNELS, MAX_CHUNKS


def positions(mask: Column) -> Column:
    """Where a mask is set, from 0."""
    return F.filter(F.sequence(F.lit(0), F.size(mask)), lambda i: (i < F.size(mask)) & F.coalesce(F.get(mask, i) != 0, F.lit(False)))


def masked(values: Column, mask: Column) -> Column:
    """The values where a mask of equal length is set."""
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["v"])


def contiguous(values: Column) -> Column:
    """Non-empty, and each one more than the last."""
    return F.when(F.size(values) > 0, values == F.sequence(F.get(values, F.lit(0)), F.greatest(F.get(values, F.lit(0)), F.element_at(values, -1)))).otherwise(False)


def split_positions(target: Column, tag: Column) -> Column:
    """struct(boundary, content): target positions inside tags, and the others, sorted."""
    return F.struct(F.array_sort(F.array_intersect(target, tag)).alias("boundary"), F.array_sort(F.array_except(target, tag)).alias("content"))


def teacher_forced(context: Column, prefix: Column, target: Column, blocked: Column) -> Column:
    """struct of a forced request: the joined input and the positions of its target."""
    start = F.size(context) + F.size(prefix)
    n = start + F.size(target)
    where = F.sequence(start, n - 1)
    return F.struct(
        F.concat(context, prefix, target).alias("input_ids"), F.array_repeat(F.lit(1), n).alias("attention_mask"), F.sequence(F.lit(0), n - 1).alias("position_ids"), target.alias("target_ids"),
        where.alias("target_positions"), F.transform(where, lambda i: i - 1).alias("predictor_positions"), F.array_sort(F.array_distinct(blocked)).alias("blocked_key_positions"),
    )


def request_problem(context: Column, prefix: Column, target: Column, blocked: Column, max_tokens: int = 8192) -> Column:
    """Why a forced request can't be scored; null if it can."""
    start = F.size(context) + F.size(prefix)
    return (
        F.when(F.size(target) == 0, "empty_target").when(start + F.size(target) > max_tokens, "score_context_overflow")
        .when(start == 0, "no_causal_predecessor").when(F.exists(blocked, lambda b: (b < 0) | (b >= start)), "blocked_outside_prefix")
    )


def barrier_runs(mask: Column, blocked: Column) -> Column:
    """array<struct<first,last,blocked>>: the barrier as runs of valid positions that are all blocked or all not.

    A position reads itself and what comes before it: all valid positions if it is
    blocked, else those that aren't.  Runs are as many as blocked spans and gaps of
    the mask, not as positions, and answer for every cell of the square mask.
    """
    kind = lambda i: F.when(F.coalesce(F.get(mask, i) != 0, F.lit(False)), F.array_contains(blocked, i).cast("int")).otherwise(-1)
    run = lambda s, last: F.array(F.named_struct(F.lit("first"), s["first"], F.lit("last"), last.cast("int"), F.lit("blocked"), s["kind"] == 1))

    def step(s: Column, i: Column) -> Column:
        now = kind(i)
        ends = (now != s["kind"]) & (s["kind"] >= 0)
        return F.struct(F.when(ends, F.concat(s["runs"], run(s, i - 1))).otherwise(s["runs"]).alias("runs"), F.when(now != s["kind"], i).otherwise(s["first"]).alias("first"), now.alias("kind"))

    n = F.size(mask)
    start = F.struct(F.array().cast("array<struct<first:int,last:int,blocked:boolean>>").alias("runs"), F.lit(0).alias("first"), F.lit(-1).alias("kind"))
    places = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda s: F.when(s["kind"] >= 0, F.concat(s["runs"], run(s, n - 1))).otherwise(s["runs"]))


def barrier_ranges(runs: Column, q: Column) -> Column:
    """array<struct<first,last>>: what position q may read; nothing for one that isn't valid."""
    own = F.filter(runs, lambda r: (r["first"] <= q) & (r["last"] >= q))
    seen = F.filter(runs, lambda r: (F.size(own) > 0) & (r["first"] <= q) & (F.get(own, F.lit(0))["blocked"] | ~r["blocked"]))
    return F.transform(seen, lambda r: F.named_struct(F.lit("first"), r["first"], F.lit("last"), F.least(r["last"], q)))


def barrier_sums(runs: Column) -> Column:
    """struct(pairs, q, k): how many cells are allowed, and the sums of their query and key positions, in one pass over the runs."""
    long = lambda c: c.cast("long")
    half = lambda x: F.shiftright(x, 1)
    sixth = lambda x: F.call_function("div", x, F.lit(6))

    def step(s: Column, r: Column) -> Column:
        a, m = long(r["first"]), long(r["last"] - r["first"] + 1)
        c, t = F.when(r["blocked"], s["n"]).otherwise(s["open_n"]), F.when(r["blocked"], s["t"]).otherwise(s["open_t"])
        own = m * a + half(m * (m - 1))
        pairs = m * c + half(m * (m + 1))
        q = m * a * (c + 1) + (a + c + 1) * half(m * (m - 1)) + sixth((m - 1) * m * (2 * m - 1))
        k = m * t + a * half(m * (m + 1)) + sixth((m - 1) * m * (m + 1))
        return F.struct(
            (s["n"] + m).alias("n"), (s["t"] + own).alias("t"), F.when(r["blocked"], s["open_n"]).otherwise(s["open_n"] + m).alias("open_n"), F.when(r["blocked"], s["open_t"]).otherwise(s["open_t"] + own).alias("open_t"),
            (s["pairs"] + pairs).alias("pairs"), (s["q"] + q).alias("q"), (s["k"] + k).alias("k"),
        )

    zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("n", "t", "open_n", "open_t", "pairs", "q", "k")))
    return F.aggregate(runs, zero, step, lambda s: F.struct(s["pairs"].alias("pairs"), s["q"].alias("q"), s["k"].alias("k")))


def information_barrier(requests: DataFrame) -> DataFrame:
    """(request_id, q, k): the pairs in which position q may look at k, in long form.

    Only allowed pairs are made, from the runs; they grow with the square of a
    request, so take barrier_sums and barrier_ranges where the pairs aren't wanted.
    """
    rows = requests.select("request_id", barrier_runs(F.col("attention_mask"), F.col("blocked_key_positions")).alias("runs"), F.explode(F.sequence(F.lit(0), F.size("attention_mask") - 1)).alias("q"))
    rows = rows.select("request_id", "q", F.explode(barrier_ranges(F.col("runs"), F.col("q"))).alias("r"))
    return rows.select("request_id", "q", F.explode(F.sequence("r.first", "r.last")).alias("k"))


def additive_mask(allowed: Column) -> Column:
    return F.when(allowed, F.lit(0.0)).otherwise(F.lit(float("-inf")))


def pad_right(values: Column, width: Column, fill: Column | int) -> Column:
    fill = F.lit(fill) if isinstance(fill, int) else fill
    return F.concat(values, F.array_repeat(fill, F.greatest(width - F.size(values), F.lit(0))))


def pad_batches(requests: DataFrame, batch: str = "batch_id", pad_token: int = 0) -> DataFrame:
    """Requests of a batch padded on the right to its widest; each stays a row."""
    w = Window.partitionBy(batch)
    width, targets = F.max(F.size("input_ids")).over(w), F.max(F.size("target_ids")).over(w)
    rows = requests.withColumn("width", width).withColumn("target_width", targets)
    return rows.select(
        batch, "request_id", pad_right(F.col("input_ids"), F.col("width"), pad_token).alias("input_ids"), pad_right(F.col("attention_mask"), F.col("width"), 0).alias("attention_mask"),
        pad_right(F.col("position_ids"), F.col("width"), F.element_at("position_ids", -1)).alias("position_ids"), pad_right(F.col("target_ids"), F.col("target_width"), pad_token).alias("target_ids"),
        pad_right(F.transform("target_ids", lambda _: F.lit(1)), F.col("target_width"), 0).alias("target_mask"), pad_right(F.col("predictor_positions"), F.col("target_width"), 0).alias("predictor_positions"),
        F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.array_contains("blocked_key_positions", i).cast("int")).alias("blocked_mask"),
    )


def masked_mean(values: Column, mask: Column) -> Column:
    total = F.aggregate(F.zip_with(values, mask, lambda v, m: v * m), F.lit(0.0), lambda a, x: a + x)
    return total / F.nullif(F.aggregate(mask, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def credit_spans(credits: DataFrame) -> DataFrame:
    """(batch_row_index, trajectory_id, slot, channel, coefficient, positions): slot 0 the action, 1 to 6 the chunks.

    Spans without positions don't occur.
    """
    kind = F.col("action_type")
    action = F.struct(F.lit(0).alias("slot"), F.when(kind == "search", CHANNELS["search_action"]).when(kind == "answer", CHANNELS["answer_action"]).alias("channel"), F.col("action_coefficient").cast("float").alias("coefficient"), F.col("action_positions").alias("positions"))
    think = F.transform(
        F.arrays_zip(F.col("think_chunk_positions").alias("p"), F.col("think_chunk_coefficients").alias("c")),
        lambda x, i: F.struct((i + 1).alias("slot"), F.when(kind == "search", CHANNELS["search_think"]).when(kind == "answer", CHANNELS["answer_think"]).alias("channel"), x["c"].cast("float").alias("coefficient"), x["p"].alias("positions")),
    )
    rows = credits.where(kind.isin("search", "answer")).select("batch_row_index", "trajectory_id", F.explode(F.concat(F.array(action), think)).alias("s"))
    return rows.select("batch_row_index", "trajectory_id", "s.*").where((F.size("positions") > 0) & (F.col("slot") <= MAX_CHUNKS))


def span_overlaps(spans: DataFrame) -> DataFrame:
    """(batch_row_index, position, n): positions that more than one span of a row covers."""
    return spans.select("batch_row_index", F.explode("positions").alias("position")).groupBy("batch_row_index", "position").agg(F.count("*").alias("n")).where("n > 1")


def spans_outside(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """Spans that leave the valid response; lengths: batch_row_index and n_valid."""
    return spans.join(lengths, "batch_row_index").where((F.array_min("positions") < 0) | (F.array_max("positions") >= F.col("n_valid")))


def split_by_offsets(ids: Column, starts: Column, ends: Column, cut: Column) -> Column:
    """struct(prefix, target, crossing) of tokens about a character: those that end by it, those that start at it or later.

    crossing says that a token lies on both sides, so that the text can't be
    split there; such a token is in neither part.
    """
    tokens = F.arrays_zip(ids.alias("i"), starts.alias("s"), ends.alias("e"))
    part = lambda keep: F.transform(F.filter(tokens, keep), lambda t: t["i"])
    return F.struct(part(lambda t: t["e"] <= cut).alias("prefix"), part(lambda t: t["s"] >= cut).alias("target"), F.exists(tokens, lambda t: (t["s"] < cut) & (t["e"] > cut)).alias("crossing"))
