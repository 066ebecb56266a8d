"""Scalar functions, as Column expressions that stay inside generated code."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.schema import EMPTY_SLOT, NEGATIVE_SCALE

ARTICLES = ("a", "an", "the")


def answer_words(text: Column) -> Column:
    """The words of a normalised answer: lower case, no ASCII punctuation, no articles.

    This is the published rule of question-answering evaluation; null has no words.
    """
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    return F.filter(F.split(bare, r"\s+"), lambda w: (w != "") & ~w.isin(*ARTICLES))


def normalize_answer(text: Column) -> Column:
    return F.array_join(answer_words(text), " ")


def match_text(text: Column) -> Column:
    """Text for comparisons of passages: lower case, single spaces."""
    return F.lower(collapse_space(text))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


#: Words of both sides that a task sorts at once, unless one pair has more.
FBETA_WORDS = 1 << 18


def _by_words(batches: Iterable[pa.RecordBatch], columns: tuple[str, ...], most: int) -> Iterator[pa.RecordBatch]:
    """Stretches of the batches' rows with at most ``most`` list entries, or of one row."""
    for batch in batches:
        size = sum(pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        end, at = np.cumsum(size), 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(end, end[at] - size[at] + most, "right")) - at)
            yield batch.slice(at, n)
            at += n


def fbeta_scores(pairs: DataFrame, key: str, prediction: str, target: str, beta: float = 0.5) -> DataFrame:
    """(key, overlap, n_prediction, n_target, fbeta) of two text columns, by counts of each word; key names a pair.

    The overlap is that of multisets: a word counts as often as on the side with
    fewer.  Both sides are split and hashed in the JVM; each pair is a row, and its
    hashes are sorted and merged within a stretch of a batch of bounded size, so no
    word is ever shuffled.
    """
    hashed = lambda c: F.transform(answer_words(F.col(c)), lambda w: F.xxhash64(w))
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in _by_words(batches, ("p", "t"), FBETA_WORDS):
            row, side, word = [], [], []
            for i, c in enumerate(("p", "t")):
                size = pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64)
                row.append(np.repeat(np.arange(len(size)), size))
                side.append(np.full(len(row[-1]), i))
                word.append(batch.column(c).flatten().to_numpy())
            row, side, word = (np.concatenate(x) for x in (row, side, word))
            n = [np.bincount(row[side == i], minlength=batch.num_rows) for i in (0, 1)]
            order = np.lexsort((word, row))
            start = np.flatnonzero(np.r_[True, (np.diff(row[order]) != 0) | (np.diff(word[order].view(np.uint64)) != 0)][: len(order)])
            both = [np.add.reduceat(side[order] == i, start, dtype=np.int64) for i in (0, 1)] if len(start) else [np.zeros(0, np.int64)] * 2
            overlap = np.bincount(row[order][start], np.minimum(*both), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(x.astype(np.int64)) for x in (overlap, *n))], [key, "overlap", "n_prediction", "n_target"])

    found = pairs.select(key, hashed(prediction).alias("p"), hashed(target).alias("t")).mapInArrow(run, f"{key} {kind}, overlap long, n_prediction long, n_target long")
    return found.withColumn("fbeta", fbeta(F.col("overlap"), F.col("n_prediction"), F.col("n_target"), beta))


def fbeta(overlap: Column, n_prediction: Column, n_target: Column, beta: float = 0.5) -> Column:
    """F-beta of a word overlap; 0 where either side or the overlap is empty."""
    p, r, b = overlap / F.nullif(n_prediction, F.lit(0)), overlap / F.nullif(n_target, F.lit(0)), beta * beta
    return F.coalesce((1 + b) * p * r / F.nullif(b * p + r, F.lit(0.0)), F.lit(0.0))


def answer_quality(binary_em: Column, best_fbeta: Column) -> Column:
    return F.when(binary_em == 1, F.lit(1.0)).otherwise(F.coalesce(best_fbeta, F.lit(0.0)))


def directed_agreement(incremental: Column, control: Column) -> Column:
    """struct(directed, conflict): the smaller of two contrasts of one sign; 0 otherwise."""
    directed = F.when((incremental > 0) & (control > 0), F.least(incremental, control)).when((incremental < 0) & (control < 0), F.greatest(incremental, control)).otherwise(0.0)
    return F.struct(directed.alias("directed"), (incremental * control < 0).alias("conflict"))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def search_utility(
    real: Column, empty: Column, controls: list[Column], delta: Column | float, scale: Column | float, *,
    valid: Column | None = None, consumable: Column | None = None, repeat: Column | None = None, negative_scale: float = NEGATIVE_SCALE,
) -> Column:
    """struct(utility, g_incremental, g_control, g_directed, conflict, scored, zero_reason).

    First of the reasons that holds: invalid_search, unconsumable_observation,
    score_unavailable; a scored turn has contrast_sign_conflict, dead_zone or
    visible_exact_repeat where its utility is zero.  A repeat takes a positive
    utility away and leaves a negative one.
    """
    delta = F.lit(delta) if isinstance(delta, int | float) else delta
    scale = F.lit(scale) if isinstance(scale, int | float) else scale
    true, false = F.lit(True), F.lit(False)
    valid, consumable, repeat = valid if valid is not None else true, consumable if consumable is not None else true, repeat if repeat is not None else false
    known = finite(real) & finite(empty)
    for c in controls:
        known = known & finite(c)
    scored = valid & consumable & known
    inc, ctl = real - empty, real - sum(controls[1:], controls[0]) / len(controls)
    agreed = directed_agreement(inc, ctl)
    d = agreed["directed"]
    force = F.tanh(F.greatest(F.abs(d) - delta, F.lit(0.0)) / scale)
    raw = F.when(d > delta, force).when(d < -delta, -negative_scale * force).otherwise(0.0)
    utility = F.when(scored, F.when(repeat & (raw > 0), 0.0).otherwise(raw)).otherwise(0.0)
    reason = (
        F.when(~valid, "invalid_search").when(~consumable, "unconsumable_observation").when(~known, "score_unavailable")
        .when(repeat & (raw > 0), "visible_exact_repeat").when((raw == 0) & agreed["conflict"], "contrast_sign_conflict").when(raw == 0, "dead_zone")
    )
    return F.struct(
        utility.alias("utility"), F.when(scored, inc).alias("g_incremental"), F.when(scored, ctl).alias("g_control"), F.when(scored, d).alias("g_directed"),
        F.when(scored, agreed["conflict"]).otherwise(False).alias("conflict"), scored.alias("scored"), reason.alias("zero_reason"),
    )


def responsibility_strength(full: Column, masked: Column, delta: Column | float, scale: Column | float) -> Column:
    return 1 - F.exp(-F.greatest(full - masked - delta, F.lit(0.0)) / scale)


def chunk_weights(full: Column, masked: Column, delta: Column | float, power: float = 2.0, precision: str = "float") -> Column:
    """Shares of relu(full - masked - delta) ** power; all 0 without mass.

    Single precision is the published one; ``precision`` may be ``double``.
    """
    d = F.lit(delta) if isinstance(delta, int | float) else delta
    cast, zero = (lambda c: c.cast(precision)), F.lit(0.0).cast(precision)
    mass = F.transform(masked, lambda m: cast(F.pow(F.greatest(cast(full - m) - cast(d), zero), F.lit(power))))
    total = F.aggregate(mass, zero, lambda a, x: cast(a + x))
    return F.transform(mass, lambda x: F.coalesce(cast(x / F.nullif(total, zero)), zero))


def route_credit(utility: Column, rho: Column, weights: Column, alpha: Column | float = 1.0) -> Column:
    """struct(action, chunks): a * U for the action and a * rho * w * U for each chunk."""
    alpha = F.lit(alpha) if isinstance(alpha, int | float) else alpha
    return F.struct((alpha * utility).alias("action"), F.transform(weights, lambda w: alpha * rho * w.cast("double") * utility).alias("chunks"))


def absolute_mass(action: Column, chunks: Column) -> Column:
    return F.abs(action) + F.aggregate(chunks, F.lit(0.0), lambda a, x: a + F.abs(x))


def near_length(anchor: Column, candidate: Column) -> Column:
    return (anchor > 0) & (candidate > 0) & (candidate / F.nullif(anchor, F.lit(0))).between(0.75, 1.25)


def exact_repeat(current: Column, visible: Column) -> Column:
    """Every non-empty passage now returned was visible before; false without one."""
    clean = lambda a: F.filter(F.transform(a, collapse_space), lambda x: x != "")
    return (F.size(clean(current)) > 0) & (F.size(F.array_except(clean(current), clean(visible))) == 0)


def document_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?is)<documents>.*?</documents>"), F.lit(0))


def document_passages(block: Column) -> Column:
    """The passages ``title\\nbody`` of a text of ``Doc N: title`` entries."""
    bare = F.regexp_replace(F.coalesce(block, F.lit("")), r"(?i)</?documents>", "")
    parts = F.split(F.concat(F.lit("\n"), bare), r"\n\s*Doc \d+:")
    bare = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(bare, lambda x: x != "")


def visible_passages(context: Column) -> Column:
    return F.flatten(F.transform(document_blocks(context), document_passages))


def observation_slot(text: Column) -> Column:
    """A trimmed observation inside <documents> tags; the empty slot for an empty one."""
    t = F.trim(F.coalesce(text, F.lit("")))
    wrapped = F.lower(t).startswith("<documents>") & F.lower(t).endswith("</documents>")
    return F.when(t == "", EMPTY_SLOT).when(wrapped, t).otherwise(F.concat(F.lit("<documents>"), t, F.lit("</documents>")))


def question_id(source: Column, split: Column, index: Column) -> Column:
    return F.concat_ws(":", F.coalesce(source, F.lit("unknown")), F.coalesce(split, F.lit("train")), F.lit("row"), index.cast("string"))


def request_key(row: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON of everything that changes a request's score.

    The comparison group is a part of it, so that no score crosses groups.
    """
    return F.sha2(F.to_json(F.struct(*(row[k].alias(k) for k in sorted(row)))), 256)


def scorer_key(row: dict[str, Column] | None = None) -> Column:
    """The key of a teacher-forced request, from its columns or those given: equal keys have one score.

    Of the input only what stands before the target counts, as the target is a field of its own.
    """
    names = ("actor_snapshot_id", "comparison_group_id", "attention_mask", "position_ids", "target_ids", "target_positions", "predictor_positions", "blocked_key_positions", "probe_version")
    given = {n: F.col(n) for n in (*names, "input_ids")} | (row or {})
    prefix = F.slice(given["input_ids"], F.lit(1), F.coalesce(F.get(given["target_positions"], F.lit(0)), F.lit(0)))
    return request_key({n: given[n] for n in names} | {"prefix_ids": prefix})


def effective_lambda(lambda_max: Column | float, step: Column, warmup: int = 30) -> Column:
    return F.lit(lambda_max) * (F.lit(1.0) if warmup == 0 else F.least(step / warmup, F.lit(1.0)))


def token_length(text: Column) -> Column:
    """Words, where no tokenizer's length is supplied."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def call_bucket(turn_index: Column) -> Column:
    return F.when(turn_index == 0, "1").otherwise("2+")


def document_signature(passages: Column) -> Column:
    return F.array_sort(F.transform(passages, match_text))


def aliases_of(env: Column, reward: Column) -> Column:
    """Accepted answers: the environment's ground truth, else the reward model's."""
    return F.coalesce(env, reward, F.array().cast("array<string>"))


def hash_order(*parts: Column | str) -> Column:
    """The order of a stable sample: hexadecimal SHA-256 of the parts joined by bars."""
    return F.sha2(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256)
