"""Rows for the registered queries, made from whole test tables, and the same rows in SQL.

None of the tables holds rollouts, so other columns stand for theirs.  Each pair
of a function and a string gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def answers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.select(F.col("doc_id").cast("string").alias("trajectory_id"), F.col("source").alias("rollout_group_id"), F.col("quality").alias("binary_em"), (F.col("toxic") == 0).alias("valid_terminal_answer"), F.when(F.col("quality") == 1, 1.0).otherwise(F.col("n_chars") % 97 / 97.0).alias("quality"))


ANSWERS = """SELECT CAST(doc_id AS VARCHAR) AS trajectory_id, source AS rollout_group_id, quality AS binary_em, toxic = 0 AS valid_terminal_answer,
  CASE WHEN quality = 1 THEN 1.0 ELSE (n_chars % 97) / 97.0 END::DOUBLE AS q FROM documents JOIN labels USING (doc_id)"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    """A conversation as a trajectory, its first turn's length as the question."""
    n = F.length("text")
    rows = table(spark, d, "conversations").select(
        F.lit(1).alias("global_step"), (F.col("conv_id") * 100 + F.col("turn")).alias("batch_row_index"), ((F.col("conv_id") + F.col("turn")) % 11 == 0).alias("is_adjustment_copy"), (F.col("conv_id") % 20).cast("string").alias("question_id"),
        F.concat(F.lit("g"), (F.col("conv_id") % 20).cast("string")).alias("rollout_group_id"), F.col("conv_id").cast("string").alias("trajectory_id"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("turn_id"),
        F.col("turn").cast("int").alias("turn_index"), F.when(F.col("role") == "assistant", "search").when(F.col("role") == "user", "answer").otherwise("other").alias("action_type"), (n % 13 != 0).alias("valid_action"), (F.col("turn") % 3 != 2).alias("observation_consumable"),
        ((n % 41) / 20.0 - 1).alias("utility"), (n % 3).cast("int").alias("chunks_n"), "text", (F.col("conv_id") % 2).cast("int").alias("terminal_binary_em"),
    )
    return rows


TURNS = """SELECT 1 AS global_step, conv_id * 100 + turn AS batch_row_index, (conv_id + turn) % 11 = 0 AS is_adjustment_copy, CAST(conv_id % 20 AS VARCHAR) AS question_id,
  'g' || CAST(conv_id % 20 AS VARCHAR) AS rollout_group_id, CAST(conv_id AS VARCHAR) AS trajectory_id, CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS turn_id, CAST(turn AS INTEGER) AS turn_index,
  CASE role WHEN 'assistant' THEN 'search' WHEN 'user' THEN 'answer' ELSE 'other' END AS action_type, length(text) % 13 <> 0 AS valid_action, turn % 3 <> 2 AS observation_consumable,
  (length(text) % 41) / 20.0::DOUBLE - 1 AS utility, CAST(length(text) % 3 AS INTEGER) AS chunks_n, text, CAST(conv_id % 2 AS INTEGER) AS terminal_binary_em FROM conversations"""


def pool(spark: SparkSession, d: str) -> DataFrame:
    """Documents as observations; every thousand ids a step."""
    return table(spark, d, "documents").select(
        F.floor(F.col("doc_id") / 1000).cast("int").alias("global_step"), F.col("doc_id").cast("string").alias("observation_id"), (F.col("doc_id") % 7).cast("string").alias("question_id"), F.col("source").alias("data_source"), F.col("lang").alias("call_bucket"),
        F.col("text").alias("serialized_observation"), F.col("n_chars").cast("int").alias("token_length"), (1 + F.col("n_chars") % 5).cast("int").alias("document_count"), F.array().cast("array<string>").alias("document_signature"), (F.col("doc_id") % 17 != 0).alias("valid"), "doc_id",
    )


POOL = """SELECT doc_id // 1000 AS global_step, CAST(doc_id AS VARCHAR) AS observation_id, doc_id % 7 AS question_id, source AS data_source, lang AS call_bucket, text, n_chars AS token_length,
  1 + n_chars % 5 AS document_count, doc_id % 17 <> 0 AS valid, doc_id FROM documents"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Ten events as a turn: five views for each of two aliases."""
    e = F.col("event_id")
    view = F.array(*(F.lit(v) for v in ("real", "empty", "control_0", "control_1", "control_2")))
    return table(spark, d, "events").select(F.concat(F.lit("r"), e.cast("string")).alias("request_id"), F.floor(e / 10).cast("string").alias("turn_id"), F.get(view, (e % 5).cast("int")).alias("view"), (e / 5 % 2).cast("int").alias("alias_index"), (F.col("value") / 100).alias("score"), (e % 70 == 0).alias("repeat"))


SCORES = """SELECT 'r' || CAST(event_id AS VARCHAR) AS request_id, CAST(event_id // 10 AS VARCHAR) AS turn_id, ['real', 'empty', 'control_0', 'control_1', 'control_2'][event_id % 5 + 1] AS view,
  CAST((event_id // 5) % 2 AS INTEGER) AS alias_index, value / 100 AS score FROM events"""


def masked(spark: SparkSession, d: str) -> DataFrame:
    """Eight events as a turn: the full score, the whole mask, and six chunks."""
    rows = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 8).alias("g")).agg(F.sort_array(F.collect_list(F.struct("event_id", (F.col("value") / 200).alias("v")))).alias("a")).where(F.size("a") == 8)
    at = lambda i: F.get("a", F.lit(i))["v"]
    return rows.select(F.col("g").cast("string").alias("turn_id"), at(0).alias("full_score"), at(1).alias("whole_masked"), F.array(*(at(i) for i in range(2, 8))).alias("chunk_masked"))


MASKED = """SELECT CAST(event_id // 8 AS VARCHAR) AS turn_id, max(CASE WHEN event_id % 8 = 0 THEN value / 200 END) AS full_score, max(CASE WHEN event_id % 8 = 1 THEN value / 200 END) AS whole_masked,
  list(value / 200 ORDER BY event_id) FILTER (WHERE event_id % 8 > 1) AS chunk_masked FROM events GROUP BY event_id // 8 HAVING count(*) = 8"""


def calibration(spark: SparkSession, d: str) -> DataFrame:
    e, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    return table(spark, d, "events").select(
        "event_id", F.col("event_type").alias("kind"), (u % 10).cast("int").alias("batch"), (v / 100).alias("control_0"), (u % 50 / 100.0).alias("control_1"), (e % 9 == 0).alias("used_replacement"), (v / 100 - 1).alias("g_directed"), (e % 100 / 10000.0).alias("difference"),
        F.when(e % 2 == 0, "search").otherwise("answer").alias("action_type"), (v / 100).alias("old_full"), (v / 100 + e % 7 / 10000.0).alias("plain"), (u % 10 / 10.0).alias("whole_masked"), F.lit(0.001).alias("repeat_error"), (v + 1).alias("global_norm"), (u + 1).cast("double").alias("local_norm"),
    )


CALIBRATION = """SELECT event_id, event_type AS kind, CAST(user_id % 10 AS INTEGER) AS batch, value / 100 AS control_0, (user_id % 50) / 100.0::DOUBLE AS control_1, event_id % 9 = 0 AS used_replacement, value / 100 - 1 AS g_directed, (event_id % 100) / 10000.0::DOUBLE AS difference,
  CASE WHEN event_id % 2 = 0 THEN 'search' ELSE 'answer' END AS action_type, value / 100 AS old_full, value / 100 + (event_id % 7) / 10000.0::DOUBLE AS plain, (user_id % 10) / 10.0::DOUBLE AS whole_masked, 0.001::DOUBLE AS repeat_error, value + 1 AS global_norm, CAST(user_id + 1 AS DOUBLE) AS local_norm FROM events"""


def sampled(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as sampled tokens: half of a turn's words as thinking, half as an action of its role, in four forms.

    Tags are one token or three, the end of the action is one with its last word, or it lacks.
    """
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", w.alias("w"), F.when(F.col("role") == "assistant", "search").when(F.col("role") == "user", "answer").otherwise("other").alias("kind"), ((F.col("conv_id") * 7 + F.col("turn")) % 4).cast("int").alias("form"))
    n = F.size("w")
    half, form, kind = F.floor(n / 2).cast("int"), F.col("form"), F.col("kind")
    tag = lambda name, end="": F.when(form == 1, F.array(F.lit(f"<{end}"), name, F.lit(">"))).otherwise(F.array(F.concat(F.lit(f"<{end}"), name, F.lit(">"))))
    word = lambda a: F.transform(a, lambda x: F.concat(x, F.lit(" ")))
    first, second = F.slice("w", F.lit(1), half), F.slice("w", half + 1, n - half)
    last = F.concat(F.element_at("w", F.when(n > 0, F.lit(-1))), F.lit("</"), kind, F.lit(">"))
    merged = F.concat(word(F.slice(second, F.lit(1), n - half - 1)), F.array(last))
    act = F.when(form == 3, word(second)).when((form == 2) & (n > 0), merged).otherwise(F.concat(word(second), tag(kind, "/")))
    pieces = F.when(kind == "other", word(F.col("w"))).otherwise(F.concat(tag(F.lit("think")), word(first), tag(F.lit("think"), "/"), tag(kind), act))
    return rows.select("conv_id", "turn", "kind", "form", pieces.alias("response_pieces"))


SAMPLED = r"""SELECT conv_id, turn, kind, form, w, n, k, n - k AS m, t, 3 * t + k AS first FROM (
  SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'search' WHEN 'user' THEN 'answer' ELSE 'other' END AS kind, (conv_id * 7 + turn) % 4 AS form, w, len(w) AS n, len(w) // 2 AS k, CASE (conv_id * 7 + turn) % 4 WHEN 1 THEN 3 ELSE 1 END AS t
  FROM (SELECT *, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations))"""
