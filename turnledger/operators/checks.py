"""Checks that give the offending rows, and one that raises for them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnledger.functions.scalars import finite

#: Evidence fields that may not enter, and beginnings of such names.
FORBIDDEN = frozenset("metadata metadata_json context supporting_facts supporting_fact support_hit support_hits new_fact new_facts new_doc new_docs doc_only privileged_prefix gold_evidence".split())
FORBIDDEN_PREFIXES = ("new_fact_", "new_doc_", "new_support_", "supporting_fact_", "support_hit_", "doc_only_")


class CheckFailed(ValueError):
    pass


def require_none(bad: DataFrame, what: str, show: int = 5) -> None:
    """Raises with a few rows of an offence; the search stops at the first ones."""
    if rows := bad.limit(show).collect():
        raise CheckFailed(f"{what}: {', '.join(map(str, rows))}")


def forbidden_paths(kind: T.DataType, path: tuple[str, ...] = ()) -> list[str]:
    """Paths of forbidden names at any depth of a schema, sorted."""
    if isinstance(kind, T.StructType):
        found = []
        for f in kind.fields:
            here = (*path, f.name)
            if f.name.lower() in FORBIDDEN or f.name.lower().startswith(FORBIDDEN_PREFIXES):
                found.append(".".join(here))
            found += forbidden_paths(f.dataType, here)
        return sorted(set(found))
    if isinstance(kind, T.ArrayType):
        return forbidden_paths(kind.elementType, (*path, "element"))
    if isinstance(kind, T.MapType):
        return sorted({*forbidden_paths(kind.keyType, (*path, "key")), *forbidden_paths(kind.valueType, (*path, "value"))})
    return []


def require_allowed(df: DataFrame) -> DataFrame:
    if found := forbidden_paths(df.schema):
        raise CheckFailed(f"evidence fields: {', '.join(found)}")
    return df


def forbidden_keys(df: DataFrame, column: str) -> DataFrame:
    """(key): forbidden names among the keys of a map column, distinct."""
    key = F.lower("key")
    bad = key.isin(*FORBIDDEN)
    for p in FORBIDDEN_PREFIXES:
        bad = bad | key.startswith(p)
    return df.select(F.explode(F.map_keys(column)).alias("key")).where(bad).distinct()


def _forbidden(name: str) -> bool:
    return name.lower() in FORBIDDEN or name.lower().startswith(FORBIDDEN_PREFIXES)


def forbidden_document_paths(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path): paths of forbidden names at any depth of JSON documents, each once a document; items of lists are ``element``.

    key names a document; null documents and plain values have none, text that isn't
    JSON raises.
    """
    kind = df.schema[key].dataType.simpleString()

    def walk(value, path: tuple[str, ...]) -> Iterator[str]:
        for name, inner in value.items() if isinstance(value, dict) else [("element", x) for x in value] if isinstance(value, list) else ():
            if isinstance(value, dict) and _forbidden(name):
                yield ".".join((*path, name))
            yield from walk(inner, (*path, name))

    def run(batches):
        for batch in batches:
            found = [sorted(set(walk(json.loads(t), ()))) if t is not None else [] for t in batch.column("document").to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), pa.array([p for f in found for p in f], pa.string())], [key, "path"])

    return df.select(key, F.col(column).alias("document")).mapInArrow(run, f"{key} {kind}, path string")


def drop_evidence(df: DataFrame, *columns: str) -> DataFrame:
    return require_allowed(df.drop(*(columns or ("metadata",))))


def require_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Each column is there with the type, of a struct at least the named fields."""
    have = dict(df.dtypes)
    for name, kind in columns.items():
        if name not in have:
            raise CheckFailed(f"no column {name}")
        if not have[name].startswith(kind):
            raise CheckFailed(f"{name} is {have[name]}, not {kind}")
    return df


def not_split(df: DataFrame, split: str = "train") -> DataFrame:
    return df.where(~F.col("extra_info.split").eqNullSafe(split))


def not_finite(df: DataFrame, *columns: str) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | ~finite(F.col(c).cast("double"))
    return df.where(bad)


def not_binary(df: DataFrame, column: str = "terminal_binary_em") -> DataFrame:
    value = F.col(column).cast("double")
    return df.where(value.isNull() | ~value.isin(0.0, 1.0))


def group_questions(rows: DataFrame) -> DataFrame:
    """Groups that hold more than one question."""
    return rows.groupBy("uid").agg(F.min("question_id").alias("first"), F.max("question_id").alias("last")).where("first <> last")


def duplicate_turns(turns: DataFrame) -> DataFrame:
    return originals(turns).groupBy("turn_id").count().where("count > 1")


def mixed_outcomes(turns: DataFrame) -> DataFrame:
    return originals(turns).groupBy("trajectory_id").agg(F.min("terminal_binary_em").alias("low"), F.max("terminal_binary_em").alias("high")).where("low <> high")


def group_sizes(turns: DataFrame, rollouts: int) -> DataFrame:
    """Groups whose number of trajectories isn't ``rollouts``."""
    return originals(turns).select("rollout_group_id", "trajectory_id").distinct().groupBy("rollout_group_id").count().where(F.col("count") != rollouts)


def originals(turns: DataFrame) -> DataFrame:
    """Turns that aren't copies added to fill a batch."""
    return turns.where(~F.coalesce(F.col("is_adjustment_copy"), F.lit(False)))


def shared_rows(batches: DataFrame, key: list[str], batch: str = "batch_index") -> DataFrame:
    """Keys that occur in more than one batch."""
    return batches.groupBy(*key).agg(F.min(batch).alias("first"), F.max(batch).alias("last")).where("first <> last")


def not_contained(part: DataFrame, whole: DataFrame, key: list[str]) -> DataFrame:
    return part.select(*key).join(whole.select(*key), key, "left_anti")


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().where("count > 1")


def unbalanced(df: DataFrame, each: int, by: str = "data_source") -> DataFrame:
    return df.groupBy(by).count().where(F.col("count") != each)


def over_budget(mass: DataFrame, budget: float, slack: float = 1e-6) -> DataFrame:
    return mass.where(F.col("mass") > budget + slack)


def outcome_joined(turns: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Each turn with its trajectory's raw 0/1 outcome; a shaped reward stays apart.  Raises for a missing or another outcome."""
    out = turns.join(outcomes.select("traj_uid", F.col("outcome").cast("double").alias("terminal_binary_em")), "traj_uid", "left")
    require_none(not_binary(out).select("traj_uid"), "an outcome other than 0 or 1")
    return out
