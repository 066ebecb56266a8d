"""Documents, manifests and their hashes."""

from __future__ import annotations

import hashlib
import json
import math
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger import schema
from turnledger.operators import calibration, checks
from turnledger.operators.checks import CheckFailed
from turnledger.sources.tables import file_hashes

# Fixed values of the method's documents: what a resolved document pins, by path.
PINNED = {
    "artifact": "urcr_v4_resolved_method",
    "schema_version": 1,
    "method_revision": schema.REVISION,
    "frozen": True,
    "search_utility.control_count": schema.CONTROL_COUNT,
    "search_utility.negative_scale": schema.NEGATIVE_SCALE,
    "search_utility.group_whitening": False,
    "answer_utility.beta": 0.5,
    "answer_utility.std_normalization": False,
    "answer_utility.residual_group": "rollout_group_id_and_binary_em",
    "responsibility.probe_template_version": schema.PROBE_VERSION,
    "responsibility.targets": "actual_sampled_action_content",
    "responsibility.intervention": "position_preserving_outgoing_information_barrier",
    "responsibility.mapping": "positive_exponential",
    "chunks.power": 2.0,
    "chunks.max_chunks": schema.MAX_CHUNKS,
    "chunks.no_mass": "zero",
    "chunks.whole_think_fallback": False,
    "credit.alpha_query": 1.0,
    "credit.alpha_answer": schema.ANSWER_ALPHA,
    "credit.lambda_think_query": 1.0,
    "credit.lambda_think_answer": 1.0,
    "credit.search_trajectory_absolute_cap": schema.SEARCH_CAP,
    "credit.query_think_split": False,
    "metadata.online_pipeline": False,
    "metadata.credit_enabled": False,
    "metadata.diagnostics": "offline_sidecar_only",
    "local_objective.surrogate": "signed_tokenwise_ppo",
    "local_objective.span_reduction": "mean_once",
    "local_objective.population_denominator": "original_trajectories",
    "local_objective.same_actor_forward_for_training": True,
    "local_objective.warmup_outer_steps": 30,
    "scorer.micro_batch_size_per_gpu": 32,
    "scorer.rollout_temperature": 1.0,
}
# The numbers that a document has to give: whether they must be over zero, and their ceiling.
NUMBERS = {
    "search_utility.delta": (False, None),
    "search_utility.scale": (True, None),
    "responsibility.search.delta": (False, None),
    "responsibility.search.scale": (True, None),
    "responsibility.answer.delta": (False, None),
    "responsibility.answer.scale": (True, None),
    "local_objective.lambda_max": (True, 0.2),
}
# The metrics of a training step that have to be finite.
HEALTH = (
    "actor/pg_loss",
    "actor/grad_norm",
    "actor/lr",
    "actor/entropy_loss",
    "actor/kl_loss",
    "urcr_v4/effective_local_loss",
    "urcr_v4/lambda_effective",
    "urcr_v4/original_trajectory_count",
    "urcr_v4/pipeline_seconds",
)
# What a batch's calibration document pins.
BATCH = {
    "artifact": "urcr_v4_s150_frozen_calibration",
    "pass": True,
    "temperature": 1.0,
    "world_size": 4,
    "scorer_micro_batch_size_per_gpu": 32,
}


def document_hash(value: dict) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def at_path(document: dict, path: str):
    """The value at a dotted path; None where a part is missing."""
    for part in path.split("."):
        document = document.get(part) if isinstance(document, dict) else None
    return document


def _number(x) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x)


def method_faults(document: dict) -> list[str]:
    """The paths of a resolved method document with another value than pinned, a number out of range, a legacy switch that is on, or metadata beyond the pinned."""
    out = []
    for path, want in PINNED.items():
        have = at_path(document, path)
        if isinstance(want, bool):
            wrong = have is not want
        else:
            wrong = have != want or (not isinstance(want, str) and not _number(have))
        out += [path] * wrong
    for path, (positive, most) in NUMBERS.items():
        x = at_path(document, path)
        out += [path] * (not _number(x) or (positive and x <= 0) or (most is not None and x > most))
    legacy = document.get("legacy")
    out += [f"legacy.{k}" for k, v in legacy.items() if v is not False and v is not None] if isinstance(legacy, dict) else ["legacy"]
    extra = set(document.get("metadata") or {}) - {p.removeprefix("metadata.") for p in PINNED if p.startswith("metadata.")}
    return out + [f"metadata.{k}" for k in sorted(extra)]


def validate_method(document: dict) -> dict[str, float]:
    """The numbers of a resolved method document, by path, with the warmup steps; raises at a fault."""
    if faults := method_faults(document):
        raise CheckFailed(f"the method document is wrong at {', '.join(faults)}")
    return {p: float(at_path(document, p)) for p in (*NUMBERS, "local_objective.warmup_outer_steps")}


def method_findings(documents: DataFrame, key: str = "document_id", text: str = "document") -> DataFrame:
    """(key, path, value) of what is wrong with the pinned values and the numbers of a column of JSON documents; value is the JSON found, null if missing."""
    checked = []
    for path in dict.fromkeys((*PINNED, *NUMBERS)):
        have = F.get_json_object(text, f"$.{path}")
        number = have.try_cast("double")
        bad = F.lit(False)
        if path in PINNED:
            want = PINNED[path]
            same = have == F.lit(str(want).lower() if isinstance(want, bool) else want) if isinstance(want, bool | str) else number == F.lit(float(want))
            bad = ~F.coalesce(same, F.lit(False))
        if path in NUMBERS:
            positive, most = NUMBERS[path]
            fine = F.abs(number) < F.lit(math.inf)
            fine = fine & (number > 0) if positive else fine
            fine = fine & (number <= most) if most is not None else fine
            bad = bad | ~F.coalesce(fine, F.lit(False))
        checked.append(F.when(bad, F.struct(F.lit(path).alias("path"), have.alias("value"))))
    found = documents.select(key, F.explode(F.filter(F.array(*checked), lambda x: x.isNotNull())).alias("f"))
    return found.select(key, "f.path", "f.value")


def resolved_document(numbers: dict[str, float]) -> dict:
    """The nested document of the pinned values and the numbers, by path, with no legacy switch on."""
    out: dict = {"legacy": {}}
    for path, value in (PINNED | {p: numbers[p] for p in NUMBERS}).items():
        *head, last = path.split(".")
        at = out
        for part in head:
            at = at.setdefault(part, {})
        at[last] = value
    return out


def safe_relative(path: str) -> str:
    """A relative path that doesn't leave its folder."""
    p = PurePosixPath(path)
    if p.is_absolute() or ".." in p.parts or not p.parts:
        raise CheckFailed(f"{path!r} leaves the folder")
    return str(p)


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark's readers name it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(found).toString()


def verify_manifest(spark: SparkSession, root: str, manifest: dict, manifest_sha256: str | None = None) -> DataFrame:
    """(path, sha256) of the files that a manifest lists, all found with their hashes.

    manifest: {"files": {relative path: sha256}}.
    """
    if manifest_sha256 is not None and document_hash(manifest) != manifest_sha256:
        raise CheckFailed("the manifest isn't the recorded one")
    listed = {safe_relative(p): h for p, h in manifest["files"].items()}
    want = spark.createDataFrame(sorted(listed.items()), "path string, want string")
    have = file_hashes(spark, *(f"{root}/{p}" for p in listed))
    name = F.substring("path", F.lit(len(qualified(spark, root)) + 2), F.length("path"))  # relative to the root, and to no folder of the same end
    have = have.select(name.alias("path"), "sha256")
    checks.require_none(want.join(have.withColumnRenamed("sha256", "want"), ["path", "want"], "left_anti"), "a file with another hash")
    return have


def health_findings(metrics: DataFrame, trajectories: int) -> DataFrame:
    """(global_step, metric, finding) of training steps that aren't healthy; metrics: (global_step, metric, value).

    Every metric of HEALTH has to be there once and finite, the gradient and the
    local weight over zero, the learning rate not under zero and after the first
    step over it, and the trajectories as many as expected.  Other metrics are ignored.
    """
    own = lambda m: F.when(F.col("metric") == m, F.col("value"))
    cells = [c for i, m in enumerate(HEALTH) for c in (F.count_if(F.col("metric") == m).alias(f"n{i}"), F.max(own(m)).cast("double").alias(f"x{i}"))]
    steps = metrics.groupBy("global_step").agg(*cells)  # a step is a row, as there are few metrics
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"n{i}").alias("n"), F.col(f"x{i}").alias("x")) for i, m in enumerate(HEALTH)))).alias("c")
    rows = steps.select("global_step", each).select("global_step", "c.*")
    x, m = F.col("x"), F.col("metric")
    finding = F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "not_scalar").when(x.isNull() | F.isnan("x") | (F.abs("x") == F.lit(math.inf)), "not_finite")
    finding = finding.when(m.isin("actor/grad_norm", "urcr_v4/lambda_effective") & (x <= 0), "not_positive")
    finding = finding.when((m == "actor/lr") & ((x < 0) | (F.col("global_step") > 1) & (x <= 0)), "not_positive")
    finding = finding.when((m == "urcr_v4/original_trajectory_count") & (x.cast("long") != trajectories), "other_count")
    return rows.select("global_step", "metric", finding.alias("finding")).where("finding is not null")


def step_health(metrics: DataFrame, trajectories: int) -> DataFrame:
    """The metrics themselves; raises where a step isn't healthy."""
    checks.require_none(health_findings(metrics, trajectories), "a step that isn't healthy")
    return metrics


def freeze(numbers: dict[str, float], sources: dict[str, dict], parents: dict[str, str]) -> tuple[dict, str]:
    """A resolved method document chained by hash to the documents it came from, and its own hash.

    numbers: by the paths of NUMBERS; sources: documents by name; parents: their
    recorded hashes.
    """
    for name, value in sources.items():
        if document_hash(value) != parents.get(name):
            raise CheckFailed(f"{name} isn't the recorded document")
    document = resolved_document(numbers) | {"parents": dict(sorted(parents.items()))}
    validate_method(document)
    return document, document_hash(document)


def population_findings(entries: DataFrame, documents: DataFrame, model: str, questions: int = 128, trajectories: int = 1024) -> DataFrame:
    """(batch_index, finding) of what keeps calibration batches from being pooled.

    entries: batch_index, batch_count, selected_rows, manifest_rows, question_ids
    (arrays), data_sha256 and found_sha256 (null without a file).  documents: one a
    batch with the columns of BATCH, model, question_group_count,
    original_trajectory_count, optimizer_update_executed, calibration_batch_index,
    method_revision, reference_sha256 and observed_questions (an array).  Indices
    have to run from 1 to batch_count; rows and questions may lie in one batch
    alone; all batches have to share a method revision and a numeric reference,
    those of the first.
    """
    both = entries.join(documents, "batch_index", "left")
    differs = lambda c, v: ~F.coalesce(F.col(c) == F.lit(v), F.lit(False))
    equal = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    wanted = BATCH | {"model": model, "question_group_count": questions, "original_trajectory_count": trajectories, "optimizer_update_executed": False}
    tests = {f"other_{k}": differs(k, v) for k, v in wanted.items()} | {
        "changed_data": ~equal("data_sha256", "found_sha256"),
        "other_manifest": ~equal("selected_rows", "manifest_rows"),
        "other_batch_index": (F.col("batch_index") > 1) & ~equal("calibration_batch_index", "batch_index"),
        "unexpected_question": F.size(F.array_except("observed_questions", "question_ids")) > 0,
        "index_out_of_range": (F.col("batch_index") < 1) | (F.col("batch_index") > F.col("batch_count")),
    }
    out = both.select("batch_index", F.explode(F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())), lambda x: x.isNotNull())).alias("finding"))
    for column, name in (("selected_rows", "shared_row"), ("question_ids", "shared_question")):
        rows = entries.select("batch_index", F.explode(column).alias("v"))
        again = rows.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
        out = out.unionByName(rows.join(again, "v").select("batch_index", F.lit(name).alias("finding")).distinct())
    out = out.unionByName(entries.groupBy("batch_index").count().where("count > 1").select("batch_index", F.lit("repeated_index").alias("finding")))
    missing = entries.agg(F.max("batch_count").alias("n")).select(F.explode(F.sequence(F.lit(1), "n")).alias("batch_index")).join(entries, "batch_index", "left_anti")
    out = out.unionByName(missing.select("batch_index", F.lit("missing_index").alias("finding")))
    first = documents.agg(F.min_by(F.struct("method_revision", "reference_sha256"), "batch_index").alias("first"))
    other = documents.join(F.broadcast(first), F.lit(True))  # one row
    for column, name in (("method_revision", "other_revision"), ("reference_sha256", "other_reference")):
        out = out.unionByName(other.where(~F.col(column).eqNullSafe(F.col(f"first.{column}"))).select("batch_index", F.lit(name).alias("finding")))
    return out


def validate_batches(documents: DataFrame, batches: int | None = None) -> DataFrame:
    """Calibration documents with distinct ids and disjoint questions; raises otherwise."""
    checks.require_none(checks.repeated_ids(documents, "batch_id"), "a repeated batch")
    if batches is not None and documents.count() != batches:
        raise CheckFailed("another number of batches")
    questions = documents.select("batch_id", F.explode("search.rows.question_id").alias("question_id")).distinct()
    checks.require_none(checks.shared_rows(questions, ["question_id"], "batch_id"), "a question in two batches")
    rows = calibration.search_rows(documents)
    checks.require_none(documents.join(rows.select("batch_id"), "batch_id", "left_anti").select("batch_id"), "a batch without search rows")
    return documents


def prepare_batches(rows: DataFrame, excluded: DataFrame, batches: int, each: int, seed: int) -> DataFrame:
    """Training rows to balanced disjoint batches: checks, evidence dropped, drawn, checked again."""
    from turnledger.operators import sampling

    checks.require_columns(rows, {"data_source": "string", "extra_info": "struct<index:"})
    checks.require_none(checks.not_split(rows).select("extra_info"), "a row of another split")
    bare = checks.drop_evidence(rows).withColumn("row_index", F.col("extra_info.index"))
    out = sampling.disjoint_batches(bare, excluded, batches, each, seed)
    checks.require_none(out.groupBy("batch_index", "data_source").count().where(F.col("count") != each), "a batch that isn't balanced")
    checks.require_none(checks.shared_rows(out, ["data_source", "row_index"]), "a row in two batches")
    return out
