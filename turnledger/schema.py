"""Row types of the engine, and the constants of the method."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the method.
REVISION = "urcr_v4_unified_typed_r1_final"
CONTROL_STREAM = "urcr_v4_sha256_counter_r1"
PROBE_VERSION = "urcr_v4_native_neutral_answer_probe_r1"
CONTROL_COUNT = 3
ANSWER_ALPHA = 0.25
SEARCH_CAP = 2.0
TRAJECTORY_BUDGET = 2.5
NEGATIVE_SCALE = 0.1
MAX_CHUNKS = 6
MAX_ALIASES = 3
ROLLOUTS = 8
VIEWS = ("real", "empty", "control_0", "control_1", "control_2")
CHANNELS = {"search_action": 0, "search_think": 1, "answer_action": 2, "answer_think": 3}
EMPTY_SLOT = "<documents></documents>"

_ATOMS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType()}


def _parts(text: str) -> list[str]:
    """The pieces of a list between commas outside of angle brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _type(text: str) -> T.DataType:
    head, _, rest = text.partition("<")
    if head == "array":
        return T.ArrayType(_type(rest[:-1]))
    if head == "map":
        return T.MapType(*map(_type, _parts(rest[:-1])))
    if head == "struct":
        return T.StructType([T.StructField(n.strip(), _type(k.strip())) for n, _, k in (f.partition(":") for f in _parts(rest[:-1]))])
    return _ATOMS[head]


def _struct(text: str) -> T.StructType:
    """A row type from ``name type, ...``; Spark's own parser needs a running session."""
    return T.StructType([T.StructField(n, _type(k.strip())) for n, _, k in (f.partition(" ") for f in _parts(text))])


TRAINING = _struct("data_source string, extra_info struct<index:int,split:string>, reward_model struct<ground_truth:struct<target:array<string>>>, metadata struct<supporting_facts:array<string>>")

ROLLOUT = _struct(
    "batch_row_index int, responses array<int>, response_mask array<int>, prompt_ids array<int>, prompt_mask array<int>, old_log_probs array<double>, data_source string, uid string, traj_uid string, "
    "extra_info struct<index:int,split:string,question:string>, env_kwargs struct<ground_truth:struct<target:array<string>>,question:string>, reward_model struct<ground_truth:struct<target:array<string>>,style:string>, "
    "turn_step int, episode_lengths double, terminal_binary_em double, is_action_valid boolean, is_adjustment_copy boolean, search_feedback string, turn_context_text string, "
    "action_type string, action_text string, invalid_action boolean, empty_action boolean, unclosed_action boolean, think_mask array<int>, action_mask array<int>, tag_mask array<int>, think_chunks array<array<int>>"
)

TURN = _struct(
    "global_step int, batch_row_index int, is_adjustment_copy boolean, question_id string, rollout_group_id string, trajectory_id string, turn_id string, rollout_index int, turn_index int, data_source string, question string, "
    "answer_aliases array<string>, visible_context_text string, visible_prompt_token_ids array<int>, sampled_response_token_ids array<int>, action_type string, action_text string, observation_text string, valid_action boolean, "
    "observation_consumable boolean, terminal_binary_em int, think_content_positions array<int>, action_target_positions array<int>, action_content_positions array<int>, action_boundary_positions array<int>, "
    "action_tag_positions array<int>, think_chunks array<array<int>>, old_action_target_log_probs array<double>"
)

ANSWER = _struct("trajectory_id string, rollout_group_id string, binary_em int, valid_terminal_answer boolean, answer string, aliases array<string>")

CANDIDATE = _struct("global_step int, observation_id string, question_id string, data_source string, call_bucket string, serialized_observation string, token_length int, document_count int, document_signature array<string>, valid boolean")

REQUEST = _struct(
    "request_id string, comparison_group_id string, view string, actor_snapshot_id string, input_ids array<int>, attention_mask array<int>, position_ids array<int>, target_ids array<int>, target_positions array<int>, "
    "predictor_positions array<int>, blocked_key_positions array<int>, probe_version string"
)

SCORE = _struct("request_id string, score double")

CALIBRATION_DOCUMENT = _struct(
    "batch_id string, numeric_reference struct<same_shape_repeat_max_abs_difference:double>, "
    "search struct<rows:array<struct<question_id:string,turn_id:string,control_used_replacement:boolean,view_scores:struct<real:double,empty:double,control_0:double,control_1:double,control_2:double>,g_incremental:double,g_control:double,g_directed:double,visible_exact_repeat:boolean,contrast_sign_conflict:boolean>>,summary:struct<unscored_reason_counts:map<string,int>>>, "
    "responsibility struct<rows:array<struct<turn_id:string,action_type:string,is_zero_utility_shadow:boolean,old_full_score:double,plain_scorer_score:double,whole_masked_score:double,chunk_masked_scores:array<double>>>>, "
    "answer struct<rows:array<struct<turn_id:string,rollout_group_id:string,binary_em:int,valid_terminal_answer:boolean,residual:double>>>"
)
