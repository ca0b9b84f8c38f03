"""JSON extraction, strict contract validation, first valid block,
safe fallback.

Strict ``JSON.parse`` semantics are rebuilt from VARIANT parsing
(``try_parse_json``) plus a guard against trailing text, and the
strict-object contract from ``json_object_keys`` and per-field variant types.
Everything is a Column expression, so validation runs inside the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsre import WS, js_trim
from ..functions.service_types import UNKNOWN_ID, service_ids

# ---------------------------------------------------------------------------
# The model-output contract.
# ---------------------------------------------------------------------------
CONTRACT_KEYS = ["explanation", "serviceTypeId", "confidenceScore", "shouldAlertAdmin", "alertReason"]
ALERT_MIN_CONFIDENCE = 0.7  # alert only when confidenceScore is strictly above
SAFE_ALERT_REASON = "Categorizer response could not be parsed or validated; no admin alert sent."
MODEL_ERROR_SUFFIX = " Model error: "
FENCE_OPEN_PATTERN = rf"(?i)^```(?:json)?[{WS}]*"
# ---------------------------------------------------------------------------

NUMBER_TYPE = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"

def strip_fences(col: Column) -> Column:
    """Trim, then drop a leading ```json fence and a trailing ``` fence."""
    return _unfenced(js_trim(col))


def _unfenced(t: Column) -> Column:
    """:func:`strip_fences` of a trimmed text; most have no fence to look for."""
    fence = F.lit("```")
    u = F.regexp_replace(t, FENCE_OPEN_PATTERN, "")
    # the trimmed text ends where a closing fence ends
    u = F.when(u.endswith(fence), F.left(u, F.length(u) - 3)).otherwise(u)
    return F.when(t.startswith(fence) | t.endswith(fence), js_trim(u)).otherwise(t)


def pick_object(w: Column) -> Column:
    """The object candidate in fence-free text: the text itself when it is
    ``{...}``, else first '{' to last '}', else unchanged."""
    start = F.instr(w, "{")
    end = F.length(w) - F.length(F.substring_index(w, "}", -1))  # 0: there is none
    return (F.when(is_braced(w), w)
            .when((start > 0) & (end > start), w.substr(start, end - start + 1))
            .otherwise(w))


def is_braced(text: Column) -> Column:
    return text.startswith("{") & text.endswith("}")


def _text_stages(src: str) -> list:
    """The stages of O7."""
    return [[("_t", lambda g: js_trim(g(src)))],
            [("_w", lambda g: _unfenced(g("_t")))],
            [("json_text", lambda g: pick_object(g("_w")))]]


# Validation as stages.  Every stage reads only cheap references (columns or
# lambda-variable fields) of the previous one, so Catalyst keeps the stages
# as separate projections instead of inlining one huge expression tree.
def _field_type(v: Column, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))


def _stages(src: str, service_types: list[dict] | None = None):
    """[(name, fn(get) -> Column)] per stage; ``get(name)`` reads a value of
    an earlier stage (or the source text under ``src``)."""
    ids = service_ids(service_types)

    def text_issue(key, t, value):
        return (F.when(t.isNull(), F.lit(f"{key}:missing"))
                .when(t != "STRING", F.lit(f"{key}:invalid_type"))
                .when(value == "", F.lit(f"{key}:too_small")))

    def base_issues(g):
        return F.array_compact(F.array(
            text_issue("explanation", g("_t_expl"), g("_expl")),
            F.when(g("_t_sid").isNull(), F.lit("serviceTypeId:missing"))
            .when((g("_t_sid") != "STRING") | ~g("_sid").isin(*ids), F.lit("serviceTypeId:invalid_enum")),
            F.when(g("_t_score").isNull(), F.lit("confidenceScore:missing"))
            .when(~g("_t_score").rlike(NUMBER_TYPE), F.lit("confidenceScore:invalid_type"))
            .when((g("_score") < 0) | (g("_score") > 1) | F.isnan(g("_score")),
                  F.lit("confidenceScore:out_of_range")),
            F.when(g("_t_alert").isNull(), F.lit("shouldAlertAdmin:missing"))
            .when(g("_t_alert") != "BOOLEAN", F.lit("shouldAlertAdmin:invalid_type")),
            text_issue("alertReason", g("_t_reason"), g("_reason")),
            F.when(g("_extra"), F.lit("unrecognized_keys")),
        ))

    def cross_issues(g):
        return F.array_compact(F.array(
            F.when(g("_alert") & (g("_sid") == UNKNOWN_ID), F.lit("shouldAlertAdmin:unknown_service")),
            F.when(g("_alert") & (g("_score") <= ALERT_MIN_CONFIDENCE),
                   F.lit("shouldAlertAdmin:confidence_not_above_0.7")),
        ))

    def issues(g):
        return (F.when(g("_v").isNull(), F.array(F.lit("invalid_json")))
                .when(~g("_root").startswith("OBJECT"), F.array(F.lit("not_object")))
                .when(F.size(g("_base")) > 0, g("_base"))
                .otherwise(g("_cross")))

    def result(g):
        r = F.struct(g("_expl").alias("explanation"), g("_sid").alias("service_type_id"),
                     g("_score").alias("confidence_score"), g("_alert").alias("should_alert_admin"),
                     g("_reason").alias("alert_reason"))
        return F.when(F.size(g("issues")) == 0, r)

    # ``JSON.parse``: the parser of VARIANT accepts trailing text, so the text
    # must parse as the one element of an array and as a member of an object
    def parsed(g):
        single = (g("_arr").isNotNull() & F.try_variant_get(g("_arr"), "$[1]", "variant").isNull()
                  & F.try_parse_json(F.concat(F.lit('{"r":'), g("json_text"), F.lit("}"))).isNotNull())
        return F.when(single, F.try_variant_get(g("_arr"), "$[0]", "variant"))

    return [*_text_stages(src),
        [("_arr", lambda g: F.try_parse_json(F.concat(F.lit("["), g("json_text"), F.lit("]"))))],
        [("_v", parsed)],
        [("_keys", lambda g: F.map_keys(F.try_variant_get(g("_v"), "$", "map<string,variant>"))),
         ("_root", lambda g: F.schema_of_variant(g("_v"))),
         ("_t_expl", lambda g: _field_type(g("_v"), "explanation")),
         ("_expl", lambda g: js_trim(F.try_variant_get(g("_v"), "$.explanation", "string"))),
         ("_t_sid", lambda g: _field_type(g("_v"), "serviceTypeId")),
         ("_sid", lambda g: F.try_variant_get(g("_v"), "$.serviceTypeId", "string")),
         ("_t_score", lambda g: _field_type(g("_v"), "confidenceScore")),
         ("_score", lambda g: F.try_variant_get(g("_v"), "$.confidenceScore", "double")),
         ("_t_alert", lambda g: _field_type(g("_v"), "shouldAlertAdmin")),
         ("_alert", lambda g: F.try_variant_get(g("_v"), "$.shouldAlertAdmin", "boolean")),
         ("_t_reason", lambda g: _field_type(g("_v"), "alertReason")),
         ("_reason", lambda g: js_trim(F.try_variant_get(g("_v"), "$.alertReason", "string")))],
        [("_extra", lambda g: F.size(F.array_except(
            g("_keys"), F.array(*[F.lit(k) for k in CONTRACT_KEYS]))) > 0)],
        [("_base", base_issues), ("_cross", cross_issues)],
        [("issues", issues)],
        [("result", result)],
    ]


CHECK_FIELDS = ["pos", "is_text", "issues", "result"]


def _reads(fn) -> set[str]:
    """The names that a stage's function reads."""
    names = set()
    fn(lambda n: names.add(n) or F.lit(None))
    return names


def _stage_chain(arr: Column, stages: list, out: list[str] | None = None) -> Column:
    """Run the stages over an array of ``struct(pos, is_text, _src)``, one
    nested ``transform`` per stage, keeping ``out``.

    Inside a lambda, earlier values are read as fields of the lambda
    variable, which the optimizer never substitutes; so the plan stays linear
    in the number of stages even when filters are pushed through it.  A stage
    copies what it carries on, so values go as soon as no later one reads them.
    """
    keep = out or CHECK_FIELDS
    later = [{*keep, "is_text"}]  # the names that are read after each stage
    for stage in reversed(stages):
        later.append(later[-1] | set().union(*(_reads(fn) for _, fn in stage)))
    later = later[-2::-1]

    def make_step(stage, carried):
        def step(x):
            old = [x[f].alias(f) for f in carried]
            new = [F.when(x["is_text"], fn(lambda n: x[n])).alias(name) for name, fn in stage]
            return F.struct(*old, *new)
        return step

    fields = ["pos", "is_text", "_src"]
    for stage, read in zip(stages, later, strict=True):
        carried = [f for f in fields if f in read]
        arr = F.transform(arr, make_step(stage, carried))
        fields = carried + [n for n, _ in stage]
    return F.transform(arr, lambda x: F.struct(*[x[f].alias(f) for f in keep]))


def _one(text: Column, is_text: Column) -> Column:
    return F.array(F.struct(F.lit(0).alias("pos"), is_text.alias("is_text"), text.alias("_src")))


def checked_col(text: Column, is_text: Column | None = None, service_types: list[dict] | None = None,
                keep_json_text: bool = False) -> Column:
    """O7 + O8 of one text: a struct with ``issues, result`` (and ``json_text``)."""
    flag = F.lit(True) if is_text is None else is_text
    out = [*CHECK_FIELDS, *(["json_text"] if keep_json_text else [])]
    return F.element_at(_stage_chain(_one(text, flag), _stages("_src", service_types), out), 1)


def extract_json(df: DataFrame, col: str, out: str = "json_text") -> DataFrame:
    """Add ``out`` = the normalised JSON text of ``col``."""
    chain = _stage_chain(_one(F.col(col), F.lit(True)), _text_stages("_src"), ["json_text"])
    return df.withColumn(out, F.element_at(chain, 1)["json_text"])


def validate_output(df: DataFrame, col: str, keep_json_text: bool = False,
                    service_types: list[dict] | None = None) -> DataFrame:
    """O7 + O8: add ``result`` (the trimmed contract output, NULL when
    invalid) and ``issues`` (our issue codes; empty when valid)."""
    out = (df.withColumn("_chk", checked_col(F.col(col), service_types=service_types,
                                              keep_json_text=keep_json_text))
             .withColumn("result", F.col("_chk.result"))
             .withColumn("issues", F.col("_chk.issues")))
    if keep_json_text:
        out = out.withColumn("json_text", F.col("_chk.json_text"))
    return out.drop("_chk")


def _apply_stages_array(df: DataFrame, arr: str, out: str, text_field: str = "text",
                        type_field: str = "type", service_types: list[dict] | None = None) -> DataFrame:
    """The stages over every block of an array column (non-text blocks get NULLs)."""
    blocks = F.transform(F.col(arr), lambda b, i: F.struct(
        i.alias("pos"), (b[type_field] == "text").alias("is_text"), b[text_field].alias("_src")))
    return df.withColumn(out, _stage_chain(blocks, _stages("_src", service_types)))


def first_valid_block(responses: DataFrame, content: str = "content",
                      service_types: list[dict] | None = None) -> DataFrame:
    """O9 on responses carrying ``content ARRAY<STRUCT<type,text>>``.

    Adds ``result`` (first text block, in order, that passes O8),
    ``winner_pos``, ``parse_errors`` (position and issues of every failed
    text block before the winner - all of them when none won) and
    ``parse_error``.  Array HOFs only: no explode, no shuffle.
    """
    tmp = _apply_stages_array(responses, content, "_blocks", service_types=service_types)
    winner = F.try_element_at(F.filter(F.col("_blocks"), lambda x: x["result"].isNotNull()), F.lit(1))
    return (
        tmp.withColumn("_winner", F.struct(winner["pos"].alias("pos"), winner["result"].alias("result")))
        .withColumn("result", F.col("_winner.result"))
        .withColumn("winner_pos", F.col("_winner.pos"))
        .withColumn("parse_errors", F.transform(
            F.filter(F.col("_blocks"), lambda x: x["is_text"] & x["result"].isNull()
                     & (F.col("winner_pos").isNull() | (x["pos"] < F.col("winner_pos")))),
            lambda x: F.struct(x["pos"].alias("pos"), x["issues"].alias("issues"))))
        .withColumn("parse_error", F.size("parse_errors") > 0)
        .drop("_blocks", "_winner")
    )


def validate_blocks(blocks: DataFrame, text: str = "text", type_col: str = "type",
                    service_types: list[dict] | None = None) -> DataFrame:
    """O7+O8 on one row per block; non-text blocks get NULL result/issues."""
    return (blocks.withColumn("_chk", checked_col(F.col(text), F.col(type_col) == "text", service_types))
            .withColumn("result", F.col("_chk.result"))
            .withColumn("issues", F.col("_chk.issues"))
            .drop("_chk"))


def first_valid_block_rows(blocks: DataFrame, run: str = "run_id", pos: str = "pos",
                           type_col: str = "type", text: str = "text",
                           service_types: list[dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """O9 on one row per block.  Returns (per-run winners, parse-error blocks).

    Winners: ``run, result, winner_pos, n_blocks, n_parse_errors``.  Parse
    errors are the failed text blocks *before* the winner (all of them when
    no block won), as the reference logs them while scanning.  Both come from
    one aggregation; a run's list holds the failed blocks of one response.
    """
    checked = validate_blocks(blocks, text, type_col, service_types).select(run, pos, type_col, "result", "issues")
    is_text = F.col(type_col) == "text"
    ok = is_text & F.col("result").isNotNull()
    failed = F.collect_list(F.when(is_text & F.col("result").isNull(), F.struct(F.col(pos).alias("pos"), "issues")))
    per_run = checked.groupBy(run).agg(
        F.min_by(F.col("result"), F.when(ok, F.col(pos))).alias("result"),
        F.min(F.when(ok, F.col(pos))).alias("winner_pos"),
        F.count(F.lit(1)).alias("n_blocks"), failed.alias("_failed"),
    )
    per_run = per_run.withColumn("_failed", F.filter("_failed", lambda x: F.col("winner_pos").isNull()
                                                     | (x["pos"] < F.col("winner_pos"))))
    winners = per_run.select(run, "result", "winner_pos", "n_blocks", F.size("_failed").cast("long").alias("n_parse_errors"))
    errors = per_run.select(run, F.explode("_failed").alias("e")).select(run, F.col("e.pos").alias(pos), "e.issues")
    return winners, errors


def safe_fallback(df: DataFrame, result: str = "result", error_message: str = "error_message",
                  out: str = "result") -> DataFrame:
    """Replace a missing result by the safe no-alert result.

    The safe reason (plus `` Model error: <msg>`` when the response carried
    one) is used as explanation and alertReason; ``fallback`` marks the rows.
    """
    msg = F.col(error_message) if error_message in df.columns else F.lit(None).cast("string")
    reason = F.when(msg.isNotNull() & (msg != ""),
                    F.concat(F.lit(SAFE_ALERT_REASON + MODEL_ERROR_SUFFIX), msg)
                    ).otherwise(F.lit(SAFE_ALERT_REASON))
    safe = F.struct(
        reason.alias("explanation"),
        F.lit(UNKNOWN_ID).alias("service_type_id"),
        F.lit(0.0).alias("confidence_score"),
        F.lit(False).alias("should_alert_admin"),
        reason.alias("alert_reason"),
    )
    return (df.withColumn("fallback", F.col(result).isNull())
              .withColumn(out, F.coalesce(F.col(result), safe)))
