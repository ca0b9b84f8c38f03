"""O21 eval_matrix, O22 score_cases, O23 eval_summary, O25 eval_buckets,
O26 gate_sweep: scoring classifiers over labelled case tables.

Case variables arrive as text (as read from a CSV) and are cast here with
the assertion's rules.  Scoring reuses the contract's parse stages and adds
its own stages in the same ``transform`` chain, so each output is parsed
once, inside one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsre import js_trim
from ..functions import service_types as st
from ..functions.service_types import UNKNOWN_ID
from .contract import NUMBER_TYPE, _one, _stage_chain, _stages, is_braced

# ---------------------------------------------------------------------------
# The eval providers (id, label, temperature, max_tokens,
# context window, response format), in file order.
# ---------------------------------------------------------------------------
PROVIDERS = [
    {"id": "ollama:chat:qwen3.5:9b", "label": "ollama/qwen3.5:9b", "temperature": 0.0,
     "max_tokens": 400, "context": 4096, "response_format": None},
    {"id": "ollama:chat:gemma4:e4b", "label": "ollama/gemma4:e4b", "temperature": 0.0,
     "max_tokens": 400, "context": 4096, "response_format": None},
    {"id": "openai:gpt-4o-mini", "label": "openai/gpt-4o-mini", "temperature": 0.0,
     "max_tokens": None, "context": None, "response_format": "json_schema"},
    {"id": "openai:gpt-4.1-mini", "label": "openai/gpt-4.1-mini", "temperature": 0.0,
     "max_tokens": None, "context": None, "response_format": "json_schema"},
    {"id": "openai:gpt-4.1-nano", "label": "openai/gpt-4.1-nano", "temperature": 0.0,
     "max_tokens": None, "context": None, "response_format": "json_schema"},
    {"id": "openai:gpt-5-mini", "label": "openai/gpt-5-mini", "temperature": 0.0,
     "max_tokens": None, "context": None, "response_format": "json_schema"},
    {"id": "openai:gpt-5-nano", "label": "openai/gpt-5-nano", "temperature": 0.0,
     "max_tokens": None, "context": None, "response_format": "json_schema"},
    {"id": "anthropic:messages:claude-haiku-4-5-20251001", "label": "anthropic/claude-haiku-4-5",
     "temperature": 0.0, "max_tokens": 400, "context": None, "response_format": None},
    {"id": "google:gemini-2.5-flash-lite", "label": "google/gemini-2.5-flash-lite", "temperature": 0.0,
     "max_tokens": None, "context": None, "response_format": None},
    {"id": "google:gemini-2.5-flash", "label": "google/gemini-2.5-flash", "temperature": 0.0,
     "max_tokens": None, "context": None, "response_format": None},
]
BASE_CHECKS = 6
NOT_AN_OBJECT = "Output must be a JSON object."
DEFAULT_THRESHOLDS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9]
# ---------------------------------------------------------------------------


def eval_matrix(cases: DataFrame, providers: list[dict] | None = None, pattern: str | None = None,
                first_n: int | None = None, case_no: str = "case_no") -> DataFrame:
    """Every case x every selected provider.

    The provider list is configuration (a handful of rows), filtered by a
    regex on the label on the driver and attached with ``explode`` of a
    literal array - a generator, not a join.  ``first_n`` keeps the first N
    cases in file order (a top-N, bounded by N).
    """
    import re

    rows = [p for p in (providers or PROVIDERS) if pattern is None or re.search(pattern, p["label"])]
    if first_n is not None:
        cases = cases.orderBy(case_no).limit(first_n)
    entry = ("struct<provider_ord:int,provider_id:string,provider_label:string,temperature:double,max_tokens:int,"
             "context:int,response_format:string>")
    lit_rows = F.array(*[F.struct(
        F.lit(i).alias("provider_ord"), F.lit(p["id"]).alias("provider_id"),
        F.lit(p["label"]).alias("provider_label"), F.lit(float(p["temperature"])).alias("temperature"),
        F.lit(p["max_tokens"]).cast("int").alias("max_tokens"), F.lit(p["context"]).cast("int").alias("context"),
        F.lit(p["response_format"]).cast("string").alias("response_format"),
    ) for i, p in enumerate(rows)]).cast(f"array<{entry}>")
    # no match: an empty array, so no rows but the same columns
    return cases.withColumn("_p", F.explode(lit_rows)).select("*", "_p.*").drop("_p")


def as_boolean(col: Column) -> Column:
    """'true'/'false' in any case, trimmed; anything else NULL."""
    t = F.lower(js_trim(col))
    return F.when(t == "true", F.lit(True)).when(t == "false", F.lit(False))


NUMERIC_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def as_number(col: Column) -> Column:
    """``Number(String(v).trim())`` for decimal/exponent text: '' -> NULL,
    blank -> 0, non-numeric or non-finite -> NULL (hex is not supported)."""
    t = js_trim(col)
    return (F.when(col.isNull() | (col == ""), F.lit(None).cast("double"))
            .when(t == "", F.lit(0.0))
            .when(t.rlike(NUMERIC_TEXT) & (F.abs(t.try_cast("double")) != F.lit(float("inf"))),
                  t.try_cast("double")))


def expected_ids(plural: Column, single: Column, plural_is_array: bool = False) -> Column:
    """Plural list wins when non-blank (and may end up empty), else the
    trimmed single id, else empty.  An ARRAY of ids is taken element by
    element (trimmed, blanks dropped) and wins even when empty."""
    if plural_is_array:
        given = F.filter(F.transform(plural, lambda x: js_trim(x.cast("string"))), lambda x: x != "")
        return F.when(plural.isNotNull(), given).otherwise(expected_ids(F.lit(None).cast("string"), single))
    parts = F.filter(F.transform(F.split(plural, ",", -1), lambda x: js_trim(x)), lambda x: x != "")
    return (F.when(plural.isNotNull() & (js_trim(plural) != ""), parts)
            .when(single.isNotNull() & (js_trim(single) != ""), F.array(js_trim(single)))
            .otherwise(F.array().cast("array<string>")))


def _number_text(x: Column) -> Column:
    """A double as JavaScript prints it: no point for whole numbers, digits
    written out from 1e-6 up to 1e21, else ``1e-7``, ``1.5e+21``."""
    text, size = x.cast("string"), F.abs(x)

    def written_out(scale: int) -> Column:
        digits = text.try_cast(f"decimal(38,{scale})").cast("string")
        return F.regexp_replace(F.regexp_replace(digits, r"0+$", ""), r"\.$", "")

    power = F.regexp_replace(F.regexp_replace(text, r"\.0E|E", "e"), r"e(\d)", r"e+$1")
    return (F.when(x == 0, F.lit("0")).when((size >= 1e21) | (size < 1e-6), power)
            .when(size < 1, written_out(30)).otherwise(written_out(16)))


def _score_stages(notify: Column, ids: Column, min_c: Column, max_c: Column, service_types: list[dict] | None = None):
    known = st.service_ids(service_types)
    ids_set = [F.lit(x) for x in known]

    def is_number(g):
        return F.coalesce(g("_t_score").rlike(NUMBER_TYPE), F.lit(False))

    def failures(g):
        num = is_number(g)
        alert_is_bool = g("_t_alert") == "BOOLEAN"
        def must(cond):  # a requirement; NULL (missing / wrong type) fails it
            return ~F.coalesce(cond, F.lit(False))

        def fails_if(cond):  # a failure condition; NULL does not fail
            return F.coalesce(cond, F.lit(False))

        sid = F.coalesce(g("_sid"), F.lit("undefined"))
        alert = F.when(alert_is_bool, g("_alert").cast("string"))
        # The wording of a verdict's failures.
        rules = [
            (must((g("_t_expl") == "STRING") & (g("_expl") != "")), F.lit("explanation must be a non-empty string")),
            (must((g("_t_sid") == "STRING") & g("_sid").isin(*ids_set)),
             F.lit("serviceTypeId must be one of " + ", ".join(known))),
            (must(num & (g("_score") >= 0) & (g("_score") <= 1)),
             F.lit("confidenceScore must be a number between 0 and 1")),
            (must(alert_is_bool), F.lit("shouldAlertAdmin must be a boolean")),
            (must((g("_t_reason") == "STRING") & (g("_reason") != "")), F.lit("alertReason must be a non-empty string")),
            (notify.isNull(), F.lit("expectedShouldNotify test variable must be true or false")),
            (fails_if(notify.isNotNull() & alert_is_bool & (g("_alert") != notify)),
             F.concat(F.lit("expected shouldAlertAdmin "), notify.cast("string"), F.lit(", got "), alert)),
            (fails_if((F.size(ids) > 0) & ~F.coalesce((g("_t_sid") == "STRING")
                                                     & F.array_contains(ids, g("_sid")), F.lit(False))),
             F.concat(F.lit("expected serviceTypeId "), F.array_join(ids, " or "), F.lit(", got "), sid)),
            (fails_if(min_c.isNotNull() & num & (g("_score") < min_c)),
             F.concat(F.lit("expected confidenceScore >= "), _number_text(min_c), F.lit(", got "), _number_text(g("_score")))),
            (fails_if(max_c.isNotNull() & num & (g("_score") > max_c)),
             F.concat(F.lit("expected confidenceScore <= "), _number_text(max_c), F.lit(", got "), _number_text(g("_score")))),
        ]
        return F.array_compact(F.array(*(F.when(cond, text) for cond, text in rules)))

    def passed_text(g):
        return F.concat(F.lit("Parsed "), g("_sid"), F.lit(" at confidence "), _number_text(g("_score")),
                        F.lit("; shouldAlertAdmin="), g("_alert").cast("string"))

    def checks(g):
        return (F.lit(BASE_CHECKS).cast("long") + notify.isNotNull().cast("long")
                + (F.size(ids) > 0).cast("long") + min_c.isNotNull().cast("long")
                + max_c.isNotNull().cast("long"))

    def parsed(g):
        # a picked text without braces had none to pick
        return is_braced(g("json_text")) & g("_v").isNotNull() & F.coalesce(g("_root").startswith("OBJECT"), F.lit(False))

    return [
        [("parsed", parsed), ("_failures", failures), ("n_checks", checks)],
        [("n_failures", lambda g: F.size(g("_failures")).cast("long")),
         ("reason", lambda g: F.when(~g("parsed"), F.lit(NOT_AN_OBJECT)).when(
             F.size(g("_failures")) > 0, F.array_join(g("_failures"), "; ")).otherwise(passed_text(g)))],
        [("pass", lambda g: g("parsed") & (g("n_failures") == 0)),
         ("score", lambda g: F.when(g("parsed"), F.greatest(
             F.lit(0.0), (g("n_checks") - g("n_failures")).cast("double") / g("n_checks")))
             .otherwise(F.lit(0.0))),
         ("contract_pass", lambda g: F.size(g("issues")) == 0),
         ("eligible_score", lambda g: F.when(
             g("parsed") & (g("_t_sid") == "STRING") & g("_sid").isin(*ids_set) & (g("_sid") != UNKNOWN_ID)
             & is_number(g), g("_score")))],
    ]


SCORE_FIELDS = ["parsed", "n_failures", "n_checks", "pass", "score", "reason", "contract_pass", "eligible_score"]


def score_cases(df: DataFrame, output: str = "output", should_notify: str = "expected_should_notify",
                service_id: str = "expected_service_type_id", service_ids: str = "expected_service_type_ids",
                min_confidence: str = "min_confidence", max_confidence: str = "max_confidence",
                service_types: list[dict] | None = None) -> DataFrame:
    """The assertion verdict for every (case, output) row.

    Adds ``parsed, n_failures, n_checks, pass, score, reason, contract_pass,
    eligible_score`` (``reason``: the failures in order, or what was parsed) and ``expected_notify`` (the cast expectation).
    ``contract_pass`` applies the production contract to the same output;
    an output can pass the eval and fail the contract.
    """
    cast = df.withColumns({
        "expected_notify": as_boolean(F.col(should_notify)),
        "_ids": expected_ids(F.col(service_ids), F.col(service_id),
                             df.schema[service_ids].dataType.typeName() == "array"),
        "_min": as_number(F.col(min_confidence)),
        "_max": as_number(F.col(max_confidence)),
    })
    stages = _score_stages(F.col("expected_notify"), F.col("_ids"), F.col("_min"), F.col("_max"),
                           service_types)
    one = _one(F.coalesce(F.col(output).cast("string"), F.lit("")), F.lit(True))
    verdict = F.element_at(_stage_chain(one, _stages("_src", service_types) + stages, SCORE_FIELDS), 1)
    out = cast.withColumn("_verdict", verdict)
    return out.select(*[c for c in out.columns if c not in ("_verdict", "_ids", "_min", "_max")],
                      *[F.col(f"_verdict.{f}").alias(f) for f in SCORE_FIELDS])


def eval_summary(verdicts: DataFrame, by: tuple[str, ...] = ("provider_id",)) -> DataFrame:
    """Pass rate, mean score, tokens and cost per provider, plus how many
    outputs pass the eval but fail the production contract."""
    return verdicts.groupBy(*by).agg(*_summary_aggs())


def _summary_aggs() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("cases"),
        F.sum(F.col("pass").cast("long")).alias("passes"),
        F.avg(F.col("pass").cast("double")).alias("pass_rate"),
        F.avg("score").alias("avg_score"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("cost_usd").alias("cost_usd"),
        F.sum((F.col("pass") & ~F.col("contract_pass")).cast("long")).alias("eval_pass_contract_fail"),
    ]


def eval_buckets(verdicts: DataFrame, bucket: str = "path_type", provider: str = "provider_id") -> DataFrame:
    """The summary by path bucket and provider with rollup subtotals;
    ``level`` tells them apart (``provider``, ``bucket``, ``all``), as a bucket
    may itself be NULL."""
    level = (F.when(F.grouping(bucket) == 1, "all").when(F.grouping(provider) == 1, "bucket").otherwise("provider"))
    return verdicts.rollup(bucket, provider).agg(*_summary_aggs(), level.alias("level"))


def gate_sweep(verdicts: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """Confusion counts of the alert gate recomputed at each threshold.

    Eligible at t = parsed, listed (non-unknown) service, number score > t
    (strict, as in the contract); compared with the cast expectation (rows
    without one are left out).  One aggregation pass with a column group per
    threshold, then unpivoted - no join, no row multiplication.
    """
    ts = thresholds or DEFAULT_THRESHOLDS
    rows = verdicts.filter(F.col("expected_notify").isNotNull())
    aggs = []
    for i, t in enumerate(ts):
        eligible = F.coalesce(F.col("eligible_score") > F.lit(t), F.lit(False))
        exp = F.col("expected_notify")
        for name, cond in (("tp", eligible & exp), ("fp", eligible & ~exp),
                           ("tn", ~eligible & ~exp), ("fn", ~eligible & exp)):
            aggs.append(F.sum(cond.cast("long")).alias(f"{name}_{i}"))
    wide = rows.agg(*aggs)
    stack = ", ".join(f"{float(t)}D, tp_{i}, fp_{i}, tn_{i}, fn_{i}" for i, t in enumerate(ts))
    long = wide.selectExpr(f"stack({len(ts)}, {stack}) AS (threshold, tp, fp, tn, fn)")
    return long.select("threshold", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                                      for c in ("tp", "fp", "tn", "fn")])
