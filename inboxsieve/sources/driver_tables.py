"""Adapters from the generic test tables to the triage data model.

The test data has no mail: ``documents`` stands in for inbound mail,
``conversations`` for model responses (one row per content block),
``events`` for webhook deliveries, ``labels`` for labelled eval cases and
``part`` for free-text service names.  Each adapter is a plain projection of
the table (so the work grows with it), and each has a DuckDB SQL twin used
by the oracle queries - the two are written independently on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["documents", "labels", "conversations", "events", "part"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table, as it lies in its files."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# Literal lines appended to mail bodies by ``doc_id % 8`` so
# that signatures and every PII kind occur in the data.
# ---------------------------------------------------------------------------
BODY_SUFFIXES = [
    "",
    "\n\nThanks,\nJane Doe\n555-123-4567",
    "\n--\nJohn Smith | https://example.com/profile | john.smith@example.com",
    "\nCall me at (555) 123-4567 or +1 555.987.6543, see https://example.org/a?b=1 today.",
    "\nSSN 123-45-6789, card 4111 1111 1111 1111, alt 4111111111111111, id 1234567890123.",
    "\r\nBest regards\r\nSent from my phone",
    "\néhttp://x.fr é12-34-5678é _http://y.fr 4111-1111-1111-1111x",
    "\nKind regards!!\n\n",
]
# Subjects are the first text line, blanked for a few ids (screening cases).
SUBJECT_BLANKS = {0: "", 1: "   "}  # doc_id % 13 -> subject
# Event types of the ``events`` table that stand for other webhook types.
IGNORED_EVENT_TYPES = {"view": "email.opened"}
RECEIVED_TYPE = "email.received"
FAILED_EVENT_TYPE = "error"
EMAIL_ID_STRIDE = 7  # email_id = user_id * 7, so some ids have no mail
# ---------------------------------------------------------------------------


def _pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 raw mail: ``email_id, from, subject, text``."""
    d = read(spark, sf_dir, "documents")
    subject = F.substring_index(F.col("text"), "\n", 1)
    for k, v in SUBJECT_BLANKS.items():
        subject = F.when(F.col("doc_id") % 13 == k, F.lit(v)).otherwise(subject)
    return d.select(
        F.col("doc_id").alias("email_id"),
        F.concat(F.lit("customer"), F.col("doc_id").cast("string"), F.lit("@example.com")).alias("from"),
        subject.alias("subject"),
        F.concat(F.col("text"), _pick(F.col("doc_id") % 8, BODY_SUFFIXES)).alias("text"),
        F.col("lang"),
    )


# ---------------------------------------------------------------------------
# Synthetic model answers: 12 shapes chosen by ``seed % 12`` (valid, fenced,
# prose-wrapped, malformed, partial, contradictory, missing key, extra key,
# string score, array-wrapped, two objects, blank reason).
# ---------------------------------------------------------------------------
ANSWER_IDS = ["stumpGrinding", "stumpRemoval", "rootRemoval", "treePruning", "unknown", "lawnMowing"]


def json_escape(col: Column) -> Column:
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        col = F.replace(col, F.lit(plain), F.lit(code))
    return col


def answer_text(seed: Column, hint: Column) -> Column:
    """A model answer derived from a seed and a text (the whole text goes into
    the explanation)."""
    return answer_with(seed, json_escape(hint))


def answer_with(seed: Column, words: Column) -> Column:
    """:func:`answer_text` of an escaped text, for many answers to one text."""
    shape = seed % 12
    sid = _pick(F.floor(seed / 12) % 6, ANSWER_IDS)
    score_int = (seed * 37) % 101
    score = F.concat(score_int.cast("string"), F.lit("e-2"))
    alert = F.when((score_int > 70) & (sid != "unknown"), F.lit("true")).otherwise(F.lit("false"))
    expl = F.concat(F.lit("Mail "), seed.cast("string"), F.lit(": "), words)
    reason = F.concat(F.lit("Reason for "), seed.cast("string"))

    def obj(sid_c, score_c, alert_c, reason_c, extra=None, with_alert=True) -> Column:
        parts = [F.lit('{"explanation": "'), expl, F.lit('", "serviceTypeId": "'), sid_c,
                 F.lit('", "confidenceScore": '), score_c]
        if with_alert:
            parts += [F.lit(', "shouldAlertAdmin": '), alert_c]
        parts += [F.lit(', "alertReason": "'), reason_c, F.lit('"')]
        if extra is not None:
            parts.append(extra)
        parts.append(F.lit("}"))
        return F.concat(*parts)

    plain = obj(sid, score, alert, reason)
    partial = plain.substr(F.lit(1), F.length(plain) - 12)
    return (
        F.when(shape == 0, plain)
        .when(shape == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit("Here is the result: "), plain, F.lit(" Hope it helps.")))
        .when(shape == 3, F.concat(F.lit("{not valid json "), seed.cast("string")))
        .when(shape == 4, partial)
        .when(shape == 5, obj(F.lit("unknown"), F.lit("0.95"), F.lit("true"), reason))
        .when(shape == 6, obj(sid, score, alert, reason, with_alert=False))
        .when(shape == 7, obj(sid, score, alert, reason, extra=F.lit(', "extra": 1')))
        .when(shape == 8, obj(sid, F.concat(F.lit('"'), score, F.lit('"')), alert, reason))
        .when(shape == 9, F.concat(F.lit("["), plain, F.lit("]")))
        .when(shape == 10, F.concat(plain, F.lit(" "), plain))
        .otherwise(obj(sid, score, alert, F.lit("   ")))
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response content blocks: ``run_id, pos, type, text`` (+ role)."""
    c = read(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("run_id"),
        F.col("turn").alias("pos"),
        F.when(F.col("role") == "system", F.lit("thinking")).otherwise(F.lit("text")).alias("type"),
        answer_text(F.col("conv_id") * 7 + F.col("turn"), F.col("text")).alias("text"),
    )


def run_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-run response metadata (provider, model, stop reason, error,
    usage) from a partial (map-side combined) aggregation of the blocks."""
    b = blocks(spark, sf_dir)
    grouped = b.groupBy("run_id").agg(
        F.sum(F.length("text")).alias("_chars"),
        F.count(F.lit(1)).alias("content_block_count"),
    )
    return grouped.select("run_id", "content_block_count",
                          *_response_meta(F.col("run_id"), F.col("_chars")))


def _response_meta(run: Column, chars: Column) -> list[Column]:
    err = F.when(run % 9 == 0, F.lit("upstream timeout"))
    return [
        _pick(run % 3, ["openai", "anthropic", "self-hosted"]).alias("provider"),
        _pick(run % 3, ["gpt-4o-mini", "claude-haiku-4-5", "gemma4:e4b"]).alias("model"),
        F.when(run % 5 == 0, _pick(run % 3, ["gpt-4o-mini-2024-07-18", "claude-haiku-4-5-20251001",
                                            "gemma4:e4b"])).alias("response_model"),
        F.when(err.isNotNull(), F.lit("error")).otherwise(F.lit("stop")).alias("stop_reason"),
        err.alias("error_message"),
        F.struct(
            (F.lit(900) + run % 100).cast("long").alias("input"),
            F.ceil(chars / 4).cast("long").alias("output"),
            F.lit(0).cast("long").alias("cache_read"),
            F.lit(0).cast("long").alias("cache_write"),
            (F.lit(900) + run % 100 + F.ceil(chars / 4)).cast("long").alias("total_tokens"),
            F.when(run % 3 == 2, F.lit(0.0)).otherwise(
                ((F.lit(900) + run % 100) * 0.15 + F.ceil(chars / 4) * 0.6) / 1e6).alias("cost_usd"),
        ).alias("usage"),
    ]


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 webhook deliveries: ``delivery_id, type, email_id, received_at, ok``."""
    return deliveries_from(read(spark, sf_dir, "events"))


def deliveries_from(e: DataFrame) -> DataFrame:
    """The delivery projection of an ``events`` frame (batch or stream)."""
    wtype = F.lit(RECEIVED_TYPE)
    for src, dst in IGNORED_EVENT_TYPES.items():
        wtype = F.when(F.col("event_type") == src, F.lit(dst)).otherwise(wtype)
    return e.select(
        F.col("event_id").alias("delivery_id"),
        wtype.alias("type"),
        (F.col("user_id") * EMAIL_ID_STRIDE).alias("email_id"),
        F.col("ts").alias("received_at"),
        (F.col("event_type") != FAILED_EVENT_TYPE).alias("ok"),
    )


def service_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text service names: ``value_id, value`` from ``part``."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey") % 7
    value = (F.when(k == 0, F.lit("Stump grinding")).when(k == 1, F.lit("stump_grinding"))
             .when(k == 2, F.lit("ROOT-REMOVAL")).when(k == 3, F.lit(" treePruning "))
             .when(k == 4, F.lit("Unknown or not listed")).when(k == 5, F.col("p_type"))
             .otherwise(F.col("p_name")))
    return p.select(F.col("p_partkey").alias("value_id"), value.alias("value"))


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D12 labelled cases (all STRING, as read from a CSV) from labels x documents."""
    lab = read(spark, sf_dir, "labels")
    doc = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    j = lab.join(doc, "doc_id")
    d = F.col("doc_id")
    ids = F.when(d % 11 == 0, F.lit("stumpRemoval,rootRemoval")).when(d % 11 == 1, F.lit(" , "))
    return j.select(
        d.alias("case_no"),
        F.concat(F.lit("case "), d.cast("string")).alias("description"),
        F.col("lang").alias("path_type"),
        F.substring_index(F.col("text"), "\n", 1).alias("subject"),
        F.col("text").alias("body"),
        F.when(ids.isNull(), _pick(d % 5, ["stumpGrinding", "stumpRemoval", "rootRemoval",
                                           "treePruning", "unknown"])).alias("expected_service_type_id"),
        ids.alias("expected_service_type_ids"),
        F.when(F.col("toxic") == 1, F.lit(" maybe ")).when(F.col("quality") == 1, F.lit(" TRUE"))
        .otherwise(F.lit("false")).alias("expected_should_notify"),
        F.when(F.col("quality") == 1, F.when(d % 4 == 0, F.lit("0.55")).otherwise(F.lit("0.7")))
        .alias("min_confidence"),
        F.when(F.col("quality") == 0, F.when(d % 4 == 1, F.lit(" ")).otherwise(F.lit("0.3")))
        .alias("max_confidence"),
    )


def recorded_responses(requests: DataFrame, key: str = "email_id") -> DataFrame:
    """Recorded model responses for rendered requests (stand-in for a live
    model): one text block ``answer_text(key, body)``; ids divisible by 9
    carry a model error message as well.  One recording per request hash."""
    k = F.col(key)
    text = answer_text(k, F.col("body"))
    err = F.when(k % 9 == 0, F.lit("upstream timeout"))
    n_in = F.ceil(F.length("user_prompt") / 4).cast("long")
    n_out = F.ceil(F.length(text) / 4).cast("long")
    answers = requests.select(
        "request_hash", k.alias("_k"),
        F.col("provider").alias("response_provider"),
        F.col("model").alias("response_model_id"),
        F.lit(None).cast("string").alias("response_model"),
        F.when(err.isNotNull(), F.lit("error")).otherwise(F.lit("stop")).alias("stop_reason"),
        err.alias("error_message"),
        F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"),
        F.struct(n_in.alias("input"), n_out.alias("output"), F.lit(0).cast("long").alias("cache_read"),
                 F.lit(0).cast("long").alias("cache_write"), (n_in + n_out).alias("total_tokens"),
                 ((n_in * 0.15 + n_out * 0.6) / 1e6).alias("cost_usd")).alias("usage"),
    )
    # identical prompts (copied mail) share one recording: the smallest id's,
    # chosen deterministically with a map-side combinable min_by
    fields = [c for c in answers.columns if c not in ("request_hash", "_k")]
    one = answers.groupBy("request_hash").agg(F.min_by(F.struct(*fields), F.col("_k")).alias("_r"))
    return one.select("request_hash", *[F.col(f"_r.{c}").alias(c) for c in fields])


def recorded_eval_responses(requests: DataFrame) -> DataFrame:
    """Recordings of an eval run as ``answer_text(case_no * 10 +
    provider_ord, body)``, one per request: equal prompts share that of the
    smallest case.  A call fails, without a recording, where that seed is
    divisible by 17.  ``escaped_body``, where the requests have it, is the
    body as :func:`json_escape` gives it."""
    seed = F.col("case_no") * 10 + F.col("provider_ord")
    text = (answer_with(seed, F.col("escaped_body")) if "escaped_body" in requests.columns
            else answer_text(seed, F.col("body")))
    n_in = F.ceil(F.col("prompt_length") / 4).cast("long")
    n_out = F.ceil(F.length(text) / 4).cast("long")
    cost = F.when(F.col("provider_id").startswith("ollama"), F.lit(0.0)).otherwise((n_in * 0.15 + n_out * 0.6) / 1e6)
    answers = requests.select(
        "request_hash", F.col("case_no").alias("_k"), (seed % 17 == 0).alias("_failed"),
        F.col("provider").alias("response_provider"), F.col("model").alias("response_model_id"),
        F.lit(None).cast("string").alias("response_model"), F.lit("stop").alias("stop_reason"),
        F.lit(None).cast("string").alias("error_message"),
        F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"),
        F.struct(n_in.alias("input"), n_out.alias("output"), F.lit(0).cast("long").alias("cache_read"),
                 F.lit(0).cast("long").alias("cache_write"), (n_in + n_out).alias("total_tokens"),
                 cost.alias("cost_usd")).alias("usage"))
    fields = [c for c in answers.columns if c not in ("request_hash", "_k")]
    one = answers.groupBy("request_hash").agg(F.min_by(F.struct(*fields), F.col("_k")).alias("_r")).where("NOT _r._failed")
    return one.select("request_hash", *[F.col(f"_r.{c}").alias(c) for c in fields if c != "_failed"])
