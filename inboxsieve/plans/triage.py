"""P1 triage_batch and P3 categorize_table: the operators composed.

P1 (inbound mail, batch): type filter -> distinct ids that no live claim blocks -> mail lookup ->
sanitize -> screen -> requests -> classify (once per distinct request) ->
first valid block -> fallback -> service type; the outcome per mail decides
``ok`` for the claim fold over *all* deliveries; only processed deliveries
give results, alerts, notifications, telemetry and events; every failure is
a quarantine row with its cause.  The responses are checkpointed before they
fan out to the sinks, so the model never runs twice.

Difference to the one-at-a-time service (documented): all deliveries of one
mail in one batch share one classification outcome.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsre import utf16_length
from ..operators import contract, dedupe, route, sanitize, service, telemetry
from ..operators.inference import Backend, KeywordBackend, classify
from ..operators.requests import ModelConfig, build_requests
from ..session import checkpoint

UNKNOWN_MODEL_MESSAGE = "Unknown categorizer model configuration"
RESULT_TYPE = ("struct<explanation:string,service_type_id:string,confidence_score:double,"
               "should_alert_admin:boolean,alert_reason:string>")
UPSTREAM_MESSAGE = "The delivery failed after its mail was categorized"
NO_TIME_MESSAGE = "The delivery has no time of receipt"


def categorize(inputs: DataFrame, backend: Backend, config: ModelConfig | None = None,
               source: str | None = None, key: str = "email_id",
               service_types: list[dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """O5 -> O6 -> O9 -> O10 -> O11 for accepted inputs (``key, subject, body``).

    Returns (results, errors).  Results carry the request/response columns,
    ``result`` (never NULL), ``fallback``, ``parse_error``,
    ``service_type_label``.  Errors (``key, error_message, provider, model,
    subject_length, body_length``) are failed model calls, and every input
    when the model configuration is unknown (errors, not safe fallbacks).

    The responses are checkpointed before they are split, so the backend is
    called once per distinct request however many sinks read the outcome.
    """
    cfg = config or ModelConfig()
    lengths = {"subject_length": utf16_length(F.col("subject")), "body_length": utf16_length(F.col("body"))}
    src = inputs.withColumn("source", F.lit(source).cast("string"))
    error_columns = [key, "error_message", "provider", "model", "subject_length", "body_length"]
    unknown = src.withColumns(lengths).withColumns({
        "error_message": F.lit(UNKNOWN_MODEL_MESSAGE), "provider": F.lit(cfg.provider), "model": F.lit(cfg.model_id),
    }).select(*error_columns)
    if not cfg.known:
        # no call is made; an empty run of the same chain gives the columns
        src, backend = src.where(F.lit(False)), KeywordBackend()
    requests = build_requests(src, cfg, service_types=service_types).withColumns(lengths)
    # validate each distinct answer once, before it meets the request rows
    responses = classify(requests, backend, on_responses=lambda r: contract.first_valid_block(
        r, "content", service_types=service_types))
    responses = checkpoint(responses)
    errors = responses.filter(F.col("model_call_error").isNotNull()).withColumn(
        "error_message", F.col("model_call_error")).select(*error_columns)
    answered = responses.filter(F.col("model_call_error").isNull()).withColumn(
        "content_block_count", F.size("content"))
    results = contract.safe_fallback(answered)
    results = service.resolve_service_type(results, "result.service_type_id", out="service_type",
                                           service_types=service_types)
    results = results.withColumn("service_type_label", F.col("service_type.label"))
    return results, (errors if cfg.known else unknown)


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "service_type_id": F.col("result.service_type_id"),
        "confidence_score": F.col("result.confidence_score"),
        "should_alert_admin": F.col("result.should_alert_admin"),
        "explanation": F.col("result.explanation"),
        "alert_reason": F.col("result.alert_reason"),
    })


def unblocked(kept: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """The ids with a delivery that no live claim of the ledger blocks: only
    these need a mail lookup and a model call."""
    if ledger is None:
        return kept.select("email_id").distinct()
    at = dedupe._micros(F.col("received_at"), kept.schema["received_at"].dataType)
    live = ledger.select(F.col("email_id").alias("_id"), "until")
    return (kept.join(live, kept["email_id"].eqNullSafe(live["_id"]), "left")
            .where(F.col("until").isNull() | (F.col("until") <= at)).select("email_id").distinct())


def triage_batch(deliveries: DataFrame, emails: DataFrame, backend: Backend,
                 config: ModelConfig | None = None, ttl: _dt.timedelta = dedupe.DEFAULT_TTL,
                 channel: str | Column = "discord", notify_timestamp: str = "1970-01-01T00:00:00.000Z",
                 service_types: list[dict] | None = None, ledger: DataFrame | None = None,
                 claim_partitions: int | None = None, retain_input: bool = False,
                 version: str | None = None) -> dict[str, DataFrame]:
    """P1 over a batch of deliveries (``delivery_id, type, email_id,
    received_at`` and optionally ``ok`` for failures outside this job) and a
    mail table (``email_id, from, subject, text``, and ``lookup_error`` where a
    mail could not be fetched).  Of several rows of one id the latest
    ``version`` counts; different ones of one version are a failed lookup.

    ``channel`` is a name or a column expression over the results; an alert
    whose channel is unknown fails its delivery, which releases the claim.

    ``ledger`` (``email_id, until, fin, final``) carries live claims of
    earlier batches; the returned ``ledger`` holds the state after this one.
    Mail whose every delivery is blocked by it is neither looked up nor
    classified.  ``retain_input`` keeps the redacted subject and body on the
    results, for a store that retains them.
    """
    cfg = config or ModelConfig()
    kept, ignored = route.filter_events(deliveries)
    ids = unblocked(kept, ledger)
    # the mails asked for, once for the branch of the found and that of the missing
    looked_up = checkpoint(route.lookup_email(ids, emails, version=version))
    missing = looked_up.where(F.col("error_message").isNotNull()).select("email_id", "error_message")
    found = (looked_up.where(F.col("error_message").isNull()).drop("error_message")
             .withColumn("raw_subject", F.col("subject")))
    accepted, rejected = sanitize.screen_raw_inbound(found, keep=("email_id", "from", "raw_subject"))
    if retain_input:
        accepted = accepted.withColumns({"redacted_subject": F.col("subject"), "redacted_body": F.col("body")})
    results, model_errors = categorize(accepted, backend, cfg, "inbound_email", service_types=service_types)
    alerting = F.col("should_alert_admin").eqNullSafe(F.lit(True))
    results = _flat(results).withColumns({
        "channel": F.lit(channel) if isinstance(channel, str) else channel,
        "notify_error": F.when(alerting, route.channel_error(channel))})
    # read by the claims and by every sink; text is only what notifications need
    results = checkpoint(results)

    no_model = {c: F.lit(None).cast(t) for c, t in (("provider", "string"), ("model", "string"))}
    no_length = {c: F.lit(None).cast("long") for c in ("subject_length", "body_length")}
    columns = ["email_id", "stage", "error_message", "provider", "model", "subject_length", "body_length"]
    # one narrow row per mail that failed, read by several sinks
    failures = checkpoint(missing.withColumns({"stage": F.lit("fetch"), **no_model, **no_length}).select(*columns)
                .unionByName(rejected.withColumns({"stage": F.lit("prompt"), "error_message": F.col("reject_reason"),
                                                   "provider": F.lit(cfg.provider), "model": F.lit(cfg.model_id)})
                             .select(*columns))
                .unionByName(model_errors.withColumn("stage", F.lit("model")).select(*columns))
                .unionByName(results.where(F.col("notify_error").isNotNull()).withColumns(
                    {"stage": F.lit("notify"), "error_message": F.col("notify_error")}).select(*columns)))

    outcome = results.where(F.col("notify_error").isNull()).select("email_id", F.lit(True).alias("_outcome_ok"))
    upstream_ok = F.col("ok") if "ok" in kept.columns else F.lit(True)
    attempts = (kept.join(outcome, "email_id", "left")
                .withColumn("ok", upstream_ok & F.coalesce(F.col("_outcome_ok"), F.lit(False)))
                .drop("_outcome_ok"))
    claims = dedupe.claim_deliveries(attempts, key="email_id", ts="received_at", tie="delivery_id",
                                     ok="ok", ttl=ttl, initial_state=ledger, with_state=True,
                                     num_partitions=claim_partitions)
    # claims feed several sinks: materialise once
    claims = checkpoint(claims)

    # deliveries whose mail was categorized: all processed ones, and those
    # released because their notification failed after that
    categorized = checkpoint(claims.filter(F.col("status").isin(dedupe.PROCESSED, dedupe.RELEASED))
                             .join(results.drop("ok"), "email_id", "inner"))
    processed = categorized.where(F.col("status") == dedupe.PROCESSED)
    categorized = categorized.where((F.col("status") == dedupe.PROCESSED) | F.col("notify_error").isNotNull())
    alerts, _quiet = route.alert_gate(processed)
    notifications = route.build_notifications(alerts, None, F.col("channel"), notify_timestamp)
    skipped = claims.filter(F.col("status") == dedupe.SKIPPED)
    events = telemetry.lifecycle_events(
        received=kept, skipped=skipped, categorized=categorized, alerts=alerts,
        fallbacks=categorized.filter(F.col("fallback")), channel=F.col("channel"))
    run_id = F.concat_ws(":", F.col("email_id").cast("string"), F.col("delivery_id").cast("string")).alias("run_id")
    runs = categorized.withColumn("run_id", run_id)
    released = (claims.filter(F.col("status") == dedupe.RELEASED).select("email_id", "delivery_id", "received_at")
                .join(failures, "email_id", "left"))
    # a claimed delivery of mail that could not be categorized ran the
    # categorizer too: no prompt, or a failed model call (an error, not a fallback)
    failed_runs = released.where(F.col("stage").isin("prompt", "model")).select(
        run_id, F.lit("inbound_email").alias("source"), "provider", "model",
        F.lit(cfg.resolved_base_url).cast("string").alias("base_url"), "subject_length", "body_length",
        (F.col("stage") == "prompt").alias("prompt_error"),
        F.when(F.col("stage") == "model", F.col("error_message")).alias("model_call_error"),
        F.lit(None).cast(RESULT_TYPE).alias("result"))
    tel = telemetry.run_telemetry(runs).unionByName(telemetry.run_telemetry(failed_runs))
    # one row per failed delivery, with its real cause
    invalid = claims.filter(F.col("status") == dedupe.INVALID).select(
        "email_id", "delivery_id", F.lit("delivery").alias("stage"), F.lit(NO_TIME_MESSAGE).alias("error_message"))
    causes = released.select(
        "email_id", "delivery_id", F.coalesce("stage", F.lit("delivery")).alias("stage"),
        F.coalesce("error_message", F.lit(UPSTREAM_MESSAGE)).alias("error_message")).unionByName(invalid)
    errors = telemetry.quarantine(*((stage, causes.where(F.col("stage") == stage).drop("stage"))
                                    for stage in ("fetch", "prompt", "model", "notify", "delivery")))
    result_cols = ["delivery_id", "email_id", "received_at", "service_type_id", "service_type_label",
                   "confidence_score", "should_alert_admin", "explanation", "alert_reason", "fallback",
                   "parse_error"] + (["redacted_subject", "redacted_body"] if retain_input else [])
    return {
        "results": processed.select(*result_cols),
        "alerts": alerts.select(*result_cols),
        "notifications": notifications,
        "claims": claims.drop("state_until", "state_fin", "state_final"),
        "ledger": dedupe.ledger_rows(claims, "email_id", "received_at", "delivery_id"),
        "ignored": ignored,
        "events": events,
        "telemetry": tel,
        "quarantine": errors,
    }


EVAL_FIELDS = ["explanation", "service_type_id", "confidence_score", "should_alert_admin", "alert_reason"]


def categorize_table(cases: DataFrame, backend: Backend, config: ModelConfig | None = None,
                     key: str = "case_no", service_types: list[dict] | None = None,
                     at: Column | None = None) -> dict[str, DataFrame]:
    """Eval screening on the raw text (no redaction), categorization with
    source ``eval_endpoint``, the 6-field projection and its events.  ``at``:
    the time of the run, which its events carry."""
    accepted, rejected = sanitize.screen_inputs(cases.select(key, "subject", "body"), "eval")
    results, errors = categorize(accepted.withColumnRenamed(key, "email_id"), backend, config,
                                 "eval_endpoint", service_types=service_types)
    results = _flat(results).withColumnRenamed("email_id", key)
    if at is not None:
        results = results.withColumn("received_at", at)
    projected = results.select(key, *EVAL_FIELDS, "service_type", "fallback")
    events = telemetry.lifecycle_events(
        eval_results=results,
        fallbacks=results.filter(F.col("fallback")))
    errors = errors.withColumnRenamed("email_id", key)
    cfg = config or ModelConfig()
    failed_runs = errors.select(
        F.col(key).cast("string").alias("run_id"), F.lit("eval_endpoint").alias("source"), "provider", "model",
        F.lit(cfg.resolved_base_url).cast("string").alias("base_url"), "subject_length", "body_length",
        F.col("error_message").alias("model_call_error"), F.lit(None).cast(RESULT_TYPE).alias("result"))
    runs = results.withColumn("run_id", F.col(key).cast("string"))
    return {"results": projected, "rejected": rejected, "errors": errors, "events": events,
            "telemetry": telemetry.run_telemetry(runs).unionByName(telemetry.run_telemetry(failed_runs))}
