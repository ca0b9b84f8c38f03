"""Registered queries: one per operator / plan, each over the whole test
tables.  Every callable takes ``(spark, sf_dir)`` and returns a DataFrame
whose column names match the DuckDB oracle in :mod:`.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsre import utf16_length
from ..operators import contract, dedupe, evaluate, route, sanitize, service, store, telemetry
from ..operators.inference import KeywordBackend, RecordedBackend, classify
from ..operators.requests import ModelConfig, build_requests
from . import eval_run, triage
from ..session import prepare
from ..sources import driver_tables as dt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return run
    return register


def _ts_text(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# --------------------------------------------------------------- O1-O4, O28
@query("redact_pii")
def q_redact_pii(spark, sf_dir):
    """O1 on raw subject and text."""
    e = dt.emails(spark, sf_dir)
    return sanitize.redact_pii(e.select("email_id", "subject", F.col("text").alias("body")),
                               ["subject", "body"])


@query("strip_signatures")
def q_strip_signatures(spark, sf_dir):
    """O2 on raw text."""
    e = dt.emails(spark, sf_dir)
    return sanitize.strip_signatures(e.select("email_id", F.col("text").alias("body")), "body")


@query("sanitize_emails")
def q_sanitize_emails(spark, sf_dir):
    """O3: redacted subject, stripped + redacted body."""
    return sanitize.sanitize_emails(dt.emails(spark, sf_dir))


@query("screen_inputs")
def q_screen_inputs(spark, sf_dir):
    """O4 in both modes: eval on raw mail, inbound on sanitized mail."""
    raw = dt.emails(spark, sf_dir).withColumns({"raw_subject": F.col("subject"), "raw_text": F.col("text")})
    clean = sanitize.sanitize_emails(raw, keep=("email_id", "raw_subject", "raw_text"))
    return clean.select(
        "email_id",
        sanitize.screen_flag(F.col("raw_subject"), F.col("raw_text"), "eval").alias("eval_reject_reason"),
        sanitize.screen_flag(F.col("subject"), F.col("body"), "inbound").alias("inbound_reject_reason"),
    )


@query("prescreen")
def q_prescreen(spark, sf_dir):
    """O28 with the default rules; one row per mail, rule NULL = kept."""
    e = dt.emails(spark, sf_dir).select("email_id", "subject", F.col("text").alias("body"))
    return sanitize.prescreen_flag(e).select("email_id", "prescreen_rule")


# ------------------------------------------------------------------ O7-O11
@query("extract_json")
def q_extract_json(spark, sf_dir):
    """O7 on every text block."""
    b = dt.blocks(spark, sf_dir).filter(F.col("type") == "text")
    return contract.extract_json(b, "text").select("run_id", "pos", "json_text")


def _result_cols(prefix: str = "result") -> list:
    return [F.col(f"{prefix}.explanation").alias("explanation"),
            F.col(f"{prefix}.service_type_id").alias("service_type_id"),
            F.col(f"{prefix}.confidence_score").alias("confidence_score"),
            F.col(f"{prefix}.should_alert_admin").alias("should_alert_admin"),
            F.col(f"{prefix}.alert_reason").alias("alert_reason")]


@query("validate_output")
def q_validate_output(spark, sf_dir):
    """O8 on every text block: validity, issue codes and the trimmed result."""
    b = dt.blocks(spark, sf_dir).filter(F.col("type") == "text")
    v = contract.validate_output(b, "text")
    return v.select("run_id", "pos", F.col("result").isNotNull().alias("valid"),
                    F.array_join("issues", "|").alias("issues"), *_result_cols())


@query("first_valid_block")
def q_first_valid_block(spark, sf_dir):
    """O9 per run (block rows form)."""
    winners, _ = contract.first_valid_block_rows(dt.blocks(spark, sf_dir))
    return winners.select("run_id", "winner_pos", "n_blocks", "n_parse_errors", *_result_cols())


@query("safe_fallback")
def q_safe_fallback(spark, sf_dir):
    """O9 + O10 per run: every run ends with a result."""
    winners, _ = contract.first_valid_block_rows(dt.blocks(spark, sf_dir))
    meta = dt.run_meta(spark, sf_dir).select("run_id", "error_message")
    out = contract.safe_fallback(winners.join(meta, "run_id"))
    return out.select("run_id", "fallback", *_result_cols())


@query("resolve_service_type")
def q_resolve_service_type(spark, sf_dir):
    """O11 over free-text service names."""
    s = service.resolve_service_type(dt.service_spellings(spark, sf_dir), "value")
    return s.select("value_id", "value", F.col("service_type.id").alias("service_type_id"),
                    F.col("service_type.label").alias("service_type_label"))


# ---------------------------------------------------------------------- O14
CLAIM_PARTITIONS = 16  # so that keys run over partition bounds at any scale


def _received(spark, sf_dir) -> DataFrame:
    d = dt.deliveries(spark, sf_dir)
    return d.filter(F.col("type") == dt.RECEIVED_TYPE)


@query("claim_deliveries")
def q_claim_deliveries(spark, sf_dir):
    """O14 over all received deliveries (key = email id, ok = no error)."""
    claims = dedupe.claim_deliveries(_received(spark, sf_dir), key="email_id", ts="received_at",
                                     tie="delivery_id", ok="ok", num_partitions=CLAIM_PARTITIONS)
    return claims.select("delivery_id", "email_id", "status", "existing_status",
                         _ts_text(F.col("expires_at")).alias("expires_at"))


# ------------------------------------------------------------------ O5, O6
def _accepted(spark, sf_dir) -> DataFrame:
    ok, _ = sanitize.screen_raw_inbound(dt.emails(spark, sf_dir))
    return ok


@query("build_requests")
def q_build_requests(spark, sf_dir):
    """O5 for accepted sanitized mail, self-hosted configuration."""
    r = build_requests(_accepted(spark, sf_dir), ModelConfig(provider="self-hosted"))
    return r.select("email_id", F.md5("user_prompt").alias("prompt_md5"),
                    utf16_length(F.col("user_prompt")).alias("prompt_length"),
                    "provider", "model", "base_url", "max_tokens", "payload_mode", "response_format")


@query("classify")
def q_classify(spark, sf_dir):
    """O6 with the model-free keyword backend."""
    r = classify(build_requests(_accepted(spark, sf_dir)), KeywordBackend())
    return r.select("email_id", "response_provider", "stop_reason",
                    F.element_at("content", 1)["text"].alias("answer"),
                    F.col("usage.input").alias("input_tokens"))


# ---------------------------------------------------------- O12, O13, O16, O17
def _run_results(spark, sf_dir, with_meta: bool = False) -> DataFrame:
    winners, _ = contract.first_valid_block_rows(dt.blocks(spark, sf_dir))
    meta = dt.run_meta(spark, sf_dir)
    out = contract.safe_fallback(winners.join(meta, "run_id"))
    out = service.resolve_service_type(out, "result.service_type_id")
    extra = [c for c in meta.columns if c != "run_id"] + ["n_parse_errors"] if with_meta else []
    return out.select("run_id", F.col("run_id").alias("email_id"), "fallback", *_result_cols(),
                      F.col("service_type.label").alias("service_type_label"), *extra)


@query("alert_gate")
def q_alert_gate(spark, sf_dir):
    """O12 over per-run results: which runs alert."""
    alerts = F.col("should_alert_admin").eqNullSafe(F.lit(True))
    return _run_results(spark, sf_dir).select("run_id", F.when(alerts, "alert").otherwise("quiet").alias("route"))


@query("build_notifications")
def q_build_notifications(spark, sf_dir):
    """Discord bodies for alerting runs, joined to the raw mail."""
    alerts, _ = route.alert_gate(_run_results(spark, sf_dir))
    return route.build_notifications(alerts, dt.emails(spark, sf_dir), "discord",
                                     "2024-01-01T00:00:00.000Z")


@query("route_notifications")
def q_route_notifications(spark, sf_dir):
    """O13 with a channel per row: sent ones, and the error of each other."""
    alerts, _ = route.alert_gate(_run_results(spark, sf_dir))
    channel = F.element_at(F.array(*[F.lit(c) for c in ("discord", "sms", None)]), (F.col("run_id") % 3 + 1).cast("int"))
    mails = dt.emails(spark, sf_dir).select("email_id", "from", "subject")
    sent, failed = route.route_notifications(alerts, mails, channel, "2024-01-01T00:00:00.000Z")
    return (sent.select("email_id", "channel", F.md5("body_json").alias("body_md5"), F.lit(None).cast("string").alias("error_message"))
            .unionByName(failed.select("email_id", F.lit(None).cast("string").alias("channel"),
                                       F.lit(None).cast("string").alias("body_md5"), "error_message")))


@query("filter_events")
def q_filter_events(spark, sf_dir):
    """Deliveries kept / ignored per webhook type."""
    kept = F.col("type").eqNullSafe(F.lit(route.RECEIVED_TYPE)).alias("kept")
    return dt.deliveries(spark, sf_dir).groupBy("type", kept).agg(F.count(F.lit(1)).alias("n"))


@query("attach_email")
def q_attach_email(spark, sf_dir):
    """Received deliveries with their mail, or the missing-mail error."""
    kept, _ = route.filter_events(dt.deliveries(spark, sf_dir))
    # only the length of a subject enters the join, no text
    mails = dt.emails(spark, sf_dir).select("email_id", utf16_length(F.col("subject")).alias("subject_length"))
    return route.lookup_email(kept.select("delivery_id", "email_id"), mails)


# ---------------------------------------------------------------- P1, P3
def recorded_backend(spark, sf_dir, config: ModelConfig) -> RecordedBackend:
    """Recorded completions for every accepted mail of the table."""
    return RecordedBackend(dt.recorded_responses(build_requests(_accepted(spark, sf_dir), config)))


def triage_outputs(spark, sf_dir, **how) -> dict[str, DataFrame]:
    cfg = ModelConfig()
    mails = dt.emails(spark, sf_dir)
    mails = mails.unionByName(mails.where("email_id % 5 = 0"))  # the mail table repeats rows
    return triage.triage_batch(dt.deliveries(spark, sf_dir), mails,
                               recorded_backend(spark, sf_dir, cfg), cfg,
                               notify_timestamp="2024-01-01T00:00:00.000Z", claim_partitions=CLAIM_PARTITIONS, **how)


@query("triage_batch")
def q_triage_batch(spark, sf_dir):
    """The status of every delivery, with the outcome of processed ones."""
    out = triage_outputs(spark, sf_dir)
    return _triage_rows(out["claims"], out["results"])


def _triage_rows(claims: DataFrame, results: DataFrame) -> DataFrame:
    res = results.select("delivery_id", "service_type_id", "should_alert_admin", "fallback")
    return claims.join(res, "delivery_id", "left").select(
        "delivery_id", "email_id", "status", "existing_status", _ts_text(F.col("expires_at")).alias("expires_at"),
        "service_type_id", "should_alert_admin", "fallback")


@query("triage_summary")
def q_triage_summary(spark, sf_dir):
    """Flagship: how many mails ask for each service type, and how many alert."""
    cfg = ModelConfig()
    results, _ = triage.categorize(_accepted(spark, sf_dir), recorded_backend(spark, sf_dir, cfg), cfg,
                                   "inbound_email")
    return (results.groupBy(F.col("result.service_type_id").alias("service_type_id"),
                            F.col("result.should_alert_admin").alias("should_alert_admin"))
            .agg(F.count(F.lit(1)).alias("n_mails")))


@query("categorize_table")
def q_categorize_table(spark, sf_dir):
    """P3 over the labelled cases with the keyword backend."""
    out = triage.categorize_table(dt.eval_cases(spark, sf_dir), KeywordBackend())
    return out["results"].select("case_no", "service_type_id", "confidence_score", "should_alert_admin",
                                 "fallback", F.col("service_type.label").alias("service_type_label"))


# ------------------------------------------------------ O18-O20, O24, O27
def _telemetry_runs(spark, sf_dir) -> DataFrame:
    """Categorizer runs: per-run results + response metadata + the sanitized
    mail of the same id as the run input."""
    res = _run_results(spark, sf_dir, with_meta=True).drop("email_id")
    # the mail side is pruned by the run ids first
    wanted = res.select("run_id").distinct()
    # join the raw mail first, then sanitize only the mails that have a run
    raw = dt.emails(spark, sf_dir).select(F.col("email_id").alias("run_id"), "subject", "text").join(wanted, "run_id", "left_semi")
    runs = res.join(raw, "run_id", "left").withColumns({
        "subject": sanitize.redact_pii_col(F.col("subject")),
        "body": sanitize.redact_pii_col(sanitize.strip_signature_col(F.coalesce(F.col("text"), F.lit("")))),
    })
    runs = runs.withColumn("body", F.when(F.col("text").isNotNull(), F.col("body"))).drop("text")
    return _run_columns(runs)


RUN_EPOCH = 1_704_067_200  # runs of the rollup start a minute apart from here


def _run_columns(runs: DataFrame) -> DataFrame:
    return runs.select(
        "*",
        F.col("model").alias("model_req"),
        F.when(F.col("run_id") % 2 == 0, F.lit("eval_endpoint")).otherwise(F.lit("inbound_email")).alias("source"),
        F.when(F.col("provider") == "self-hosted", F.lit("http://localhost:11434/v1")).alias("base_url"),
        F.col("model").alias("response_model_id"),
        F.col("provider").alias("response_provider"),
        (F.col("n_parse_errors") > 0).alias("parse_error"),
        F.struct(*[F.col(c).alias(c) for c in ("explanation", "service_type_id", "confidence_score",
                                               "should_alert_admin", "alert_reason")]).alias("result"),
    )


TELEMETRY_QUERY_COLUMNS = [c for c in telemetry.TELEMETRY_COLUMNS if c not in ("started_at", "ended_at")]


@query("run_telemetry")
def q_run_telemetry(spark, sf_dir):
    """Content-free telemetry per run."""
    t = telemetry.run_telemetry(_telemetry_runs(spark, sf_dir))
    return t.select(*TELEMETRY_QUERY_COLUMNS).withColumn("cost_usd", F.round("cost_usd", 9))


def _timed_telemetry(spark, sf_dir) -> DataFrame:
    begun = F.timestamp_seconds(F.lit(RUN_EPOCH) + F.col("run_id") * 60).cast("timestamp_ntz")
    runs = _run_results(spark, sf_dir, with_meta=True).withColumns({
        "started_at": begun, "ended_at": F.timestamp_add("SECOND", F.col("run_id") % 30, begun)})
    return telemetry.run_telemetry(_run_columns(runs))


@query("usage_rollup")
def q_usage_rollup(spark, sf_dir):
    """Runs, errors, tokens, cost and latency per provider/model/source
    and hour."""
    r = telemetry.usage_rollup(_timed_telemetry(spark, sf_dir))
    return r.withColumn("cost_usd", F.round("cost_usd", 9))


@query("usage_levels")
def q_usage_levels(spark, sf_dir):
    """Coarser levels added up from the rollup by hour, sketches merged."""
    levels = telemetry.roll_up(telemetry.usage_rollup(_timed_telemetry(spark, sf_dir), sketch=True))
    # how many latencies the merged sketch stands for; quantiles are compared in the tests
    n = F.kll_sketch_get_n_double("latency_sketch").alias("n_latencies")
    return levels.select("*", n).drop("latency_sketch").withColumn("cost_usd", F.round("cost_usd", 9))


@query("usage_rollup_stream")
def q_usage_rollup_stream(spark, sf_dir):
    """O24 on a stream: windows that the watermark has closed, with quantiles
    (exact here, as a group has fewer runs than the sketch holds)."""
    from ..streaming.runner import run_available_now, scratch_path
    path = scratch_path(spark, "telemetry")
    rows = _timed_telemetry(spark, sf_dir)
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    out = run_available_now(telemetry.usage_rollup_stream(stream, watermark="0 seconds"), "usage")
    out = telemetry.latency_quantiles(out).drop("latency_sketch")
    return out.withColumns({"bucket": F.col("bucket").cast("timestamp_ntz"), "cost_usd": F.round("cost_usd", 9)})


@query("lifecycle_events")
def q_lifecycle_events(spark, sf_dir):
    """O19 over the batch triage run and the eval table: events by name and
    properties."""
    ev = triage_outputs(spark, sf_dir)["events"]
    ev = ev.unionByName(triage.categorize_table(dt.eval_cases(spark, sf_dir), KeywordBackend())["events"])
    props = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(
        e["key"], F.lit("="), e["value"])), "|")
    return ev.groupBy("event", props.alias("properties")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("distinct_id").alias("n_ids"))


@query("quarantine")
def q_quarantine(spark, sf_dir):
    """Every failed delivery of the batch triage run with its cause, and
    every case of the eval table under an unknown model configuration."""
    q = triage_outputs(spark, sf_dir)["quarantine"]
    q = q.select("stage", "email_id", F.get_json_object("context", "$.delivery_id").alias("delivery_id"), "error_message")
    none = triage.categorize_table(dt.eval_cases(spark, sf_dir), KeywordBackend(), ModelConfig(provider="none"))
    return q.unionByName(none["errors"].select(
        F.lit("model").alias("stage"), F.col("case_no").cast("string").alias("email_id"),
        F.lit(None).cast("string").alias("delivery_id"), "error_message"))


@query("result_store")
def q_result_store(spark, sf_dir):
    """Stored rows of the batch triage run, redacted input retained,
    upserted into a date-partitioned table and read back."""
    from ..streaming.runner import scratch_path
    rows = store.result_store(triage_outputs(spark, sf_dir, retain_input=True)["results"], retain_content=True)
    path = scratch_path(spark, "store")
    store.write_result_store(rows, path)
    store.write_result_store(rows.where("email_id % 2 = 0"), path)  # written again: still one copy
    rows = spark.read.parquet(path)
    return rows.select("delivery_id", "email_id", "service_type_id", "confidence_score",
                       "should_alert_admin", "fallback", F.md5("redacted_subject").alias("subject_md5"),
                       F.md5("redacted_body").alias("body_md5"), F.col("dt").cast("string").alias("dt"))


# ------------------------------------------------------- O21-O23, O25, O26
def _verdicts(spark, sf_dir) -> DataFrame:
    cases = dt.eval_cases(spark, sf_dir).withColumn("escaped_body", dt.json_escape(F.col("body")))
    m = evaluate.eval_matrix(cases.drop("description", "body"))
    seed = F.col("case_no") * 10 + F.col("provider_ord")
    out = m.withColumn("output", dt.answer_with(seed, F.col("escaped_body")))
    n_in = (F.lit(900) + F.col("case_no") % 100).cast("long")
    n_out = F.ceil(F.length("output") / 4).cast("long")
    out = out.withColumns({
        "total_tokens": n_in + n_out,
        "cost_usd": F.when(F.col("provider_id").startswith("ollama"), F.lit(0.0))
        .otherwise((n_in * 0.15 + n_out * 0.6) / 1e6),
    })
    return evaluate.score_cases(out.drop("escaped_body")).drop("output")


@query("eval_matrix")
def q_eval_matrix(spark, sf_dir):
    """Labelled cases x the 10 providers."""
    m = evaluate.eval_matrix(dt.eval_cases(spark, sf_dir).select("case_no", "path_type"))
    return m.select("case_no", "provider_id", "provider_label", "max_tokens")


@query("score_cases")
def q_score_cases(spark, sf_dir):
    """The verdict of every (case, provider) output."""
    return _verdicts(spark, sf_dir).select("case_no", "provider_id", "pass", "score", "n_failures",
                                           "n_checks", "contract_pass", "reason")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("pass_rate", "avg_score", "cost_usd")})


@query("eval_summary")
def q_eval_summary(spark, sf_dir):
    """Per provider pass rate, score, tokens, cost."""
    return _rounded(evaluate.eval_summary(_verdicts(spark, sf_dir)))


@query("eval_buckets")
def q_eval_buckets(spark, sf_dir):
    """The summary by language bucket and provider with rollup rows."""
    return _rounded(evaluate.eval_buckets(_verdicts(spark, sf_dir)))


@query("eval_run")
def q_eval_run(spark, sf_dir):
    """O21 -> O5 -> O6 -> O22 -> O23: the labelled cases answered by recordings
    of every provider, summarised."""
    cases = dt.eval_cases(spark, sf_dir).withColumn("escaped_body", dt.json_escape(F.col("body")))
    requests = eval_run.eval_requests(cases)
    verdicts = eval_run.eval_run(requests, RecordedBackend(dt.recorded_eval_responses(requests)))
    failed = F.sum(F.col("model_call_error").isNotNull().cast("long")).alias("failed_calls")
    summary = verdicts.groupBy("provider_id").agg(*evaluate._summary_aggs(), failed)
    return _rounded(summary)


@query("gate_sweep")
def q_gate_sweep(spark, sf_dir):
    """Confusion counts of the alert gate at thresholds 0.5 .. 0.9."""
    return evaluate.gate_sweep(_verdicts(spark, sf_dir))


# ----------------------------------------------------------------- O15, P2
def _delivery_stream(spark, sf_dir) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    events = (spark.readStream.schema(spark.read.parquet(path).schema)
              .option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    return dt.deliveries_from(events)


@query("claim_deliveries_stream")
def q_claim_deliveries_stream(spark, sf_dir):
    """The claim fold as a stateful stream (availableNow run)."""
    from ..streaming.claims import claim_deliveries_stream
    from ..streaming.runner import run_available_now
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    received = _delivery_stream(spark, sf_dir).filter(F.col("type") == dt.RECEIVED_TYPE)
    stream = claim_deliveries_stream(received, key="email_id", ts="received_at", tie="delivery_id", ok="ok",
                                     watermark="30 days")
    claims = run_available_now(stream, "claims")
    return claims.select("delivery_id", "email_id", "status", "existing_status",
                         _ts_text(F.col("expires_at")).alias("expires_at"))


@query("claim_stream")
def q_claim_stream(spark, sf_dir):
    """O15 through the batch fold per micro-batch and the claim ledger."""
    from ..streaming.runner import scratch_path
    from ..streaming.triage_stream import claim_stream
    out_dir = scratch_path(spark, "claims")
    received = _delivery_stream(spark, sf_dir).filter(F.col("type") == dt.RECEIVED_TYPE)
    claim_stream(received, out_dir, key="email_id", ts="received_at", tie="delivery_id", ok="ok",
                 claim_partitions=CLAIM_PARTITIONS).awaitTermination()
    claims = spark.read.parquet(f"{out_dir}/claims")
    return claims.select("delivery_id", "email_id", "status", "existing_status",
                         _ts_text(F.col("expires_at")).alias("expires_at"))


@query("triage_stream")
def q_triage_stream(spark, sf_dir):
    """The streaming triage (availableNow run), the rows of P1."""
    from ..streaming.runner import scratch_path
    from ..streaming.triage_stream import triage_stream
    cfg = ModelConfig()
    out_dir = scratch_path(spark, "triage")
    q = triage_stream(_delivery_stream(spark, sf_dir), dt.emails(spark, sf_dir),
                      recorded_backend(spark, sf_dir, cfg), out_dir, cfg,
                      notify_timestamp="2024-01-01T00:00:00.000Z", claim_partitions=CLAIM_PARTITIONS)
    q.awaitTermination()
    return _triage_rows(spark.read.parquet(f"{out_dir}/claims"), spark.read.parquet(f"{out_dir}/results"))


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)
