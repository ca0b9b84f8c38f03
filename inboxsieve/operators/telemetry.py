"""O18 run_telemetry, O19 lifecycle_events, O20 quarantine, O24 usage_rollup.

Telemetry is content-free by construction: :data:`TELEMETRY_COLUMNS` is an
allow-list of lengths, ids, flags, token counts and cost; no subject, body,
prompt, raw output or explanation text can reach it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsre import js_trim, utf16_length

FEATURE_NAME = "categorizer"
SOURCE_MAX = 64
NO_PERSON_PROFILE = "$process_person_profile"
SERVICE_DISTINCT_ID = "email-triage"  # distinct id of events that belong to no mail
# The traffic sources the categorizer accepts from metadata.
TRAFFIC_SOURCES = ("eval_endpoint", "inbound_email")

TELEMETRY_COLUMNS = [
    "run_id", "feature_name", "source", "provider", "request_model", "base_url_host", "subject_length",
    "body_length", "response_provider", "response_model", "stop_reason", "content_block_count", "model_error",
    "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens", "cost_usd",
    "service_type_id", "confidence_score", "should_alert_admin", "explanation_length", "alert_reason_length",
    "parse_error", "prompt_error", "fallback", "started_at", "ended_at",
]


def _finite(col: Column) -> Column:
    """Non-finite numbers are dropped (NULL), as the span attributes drop them."""
    d = col.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(None)).otherwise(col)


def source_label(source: Column) -> Column:
    """Whitelisted (other values count as absent), trimmed, cut to 64,
    default ``unknown``."""
    t = F.substring(js_trim(F.when(source.isin(*TRAFFIC_SOURCES), source)), 1, SOURCE_MAX)
    return F.when(t.isNull() | (t == ""), F.lit("unknown")).otherwise(t)


def url_host(url: Column) -> Column:
    """``new URL(x).host`` (retrying with ``http://``), ``invalid`` when both fail.

    A bare ``host:port`` parses as a scheme in the URL standard and has no
    host, so it yields NULL.
    """
    t = js_trim(url)
    has_scheme = t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    direct = F.try_parse_url(t, F.lit("AUTHORITY"))
    retried = F.try_parse_url(F.concat(F.lit("http://"), t), F.lit("AUTHORITY"))
    raw = (F.when(t.isNull() | (t == ""), F.lit(None))
           .when(direct.isNotNull(), direct)
           .when(has_scheme, F.lit(None))
           .when(retried.isNotNull(), retried)
           .otherwise(F.lit("invalid")))
    host = F.lower(F.regexp_replace(raw, r"^.*@", ""))
    scheme = F.lower(F.when(direct.isNotNull(), F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
                     .otherwise(F.lit("http")))
    default_port = (F.when(scheme.isin("http", "ws"), F.lit(":80")).when(scheme.isin("https", "wss"), F.lit(":443"))
                    .when(scheme == "ftp", F.lit(":21")))
    host = F.when(default_port.isNotNull() & host.endswith(default_port),
                  host.substr(F.lit(1), F.length(host) - F.length(default_port))).otherwise(host)
    return F.when(raw == "invalid", raw).when(host == "", F.lit(None)).otherwise(host)


def run_telemetry(runs: DataFrame) -> DataFrame:
    """One content-free row per categorizer run.

    ``runs`` carries the run input (``source, provider, model, base_url,
    subject, body``), the response (``response_provider, response_model_id,
    response_model, stop_reason, error_message, content_block_count,
    usage``), the ``result`` struct and the flags ``parse_error,
    prompt_error, fallback`` plus ``started_at/ended_at`` when known.
    """
    has = set(runs.columns)

    def opt(name, cast="string"):
        return F.col(name) if name in has else F.lit(None).cast(cast)

    model_error = ((opt("stop_reason") == "error")
                   | (opt("error_message").isNotNull() & (opt("error_message") != ""))
                   | opt("model_call_error").isNotNull())
    usage = F.col("usage") if "usage" in has else F.lit(None).cast(
        "struct<input:bigint,output:bigint,cache_read:bigint,cache_write:bigint,total_tokens:bigint,"
        "cost_usd:double>")
    return runs.select(
        "run_id",
        F.lit(FEATURE_NAME).alias("feature_name"),
        source_label(opt("source")).alias("source"),
        opt("provider").alias("provider"),
        opt("model").alias("request_model"),
        url_host(opt("base_url")).alias("base_url_host"),
        (F.col("subject_length") if "subject_length" in has else utf16_length(opt("subject"))
         ).cast("long").alias("subject_length"),
        (F.col("body_length") if "body_length" in has else utf16_length(opt("body"))
         ).cast("long").alias("body_length"),
        opt("response_provider").alias("response_provider"),
        F.coalesce(opt("response_model"), opt("response_model_id")).alias("response_model"),
        opt("stop_reason").alias("stop_reason"),
        opt("content_block_count", "long").cast("long").alias("content_block_count"),
        F.coalesce(model_error, F.lit(False)).alias("model_error"),
        usage["input"].alias("input_tokens"),
        usage["output"].alias("output_tokens"),
        usage["cache_read"].alias("cache_read_tokens"),
        usage["cache_write"].alias("cache_write_tokens"),
        usage["total_tokens"].alias("total_tokens"),
        _finite(usage["cost_usd"]).alias("cost_usd"),
        F.col("result.service_type_id").alias("service_type_id"),
        _finite(F.col("result.confidence_score")).alias("confidence_score"),
        F.col("result.should_alert_admin").alias("should_alert_admin"),
        utf16_length(F.col("result.explanation")).alias("explanation_length"),
        utf16_length(F.col("result.alert_reason")).alias("alert_reason_length"),
        F.coalesce(opt("parse_error", "boolean"), F.lit(False)).alias("parse_error"),
        F.coalesce(opt("prompt_error", "boolean"), F.lit(False)).alias("prompt_error"),
        F.coalesce(opt("fallback", "boolean"), F.lit(False)).alias("fallback"),
        opt("started_at", "timestamp").alias("started_at"),
        opt("ended_at", "timestamp").alias("ended_at"),
    )


def event_rows(df: DataFrame, event: str, distinct_id: Column, props: dict[str, Column],
               ts: Column | None = None) -> DataFrame:
    """Rows of one analytics event: ``distinct_id, event, properties, ts``."""
    pairs = []
    for k, v in props.items():
        pairs += [F.lit(k), v.cast("string")]
    pairs += [F.lit(NO_PERSON_PROFILE), F.lit("false")]
    props_map = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    return df.select(distinct_id.cast("string").alias("distinct_id"), F.lit(event).alias("event"),
                     props_map.alias("properties"),
                     (ts if ts is not None else F.lit(None)).cast("timestamp_ntz").alias("ts"))


def lifecycle_events(received: DataFrame | None = None, skipped: DataFrame | None = None,
                     categorized: DataFrame | None = None, alerts: DataFrame | None = None,
                     eval_results: DataFrame | None = None, fallbacks: DataFrame | None = None,
                     channel: str | Column = "discord", service_id: str = SERVICE_DISTINCT_ID) -> DataFrame | None:
    """The six analytics events as one table (``unionByName``).

    received: ``email_id, received_at``; skipped: ``email_id,
    existing_status, received_at``; categorized/alerts: ``email_id,
    service_type_id, service_type_label, confidence_score,
    should_alert_admin``; eval_results: ``service_type_id,
    confidence_score, should_alert_admin``; fallbacks: ``provider, model,
    stop_reason, error_message, source``.  An event's time is the row's
    ``received_at`` (NULL where there is none).  ``channel``: a name or a
    column of the alerts.
    """
    parts = []
    ts = lambda df, c="received_at": F.col(c) if c in df.columns else None
    if received is not None:
        parts.append(event_rows(received, "inbound_email_received", F.col("email_id"), {}, ts(received)))
    if skipped is not None:
        parts.append(event_rows(skipped, "email_processing_skipped", F.col("email_id"),
                                {"existing_status": F.col("existing_status")}, ts(skipped)))
    if categorized is not None:
        parts.append(event_rows(categorized, "email_categorized", F.col("email_id"), {
            "service_type_id": F.col("service_type_id"), "service_type_label": F.col("service_type_label"),
            "confidence_score": F.col("confidence_score"), "should_alert_admin": F.col("should_alert_admin"),
        }, ts(categorized)))
    if alerts is not None:
        parts.append(event_rows(alerts, "admin_alert_sent", F.col("email_id"), {
            "service_type_id": F.col("service_type_id"), "service_type_label": F.col("service_type_label"),
            "notification_channel": F.lit(channel) if isinstance(channel, str) else channel}, ts(alerts)))
    if eval_results is not None:
        parts.append(event_rows(eval_results, "eval_email_categorized", F.lit(service_id), {
            "service_type_id": F.col("service_type_id"), "confidence_score": F.col("confidence_score"),
            "should_alert_admin": F.col("should_alert_admin")}, ts(eval_results)))
    if fallbacks is not None:
        parts.append(event_rows(fallbacks, "categorizer_fallback_result", F.lit(service_id), {
            "provider": F.col("provider"), "model_id": F.col("model"), "stop_reason": F.col("stop_reason"),
            "has_model_error": F.col("error_message").isNotNull() & (F.col("error_message") != ""),
            "source": source_label(F.col("source"))}, ts(fallbacks)))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quarantine(*errors: tuple[str, DataFrame], key: str = "email_id") -> DataFrame | None:
    """Error rows of all stages as one table: ``stage, key, error_name,
    error_message, context`` (context = the row's other columns as JSON).

    Each input is ``(stage, df)`` where df has ``key`` and ``error_message``
    (and optionally ``error_name``)."""
    parts = []
    for stage, df in errors:
        ctx_cols = [c for c in df.columns if c not in (key, "error_message", "error_name")
                    and c not in ("subject", "body", "text", "user_prompt", "system_prompt", "content")]
        parts.append(df.select(
            F.lit(stage).alias("stage"),
            F.col(key).cast("string").alias(key),
            (F.col("error_name") if "error_name" in df.columns else F.lit("Error")).alias("error_name"),
            F.col("error_message").alias("error_message"),
            (F.to_json(F.struct(*ctx_cols)) if ctx_cols else F.lit(None).cast("string")).alias("context"),
        ))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Size of the quantile sketch; the rank of a quantile is off by 1.65 %
#: at most with 99 % confidence at 200 (Karnin, Lang, Liberty 2016).
SKETCH_K = 200
QUANTILES = {"p50_latency_s": 0.5, "p95_latency_s": 0.95}


def usage_rollup(telemetry: DataFrame, by: tuple[str, ...] = ("provider", "request_model", "source"),
                 time_col: str | None = "started_at", unit: str = "hour", sketch: bool = False) -> DataFrame:
    """Runs, error and fallback counts, tokens, cost and latency per
    group (and per ``date_trunc(unit, time_col)`` when given).  A plain
    partial (map-side) aggregation.  ``sketch`` adds ``latency_sketch``, from
    which :func:`roll_up` makes coarser levels."""
    keys = [F.col(c) for c in by]
    if time_col:
        keys.append(F.date_trunc(unit, F.col(time_col)).alias("bucket"))
    out = telemetry.groupBy(*keys).agg(*_usage_aggs(), *([_latency_sketch()] if sketch else []))
    return out


def _latency() -> Column:
    return (F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6


def _latency_sketch() -> Column:
    """A mergeable sketch of the latencies (NULL without any)."""
    return F.kll_sketch_agg_double(_latency(), SKETCH_K).alias("latency_sketch")


COUNTS = ("runs", "model_errors", "parse_errors", "fallbacks", "alerts", "input_tokens", "output_tokens",
          "total_tokens", "cost_usd")


def _usage_aggs() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("runs"),
        F.sum(F.col("model_error").cast("long")).alias("model_errors"),
        F.sum(F.col("parse_error").cast("long")).alias("parse_errors"),
        F.sum(F.col("fallback").cast("long")).alias("fallbacks"),
        F.sum(F.col("should_alert_admin").cast("long")).alias("alerts"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("cost_usd").alias("cost_usd"),
        F.avg(_latency()).alias("avg_latency_s"),
    ]


def latency_quantiles(rollup: DataFrame) -> DataFrame:
    """A rollup with ``p50_latency_s`` and ``p95_latency_s`` from its sketches."""
    n = F.kll_sketch_get_n_double("latency_sketch")
    return rollup.withColumns({name: F.when(n > 0, F.kll_sketch_get_quantile_double("latency_sketch", F.lit(q)))
                               for name, q in QUANTILES.items()})


def roll_up(rollup: DataFrame, by: tuple[str, ...] = ("provider", "request_model", "source", "bucket")) -> DataFrame:
    """Coarser levels of a rollup that has sketches (``ROLLUP(by)``): counts
    are added, sketches merged, no run is read again.  ``level`` is the number
    of leading columns of ``by`` that a row is grouped by."""
    level = F.lit(len(by)) - F.bit_count(F.grouping_id())  # a bit for each column added up over
    return rollup.rollup(*by).agg(
        level.cast("int").alias("level"), *[F.sum(c).alias(c) for c in COUNTS],
        F.kll_merge_agg_double("latency_sketch", SKETCH_K).alias("latency_sketch"))


def usage_rollup_stream(telemetry: DataFrame, by: tuple[str, ...] = ("provider", "request_model", "source"),
                        time_col: str = "started_at", window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """O24 on a stream: the rollup per event-time window with its sketch,
    written in append mode once the watermark has passed a window's end."""
    event_time = telemetry.withColumn("_at", F.col(time_col).cast("timestamp")).withWatermark("_at", watermark)
    keys = [F.window("_at", window).alias("_w"), *[F.col(c) for c in by]]
    out = event_time.groupBy(*keys).agg(*_usage_aggs(), _latency_sketch())
    return out.select(F.col("_w.start").alias("bucket"), *[c for c in out.columns if c != "_w"])
