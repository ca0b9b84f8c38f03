"""O5 build_requests: render the model request of every mail.

The prompt is a literal template with the subject and body spliced in by
``concat`` (the service list is rendered once on the driver); the model
configuration is resolved once on the driver and added as literal columns.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.service_types import UNKNOWN_ID, prompt_json, service_ids

# ---------------------------------------------------------------------------
# System prompt and user prompt template.
# ---------------------------------------------------------------------------
SYSTEM_PROMPT = ("You are an email categorization specialist that reviews inbound emails and "
                 "determines their intent.")

PROMPT_HEAD = f"""Determine if the provided email is asking for a quote/estimate from the business based on the subject and body contents.
For valid quote/estimate requests, infer the most likely service type from the serviceTypes list below. If the email asks about multiple listed services, choose the primary or most prominent listed service.
The serviceTypeId field must be exactly one of the ids from serviceTypes. Use "{UNKNOWN_ID}" if the requested service is unclear, does not match the list, or the email is not asking for a quote/estimate.
If the email is not asking for a quote/estimate, set serviceTypeId to "{UNKNOWN_ID}", use a confidenceScore of 0.3 or lower, set shouldAlertAdmin to false, and explain that this is not a quote request.
If serviceTypeId is "{UNKNOWN_ID}", use a confidenceScore below 0.7 and set shouldAlertAdmin to false so callers do not treat it as an actionable service request.
The confidenceScore field must be a number between 0 and 1 that reflects confidence in both quote intent and service type.
Set shouldAlertAdmin to true when the email is an actionable quote/estimate request for at least one listed service type and the confidenceScore is above 0.7. Multi-service requests should still alert when at least one requested service is listed and the best matching serviceTypeId is clear. Otherwise set shouldAlertAdmin to false.
The alertReason field must explain why an admin should or should not be alerted.

serviceTypes:
{{service_types}}

Return only valid JSON. Do not include markdown, comments, or explanatory text outside the JSON.

Expected response format:
{{{{
  "explanation": "The sender is asking the business for a quote.",
  "serviceTypeId": "stumpGrinding",
  "confidenceScore": 0.92,
  "shouldAlertAdmin": true,
  "alertReason": "The sender is requesting an estimate for stump grinding, which is a listed service."
}}}}

Input:
Subject: """
PROMPT_BODY_LABEL = "\nEmail Body: "

# Model configuration defaults.
DEFAULT_PROVIDER = "openai"
DEFAULT_MODEL = "gpt-4o-mini"
DEFAULT_SELF_HOSTED_MODEL = "gemma4:e4b"
DEFAULT_SELF_HOSTED_BASE_URL = "http://localhost:11434/v1"
DEFAULT_SELF_HOSTED_CONTEXT_WINDOW = 4096
DEFAULT_SELF_HOSTED_MAX_TOKENS = 1200
PROVIDER_API = {"openai": "openai-responses", "anthropic": "anthropic-messages",
                "google": "google-generative-ai", "self-hosted": "openai-completions"}
# ---------------------------------------------------------------------------


def prompt_head(service_types: list[dict] | None = None) -> str:
    return PROMPT_HEAD.format(service_types=prompt_json(service_types))


def user_prompt_col(subject: Column, body: Column, service_types: list[dict] | None = None) -> Column:
    return F.concat(F.lit(prompt_head(service_types)), subject, F.lit(PROMPT_BODY_LABEL), body)


def template_prompt(service_types: list[dict] | None = None) -> str:
    """The single-text form used by direct evals: system + user prompt with
    ``{{subject}}``/``{{body}}`` placeholders."""
    return (f"{SYSTEM_PROMPT}\n\n{prompt_head(service_types)}{{{{subject}}}}"
            f"{PROMPT_BODY_LABEL}{{{{body}}}}\n")


def _positive_int(value) -> int | None:
    try:
        n = int(str(value).strip())
    except (TypeError, ValueError):
        return None
    return n if n > 0 and str(n) == str(value).strip() else None


@dataclass(frozen=True)
class ModelConfig:
    """Resolved model configuration (driver-side, constant per run).

    ``settings`` replaces the process environment of a service: keys
    ``model``, ``base_url``, ``max_tokens``, ``context_window``.
    """

    provider: str = DEFAULT_PROVIDER
    model: str | None = None
    base_url: str | None = None
    max_tokens: int | None = None
    temperature: float = 0.0
    settings: dict = field(default_factory=dict)

    @property
    def model_id(self) -> str:
        if self.model:
            return self.model
        if self.settings.get("model"):
            return self.settings["model"]
        return DEFAULT_SELF_HOSTED_MODEL if self.provider == "self-hosted" else DEFAULT_MODEL

    @property
    def resolved_base_url(self) -> str | None:
        if self.base_url:
            return self.base_url
        if self.settings.get("base_url"):
            return self.settings["base_url"]
        return DEFAULT_SELF_HOSTED_BASE_URL if self.provider == "self-hosted" else None

    @property
    def resolved_max_tokens(self) -> int | None:
        n = self.max_tokens if self.max_tokens is not None else _positive_int(self.settings.get("max_tokens"))
        if n is None and self.provider == "self-hosted":
            return DEFAULT_SELF_HOSTED_MAX_TOKENS
        return n

    @property
    def api(self) -> str | None:
        return PROVIDER_API.get(self.provider)

    @property
    def known(self) -> bool:
        if self.provider == "self-hosted":
            return bool(self.resolved_base_url)
        return self.provider in PROVIDER_API

    @property
    def context_window(self) -> int | None:
        if self.provider != "self-hosted":
            return None
        return _positive_int(self.settings.get("context_window")) or DEFAULT_SELF_HOSTED_CONTEXT_WINDOW

    @property
    def payload_mode(self) -> str:
        if self.api == "openai-responses":
            return "json_schema"
        if self.provider == "self-hosted":
            return "json_object"
        return "unchanged"


#: The name of the response format, and the JSON schema's bounds.
RESPONSE_FORMAT_NAME = "email_categorization"


def output_schema(service_types: list[dict] | None = None) -> dict:
    """The JSON schema of an answer; the ids follow the configured types."""
    text = {"type": "string", "minLength": 1}
    fields = {"explanation": text, "serviceTypeId": {"type": "string", "enum": service_ids(service_types)},
              "confidenceScore": {"type": "number", "minimum": 0, "maximum": 1},
              "shouldAlertAdmin": {"type": "boolean"}, "alertReason": text}
    return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}


def response_format(payload_mode: str, service_types: list[dict] | None = None) -> str | None:
    """What a request's payload gets for the answer's format, as JSON."""
    if payload_mode == "json_schema":
        form = {"type": "json_schema", "name": RESPONSE_FORMAT_NAME, "strict": True, "schema": output_schema(service_types)}
        return json.dumps({"text": {"format": form}}, separators=(",", ":"))
    if payload_mode == "json_object":
        return json.dumps({"response_format": {"type": "json_object"}, "think": False}, separators=(",", ":"))
    return None


def request_key(user_prompt: Column, provider: Column, model: Column) -> Column:
    """One key per request: another provider's or model's answer is no answer.
    Never NULL, so that joins on it infer no filter that would run the prompt
    chain once more below the join."""
    return request_key_of(prompt_hash(user_prompt), provider, model)


def prompt_hash(user_prompt: Column) -> Column:
    return F.sha2(F.coalesce(user_prompt, F.lit("")), 256)


def request_key_of(prompt: Column, provider: Column, model: Column) -> Column:
    """:func:`request_key` from a prompt's hash, for many requests of one prompt."""
    part = lambda c: F.coalesce(c, F.lit(""))
    # sha2 may be NULL by its type, so joins would infer the filter without this
    return part(F.sha2(F.concat_ws("\n", prompt, part(provider), part(model)), 256))


def build_requests(df: DataFrame, config: ModelConfig | None = None, subject: str = "subject",
                   body: str = "body", service_types: list[dict] | None = None) -> DataFrame:
    """Add ``system_prompt, user_prompt, request_hash`` and the resolved
    model options (``provider, model, api, base_url, max_tokens,
    temperature, context_window, payload_mode, response_format``)."""
    cfg = config or ModelConfig()
    prompt = user_prompt_col(F.col(subject), F.col(body), service_types)
    return (df.withColumn("user_prompt", prompt)
              .withColumns({
                  "system_prompt": F.lit(SYSTEM_PROMPT),
                  # non-nullable on purpose: joins on the hash then infer no
                  # isnotnull() filter that would re-run the whole prompt
                  # chain below the join
                  "request_hash": request_key(F.col("user_prompt"), F.lit(cfg.provider), F.lit(cfg.model_id)),
                  "provider": F.lit(cfg.provider),
                  "model": F.lit(cfg.model_id),
                  "api": F.lit(cfg.api).cast("string"),
                  "base_url": F.lit(cfg.resolved_base_url).cast("string"),
                  "max_tokens": F.lit(cfg.resolved_max_tokens).cast("int"),
                  "temperature": F.lit(float(cfg.temperature)),
                  "context_window": F.lit(cfg.context_window).cast("int"),
                  "payload_mode": F.lit(cfg.payload_mode),
                  "response_format": F.lit(response_format(cfg.payload_mode, service_types)).cast("string"),
              }))
