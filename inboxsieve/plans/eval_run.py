"""The eval run: O21 cases x providers -> O5 one request each -> O6 answers ->
O22 verdicts (-> O23 / O25 summaries).

A request is keyed by prompt, provider and model, so each provider's answer is
its own.  A case whose call failed is scored as an output that is no JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate
from ..operators.inference import Backend, classify
from ..operators.requests import prompt_hash, request_key_of, user_prompt_col

EXPECTED = ["expected_service_type_id", "expected_service_type_ids", "expected_should_notify", "min_confidence",
            "max_confidence"]


def eval_requests(cases: DataFrame, providers: list[dict] | None = None, pattern: str | None = None,
                  first_n: int | None = None, service_types: list[dict] | None = None) -> DataFrame:
    """One request per (case, provider); the prompt is rendered, hashed and
    measured (``prompt_length``) once per case."""
    prompted = cases.withColumn("user_prompt", user_prompt_col(F.col("subject"), F.col("body"), service_types))
    prompted = prompted.withColumns({"_prompt": prompt_hash(F.col("user_prompt")),
                                     "prompt_length": F.length("user_prompt")})
    matrix = evaluate.eval_matrix(prompted, providers, pattern, first_n)
    provider = F.substring_index("provider_id", ":", 1)
    return matrix.withColumns({"provider": provider, "model": F.col("provider_id"),
                               "request_hash": request_key_of(F.col("_prompt"), provider, F.col("provider_id"))}).drop("_prompt")


def eval_run(requests: DataFrame, backend: Backend, service_types: list[dict] | None = None) -> DataFrame:
    """A verdict per request (see :func:`evaluate.score_cases`), with
    ``model_call_error, total_tokens, cost_usd``."""
    answered = classify(requests, backend)
    first_text = F.element_at(F.filter("content", lambda b: b["type"] == "text"), 1)["text"]
    output = F.when(F.col("model_call_error").isNull(), first_text)
    rows = answered.select("case_no", "path_type", "provider_id", "provider_ord", *EXPECTED, "model_call_error",
                           output.alias("output"), F.col("usage.total_tokens").alias("total_tokens"),
                           F.col("usage.cost_usd").alias("cost_usd"))
    return evaluate.score_cases(rows, service_types=service_types).drop("output")
