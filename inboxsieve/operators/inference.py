"""O6 classify: one completion per distinct request, from a swappable backend.

Backends:

* :class:`RecordedBackend` - recorded responses keyed by ``request_hash``
  (prompt, provider and model; a join; deterministic; what tests and the
  bench use);
* :class:`KeywordBackend` - a model-free classifier built from native
  expressions over the service labels (the design asks for a categorizer
  that works without a model at all);
* :class:`PandasBackend` - a user class whose ``complete(pdf) -> pdf`` is run
  with ``mapInPandas`` on Arrow batches (live model clients plug in here).

Requests are de-duplicated on ``request_hash`` before the backend runs, so
repeated mails cost one call; callers join the responses back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsre import utf16_length
from ..functions.service_types import SERVICE_TYPES, UNKNOWN_ID
from ..session import data_files, delete, exists

CONTENT_TYPE = T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()), T.StructField("text", T.StringType())]))
USAGE_TYPE = T.StructType([
    T.StructField("input", T.LongType()), T.StructField("output", T.LongType()),
    T.StructField("cache_read", T.LongType()), T.StructField("cache_write", T.LongType()),
    T.StructField("total_tokens", T.LongType()), T.StructField("cost_usd", T.DoubleType())])
RESPONSE_SCHEMA = T.StructType([
    T.StructField("request_hash", T.StringType()),
    T.StructField("response_provider", T.StringType()),
    T.StructField("response_model_id", T.StringType()),
    T.StructField("response_model", T.StringType()),
    T.StructField("stop_reason", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("content", CONTENT_TYPE),
    T.StructField("usage", USAGE_TYPE),
])
MISSING_RESPONSE = "No completion returned for the request"


class Backend:
    """Turns distinct requests (``request_hash, system_prompt, user_prompt,
    provider, model, ...``) into responses with :data:`RESPONSE_SCHEMA`."""

    def respond(self, requests: DataFrame) -> DataFrame:
        raise NotImplementedError

    def respond_rows(self, requests: DataFrame, on_responses=None) -> DataFrame:
        """Responses joined to every request row.  Default: distinct requests
        go to :meth:`respond` once, ``on_responses`` (e.g. validation) runs
        on those distinct answers, and they are joined back on the hash; the
        text columns never enter the join."""
        responses = one_per_request(self.respond(self.distinct(requests)))
        if on_responses is not None:
            responses = on_responses(responses)
        return _narrow(requests).join(responses, "request_hash", "left")

    def distinct(self, requests: DataFrame) -> DataFrame:
        """One row per request.  With an id column the choice is made on
        narrow columns, so the prompts are not shuffled to find copies."""
        key = next((c for c in ("email_id", "case_no") if c in requests.columns), None)
        if key is None:
            return requests.dropDuplicates(["request_hash"])
        chosen = (requests.groupBy("request_hash").agg(F.min(key).alias("_first"))
                  .withColumnRenamed("request_hash", "_hash"))
        first = (requests["request_hash"] == chosen["_hash"]) & (requests[key].eqNullSafe(chosen["_first"]))
        rows = requests.join(chosen, first, "left_semi")
        # ids may repeat in the input: then copies of one row are left
        return rows.dropDuplicates(["request_hash"]) if self.ids_repeat else rows

    #: Set to False if the id column is known to be unique.
    ids_repeat = True


def one_per_request(responses: DataFrame) -> DataFrame:
    """The least of a request's responses (recordings may repeat)."""
    fields = [c for c in responses.columns if c != "request_hash"]
    one = responses.groupBy("request_hash").agg(F.min(F.struct(*fields)).alias("_r"))
    return one.select("request_hash", *[F.col(f"_r.{c}").alias(c) for c in fields])


# Request columns holding mail or prompt text: dropped before any shuffle.
TEXT_COLUMNS = ("subject", "body", "text", "user_prompt", "system_prompt")


def _narrow(requests: DataFrame) -> DataFrame:
    return requests.drop(*[c for c in TEXT_COLUMNS if c in requests.columns])


class RecordedBackend(Backend):
    """Responses recorded earlier, keyed by request hash (left join)."""

    def __init__(self, recorded: DataFrame):
        self.recorded = recorded.select(*RESPONSE_SCHEMA.fieldNames())

    def respond(self, requests: DataFrame) -> DataFrame:
        return requests.select("request_hash").join(one_per_request(self.recorded), "request_hash", "left")

    def respond_rows(self, requests: DataFrame, on_responses=None) -> DataFrame:
        # a lookup: one left join of the narrow request rows; answers are
        # post-processed once per recording, not once per request row
        recorded = one_per_request(self.recorded)
        recorded = recorded if on_responses is None else on_responses(recorded)
        return _narrow(requests).join(recorded, "request_hash", "left")


# ---------------------------------------------------------------------------
# Fixed values of our model-free classifier (not part of the reference
# contract): phrases per service type, in definition order, and quote words.
# ---------------------------------------------------------------------------
KEYWORDS = {
    "stumpGrinding": ["stump grind", "grind the stump", "grinding the stump", "stump ground"],
    "stumpRemoval": ["stump remov", "remove the stump", "root ball", "stump removed"],
    "rootRemoval": ["root remov", "remove the roots", "exposed root", "roots"],
    "treePruning": ["prune", "pruning", "trimming", "trim ", "limbs", "branches"],
}
QUOTE_WORDS = ["quote", "estimate", "price", "pricing", "cost"]
# ---------------------------------------------------------------------------


def _contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | (F.instr(text, w) > 0)
    return out


class KeywordBackend(Backend):
    """A deterministic, model-free categorizer as native expressions."""

    provider = "keyword"
    model = "keyword-v1"

    def answer(self, subject: Column, body: Column) -> Column:
        text = F.lower(F.concat_ws("\n", subject, body))
        sid = F.lit(UNKNOWN_ID)
        for type_id in reversed([t["id"] for t in SERVICE_TYPES if t["id"] in KEYWORDS]):
            sid = F.when(_contains_any(text, KEYWORDS[type_id]), F.lit(type_id)).otherwise(sid)
        quote = _contains_any(text, QUOTE_WORDS)
        listed = sid != UNKNOWN_ID
        score = F.when(quote & listed, F.lit(0.9)).when(listed, F.lit(0.5)).when(quote, F.lit(0.3)) \
            .otherwise(F.lit(0.1))
        alert = quote & listed
        reason = F.when(alert, F.lit("Quote request for a listed service.")) \
            .otherwise(F.lit("Not an actionable quote request for a listed service."))
        return F.to_json(F.struct(
            F.when(quote, F.lit("The sender asks for a quote.")).otherwise(
                F.lit("The sender does not ask for a quote.")).alias("explanation"),
            sid.alias("serviceTypeId"), score.alias("confidenceScore"),
            alert.alias("shouldAlertAdmin"), reason.alias("alertReason")))

    def respond(self, requests: DataFrame) -> DataFrame:
        return self.respond_rows(requests).select(*RESPONSE_SCHEMA.fieldNames())

    def respond_rows(self, requests: DataFrame, on_responses=None) -> DataFrame:
        # pure expressions: answered in the same projection, no join
        if on_responses is not None:
            return on_responses(self.respond_rows(requests))
        text = self.answer(F.col("subject"), F.col("body"))
        n_in = F.ceil(utf16_length(F.col("user_prompt")) / 4).cast("long")
        return requests.select(
            *[c for c in requests.columns if c not in TEXT_COLUMNS],
            F.lit(self.provider).alias("response_provider"),
            F.lit(self.model).alias("response_model_id"),
            F.lit(None).cast("string").alias("response_model"),
            F.lit("stop").alias("stop_reason"),
            F.lit(None).cast("string").alias("error_message"),
            F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"),
            F.struct(n_in.alias("input"), F.lit(60).cast("long").alias("output"),
                     F.lit(0).cast("long").alias("cache_read"), F.lit(0).cast("long").alias("cache_write"),
                     (n_in + 60).alias("total_tokens"), F.lit(0.0).alias("cost_usd")).alias("usage"),
        )


CALL_FIELDS = ["request_hash", "system_prompt", "user_prompt", "provider", "model", "max_tokens", "temperature",
               "payload_mode"]
CALL_ERROR = "call_error"
CALL_SCHEMA = T.StructType([*RESPONSE_SCHEMA.fields, T.StructField(CALL_ERROR, T.StringType())])


class PandasBackend(Backend):
    """Base for backends that call code per Arrow batch (e.g. an HTTP model
    client).  Subclasses implement :meth:`complete`; it receives a pandas
    frame with ``request_hash, system_prompt, user_prompt, provider, model,
    max_tokens, temperature, payload_mode`` and returns one row per request
    with the :data:`RESPONSE_SCHEMA` columns.

    A failure concerns one request only: if ``complete`` raises for several
    requests, they are asked one by one, and one that raises alone gives a row
    with ``call_error`` (an error, not an answer).

    With ``store`` (a folder all tasks can write, as an URL or path that
    pyarrow opens) every answer is kept before the next call is made:
    :meth:`respond` asks only what the store does not have, so a batch that is
    killed and run again repeats no answered call.  Failed calls are not kept.
    The store is a table of small files; :meth:`compact` merges them.
    """

    def __init__(self, partitions: int | None = None, batch_rows: int = 64, store: str | None = None):
        self.partitions = partitions
        self.batch_rows = batch_rows
        self.store = store

    def complete(self, pdf: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def _ask(self, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Answers of some requests, and an error row for each that raises."""
        try:
            yield self.complete(pdf)
        except Exception as e:
            if len(pdf) > 1:
                for k in range(len(pdf)):
                    yield from self._ask(pdf.iloc[k:k + 1].reset_index(drop=True))
            else:
                row = dict.fromkeys(RESPONSE_SCHEMA.fieldNames())
                yield pd.DataFrame([row | {"request_hash": pdf["request_hash"][0],
                                           CALL_ERROR: f"{type(e).__name__}: {e}"}], dtype=object)

    def answered(self, spark: SparkSession) -> DataFrame | None:
        """The answers kept in the store."""
        if not self.store or not exists(spark, self.store):
            return None
        return one_per_request(spark.read.schema(RESPONSE_SCHEMA).parquet(self.store))

    def compact(self, spark: SparkSession) -> None:
        """Merge the store's files.  The old ones go when the new ones are
        there; in between a request may stand twice, which readers allow."""
        known = self.answered(spark)
        if known is not None:
            old = data_files(spark, self.store)
            known.write.mode("append").parquet(self.store)
            for path in old:
                delete(spark, path)

    def respond(self, requests: DataFrame) -> DataFrame:
        known = self.answered(requests.sparkSession)
        reqs = requests.select(*CALL_FIELDS)
        if known is not None:
            reqs = reqs.join(known.select("request_hash"), "request_hash", "left_anti")
        if self.partitions:
            reqs = reqs.repartition(self.partitions, "request_hash")
        ask, size, store = self._ask, self.batch_rows, self.store
        columns = CALL_SCHEMA.fieldNames()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for start in range(0, len(pdf), size):
                    for rows in ask(pdf.iloc[start:start + size].reset_index(drop=True)):
                        if CALL_ERROR not in rows:
                            rows = rows.assign(**{CALL_ERROR: pd.Series([None] * len(rows), dtype=object)})
                        rows = rows[columns]
                        if store:
                            _keep(store, rows[rows[CALL_ERROR].isna()])
                        yield rows

        calls = reqs.mapInPandas(run, CALL_SCHEMA)
        if known is None:
            return calls
        asked = known.join(requests.select("request_hash"), "request_hash", "left_semi")
        return asked.withColumn(CALL_ERROR, F.lit(None).cast("string")).unionByName(calls)


def _keep(store: str, rows: pd.DataFrame) -> None:
    """Add answers to the store: a file is written under a name that readers
    pass over and then renamed, so that a half-written one is never read."""
    if not len(rows):
        return
    import uuid

    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs
    from pyspark.sql.pandas.types import to_arrow_schema

    system, folder = fs.FileSystem.from_uri(store)
    system.create_dir(folder, recursive=True)
    name = uuid.uuid4().hex
    records = rows[RESPONSE_SCHEMA.fieldNames()].to_dict("records")
    clean = [{k: None if isinstance(v, float) and pd.isna(v) else v for k, v in r.items()} for r in records]
    pq.write_table(pa.Table.from_pylist(clean, to_arrow_schema(RESPONSE_SCHEMA)), f"{folder}/_{name}", filesystem=system)
    system.move(f"{folder}/_{name}", f"{folder}/{name}.parquet")


def classify(requests: DataFrame, backend: Backend, on_responses=None) -> DataFrame:
    """Responses for every request row (text columns dropped; keep
    lengths or ids before calling when they are needed later).

    For backends that call out (``PandasBackend``), distinct requests go to
    the backend once and the responses are joined back on ``request_hash``;
    recorded answers are a single lookup join, keyword answers a projection.
    ``on_responses`` (DataFrame -> DataFrame) runs on the distinct answers
    before they are joined to the request rows.  A request whose call raised,
    or without a response, gets ``model_call_error`` (a failed call is an
    error, not a safe fallback).
    """
    joined = backend.respond_rows(requests, on_responses)
    raised = F.col(CALL_ERROR) if CALL_ERROR in joined.columns else F.lit(None).cast("string")
    return joined.withColumn("model_call_error", F.coalesce(
        raised, F.when(F.col("content").isNull() & F.col("error_message").isNull(), F.lit(MISSING_RESPONSE)))
    ).drop(CALL_ERROR)
