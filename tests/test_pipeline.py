"""P1/P2/P3 and the live-backend path on small literal tables."""

import datetime as dt
import json
import sys

import pandas as pd
from pyspark.sql import functions as F

from inboxsieve.operators.inference import PandasBackend, RESPONSE_SCHEMA, classify
from inboxsieve.operators.requests import ModelConfig, build_requests
from inboxsieve.plans.triage import categorize_table, triage_batch
from inboxsieve.streaming.triage_stream import triage_stream

from pyspark import cloudpickle  # noqa: E402

# the test backend class must travel to the Python workers by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

T0 = dt.datetime(2024, 1, 1)
ANSWER = json.dumps({"explanation": "Quote for stump grinding.", "serviceTypeId": "stumpGrinding",
                     "confidenceScore": 0.9, "shouldAlertAdmin": True, "alertReason": "Listed service."})


class EchoBackend(PandasBackend):
    """Answers every request with a fixed valid JSON (stands in for a live model)."""

    def complete(self, pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        return pd.DataFrame({
            "request_hash": pdf["request_hash"], "response_provider": ["echo"] * n,
            "response_model_id": ["echo-1"] * n, "response_model": [None] * n, "stop_reason": ["stop"] * n,
            "error_message": [None] * n, "content": [[{"type": "text", "text": ANSWER}]] * n,
            "usage": [{"input": 10, "output": 5, "cache_read": 0, "cache_write": 0, "total_tokens": 15,
                       "cost_usd": 0.0}] * n,
        })


def emails(spark):
    return spark.createDataFrame([
        (1, "a@x.io", "Stump", "Please quote stump grinding.\n\nThanks,\nAl"),
        (2, "b@x.io", "", "no subject"),
        (3, "c@x.io", "Trim", "Trim my tree"),
    ], "email_id long, from string, subject string, text string")


def deliveries(spark, rows):
    return spark.createDataFrame(
        [(i, t, e, T0 + dt.timedelta(days=d)) for i, (t, e, d) in enumerate(rows)],
        "delivery_id long, type string, email_id long, received_at timestamp_ntz")


ROWS = [("email.received", 1, 0), ("email.received", 1, 1), ("email.opened", 1, 2), ("email.received", 2, 0),
        ("email.received", 9, 0), ("email.received", 3, 3), ("email.received", 1, 8), ("email.received", 3, 9)]


def test_pandas_backend_dedupes_and_answers(spark):
    req = build_requests(emails(spark).withColumnRenamed("text", "body").filter("subject <> ''"))
    out = classify(req.unionByName(req), EchoBackend(partitions=2))
    assert out.count() == 4 and out.filter(F.col("model_call_error").isNotNull()).count() == 0


def test_triage_batch_end_to_end(spark):
    out = triage_batch(deliveries(spark, ROWS), emails(spark), EchoBackend(), ModelConfig())
    status = {r["delivery_id"]: r["status"] for r in out["claims"].collect()}
    # mail 1: claimed day 0, skipped day 1, claimed again day 8; mail 2: no subject -> released;
    # mail 9: no such mail -> released; mail 3: day 3 claimed, day 9 skipped
    assert status == {0: "processed", 1: "skipped", 3: "released", 4: "released", 5: "processed",
                      6: "processed", 7: "skipped"}
    assert out["alerts"].count() == 3 and out["notifications"].count() == 3
    q = {(r["stage"], r["email_id"]) for r in out["quarantine"].collect()}
    assert ("fetch", "9") in q and ("prompt", "2") in q
    events = {r["event"]: r["n"] for r in out["events"].groupBy("event").agg(F.count("*").alias("n")).collect()}
    assert events["inbound_email_received"] == 7 and events["email_processing_skipped"] == 2
    assert events["admin_alert_sent"] == 3
    assert set(out["telemetry"].columns) >= {"subject_length", "body_length", "total_tokens"}


def test_stream_over_two_batches_matches_batch(spark, tmp_path):
    src = tmp_path / "deliveries"
    d = deliveries(spark, ROWS)
    d.filter("delivery_id < 4").coalesce(1).write.parquet(str(src / "part1"))
    d.filter("delivery_id >= 4").coalesce(1).write.parquet(str(src / "part2"))
    stream = (spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(str(src)))
    q = triage_stream(stream, emails(spark), EchoBackend(), str(tmp_path / "out"), ModelConfig())
    q.awaitTermination()
    claims = spark.read.parquet(str(tmp_path / "out" / "claims"))
    assert claims.select("batch_id").distinct().count() == 2
    got = {r["delivery_id"]: r["status"] for r in claims.collect()}
    want = {r["delivery_id"]: r["status"]
            for r in triage_batch(d, emails(spark), EchoBackend(), ModelConfig())["claims"].collect()}
    assert got == want


def test_categorize_table_eval_projection(spark):
    cases = spark.createDataFrame([(1, "Stump", "quote please"), (2, " ", "x")],
                                  "case_no long, subject string, body string")
    out = categorize_table(cases, EchoBackend())
    res = out["results"].collect()
    assert [r["case_no"] for r in res] == [1] and res[0]["service_type"]["label"] == "Stump grinding"
    assert out["rejected"].count() == 1


def test_prompt_errors_reach_telemetry(spark):
    out = triage_batch(deliveries(spark, ROWS), emails(spark), EchoBackend(), ModelConfig())
    tel = out["telemetry"]
    errs = tel.filter("prompt_error").collect()
    assert [r["run_id"] for r in errs] == ["2:3"]
    assert errs[0]["subject_length"] == 0 and errs[0]["body_length"] == len("no subject")
    assert tel.filter("NOT prompt_error").count() == 3


class SilentBackend(PandasBackend):
    """Returns no answer for any request (a failed model call)."""

    def complete(self, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series(dtype="object") for c in RESPONSE_SCHEMA.fieldNames()})


def test_model_errors_are_errors_not_fallbacks(spark):
    out = triage_batch(deliveries(spark, ROWS[:2]), emails(spark), SilentBackend(), ModelConfig())
    assert [r["status"] for r in out["claims"].orderBy("delivery_id").collect()] == ["released", "released"]
    assert out["results"].count() == 0
    stages = {r["stage"] for r in out["quarantine"].collect()}
    assert stages == {"model"} and out["quarantine"].count() == 2  # one row per failed delivery, with its cause
    tel = out["telemetry"].collect()
    assert len(tel) == 2 and all(r["model_error"] and not r["prompt_error"] for r in tel)
    assert all(r["subject_length"] == len("Stump") and r["body_length"] > 0 for r in tel)


class CountingBackend(EchoBackend):
    """Leaves a file for every request it is asked, in a folder."""

    def __init__(self, folder):
        super().__init__()
        self.folder = str(folder)

    def complete(self, pdf: pd.DataFrame) -> pd.DataFrame:
        import os
        import uuid
        for h in pdf["request_hash"]:
            open(os.path.join(self.folder, f"{h[:12]}-{uuid.uuid4().hex}"), "w").close()
        return super().complete(pdf)

    def calls(self):
        import os
        return len(os.listdir(self.folder))


def test_one_call_per_request_however_many_sinks_are_written(spark, tmp_path):
    backend = CountingBackend(tmp_path)
    out = triage_batch(deliveries(spark, ROWS), emails(spark), backend, ModelConfig())
    for df in out.values():
        df.write.format("noop").mode("overwrite").save()
    assert backend.calls() == 2  # mails 1 and 3; mail 2 has no subject, mail 9 does not exist


def test_blocked_mail_is_neither_looked_up_nor_classified(spark, tmp_path):
    first = triage_batch(deliveries(spark, ROWS[:2]), emails(spark), EchoBackend(), ModelConfig())
    backend = CountingBackend(tmp_path)
    again = deliveries(spark, [("email.received", 1, d) for d in (2, 3, 4)])
    out = triage_batch(again, emails(spark).where("email_id <> 1"), backend, ModelConfig(), ledger=first["ledger"])
    assert {r["status"] for r in out["claims"].collect()} == {"skipped"}
    assert backend.calls() == 0 and out["quarantine"].count() == 0


def test_unknown_configuration_is_an_error_of_every_mail(spark):
    cfg = ModelConfig(provider="none")
    out = triage_batch(deliveries(spark, ROWS[:2]), emails(spark), EchoBackend(), cfg)
    assert {r["status"] for r in out["claims"].collect()} == {"released"} and out["results"].count() == 0
    q = out["quarantine"].collect()
    assert {(r["stage"], r["error_message"]) for r in q} == {("model", "Unknown categorizer model configuration")}
    assert all(r["model_error"] for r in out["telemetry"].collect())
    cases = spark.createDataFrame([(1, "Stump", "quote please")], "case_no long, subject string, body string")
    table = categorize_table(cases, EchoBackend(), cfg)
    assert table["results"].count() == 0 and table["errors"].count() == 1 and table["telemetry"].count() == 1


def test_a_failed_lookup_is_not_a_missing_mail(spark):
    mails = emails(spark).withColumn("lookup_error", F.when(F.col("email_id") == 3, "quota"))
    out = triage_batch(deliveries(spark, ROWS), mails, EchoBackend(), ModelConfig())
    got = {r["email_id"]: (r["stage"], r["error_message"]) for r in out["quarantine"].collect()}
    assert got["3"] == ("fetch", "Error fetching email: quota")
    assert got["9"] == ("fetch", "The mail service did not return email data") and got["2"][0] == "prompt"


def test_upstream_failures_and_missing_times_have_their_own_cause(spark):
    d = deliveries(spark, ROWS[:2]).withColumn("ok", F.col("delivery_id") != 0)
    d = d.unionByName(d.where("delivery_id = 1").withColumns({"delivery_id": F.lit(7).cast("long"),
                                                              "received_at": F.lit(None).cast("timestamp_ntz")}))
    out = triage_batch(d, emails(spark), EchoBackend(), ModelConfig())
    got = {json.loads(r["context"])["delivery_id"]: (r["stage"], r["error_message"]) for r in out["quarantine"].collect()}
    assert got == {0: ("delivery", "The delivery failed after its mail was categorized"),
                   7: ("delivery", "The delivery has no time of receipt")}


CUSTOM = [{"id": "mowing", "label": "Mowing", "description": "Cutting grass."},
          {"id": "unknown", "label": "Unknown", "description": "Anything else."}]


class MowingBackend(EchoBackend):
    def complete(self, pdf: pd.DataFrame) -> pd.DataFrame:
        out = super().complete(pdf)
        out["content"] = [[{"type": "text", "text": ANSWER.replace("stumpGrinding", "mowing")}]] * len(out)
        return out


def test_configured_service_types_reach_the_contract(spark):
    out = triage_batch(deliveries(spark, ROWS), emails(spark), MowingBackend(), ModelConfig(), service_types=CUSTOM)
    assert {(r["service_type_id"], r["fallback"]) for r in out["results"].collect()} == {("mowing", False)}
    built_in = triage_batch(deliveries(spark, ROWS), emails(spark), MowingBackend(), ModelConfig())
    assert {(r["service_type_id"], r["fallback"]) for r in built_in["results"].collect()} == {("unknown", True)}


def test_recordings_of_another_model_are_no_answer(spark):
    from inboxsieve.operators.inference import RecordedBackend
    mails = emails(spark).withColumnRenamed("text", "body").filter("subject <> ''")
    asked = build_requests(mails, ModelConfig())
    other = build_requests(mails, ModelConfig(model="gpt-4.1-mini"))
    answers = [classify(r, EchoBackend()).select(*RESPONSE_SCHEMA.fieldNames()) for r in (asked, other, asked)]
    recorded = RecordedBackend(answers[0].unionByName(answers[1]).unionByName(answers[2]))
    out = classify(asked, recorded)
    assert out.count() == 2 and out.where("model_call_error IS NOT NULL").count() == 0
    assert classify(asked, RecordedBackend(answers[1])).where("model_call_error IS NULL").count() == 0


def test_the_ledger_read_stays_bounded(spark, tmp_path):
    """Over many batches: few files, old claims gone, the state whole."""
    import os
    from inboxsieve.streaming.triage_stream import claim_ledger, close_ledger, live_claims
    day = 24 * 3600 * 10 ** 6
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        ledger = claim_ledger(spark, str(tmp_path / "ledger"), "email_id", "bigint", every=5)
        most = 0
        for batch in range(60):
            rows = spark.createDataFrame([(batch // 2, (batch + 7) * day, batch * day, "processed")],
                                         "email_id long, until long, fin long, final string").coalesce(1)
            close_ledger(ledger, rows, batch, batch * day, dt.timedelta(days=7))
            folders = [f for _, f in ledger.parts(batch + 1)]
            most = max(most, sum(f.endswith(".parquet") for d in folders for f in os.listdir(tmp_path / "ledger" / d)))
            assert len(ledger._deltas()) <= 11 and len(ledger._names("snapshots")) <= 2
        assert most <= 8
        live = {r["email_id"]: r["until"] // day for r in live_claims(ledger, 60, 59 * day).collect()}
        assert live == {k // 2: k + 7 for k in range(53, 60, 2)}  # the later batch of each key
        assert ledger.read(60).count() < 20 and live_claims(ledger, 60, None) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_a_retried_batch_leaves_no_stale_claim(spark, tmp_path):
    from inboxsieve.streaming.triage_stream import claim_ledger, close_ledger, live_claims
    day = 24 * 3600 * 10 ** 6
    ledger = claim_ledger(spark, str(tmp_path / "ledger"), "email_id", "bigint", every=2)
    make = lambda key, until: spark.createDataFrame(
        [(key, until * day, 0, "processed")], "email_id long, until long, fin long, final string")
    for batch, (key, until) in enumerate([(1, 7), (2, 8), (3, 9)]):
        close_ledger(ledger, make(key, until), batch, batch * day, dt.timedelta(days=7))
    before = sorted(map(tuple, live_claims(ledger, 3, 0).collect()))
    close_ledger(ledger, make(4, 30), 3, 3 * day, dt.timedelta(days=7))  # writes a snapshot, then fails
    assert sorted(map(tuple, live_claims(ledger, 3, 0).collect())) == before
    close_ledger(ledger, make(4, 10), 3, 3 * day, dt.timedelta(days=7))  # the claim ends on another day now
    assert {r["email_id"]: r["until"] // day for r in ledger.read(4).collect()} == {1: 7, 2: 8, 3: 9, 4: 10}


def test_claims_of_a_stream_through_the_batch_fold(spark, tmp_path):
    """A key with most rows of every trigger, over many Arrow batches and range
    partitions, against the fold over the whole table."""
    import os
    from inboxsieve.operators import dedupe
    from inboxsieve.streaming.triage_stream import claim_stream
    rows = [(0 if i % 4 else i % 9, T0 + dt.timedelta(minutes=11 * i), i, i % 5 > 0) for i in range(9000)]
    df = spark.createDataFrame(rows, "key long, ts timestamp_ntz, delivery_id long, ok boolean")
    for k in range(3):
        df.where(f"delivery_id BETWEEN {3000 * k} AND {3000 * k + 2999}").coalesce(1).write.parquet(str(tmp_path / "src" / f"p{k}"))
    stream = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
              .parquet(str(tmp_path / "src")))
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    left = lambda: sum(len(f) for _, _, f in os.walk(folder))
    before = left()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        claim_stream(stream, str(tmp_path / "out"), claim_partitions=8, compact_every=2).awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert left() <= before  # no checkpoint of a micro-batch is left
    columns = ["delivery_id", "status", "existing_status", "expires_at"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out" / "claims")).select(*columns).collect()))
    assert got == sorted(map(tuple, dedupe.claim_deliveries(df).select(*columns).collect()))


def test_repeated_mail_rows_are_one_mail(spark):
    mails = emails(spark)
    out = triage_batch(deliveries(spark, ROWS[:1]), mails.unionByName(mails).repartition(5), EchoBackend(), ModelConfig())
    assert [(r["delivery_id"], r["status"]) for r in out["claims"].collect()] == [(0, "processed")]
    assert out["results"].count() == out["notifications"].count() == out["telemetry"].count() == 1


def test_the_latest_version_of_a_mail_counts(spark):
    from inboxsieve.operators.route import attach_email, one_mail
    rows = [(1, "old", T0, "a"), (1, "new", T0 + dt.timedelta(days=1), "b"), (1, "older", None, "c"),
            (2, "x", T0, "a"), (2, "y", T0, "a"), (2, "x", None, "a"), (3, "same", None, "a"), (3, "same", None, "a"),
            (None, "nobody", T0, "a")]
    mails = spark.createDataFrame(rows, "email_id long, subject string, fetched_at timestamp_ntz, text string")
    for parts in (1, 4):
        got = {r["email_id"]: (r["subject"], r["lookup_error"])
               for r in one_mail(mails.repartition(parts), version="fetched_at").collect()}
        assert got[1] == ("new", None) and got[3] == ("same", None) and got.keys() == {1, 2, 3}
        assert got[2][1] == "Several different mails have this id"
    asked = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, 4), (14, None)], "delivery_id long, email_id long")
    found, missing = attach_email(asked, mails, version="fetched_at")
    assert sorted((r["delivery_id"], r["subject"]) for r in found.collect()) == [(10, "new"), (11, "new")]
    assert {r["delivery_id"]: r["error_message"] for r in missing.collect()} == {
        12: "Several different mails have this id", 13: "The mail service did not return email data",
        14: "The mail service did not return email data"}


def test_an_unknown_channel_fails_its_delivery_alone(spark):
    """Mixed channels in one batch: the unknown one is released, with its
    cause; it was categorized, but not alerted."""
    channel = F.when(F.col("email_id") == 3, F.lit("pager")).otherwise(F.lit("discord"))
    out = triage_batch(deliveries(spark, ROWS), emails(spark), EchoBackend(), ModelConfig(), channel=channel)
    status = {r["delivery_id"]: r["status"] for r in out["claims"].collect()}
    assert status == {0: "processed", 1: "skipped", 3: "released", 4: "released", 5: "released", 6: "processed", 7: "released"}
    q = [(r["email_id"], r["error_message"]) for r in out["quarantine"].where("stage = 'notify'").collect()]
    assert q == [("3", "Unsupported notification channel: pager")] * 2
    assert {r["email_id"] for r in out["notifications"].collect()} == {1} == {r["email_id"] for r in out["results"].collect()}
    events = {(r["event"], r["distinct_id"]) for r in out["events"].collect()}
    assert ("email_categorized", "3") in events and ("admin_alert_sent", "3") not in events
    assert {r["email_id"] for r in out["ledger"].where("final = 'processed'").collect()} == {1}


def test_channels_are_chosen_row_by_row(spark):
    from inboxsieve.operators.route import route_notifications
    rows = [(1, "discord"), (2, "pager"), (3, None)]
    alerts = spark.createDataFrame([(i, c, "a@x.io", "S", "Label", "why") for i, c in rows],
                                   "email_id long, via string, from string, raw_subject string, service_type_label string, explanation string")
    sent, failed = route_notifications(alerts, channel=F.col("via"))
    assert [r["email_id"] for r in sent.collect()] == [1]
    assert sorted((r["email_id"], r["error_message"]) for r in failed.collect()) == [
        (2, "Unsupported notification channel: pager"), (3, "Unsupported notification channel: null")]
    sent, failed = route_notifications(alerts, channel="pager")
    assert sent.count() == 0 and failed.count() == 3


def test_every_event_of_a_delivery_has_its_time(spark):
    out = triage_batch(deliveries(spark, ROWS), emails(spark), MowingBackend(), ModelConfig())
    events = out["events"]
    assert events.where("event = 'categorizer_fallback_result'").count() == 3
    assert events.where("ts IS NULL").count() == 0
    cases = spark.createDataFrame([(1, "Stump", "quote please")], "case_no long, subject string, body string")
    table = categorize_table(cases, MowingBackend(), at=F.lit(T0))
    assert {r["ts"] for r in table["events"].collect()} == {T0} and table["events"].count() == 2


def test_retained_input_is_redacted(spark):
    mails = emails(spark).withColumn("text", F.concat("text", F.lit(" mail me at x@y.com")))
    out = triage_batch(deliveries(spark, ROWS[:1]), mails, EchoBackend(), ModelConfig(), retain_input=True)
    row = out["results"].first()
    assert row["redacted_subject"] == "Stump" and "x@y.com" not in row["redacted_body"]


class Moody(CountingBackend):
    """Raises on the subjects in ``bad``; ends the process on those in ``kill``."""

    def __init__(self, folder, store=None, bad=(), kill=(), batch_rows=3):
        super().__init__(folder)
        self.store, self.bad, self.kill, self.batch_rows = store, bad, kill, batch_rows

    def complete(self, pdf: pd.DataFrame) -> pd.DataFrame:
        import os
        for prompt in pdf["user_prompt"]:
            if any(k in prompt for k in self.kill):
                os._exit(1)
            if any(b in prompt for b in self.bad):
                raise ConnectionError("no route")
        return super().complete(pdf)


def _asked(spark, n):
    rows = [(i, f"subject {i:03d}", "please quote") for i in range(n)]
    return build_requests(spark.createDataFrame(rows, "email_id long, subject string, body string").coalesce(1))


def test_a_failed_call_concerns_one_request(spark, tmp_path):
    out = classify(_asked(spark, 8), Moody(tmp_path, bad=("subject 004",))).collect()
    errors = {r["email_id"]: r["model_call_error"] for r in out if r["model_call_error"] is not None}
    assert errors == {4: "ConnectionError: no route"} and len(out) == 8
    assert all(r["content"][0]["text"] == ANSWER for r in out if r["email_id"] != 4)
    mails = emails(spark)
    whole = triage_batch(deliveries(spark, ROWS), mails, Moody(tmp_path, bad=("Trim my tree",)), ModelConfig())
    status = {r["delivery_id"]: r["status"] for r in whole["claims"].collect()}
    assert status[0] == "processed" and status[5] == status[7] == "released"
    assert {(r["email_id"], r["error_message"]) for r in whole["quarantine"].where("stage = 'model'").collect()} == {
        ("3", "ConnectionError: no route")}


def test_answered_requests_are_not_asked_again(spark, tmp_path):
    """A batch is killed in the middle and run again."""
    import os

    import pytest
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    requests = _asked(spark, 12)
    with pytest.raises(Exception):  # noqa: B017 - the worker dies
        classify(requests, Moody(calls, store, kill=("subject 007",))).collect()
    assert 0 < len(os.listdir(calls)) < 12  # calls of three requests before the one that ends the process
    again = Moody(calls, store, bad=("subject 009",))
    out = classify(requests, again).collect()
    assert {r["email_id"] for r in out if r["model_call_error"] is not None} == {9} and len(out) == 12
    assert again.calls() == 11  # every other request once, in both runs together
    again.bad = ()
    again.compact(spark)
    out = classify(requests, again).checkpoint()
    assert out.where("model_call_error IS NULL").count() == 12 and again.calls() == 12
    first = {r["email_id"]: r["content"] for r in out.collect()}
    assert {c[0]["text"] for c in first.values()} == {ANSWER}
    assert classify(requests, Moody(calls, store)).where("usage.total_tokens = 15").count() == 12 and again.calls() == 12
