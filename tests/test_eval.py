"""Assertion scoring on the labelled cases, summaries, sweep."""

import json

from pyspark.sql import functions as F

from inboxsieve.operators import evaluate

CASE_COLS = ("case_no long, path_type string, expected_service_type_id string, expected_service_type_ids string, "
             "expected_should_notify string, min_confidence string, max_confidence string, output string")


def out(sid, score, alert, **extra):
    d = {"explanation": "x", "serviceTypeId": sid, "confidenceScore": score, "shouldAlertAdmin": alert,
         "alertReason": "y"}
    d.update(extra)
    return json.dumps(d)


def score(spark, rows):
    df = spark.createDataFrame(rows, CASE_COLS)
    return {r["case_no"]: r for r in evaluate.score_cases(df).collect()}


def test_reference_case_shapes(spark):
    rows = [
        # happy: single id, min 0.7
        (1, "happy", "rootRemoval", None, "true", "0.7", None, out("rootRemoval", 0.9, True)),
        # sad: unknown, max 0.3, model too confident
        (2, "sad", "unknown", None, "false", None, "0.3", out("unknown", 0.5, False)),
        # plural ids win over the single id
        (3, "happy", None, "stumpRemoval,rootRemoval", "true", "0.55", None, out("rootRemoval", 0.6, True)),
        # plural of only commas -> no id expectation
        (4, "happy", "treePruning", " , ", "true", None, None, out("stumpGrinding", 0.9, True)),
        # missing expectation adds a failure but not a check
        (5, "sad", "unknown", None, "maybe", None, None, out("unknown", 0.1, False)),
        # blank-space min -> 0 ; invalid id fails twice
        (6, "sad", "unknown", None, "false", " ", None, out("lawnMowing", 0.1, False)),
        # unparseable output
        (7, "sad", "unknown", None, "false", None, None, "no json here"),
        # extra keys are fine for the eval (not for the contract)
        (8, "happy", "treePruning", None, " TRUE ", None, None, out("treePruning", 0.95, True, extra=1)),
    ]
    r = score(spark, rows)
    assert r[1]["pass"] and r[1]["score"] == 1.0 and r[1]["n_checks"] == 9
    assert not r[2]["pass"] and r[2]["n_failures"] == 1 and r[2]["score"] == 8 / 9
    assert r[3]["pass"] and r[3]["n_checks"] == 9
    assert r[4]["pass"] and r[4]["n_checks"] == 7
    assert not r[5]["pass"] and r[5]["n_checks"] == 7 and r[5]["n_failures"] == 1
    assert r[6]["n_failures"] == 2 and r[6]["n_checks"] == 9
    assert not r[7]["pass"] and r[7]["score"] == 0.0 and not r[7]["parsed"]
    assert r[8]["pass"] and not r[8]["contract_pass"]


def test_eval_pass_but_contract_fail_is_counted(spark):
    rows = [(1, "happy", None, "stumpGrinding,treePruning", "true", "0.55", None, out("stumpGrinding", 0.6, True))]
    v = evaluate.score_cases(spark.createDataFrame(rows, CASE_COLS))
    s = evaluate.eval_summary(v.withColumn("provider_id", v.path_type).withColumn("total_tokens", v.case_no)
                              .withColumn("cost_usd", v.case_no * 0.0)).first()
    assert s["passes"] == 1 and s["eval_pass_contract_fail"] == 1


def test_matrix_filter_and_first_n(spark):
    cases = spark.createDataFrame([(i, "x") for i in range(5)], "case_no long, path_type string")
    m = evaluate.eval_matrix(cases, pattern="gpt-5-nano|claude-haiku-4-5|gemini-2.5-flash-lite", first_n=2)
    assert m.count() == 6
    assert {r["case_no"] for r in m.collect()} == {0, 1}
    assert evaluate.eval_matrix(cases).count() == 50


def test_gate_sweep_counts(spark):
    rows = [(i, "p", "treePruning", None, "true" if i % 2 else "false", None, None,
             out("treePruning", i / 10, True)) for i in range(10)]
    v = evaluate.score_cases(spark.createDataFrame(rows, CASE_COLS))
    sweep = {r["threshold"]: r for r in evaluate.gate_sweep(v, [0.5]).collect()}
    r = sweep[0.5]
    assert r["tp"] + r["fp"] + r["tn"] + r["fn"] == 10
    assert (r["tp"], r["fp"]) == (2, 2)  # scores 0.6..0.9 are eligible: 7, 9 expected; 6, 8 not


def test_reason_lists_the_failures_in_order(spark):
    rows = [(1, "p", "rootRemoval", None, "true", "0.95", None, out("rootRemoval", 0.9, False)),
            (2, "p", "rootRemoval", None, "true", None, None, out("rootRemoval", 1, True)), (3, "p", None, None, "true", None, None, "x")]
    r = score(spark, rows)
    assert r[1]["reason"] == "expected shouldAlertAdmin true, got false; expected confidenceScore >= 0.95, got 0.9"
    assert r[2]["reason"] == "Parsed rootRemoval at confidence 1; shouldAlertAdmin=true"
    assert r[3]["reason"] == "Output must be a JSON object."


def test_matrix_without_a_match_keeps_its_columns(spark):
    cases = spark.createDataFrame([(1, "x")], "case_no long, path_type string")
    none = evaluate.eval_matrix(cases, pattern="no such provider")
    assert none.count() == 0 and none.columns == evaluate.eval_matrix(cases).columns


def test_expected_ids_may_be_an_array(spark):
    schema = CASE_COLS.replace("expected_service_type_ids string", "expected_service_type_ids array<string>")
    rows = [(1, "p", "stumpRemoval", [" rootRemoval ", ""], "true", None, None, out("rootRemoval", 0.9, True)),
            (2, "p", "stumpRemoval", None, "true", None, None, out("rootRemoval", 0.9, True))]
    r = {x["case_no"]: x["pass"] for x in evaluate.score_cases(spark.createDataFrame(rows, schema)).collect()}
    assert r == {1: True, 2: False}


def test_usage_rollup_on_a_stream(spark, tmp_path):
    import datetime as dt

    from inboxsieve.operators import telemetry
    from inboxsieve.streaming.runner import run_available_now
    cols = "run_id string, provider string, request_model string, source string, started_at timestamp, ended_at timestamp, "
    cols += "model_error boolean, parse_error boolean, fallback boolean, should_alert_admin boolean, input_tokens long, "
    cols += "output_tokens long, total_tokens long, cost_usd double"
    t0 = dt.datetime(2024, 1, 1)
    rows = [(str(i), "p", "m", "s", t0 + dt.timedelta(minutes=25 * i), t0 + dt.timedelta(minutes=25 * i, seconds=4),
             False, i % 2 == 0, False, True, 1, 2, 3, 0.5) for i in range(8)]
    spark.createDataFrame(rows, cols).coalesce(1).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(cols).parquet(str(tmp_path / "t"))
    got = run_available_now(telemetry.usage_rollup_stream(stream, watermark="0 seconds"), "usage").orderBy("bucket").collect()
    batch = telemetry.usage_rollup(spark.createDataFrame(rows, cols)).orderBy("bucket").collect()
    assert [r["runs"] for r in got] == [r["runs"] for r in batch][:len(got)] and len(got) >= 2
    assert got[0]["avg_latency_s"] == 4.0


def test_latency_quantiles_of_merged_sketches(spark):
    """Every level of the rollup, against exact ranks of all its runs."""
    import bisect
    import datetime as dt
    import random

    from pyspark.sql import functions as F

    from inboxsieve.operators import telemetry
    cols = "provider string, request_model string, source string, started_at timestamp_ntz, ended_at timestamp_ntz, "
    cols += "model_error boolean, parse_error boolean, fallback boolean, should_alert_admin boolean, input_tokens long, "
    cols += "output_tokens long, total_tokens long, cost_usd double"
    rnd, t0, rows = random.Random(2), dt.datetime(2024, 1, 1), []
    for i in range(6000):
        begun = t0 + dt.timedelta(seconds=rnd.randrange(3600 * 20))
        took = dt.timedelta(microseconds=int(rnd.lognormvariate(14, 1)))
        rows.append((f"p{i % 2}", f"m{i % 3}", "s", begun, None if i % 50 == 0 else begun + took, False, False, False, True,
                     1, 2, 3, 0.5))
    rollup = telemetry.usage_rollup(spark.createDataFrame(rows, cols).repartition(4), sketch=True)
    levels = telemetry.latency_quantiles(telemetry.roll_up(rollup)).collect()
    assert {r["level"] for r in levels} == {0, 1, 2, 3, 4} and sum(r["runs"] for r in levels if r["level"] == 0) == 6000
    for r in levels:
        own = sorted((b - a).total_seconds() for p, m, s, a, b, *_ in rows if b is not None and all(
            x is None or x == y for x, y in ((r["provider"], p), (r["request_model"], m), (r["source"], s),
                                             (r["bucket"], a.replace(minute=0, second=0, microsecond=0)))))
        for name, q in telemetry.QUANTILES.items():
            rank = bisect.bisect_right(own, r[name] + 1e-9) / len(own)
            low = bisect.bisect_left(own, r[name] - 1e-9) / len(own)
            assert low - 0.0165 <= q <= rank + 0.0165, (r["level"], name)
    none = telemetry.usage_rollup(spark.createDataFrame(rows[:1], cols).withColumn("ended_at", F.lit(None).cast("timestamp_ntz")),
                                  sketch=True)
    assert telemetry.latency_quantiles(none).first()["p50_latency_s"] is None


def test_numbers_are_printed_as_in_javascript(spark):
    from inboxsieve.operators.evaluate import _number_text
    want = {0.0: "0", -0.0: "0", 1.0: "1", 0.7: "0.7", 100.0: "100", 1e7: "10000000", 1.5e7: "15000000", 0.0005: "0.0005",
            1e-6: "0.000001", 1e-7: "1e-7", 1.25e-9: "1.25e-9", -2.5e-8: "-2.5e-8", 1e20: "100000000000000000000",
            1e21: "1e+21", 1.5e300: "1.5e+300", 0.1234567890123456: "0.1234567890123456", -12.5: "-12.5"}
    df = spark.createDataFrame([(x,) for x in want], "x double")
    got = {r["x"]: r["t"] for r in df.select("x", _number_text(df["x"]).alias("t")).collect()}
    assert got == {x: t for x, t in want.items()}


def test_a_prompt_is_hashed_once_per_case(spark):
    """Before the cases meet the providers; and no join filters on the hash."""
    from inboxsieve.operators.requests import build_requests, request_key
    from inboxsieve.plans.eval_run import eval_requests
    cases = spark.createDataFrame([(1, "s", "b"), (2, None, "b")], "case_no long, subject string, body string")
    requests = eval_requests(cases)
    above, below = requests.select("case_no", "request_hash")._jdf.queryExecution().optimizedPlan().toString().split("Generate")
    assert "Subject:" in below and "Subject:" not in above
    for r in requests.select("request_hash", request_key(F.col("user_prompt"), F.col("provider"), F.col("model")).alias("k")).collect():
        assert r.request_hash == r.k
    mails = spark.createDataFrame([(1, "s", "b")], "email_id long, subject string, body string")
    assert not build_requests(mails).schema["request_hash"].nullable
