"""JSON extraction, strict contract, first valid block, fallback."""

import json

import pytest
from pyspark.sql import functions as F

from inboxsieve.operators import contract

VALID = {
    "explanation": "The sender is asking for a quote for stump grinding.",
    "serviceTypeId": "stumpGrinding",
    "confidenceScore": 0.92,
    "shouldAlertAdmin": True,
    "alertReason": "The sender requested an estimate for stump grinding, which is a listed service.",
}
V = json.dumps(VALID)


def with_(**kw):
    d = dict(VALID)
    for k, v in kw.items():
        if v is ...:
            d.pop(k)
        else:
            d[k] = v
    return json.dumps(d)


CASES = [
    # (name, text, valid)
    ("valid", V, True),
    ("malformed JSON", "{not valid json", False),
    ("partial JSON", V[:-12], False),
    ("invalid service IDs", with_(serviceTypeId="lawnMowing"), False),
    ("missing shouldAlertAdmin", with_(shouldAlertAdmin=...), False),
    ("contradictory", with_(serviceTypeId="unknown", confidenceScore=0.95,
                            alertReason="The model incorrectly wants to alert for an unknown service."), False),
    ("fenced", "```json\n" + V + "\n```", True),
    ("prose wrapped", "Sure! " + V + " Let me know.", True),
    ("one-element array", "[" + V + "]", True),
    ("extra key", with_(extra=1), False),
    ("string score", with_(confidenceScore="0.92"), False),
    ("alert at exactly 0.7", with_(confidenceScore=0.7), False),
    ("alert just above 0.7", with_(confidenceScore=0.7000000000000001), True),
    ("0.70000000000000001 is 0.7", V.replace("0.92", "0.70000000000000001"), False),
    ("score 1", with_(confidenceScore=1), True),
    ("score 0.7 without alert", with_(confidenceScore=0.7, shouldAlertAdmin=False), True),
    ("negative score", with_(confidenceScore=-0.1, shouldAlertAdmin=False), False),
    ("two objects", V + " " + V, False),
    ("blank reason", with_(alertReason="   "), False),
    ("empty text", "", False),
    ("number root", "42", False),
    ("NaN", V.replace("0.92", "NaN"), False),
    ("trailing comma", V[:-1] + ",}", False),
    ("single quotes", V.replace('"', "'"), False),
    ("duplicate key keeps last", V[:-1] + ', "serviceTypeId": "treePruning"}', True),
]


def test_contract_fixtures(spark):
    df = spark.createDataFrame([(n, t) for n, t, _ in CASES], "name string, text string")
    got = {r["name"]: r for r in contract.validate_output(df, "text").collect()}
    for name, _, valid in CASES:
        r = got[name]
        assert (r["result"] is not None) == valid, (name, r["issues"])
        assert (len(r["issues"]) == 0) == valid, name
    assert got["valid"]["result"]["service_type_id"] == "stumpGrinding"
    assert got["duplicate key keeps last"]["result"]["service_type_id"] == "treePruning"
    assert got["alert at exactly 0.7"]["issues"] == ["shouldAlertAdmin:confidence_not_above_0.7"]
    assert got["contradictory"]["issues"] == ["shouldAlertAdmin:unknown_service"]
    assert got["extra key"]["issues"] == ["unrecognized_keys"]


def test_results_are_trimmed(spark):
    df = spark.createDataFrame([(with_(explanation="  padded  "),)], "text string")
    assert contract.validate_output(df, "text").first()["result"]["explanation"] == "padded"


def test_extract_json(spark):
    cases = [("```json\n{\"a\":1}\n```", '{"a":1}'), ("x {\"a\":1} y", '{"a":1}'), ("no braces", "no braces"),
             ("[{\"a\":1}]", '{"a":1}'), ("  {\"a\":1}  ", '{"a":1}')]
    df = spark.createDataFrame(cases, "text string, want string")
    assert [r["json_text"] for r in contract.extract_json(df, "text").collect()] == [w for _, w in cases]


def test_first_valid_block_and_fallback(spark):
    content = "array<struct<type:string,text:string>>"
    df = spark.createDataFrame([
        (1, [("thinking", V), ("text", "{bad"), ("text", V)], None),
        (2, [("text", "{bad"), ("text", with_(serviceTypeId="x"))], "rate limited"),
        (3, [], None),
    ], f"run_id long, content {content}, error_message string")
    out = {r["run_id"]: r for r in contract.safe_fallback(contract.first_valid_block(df, "content")).collect()}
    assert out[1]["winner_pos"] == 2 and out[1]["parse_error"] and not out[1]["fallback"]
    assert [e["pos"] for e in out[1]["parse_errors"]] == [1]
    assert out[2]["fallback"] and out[2]["result"]["service_type_id"] == "unknown"
    assert out[2]["result"]["confidence_score"] == 0.0 and out[2]["result"]["should_alert_admin"] is False
    assert out[2]["result"]["alert_reason"].endswith("no admin alert sent. Model error: rate limited")
    assert out[2]["result"]["explanation"] == out[2]["result"]["alert_reason"]
    assert out[3]["fallback"] and not out[3]["parse_error"]


def test_block_rows_form_matches_array_form(spark):
    blocks = spark.createDataFrame([(1, 0, "thinking", V), (1, 1, "text", "{bad"), (1, 2, "text", V),
                                    (2, 0, "text", "{bad")], "run_id long, pos long, type string, text string")
    winners, errors = contract.first_valid_block_rows(blocks)
    w = {r["run_id"]: r for r in winners.collect()}
    assert w[1]["winner_pos"] == 2 and w[1]["n_parse_errors"] == 1
    assert w[2]["winner_pos"] is None and w[2]["n_parse_errors"] == 1
    assert sorted((r["run_id"], r["pos"]) for r in errors.collect()) == [(1, 1), (2, 0)]


def test_fallback_never_alerts(spark):
    """Property: no O8/O10 output alerts with unknown or a score <= 0.7."""
    df = spark.createDataFrame([(n, t) for n, t, _ in CASES], "name string, text string")
    out = contract.safe_fallback(contract.validate_output(df, "text"), error_message="none")
    bad = out.filter(F.col("result.should_alert_admin")
                     & ((F.col("result.service_type_id") == "unknown") | (F.col("result.confidence_score") <= 0.7)))
    assert bad.count() == 0


def test_an_answer_is_parsed_twice_and_carried_once(spark):
    """Once inside an array and once inside an object, whatever is read from it."""
    df = spark.createDataFrame([("{}",)], "t string")
    plan = contract.validate_output(df, "t")._jdf.queryExecution().analyzed().toString()
    assert plan.count("parse_json(") == 2 and "json_object_keys" not in plan


@pytest.mark.parametrize("text,valid", [
    ("```json\n%s\n```", True), ("```%s", True), ("%s```", True), ("```JSON %s ``` ", True), ("%s}", False),
    ("%s] [", True), ("%s}, {", False), ("%s, 1", True), ("%s, {}", False), ("x %s y", True), ("%s", True), ("``````", False), ("", False)])
def test_trailing_text_and_fences(spark, text, valid):
    answer = ('{"explanation": "x", "serviceTypeId": "unknown", "confidenceScore": 0.1, "shouldAlertAdmin": false, '
              '"alertReason": "y"}')
    df = spark.createDataFrame([(text.replace("%s", answer),)], "t string")
    assert (contract.validate_output(df, "t").first().result is not None) == valid
