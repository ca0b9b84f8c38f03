"""O5, O11-O13, O16-O18 and the driver contract."""

import json

from pyspark.sql import functions as F

from inboxsieve.operators import requests, route, service, telemetry


def test_service_type_resolution(spark):
    vals = ["Stump grinding", "stump_grinding", "ROOT-REMOVAL", " treePruning ", "Unknown or not listed",
            "lawn mowing", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r["t"] and r["t"]["id"] for r in service.resolve_service_type(df, "v", out="t").collect()]
    assert got == ["stumpGrinding", "stumpGrinding", "rootRemoval", "treePruning", "unknown", None, None]


def test_prompt_contents():
    p = requests.prompt_head() + "Quote request" + requests.PROMPT_BODY_LABEL + "Can you quote stump grinding?"
    assert "Subject: Quote request" in p and "Email Body: Can you quote stump grinding?" in p
    assert requests.SYSTEM_PROMPT not in p
    t = requests.template_prompt()
    assert "{{subject}}" in t and "{{body}}" in t and t.startswith(requests.SYSTEM_PROMPT)


def test_model_config_defaults():
    sh = requests.ModelConfig(provider="self-hosted")
    assert (sh.model_id, sh.resolved_base_url, sh.resolved_max_tokens, sh.payload_mode) == (
        "gemma4:e4b", "http://localhost:11434/v1", 1200, "json_object")
    oa = requests.ModelConfig()
    assert (oa.model_id, oa.resolved_max_tokens, oa.payload_mode) == ("gpt-4o-mini", None, "json_schema")
    assert requests.ModelConfig(settings={"max_tokens": "250"}).resolved_max_tokens == 250
    assert requests.ModelConfig(settings={"max_tokens": "-3"}).resolved_max_tokens is None
    assert not requests.ModelConfig(provider="nope").known


def test_notification_body(spark):
    alerts = spark.createDataFrame([(1, "Stump grinding", "x" * 2000)],
                                   "email_id long, service_type_label string, explanation string")
    emails = spark.createDataFrame([(1, "a@b.c", "")], "email_id long, from string, subject string")
    body = json.loads(route.build_notifications(alerts, emails, timestamp="T").first()["body_json"])
    assert body["content"] == "**New estimate request received**"
    fields = {f["name"]: f["value"] for f in body["embeds"][0]["fields"]}
    assert fields == {"customerEmail": "a@b.c", "emailSubject": "N/A", "serviceType": "Stump grinding",
                      "summary": "x" * 1024}
    assert body["embeds"][0]["title"] == "Details" and body["embeds"][0]["timestamp"] == "T"


def test_alert_gate_is_null_safe(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, should_alert_admin boolean")
    a, q = route.alert_gate(df)
    assert [r["id"] for r in a.collect()] == [1] and sorted(r["id"] for r in q.collect()) == [2, 3]


def test_url_host(spark):
    cases = [("http://localhost:11434/v1", "localhost:11434"), ("https://API.example.com:443/x", "api.example.com"),
             ("localhost:11434", None), ("example.com/v1", "example.com"), ("", None), (None, None),
             ("http://user:pw@h.io:8080/", "h.io:8080")]
    df = spark.createDataFrame(cases, "u string, want string")
    assert [r["h"] for r in df.select(telemetry.url_host(F.col("u")).alias("h")).collect()] == [w for _, w in cases]


def test_telemetry_has_no_text_columns():
    banned = {"subject", "body", "text", "user_prompt", "system_prompt", "content", "explanation", "alert_reason",
              "output"}
    assert not banned & set(telemetry.TELEMETRY_COLUMNS)


def test_driver_contract_keys():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    from inboxsieve.plans import catalog

    assert set(catalog.QUERIES) <= set(o) <= set(q) and len(catalog.QUERIES) >= 33


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and df.columns == ["service_type_id", "should_alert_admin", "n_mails"]


STORE_COLS = "email_id long, body string, service_type_id string, received_at timestamp_ntz"


def test_result_store_is_an_upsert(spark, tmp_path):
    import datetime as dt

    from inboxsieve.operators import store

    path, day = str(tmp_path / "s"), lambda d: dt.datetime(2024, 1, d)
    stored = lambda: sorted(((r["email_id"], r["service_type_id"], r["received_at"])
                             for r in spark.read.parquet(path).collect()), key=str)
    make = lambda rows: store.result_store(spark.createDataFrame(rows, STORE_COLS))
    first = make([(1, "secret", "a", day(2)), (2, "secret", "b", day(2)), (3, "secret", "c", day(3)), (4, "x", "d", None)])
    assert "body" not in first.columns and "dt" in first.columns
    store.write_result_store(first, path)
    store.write_result_store(first, path)
    want = [(1, "a", day(2)), (2, "b", day(2)), (3, "c", day(3)), (4, "d", None)]
    assert stored() == sorted(want, key=str)
    store.write_result_store(make([(2, "x", "new", day(2)), (1, "x", "later claim", day(4)), (4, "x", "e", None)]), path)
    want = [(1, "a", day(2)), (2, "new", day(2)), (3, "c", day(3)), (1, "later claim", day(4)), (4, "e", None)]
    assert stored() == sorted(want, key=str)


def test_retained_content_expires(spark, tmp_path):
    import datetime as dt

    from inboxsieve.operators import store

    path = str(tmp_path / "s")
    rows = [(i, f"body {i}", "a", dt.datetime(2024, 1, i)) for i in range(1, 6)]
    store.write_result_store(store.result_store(spark.createDataFrame(rows, STORE_COLS), retain_content=True), path)
    assert store.expire_content(spark, path, dt.date(2024, 1, 4)) == 3
    assert store.expire_content(spark, path, dt.date(2024, 1, 4)) == 0
    got = {r["email_id"]: (r["body"], r["service_type_id"]) for r in spark.read.parquet(path).collect()}
    assert got == {1: (None, "a"), 2: (None, "a"), 3: (None, "a"), 4: ("body 4", "a"), 5: ("body 5", "a")}


def test_source_whitelist(spark):
    df = spark.createDataFrame([("inbound_email",), ("eval_endpoint",), ("cron",), (None,)], "s string")
    got = [r["x"] for r in df.select(telemetry.source_label(F.col("s")).alias("x")).collect()]
    assert got == ["inbound_email", "eval_endpoint", "unknown", "unknown"]


def test_unknown_channel_is_an_error_of_its_row(spark):
    df = spark.createDataFrame([("discord",), ("sms",), (None,)], "via string")
    got = [r["x"] for r in df.select(route.channel_error(F.col("via")).alias("x")).collect()]
    assert got == [None, "Unsupported notification channel: sms", "Unsupported notification channel: null"]


def test_response_format_follows_the_service_types(spark):
    types = [{"id": "mowing", "label": "Mowing", "description": "Grass."}, {"id": "unknown", "label": "U", "description": "-"}]
    form = json.loads(requests.response_format("json_schema", types))["text"]["format"]
    assert form["strict"] and form["schema"]["properties"]["serviceTypeId"]["enum"] == ["mowing", "unknown"]
    assert form["schema"]["required"][0] == "explanation" and form["schema"]["additionalProperties"] is False
    assert json.loads(requests.response_format("json_object"))["response_format"] == {"type": "json_object"}
    assert requests.response_format("unchanged") is None
    mails = spark.createDataFrame([("s", "b")], "subject string, body string")
    row = requests.build_requests(mails, requests.ModelConfig()).first()
    assert json.loads(row["response_format"])["text"]["format"]["type"] == "json_schema"
