"""Source readers: quoted CSV cases, webhook JSON (batch + stream), service types."""

import json

from inboxsieve.sources import readers
from inboxsieve.streaming.runner import run_available_now


def test_eval_case_csv_with_quoted_commas(spark, tmp_path):
    p = tmp_path / "cases.csv"
    p.write_text(
        "__description,pathType,subject,body,expectedServiceTypeId,expectedServiceTypeIds,"
        "expectedShouldNotify,minConfidence,maxConfidence\n"
        '"happy: a, b",happy,"Quote","Hi, please quote ""stump"" work",stumpGrinding,,true,0.7,\n'
        '"multi",happy,"Q","B",,"stumpRemoval,rootRemoval",true,0.55,\n', encoding="utf-8")
    rows = readers.read_eval_cases(spark, str(p)).orderBy("case_no").collect()
    assert len(rows) == 2
    assert rows[0]["description"] == "happy: a, b" and rows[0]["body"] == 'Hi, please quote "stump" work'
    assert rows[0]["max_confidence"] is None and rows[1]["expected_service_type_id"] is None
    assert rows[1]["expected_service_type_ids"] == "stumpRemoval,rootRemoval"


def test_webhook_events_batch_and_stream(spark, tmp_path):
    d = tmp_path / "hooks"
    d.mkdir()
    events = [{"id": "e1", "type": "email.received", "created_at": "2024-01-01T00:00:00Z",
               "data": {"email_id": "m1"}},
              {"type": "email.opened", "created_at": "2024-01-01T01:00:00Z", "data": {"email_id": "m1"}}]
    (d / "a.json").write_text("\n".join(json.dumps(e) for e in events), encoding="utf-8")
    batch = readers.read_webhook_events(spark, str(d)).orderBy("type").collect()
    assert [r["type"] for r in batch] == ["email.opened", "email.received"]
    assert batch[1]["delivery_id"] == "e1" and len(batch[0]["delivery_id"]) == 64
    streamed = run_available_now(readers.stream_webhook_events(spark, str(d)), "hooks")
    assert streamed.count() == 2


def test_service_types_keep_definition_order(spark, tmp_path):
    p = tmp_path / "types.json"
    p.write_text(json.dumps({"b": {"label": "B", "description": "x"}, "a": {"label": "A", "description": "y"}}))
    assert [t["id"] for t in readers.load_service_types(spark, str(p))] == ["b", "a"]


def test_equal_deliveries_without_an_id_are_two(spark, tmp_path):
    """Their ids are stable, and they arrive when their files do."""
    import datetime as dt
    import os
    event = json.dumps({"type": "email.received", "created_at": "2020-05-05T00:00:00Z", "data": {"email_id": "m1"}})
    named = json.dumps({"id": "e1", "type": "email.received", "data": {"email_id": "m2"}})
    arrived = {}
    for k, lines in enumerate([[event, event, named], [event], [named] + [event] * 3000]):
        path = tmp_path / f"{k}.json"
        path.write_text("\n".join(lines), encoding="utf-8")
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
        arrived[k] = dt.datetime.fromtimestamp(1_700_000_000 + k, dt.timezone.utc).replace(tzinfo=None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        seen = [readers.read_webhook_events(spark, str(tmp_path)).collect() for _ in range(2)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    ids = [{r["delivery_id"] for r in rows} for rows in seen]
    assert ids[0] == ids[1] and len(ids[0]) == 3004 and len(seen[0]) == 3005  # e1 came twice
    times = sorted(r["received_at"] for r in seen[0] if r["email_id"] == "m1")
    assert times == sorted([arrived[0]] * 2 + [arrived[1]] + [arrived[2]] * 3000)
    assert {r["created_at"] for r in seen[0] if r["email_id"] == "m1"} == {dt.datetime(2020, 5, 5)}
