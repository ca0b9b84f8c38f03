"""The TTL claim fold, batch (range-partitioned) and streaming."""

import datetime as dt
import math
import random

import pytest

from inboxsieve.operators import dedupe

T0 = dt.datetime(2024, 1, 1)


def fixture_rows():
    # (day offset, ok) -> released, processed, skipped, processed, skipped, processed
    days = [(0, False), (1, True), (5, True), (8, True), (14.9, True), (15, True)]
    return [("k", T0 + dt.timedelta(days=d), i, ok) for i, (d, ok) in enumerate(days)]


def test_fold_fixture(spark):
    df = spark.createDataFrame(fixture_rows(), "key string, ts timestamp_ntz, delivery_id long, ok boolean")
    out = dedupe.claim_deliveries(df).orderBy("delivery_id").collect()
    assert [r["status"] for r in out] == ["released", "processed", "skipped", "processed", "skipped", "processed"]
    assert [r["existing_status"] for r in out] == [None, None, "processed", None, "processed", None]
    assert out[1]["expires_at"] == T0 + dt.timedelta(days=8)


def reference_fold(rows, ttl_days=7):
    """A plain sequential fold for comparison."""
    out = {}
    state = {}
    for key, ts, tie, ok in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        until = state.get(key)
        if until is not None and until > ts:
            out[tie] = "skipped"
            continue
        if ok:
            state[key] = ts + dt.timedelta(days=ttl_days)
            out[tie] = "processed"
        else:
            state[key] = ts
            out[tie] = "released"
    return out


def test_hot_key_split_over_partitions_matches_sequential_fold(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 else f"k{i % 17}"  # one key holds two thirds of the rows
        rows.append((key, T0 + dt.timedelta(hours=rnd.randint(0, 24 * 90)), i, rnd.random() > 0.2))
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, delivery_id long, ok boolean")
    got = {r["delivery_id"]: r["status"] for r in dedupe.claim_deliveries(df, num_partitions=16).collect()}
    assert got == reference_fold(rows)


def test_ledger_state_carries_claims(spark):
    rows = fixture_rows()
    first = spark.createDataFrame(rows[:3], "key string, ts timestamp_ntz, delivery_id long, ok boolean")
    second = spark.createDataFrame(rows[3:], "key string, ts timestamp_ntz, delivery_id long, ok boolean")
    c1 = dedupe.claim_deliveries(first, with_state=True)
    ledger = dedupe.ledger_rows(c1, "key", "ts", "delivery_id")
    c2 = dedupe.claim_deliveries(second, initial_state=ledger).orderBy("delivery_id").collect()
    assert [r["status"] for r in c2] == ["processed", "skipped", "processed"]


def test_stream_matches_batch(spark, tmp_path):
    from inboxsieve.streaming.claims import claim_deliveries_stream
    from inboxsieve.streaming.runner import run_available_now

    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    df = spark.createDataFrame(fixture_rows(), "key string, ts timestamp_ntz, delivery_id long, ok boolean")
    src = tmp_path / "src"
    df.write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    out = run_available_now(claim_deliveries_stream(stream, watermark="30 days"), "test_claims")
    got = [r["status"] for r in out.orderBy("delivery_id").collect()]
    assert got == ["released", "processed", "skipped", "processed", "skipped", "processed"]


def test_vectorised_fold_matches_row_fold_with_finish_times(spark):
    """Random keys, failures and finish delays over many partitions vs the
    row-by-row fold (statuses, existing status and expiry)."""
    rnd = random.Random(11)
    rows = []
    for i in range(2000):
        key = f"k{rnd.randint(0, 4)}"
        ts = T0 + dt.timedelta(hours=rnd.randint(0, 24 * 60))
        fin = ts + dt.timedelta(hours=rnd.choice([0, 0, 1, 30])) if rnd.random() < 0.7 else None
        rows.append((key, ts, i, rnd.random() > 0.3, fin))
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, delivery_id long, ok boolean, "
                                     "fin timestamp_ntz")
    got = {r["delivery_id"]: (r["status"], r["existing_status"], r["expires_at"])
           for r in dedupe.claim_deliveries(df, finished_at="fin", num_partitions=8).collect()}
    assert got == row_fold(rows)


def row_fold(rows):
    """Row by row, with finish times: tie -> (status, existing, expires)."""
    want, state, ttl = {}, {}, dedupe.DEFAULT_TTL
    for key, ts, tie, ok, fin in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        until, until_fin, final = state.get(key, (None, None, None))
        if until is not None and until > ts:
            want[tie] = ("skipped", "processing" if ts < until_fin else final, until)
            continue
        fin = ts if fin is None else max(fin, ts)
        state[key] = (fin + ttl, fin, "processed") if ok else (min(fin, ts + ttl), fin, "processing")
        want[tie] = ("processed", None, state[key][0]) if ok else ("released", None, None)
    return want


def hot_rows(kind, n=1500, days=400):
    """One key with two thirds of the rows over many lifetimes of a claim."""
    rnd = random.Random(5)
    name = {"string": lambda k: f"k{k}", "bigint": lambda k: 10 ** 12 + k, "int": lambda k: k}[kind]
    rows = []
    for i in range(n):
        ts = T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * days))
        fin = ts + dt.timedelta(hours=rnd.choice([0, 1, 30])) if rnd.random() < 0.5 else None
        rows.append((name(0 if i % 3 else i % 5 + 1), ts, i, rnd.random() > 0.25, fin))
    return rows


def claimed(spark, rows, kind, parts):
    df = spark.createDataFrame(rows, f"key {kind}, ts timestamp_ntz, delivery_id long, ok boolean, fin timestamp_ntz")
    return {r["delivery_id"]: (r["status"], r["existing_status"], r["expires_at"])
            for r in dedupe.claim_deliveries(df, finished_at="fin", num_partitions=parts).collect()}


@pytest.mark.parametrize("kind", ["string", "bigint", "int"])
def test_any_number_of_partitions_gives_the_same_rows(spark, kind):
    rows = hot_rows(kind)
    want = row_fold(rows)
    for parts in (1, 4, 16, 80, 200):
        assert claimed(spark, rows, kind, parts) == want, parts


@pytest.fixture
def rounds(monkeypatch):
    """How many rounds of lookups and doublings a fold takes."""
    made = []
    for name in ("_jumps", "_double"):
        whole = getattr(dedupe, name)
        monkeypatch.setattr(dedupe, name, lambda *a, whole=whole, name=name: made.append(name) or whole(*a))
    return made


@pytest.mark.parametrize("parts", [16, 32, 200])
def test_a_hot_key_takes_logarithmic_rounds(spark, rounds, parts):
    """One key, every partition longer than a claim lives and of several Arrow
    batches; claims begin out of step, so no partition tells its exit alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "60")
    try:
        rnd = random.Random(parts)
        rows = [(1, T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 12 * parts)), i, rnd.random() > 0.2,
                 None) for i in range(parts * 200)]
        got = claimed(spark, rows, "bigint", parts)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got == row_fold(rows)
    assert 1 <= len(rounds) <= math.ceil(math.log2(parts))


def test_partitions_shorter_than_a_claim(spark, rounds):
    """Claims pass through several partitions and end inside another."""
    rnd = random.Random(3)
    rows = [(1, T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 60)), i, rnd.random() > 0.3,
             T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 70)) if rnd.random() < 0.05 else None) for i in range(3000)]
    assert claimed(spark, rows, "bigint", 90) == row_fold(rows)
    assert 1 <= len(rounds) <= 7


def test_lookups_of_a_partition_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "LOOKUPS", 7)
    rows = hot_rows("bigint", 600, 60)
    assert claimed(spark, rows, "bigint", 16) == row_fold(rows)


def test_ordinary_keys_take_no_round(spark, rounds):
    rows = [(i % 500, T0 + dt.timedelta(hours=i), i, True, None) for i in range(5000)]
    assert claimed(spark, rows, "bigint", 16) == row_fold(rows) and rounds == []


def test_exit_function_against_the_fold():
    """Over batches of any size: the state after the last row for every moment
    at which an inherited claim may end."""
    import numpy as np
    rnd = np.random.default_rng(4)
    for _ in range(40):
        n, ttl = int(rnd.integers(1, 120)), int(rnd.integers(1, 60))
        t = np.sort(rnd.integers(0, 300, n))
        ok, fin = rnd.random(n) > 0.3, np.maximum(t, t + rnd.integers(-5, 40, n))
        span = int((fin - t).max()) + ttl
        exits = dedupe.Exits(span)
        cuts = np.unique(np.concatenate([[0, n], rnd.integers(0, n, 4)]))
        none = np.array([dedupe.NONE])
        for a, b in zip(cuts, cuts[1:]):
            exits.add(t[a:b], dedupe.Folded(np.zeros(b - a, dtype=np.int64), t[a:b], ok[a:b], fin[a:b], ttl, none, none,
                                            np.array(["processed"], dtype=object)))
        times, until, at_fin, done = exits.pieces()
        for u in range(-1, min(span + int(t[0]), int(t[-1])) + 1):
            whole = dedupe.Folded(np.zeros(n, dtype=np.int64), t, ok, fin, ttl, np.array([u]), np.array([u]),
                                  np.array(["processed"], dtype=object))
            k = np.searchsorted(times, u, "left")
            assert (until[k], at_fin[k]) == (whole.post_until[-1], whole.post_fin[-1])
            assert done[k] == (whole.post_final[-1] == "processed")


def test_a_ledger_claim_that_ends_inside_a_later_partition(spark, rounds):
    rows = [(1, T0 + dt.timedelta(minutes=7 * i), i, True, None) for i in range(8000)]
    df = spark.createDataFrame(rows, "key bigint, ts timestamp_ntz, delivery_id long, ok boolean, fin timestamp_ntz")
    until = T0 + dt.timedelta(days=11, minutes=3)
    micros = int(until.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    ledger = spark.createDataFrame([(1, micros, micros - 10, "processed")], "key bigint, until long, fin long, final string")
    got = dedupe.claim_deliveries(df, initial_state=ledger, num_partitions=40).where("status = 'processed'")
    want, at = [], until
    for _, ts, i, _, _ in rows:
        if ts >= at:
            want.append(i)
            at = ts + dedupe.DEFAULT_TTL
    assert sorted(r["delivery_id"] for r in got.collect()) == want


def test_one_claim_over_eighty_partitions(spark):
    rows = [(7, T0 + dt.timedelta(seconds=i), i, True, None) for i in range(4000)]
    got = claimed(spark, rows, "bigint", 80)
    assert [k for k, v in got.items() if v[0] != "skipped"] == [0]


def test_rows_without_a_time_or_key(spark):
    rows = [(None, T0, 0, True), (None, T0, 1, True), (1, None, 2, True), (1, T0, 3, True), (1, None, 4, True)]
    df = spark.createDataFrame(rows, "key bigint, ts timestamp_ntz, delivery_id long, ok boolean")
    got = {r["delivery_id"]: (r["key"], r["status"], r["expires_at"]) for r in dedupe.claim_deliveries(df).collect()}
    until = T0 + dedupe.DEFAULT_TTL
    assert got == {0: (None, "processed", until), 1: (None, "skipped", until), 2: (1, "invalid", None),
                   3: (1, "processed", until), 4: (1, "invalid", None)}


def test_far_apart_times_are_searched_run_by_run():
    import numpy as np
    run, t = np.array([0, 0, 1, 1, 1]), np.array([-(1 << 60), 5, 0, 3, 1 << 60])
    stop = np.array([2, 2, 5, 5, 5])
    assert dedupe.next_candidates(run, stop, t, t + 3).tolist() == [1, 2, 3, 4, 5]
