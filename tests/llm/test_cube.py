import numpy as np
from pyspark.sql import functions as F

from inboxsieve.llm import cube_mix
from inboxsieve.llm.queries import op2_cube_mix

from .conftest import SF, messy_rows, messy_table, words


def targets(size, weights=(5, 2, 1), cap=3):
    """Reshare until none is above; sources by code point, null last."""
    order = sorted(size, key=lambda s: (s is None, s))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, free, rest = {}, set(order), sum(size.values())
    while free:
        total = sum(w[s] for s in free)
        out.update({s: rest * w[s] / total for s in free})
        over = {s for s in free if out[s] > cap * size[s]}
        if not over:
            break
        out.update({s: cap * size[s] for s in over})
        rest -= sum(out[s] for s in over)
        free -= over
    return out


def test_targets_of_messy_rows(messy):
    size = {}
    for _, t, _, s in messy_rows():
        size[s] = size.get(s, 0) + len(words(t))
    got = {r._source: r.target for r in cube_mix.mix(messy).select("_source", "target").distinct().collect()}
    want = targets(size)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_words_come_near_the_targets(spark):
    rows = op2_cube_mix(spark, SF).collect()
    size, taken, target = {}, {}, {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r["size"]
    want = targets(size)
    assert all(abs(target[s] - want[s]) < 1e-6 * want[s] for s in size)
    assert all(abs(taken[s] - target[s]) <= 0.1 * target[s] for s in size)
    assert abs(sum(taken.values()) - sum(size.values())) <= 0.02 * sum(size.values())


def test_many_blocks_and_levels_agree_with_the_targets_and_reruns(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") * 7 % 23 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    mix = lambda: sorted(map(tuple, cube_mix.mix(docs, block_rows=50).collect()))
    one = mix()
    assert one == mix() and len(one) == 4000
    for s in {r[1] for r in one}:
        own = [r for r in one if r[1] == s]
        size, copies = np.array([r[4] for r in own]), np.array([r[7] for r in own])
        assert abs((size * copies).sum() - own[0][6]) <= 23
        # documents are balanced too, but for the landing
        assert abs(copies.sum() - len(own) * own[0][6] / own[0][5]) <= 0.02 * len(own) + 12


def test_the_flight_keeps_both_totals():
    rng = np.random.default_rng(5)
    a = np.column_stack([np.ones(500), rng.integers(0, 900, 500)]).astype(float)
    p = rng.random(500)
    q = cube_mix.flight(p, a, rng)
    assert np.allclose(a.T @ p, a.T @ q) and ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2


def test_mixed_rows_are_the_copies(messy):
    copies = {}
    for r in cube_mix.mix(messy).collect():
        copies[r._id, r._key] = (r.rows, r.copies)
    out = cube_mix.mixed(messy)
    assert out.columns == messy.columns
    got = {}
    for r in out.select("doc_id", F.xxhash64("text").alias("k"), "copies").collect():
        got[r.doc_id, r.k] = got.get((r.doc_id, r.k), 0) + 1
        assert r.copies == "clash"
    assert got == {k: n * c for k, (n, c) in copies.items() if c}


def test_empty_and_wordless_tables(spark, nothing):
    assert cube_mix.mix(nothing).count() == 0 and cube_mix.mixed(nothing).count() == 0
    rows = cube_mix.mix(messy_table(spark, [(1, None, "en", "a"), (2, " ", "en", None)])).collect()
    assert [(r.target, r.copies) for r in rows] == [(0.0, 0), (0.0, 0)]
