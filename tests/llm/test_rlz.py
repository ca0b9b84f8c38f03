import hashlib
import random

import numpy as np

from inboxsieve.llm import rlz_dedup
from inboxsieve.llm.queries import op3_rlz_dedup, table

from .conftest import SF, messy_rows, messy_table, prose, words


def brute(rows, window):
    """(id, n_words, n_removed, kept) by looking up every window."""
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k:k + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)


def check_factors(rows, done):
    """Each factor is what its reference, a smaller id, says; together they are
    the removed words, in order and without overlaps; and none could go on
    where the next one of the same reference begins."""
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(words(t))
    for r in done.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed == sum(f.end - f.start for f in r.factors)
        covered = {w for s in r.spans for w in range(s.start, s.end)}
        assert covered == {w for f in r.factors for w in range(f.start, f.end)}
        for f, g in zip(r.factors, r.factors[1:], strict=False):
            assert f.end <= g.start and (f.end < g.start or (f.ref_id, f.ref_start + f.end - f.start) != (g.ref_id, g.ref_start))
        for f in r.factors:
            n = f.end - f.start
            assert f.ref_id < r.doc_id and any(
                own[f.start:f.end] == ref[f.ref_start:f.ref_start + n] for own in texts[r.doc_id] for ref in texts[f.ref_id])


def test_messy_rows(messy):
    done = rlz_dedup.dedup_substrings(messy)
    rows = [(i, t) for i, t, _, _ in messy_rows()]
    assert result(done) == brute(rows, 50)
    check_factors(rows, done)


def brute_parse(matches):
    """Word by word: the match that reaches furthest from here on."""
    out, here, last = [], 0, max((m[1] for m in matches), default=0)
    while here < last:
        end = max((b for a, b, _ in matches if a <= here < b), default=here)
        # matches of one reference and displacement that touch are one
        grown = True
        while grown:
            grown = False
            for shift in {m[2] for m in matches if m[0] <= here < m[1]}:
                reach = here
                for a, b, s in sorted(matches):
                    if s == shift and a <= reach:
                        reach = max(reach, b)
                if reach > end:
                    end, grown = reach, True
        if end > here:
            out.append((here, end))
        here = max(end, here + 1)
    return out


def test_parse_against_a_word_by_word_one():
    rng = random.Random(6)
    for _ in range(300):
        matches = [(a, a + rng.randrange(3, 12), (rng.randrange(3), rng.randrange(2))) for a in
                   (rng.randrange(40) for _ in range(rng.randrange(8)))]
        start, end = (np.array([m[k] for m in matches], dtype=np.int64) for k in (0, 1))
        refs = [(m[2][0], 0) for m in matches]
        at = np.array([m[0] + 100 * m[2][1] for m in matches], dtype=np.int64)
        got = rlz_dedup.parse(start, end, refs, at)
        assert [(a, b) for a, b, _, _ in got] == brute_parse(matches)
        for a, b, ref, q in got:
            shift = (ref, (q - a) // 100)
            assert all(any(x <= w < y for x, y, s in matches if s == shift) for w in range(a, b))


def test_a_long_copy_is_one_factor(spark):
    """A copied passage over many blocks is one factor, cut where the copy
    leaves its reference."""
    base = prose(5, 900, 10 ** 6).split()
    other = prose(6, 300, 10 ** 6).split()
    rows = [(1, " ".join(base)), (2, " ".join(other)),
            (3, " ".join(base[100:700] + ["x"] + other[:200] + other[40:200] + base[:60]))]
    done = rlz_dedup.dedup_substrings(messy_table(spark, [(i, t, "en", "a") for i, t in rows]))
    factors = {r.doc_id: [tuple(f) for f in r.factors] for r in done.collect()}
    assert factors == {1: [], 2: [], 3: [(0, 600, 1, 100), (601, 801, 2, 0), (801, 961, 2, 40), (961, 1021, 1, 0)]}
    check_factors(rows, done)


def test_random_passages_at_every_offset(spark):
    """Passages of 49 to 120 words cut from common texts, at the start, in the
    middle and at the end, overlapping, and next to each other."""
    rng = random.Random(4)
    pool = [prose(100 + k, 150, 3000).split() for k in range(4)]
    rows = [(3, prose(77, 30))]
    for i in range(60):
        w = []
        for _ in range(rng.randrange(1, 4)):
            w += prose(rng.random(), rng.choice([0, 0, 1, 20]), 10 ** 6).split()
            p = rng.choice(pool)
            a = rng.randrange(0, 90)
            w += p[a:a + rng.choice([49, 50, 51, 60, 75, 120])]
        rows.append((i * 3 % 61 + 10, " ".join(w)))
    rows += [(None, " ".join(pool[0])), (500, "same " * 300), (501, "same " * 60 + "other " * 55)]
    done = rlz_dedup.dedup_substrings(messy_table(spark, [(i, t, "en", "a") for i, t in rows]))
    assert result(done) == brute(rows, 50)
    check_factors(rows, done)


def test_query_against_every_window(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    want = [(i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in brute(rows, 50)]
    assert sorted(map(tuple, op3_rlz_dedup(spark, SF).collect()), key=str) == sorted(want, key=str)


def test_least_positions():
    rng = np.random.default_rng(2)
    v = rng.integers(0, 9, 500).astype(np.uint64)
    for width in (1, 2, 3, 8, 35):
        want = [s + int(np.argmin(v[s:s + width])) for s in range(500 - width + 1)]
        assert rlz_dedup.least_positions(v, width).tolist() == want


def test_empty_table(nothing):
    assert rlz_dedup.dedup_substrings(nothing).count() == 0
