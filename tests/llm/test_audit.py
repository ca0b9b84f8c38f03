import itertools
import re

import numpy as np
from pyspark.sql import functions as F

from inboxsieve.llm import filter_audit
from inboxsieve.llm.queries import op13_filter_audit, table

from .conftest import SF, messy_rows, messy_table, prose, words


def brute(rows, labels):
    """Every order applied to every document, filter by filter."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    facts = []
    for i, t, s in rows:
        t, ws = t or "", words(t)
        fails = {"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        facts.append((s or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in facts}:
        own = [f[1:] for f in facts if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in d[0] for d in own) - len(gone), sum(d[0] == {f} for d in own),
                    sum(d[1] for d in gone), sum(d[2] for d in gone), f]
        for (p, _, _), r in out.items():
            if p == part:
                r[-1] = shapley.get(r[-1], r[-1])
    return {k: tuple(v) for k, v in out.items()}


def result(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in df.collect()}


def test_messy_rows(spark):
    more = [(30, "A" * 300, "en", "a"), (31, "50 % off " * 40, "en", None), (32, "A" * 300, "en", "z"), (None, "one", "de", "c"),
            (None, "one", "de", ""), (2, "one", "de", "c"), (33, prose(9, 60).upper() + " #", "en", "a"),
            (34, prose(9, 60).upper() + " #", "en", "b")]
    rows = messy_rows() + more
    docs = messy_table(spark, rows, ["part", "id", "digest", "fails", "label", "first"])
    labels = [(0, 1, 0), (1, 1, 1), (1, 0, 0), (6, None, 1), (7, 1, None), (32, 0, 1), (33, 1, 1), (None, 1, 1), (999, 1, 1)]
    table_ = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    got = result(filter_audit.audit(docs.repartition(3), table_, source="source"))
    want = brute([(i, t, s) for i, t, _, s in rows], labels)
    assert got == want and len(got) == 600 * 6


def test_query_against_every_order(spark):
    rows = [(r.doc_id, r.text, r.source) for r in table(spark, SF, "documents").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in table(spark, SF, "labels").collect()]
    assert result(op13_filter_audit(spark, SF)) == brute(rows, labels)


def test_positional_popcount():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 4, 7, 100, 1000, 12_345):
        words_ = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        want = [int(((words_ >> np.uint32(k)) & 1).sum()) for k in range(32)]
        assert filter_audit.positional_popcount(words_).tolist() == want


def test_words_of_failures():
    for fails in range(32):
        for s in range(32):
            assert bool(int(filter_audit.WORD_OF[fails]) >> s & 1) == (fails & s == 0)


def test_empty_table(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(nothing, labels).count() == 0
