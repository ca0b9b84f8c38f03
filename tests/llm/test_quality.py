from collections import Counter

import numpy as np
import pytest

from inboxsieve.llm import decision_list, doc_stats, gbt_quality
from inboxsieve.llm.queries import op4_decision_list, op5_gbt_quality, remainder, table

from .conftest import SF, messy_rows, words


def base(text):
    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if words(x)]
    grams = list(zip(w, w[1:], w[2:], strict=False))
    often = Counter(grams)
    covered = {k for i, g in enumerate(grams) if often[g] > 1 for k in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_base_statistics_of_messy_rows(messy):
    got = doc_stats.doc_stats(messy).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                            "n_repeat_words").collect()
    assert sorted(map(tuple, got)) == sorted((i, *base(t)) for i, t, _, _ in messy_rows())


def test_base_statistics_of_the_table(spark):
    text = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    for r in op4_decision_list(spark, SF).collect():
        n, chars, symbols, dups, repeats = b = base(text[r.doc_id])
        assert tuple(r)[1:6] == b
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n) and not (r.base_failed and r.kept)


def test_a_list_is_learned_and_applied_in_order():
    rng = np.random.default_rng(0)
    x = {f: rng.random(3000) for f in ("f", "g", "h")}
    bad = (x["f"] > 0.7) | ((x["g"] < 0.2) & (x["h"] > 0.5))
    rules = decision_list.learn(x, bad, features=("f", "g", "h"))
    hit = np.zeros(3000, dtype=bool)
    for r in rules:
        hit |= decision_list._covers(r, x, 3000)
    assert len(rules) >= 2 and (hit & bad).sum() > 0.95 * bad.sum() and (hit & ~bad).sum() < 0.02 * (~bad).sum()


def test_rules_keep_good_documents(spark):
    verdicts, rules = decision_list.quality_rules(table(spark, SF, "documents"), table(spark, SF, "labels"))
    rows = verdicts.join(table(spark, SF, "labels"), "doc_id").select("quality", "kept").collect()
    assert rules and all(r.kept for r in rows if r.quality == 1)


@pytest.mark.parametrize("rows", [[], [(0, 1, 0), (1, None, 0), (None, 0, 0), (999, 0, 1)]])
def test_without_usable_labels_everything_is_kept(spark, messy, rows):
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    verdicts, rules = decision_list.quality_rules(messy, labels)
    assert rules == [] and {r.kept for r in verdicts.collect()} == {True}
    scores, _ = gbt_quality.quality_scores(messy, labels)
    got = [r.score for r in scores.collect()]
    assert len(got) == len(messy_rows()) and len(set(got)) == 1 and 0 < got[0] < 1


def test_empty_documents(spark, nothing):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0)], "doc_id long, quality int, toxic int")
    assert decision_list.quality_rules(nothing, labels)[0].count() == 0
    assert gbt_quality.quality_scores(nothing, labels)[0].count() == 0


def test_flat_trees_score_like_a_walk():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(int)
    trees = gbt_quality.train(x, y, n_trees=30)

    def walk(row):
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            total += v[at - len(f)]
        return 1 / (1 + np.exp(-total))

    got = trees.score(x)
    assert np.allclose(got[:50], [walk(r) for r in x[:50]])
    assert ((got > 0.5) == y).mean() > 0.97


def test_held_out_accuracy(spark):
    rows = (op5_gbt_quality(spark, SF).join(table(spark, SF, "labels"), "doc_id")
            .select("held_out", "score", "predicted", "quality").collect())
    held = [r for r in rows if r.held_out]
    assert held and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.9


def test_scores_do_not_depend_on_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    one = gbt_quality.quality_scores(docs, labels, learn_from=remainder("doc_id", 3) != 1)[0]
    two = gbt_quality.quality_scores(docs, labels.where(remainder("doc_id", 3) != 1))[0]
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_the_emitted_expression_follows_the_rules_row_by_row(spark):
    """The ordered Spark conditional against the rules applied in Python: on
    the table, and at the thresholds themselves."""
    verdicts, rules = decision_list.quality_rules(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert rules

    def keeps(row, rules):
        return not any(all(row[t.feature] >= t.threshold if t.above else row[t.feature] <= t.threshold for t in rule)
                       for rule in rules)

    for r in verdicts.collect():
        assert r.kept == keeps(r, rules)
    edge = [(decision_list.Test("f", True, 2.0), decision_list.Test("g", False, 0.5)), (decision_list.Test("h", False, -1.0),)]
    rows = [(f, g, h) for f in (1.9, 2.0, 2.1) for g in (0.4, 0.5, 0.6) for h in (-1.1, -1.0, -0.9)]
    df = spark.createDataFrame(rows, "f double, g double, h double")
    x = {c: np.array([r[k] for r in rows]) for k, c in enumerate("fgh")}
    hit = decision_list._covers(edge[0], x, len(rows)) | decision_list._covers(edge[1], x, len(rows))
    got = [r.kept for r in df.withColumn("kept", decision_list.keeps(edge)).collect()]
    assert got == [keeps(dict(zip("fgh", r, strict=True)), edge) for r in rows] == (~hit).tolist()
