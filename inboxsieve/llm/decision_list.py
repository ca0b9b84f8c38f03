"""Quality rules learned as a decision list (sequential covering).

From labelled statistics, rules are grown one condition at a time (the
threshold test with the best information gain), pruned from the end on rows
set aside, accepted while they are precise enough there, and the rows they
cover are removed.  The result is an ordered list of threshold conjunctions,
applied as one Spark conditional expression: the first rule that holds drops
the document, a document that no rule covers is kept.

Learning runs on at most ``max_rows`` labelled rows (chosen by a hash of the
id), which is the bound on what the driver holds; statistics and verdicts
cover every document.

Cases: a null or empty text has zero statistics; documents without words are
decided like any other row; null labels and labels without a document are not
learned from; if an id has several labels the lowest counts; without usable
labels of both kinds the list is empty and keeps everything; repeated rows get
equal verdicts; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .doc_stats import FEATURES, doc_stats


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool  # value >= threshold, else value <= threshold
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.feature]
        return v >= self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


Rule = tuple[Test, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for t in rule:
        out &= t.holds(x)
    return out


def _best_test(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray, features, n_cuts: int) -> Test | None:
    """The test with the best FOIL gain among the rows inside the rule so far."""
    y = bad[inside]
    p0, n0 = int(y.sum()), int((~y).sum())
    if not p0 or not n0:
        return None
    before = np.log2(p0 / (p0 + n0))
    best, choice = 1e-9, None
    for f in features:
        v = x[f][inside]
        order = np.argsort(v, kind="stable")
        sv, pos = v[order], np.concatenate([[0], np.cumsum(y[order])])
        edges = np.flatnonzero(np.diff(sv)) + 1  # cuts between different values
        if len(edges) > n_cuts:
            edges = edges[np.linspace(0, len(edges) - 1, n_cuts).astype(int)]
        if not len(edges):
            continue
        middle = (sv[edges - 1] + sv[edges]) / 2
        for above in (False, True):
            p = p0 - pos[edges] if above else pos[edges]
            n = (len(sv) - edges if above else edges) - p
            gain = p * (np.log2(np.maximum(p, 1e-12) / np.maximum(p + n, 1)) - before)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, choice = gain[k], Test(f, above, float(middle[k]))
    return choice


def learn(x: dict[str, np.ndarray], bad: np.ndarray, features=tuple(FEATURES), max_rules: int = 24, max_tests: int = 5,
          min_precision: float = 0.95, min_cover: int = 3, n_cuts: int = 256, seed: int = 7) -> list[Rule]:
    """Ordered rules for the rows marked ``bad``; ``x`` has a column per feature."""
    bad = np.asarray(bad, dtype=bool)
    alive = np.ones(len(bad), dtype=bool)
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    for _ in range(max_rules):
        if bad[alive].sum() < min_cover:
            break
        prune = alive & (rng.random(len(bad)) < 1 / 3)
        grow = alive & ~prune
        rule: list[Test] = []
        inside = grow.copy()
        while len(rule) < max_tests and (t := _best_test(x, bad, inside, features, n_cuts)):
            rule.append(t)
            inside &= t.holds(x)
        if not rule:
            break

        def worth(k: int) -> float:
            hit = prune & _covers(tuple(rule[:k]), x, len(bad))
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            return (p - n) / max(p + n, 1)

        short = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
        kept: Rule = tuple(rule[:short])
        hit = alive & _covers(kept, x, len(bad))
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p < min_cover or p / (p + n) < min_precision:
            break
        rules.append(kept)
        alive &= ~hit
    return rules


def keeps(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression; true keeps the row."""
    out: Column | None = None
    for rule in rules:
        all_hold = rule[0].column()
        for t in rule[1:]:
            all_hold = all_hold & t.column()
        out = F.when(all_hold, False) if out is None else out.when(all_hold, False)
    return F.lit(True) if out is None else out.otherwise(True)


def labelled_rows(stats: DataFrame, labels: DataFrame, label: str, doc_id: str, max_rows: int, features):
    """At most ``max_rows`` rows of statistics with a label, ordered by a hash
    of the id, as numpy columns; ``max_rows`` bounds what the driver gets."""
    marks = (labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
             .where("_id IS NOT NULL AND _y IS NOT NULL").groupBy("_id").agg(F.min("_y").alias("_y")))
    n = marks.count()
    if n > max_rows:  # the least hashes; the limit then sorts little more than it keeps
        steps = 1 << 30
        marks = marks.where(F.pmod(F.xxhash64("_id"), F.lit(steps)) < int(steps * min(1.0, 1.2 * max_rows / n)))
    got = (stats.select(F.col(doc_id).alias("_id"), *features).join(marks, "_id")
           .orderBy(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)), "_id", *features).limit(max_rows)
           .select("_y", *features).toPandas())
    return {f: got[f].to_numpy(dtype=np.float64) for f in features}, got["_y"].to_numpy(dtype=np.int64)


def quality_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id",
                  text: str = "text", max_rows: int = 20_000, **how) -> tuple[DataFrame, list[Rule]]:
    """``(verdicts, rules)``: the statistics of every document with ``kept``
    (the list's verdict), and the learned rules.

    The statistics are computed in one pass over the texts and checkpointed
    (they are narrow), so learning and judging do not read the texts again."""
    checkpoint_dir(docs.sparkSession)
    stats = doc_stats(docs, doc_id, text).checkpoint()
    x, y = labelled_rows(stats, labels, label, doc_id, max_rows, FEATURES)
    rules = learn(x, y == 0, **how)
    return stats.withColumn("kept", keeps(rules)), rules
