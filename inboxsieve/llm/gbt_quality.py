"""Quality classifier: histogram gradient-boosted trees over document
statistics, trained with numpy and flattened into arrays, so that scoring a
batch is a handful of array lookups per tree level.

Training runs on at most ``max_rows`` labelled rows (chosen by a hash of the
id), which bounds what the driver holds; every document is scored.  A score is
the probability of label 1.

Cases: a null or empty text has zero statistics and is scored like any other;
null labels and labels without a document are not learned from; if an id has
several labels the lowest counts; without labels every score is 0.5, with
labels of one kind only every score is near that label; repeated rows get
equal scores; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .decision_list import labelled_rows
from .doc_stats import FEATURES, doc_stats


@dataclass(frozen=True)
class Trees:
    """Complete binary trees as flat arrays: node ``k`` has the children
    ``2k + 1`` (value <= threshold) and ``2k + 2``; a branch that stopped early
    sends everything left (threshold infinity)."""

    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # trees x 2^depth
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[row, self.feature[t, at]] > self.threshold[t, at])
            total += self.value[t, at - (2 ** self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def _binned(x: np.ndarray, n_bins: int) -> tuple[np.ndarray, list[np.ndarray]]:
    cuts, bins = [], np.zeros(x.shape, dtype=np.int64)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        middle = (values[1:] + values[:-1]) / 2
        if len(middle) > n_bins - 1:
            middle = np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins + 1)[1:-1]))
        cuts.append(middle)
        bins[:, f] = np.searchsorted(middle, x[:, f], side="left")
    return bins, cuts


def train(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.2, n_bins: int = 64,
          min_rows: int = 20, l2: float = 1.0) -> Trees:
    """Logistic boosting; splits are found from histograms of the gradients."""
    n, width = x.shape
    inner = 2 ** depth - 1
    share = (float(y.sum()) + 0.5) / (n + 1) if n else 0.5
    base = float(np.log(share / (1 - share)))
    feature = np.zeros((n_trees, inner), dtype=np.int64)
    threshold = np.full((n_trees, inner), np.inf)
    value = np.zeros((n_trees, inner + 1))
    if not n or not 0 < y.sum() < n:
        return Trees(feature[:0], threshold[:0], value[:0], depth, base)
    bins, cuts = _binned(x, n_bins)
    total = np.full(n, base)
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, dtype=np.int64)  # position within the level
        for level in range(depth):
            wide, first = 2 ** level, 2 ** level - 1
            best = np.full(wide, 1e-6)
            cell = node * n_bins
            for f in range(width):
                if not len(cuts[f]):
                    continue
                key = cell + bins[:, f]
                gs, hs, ns = (np.bincount(key, weights=w, minlength=wide * n_bins).reshape(wide, n_bins).cumsum(1)
                              for w in (g, h, None))
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                k = len(cuts[f])
                gl, hl, nl = gs[:, :k], hs[:, :k], ns[:, :k]
                gain = gl ** 2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt ** 2 / (ht + l2)
                gain = np.where((nl >= min_rows) & (nt - nl >= min_rows), gain, -1.0)
                at = gain.argmax(1)
                top = gain[np.arange(wide), at]
                better = top > best
                best[better] = top[better]
                feature[t, first:first + wide][better] = f
                threshold[t, first:first + wide][better] = cuts[f][at[better]]
            here = first + node
            node = 2 * node + (x[np.arange(n), feature[t, here]] > threshold[t, here])
        leaf_g = np.bincount(node, weights=g, minlength=inner + 1)
        leaf_h = np.bincount(node, weights=h, minlength=inner + 1)
        value[t] = rate * leaf_g / (leaf_h + l2)
        total += value[t, node]
    return Trees(feature, threshold, value, depth, base)


def score(stats: DataFrame, trees: Trees, doc_id: str, features=tuple(FEATURES)) -> DataFrame:
    """``<doc_id>, score`` of every row of statistics."""
    narrow = stats.select(F.col(doc_id).alias("_id"), *(F.col(f).cast("double").alias(f) for f in features))
    kind = narrow.schema["_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(trees.score(x))], ["_id", "score"])

    return narrow.mapInArrow(rows, f"_id {kind}, score double").withColumnRenamed("_id", doc_id)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id",
                   text: str = "text", learn_from: Column | None = None, max_rows: int = 20_000,
                   **how) -> tuple[DataFrame, Trees]:
    """``(scores, trees)``: ``<doc_id>, score`` for every document, and the
    model.  ``learn_from`` is a condition on the label rows.

    The statistics are computed in one pass over the texts and checkpointed
    (they are narrow); training and scoring read them from there."""
    checkpoint_dir(docs.sparkSession)
    stats = doc_stats(docs, doc_id, text).checkpoint()
    used = labels if learn_from is None else labels.where(learn_from)
    x, y = labelled_rows(stats, used, label, doc_id, max_rows, FEATURES)
    trees = train(np.column_stack([x[f] for f in FEATURES]), y, **how)
    return score(stats, trees, doc_id), trees
