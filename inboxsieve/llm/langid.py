"""Language identification by rank-order profiles (out-of-place distance).

A profile is the list of the most frequent 1- to 3-grams of letters, words
padded on both sides, ranked by count (ties by n-gram).  A language's profile
is counted over all its learning documents; a document gets the language whose
profile has the least sum of rank differences, an n-gram missing there costing
the profile's length.  The score is 1 - distance / greatest possible distance.

Cases: a text that is null or has no letter is ``und`` with score 0; so is
every document when nothing could be learned; documents with a null language
are not learned from; equal distances go to the language first by code point;
repeated rows count as often as they occur and get equal results; other
columns are ignored, whatever their names.  Very long texts are whole: memory
follows the longest text.

The driver holds ``size`` n-grams for each language value, nothing that grows
with the documents.  Counts are added up inside each task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNDETERMINED = "und"
NONE = 0x1FFFFF  # fills the unused places of a shorter n-gram's code
FLUSH = 1_000_000  # different n-grams a task holds for a language before it writes them out

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def ngram_codes(text: str) -> np.ndarray:
    """Codes of all 1- to 3-grams of the lower-cased letters, 21 bits for each
    place; a run of other characters is one pad (0)."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _is_letter()[points]
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a letter stays as the pad
    c = np.where(letter, points, 0)[keep].astype(np.int64)
    c = np.concatenate([[0], c, [0]] if c[-1] else [[0], c])
    one = c[c > 0]
    a, b, d = c[:-2], c[1:-1], c[2:]
    middle = b > 0
    return np.concatenate([one << 42 | NONE << 21 | NONE, c[:-1] << 42 | c[1:] << 21 | NONE,
                           (a << 42 | b << 21 | d)[middle]])


def _top(codes: np.ndarray, size: int) -> np.ndarray:
    found, counts = np.unique(codes, return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:size]]


def count_ngrams(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """``lang, code, n``: n-gram counts of all documents with a language."""
    narrow = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        amount: dict[str, int] = {}

        def add_up(name: str) -> None:
            new, counts = np.unique(np.concatenate(waiting.pop(name)), return_counts=True)
            amount.pop(name)
            if name in held:
                old, before = held[name]
                both, inverse = np.unique(np.concatenate([old, new]), return_inverse=True)
                counts = np.bincount(inverse, weights=np.concatenate([before, counts])).astype(np.int64)
                new = both
            held[name] = new, counts

        def out(name: str) -> pa.RecordBatch:
            codes, counts = held.pop(name)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes),
                                               pa.array(counts)], ["lang", "code", "n"])

        for batch in batches:
            for name, value in zip(batch.column("_lang"), batch.column("_text"), strict=True):
                codes = ngram_codes(value.as_py())
                name = name.as_py()
                waiting.setdefault(name, []).append(codes)
                amount[name] = amount.get(name, 0) + len(codes)
                if amount[name] > 2_000_000:
                    add_up(name)
                    if len(held[name][0]) > FLUSH:
                        yield out(name)
        for name in list(waiting):
            add_up(name)
        for name in list(held):
            yield out(name)

    return (narrow.mapInArrow(rows, "lang string, code bigint, n bigint")
            .groupBy("lang", "code").agg(F.sum("n").alias("n")))


def learn_profiles(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = 300) -> dict[str, np.ndarray]:
    """The codes of each language's profile, most frequent first."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = (count_ngrams(docs, lang, text).select("lang", "code", F.row_number().over(order).alias("rank"))
           .where(F.col("rank") <= size).collect())
    found: dict[str, list[tuple[int, int]]] = {}
    for r in top:
        found.setdefault(r["lang"], []).append((r["rank"], r["code"]))
    return {k: np.array([c for _, c in sorted(v)], dtype=np.int64) for k, v in sorted(found.items())}


class Profiles:
    """All profiles as one matrix: language x known n-gram -> rank."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.names = list(profiles)
        self.size = size
        self.codes = np.unique(np.concatenate([*profiles.values(), np.zeros(0, dtype=np.int64)]))
        self.ranks = np.full((len(self.names), len(self.codes) + 1), -1, dtype=np.int64)  # the last: unknown
        for k, codes in enumerate(profiles.values()):
            self.ranks[k, np.searchsorted(self.codes, codes)] = np.arange(len(codes))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = ngram_codes(text or "")
        if not len(codes) or not self.names:
            return UNDETERMINED, 0.0
        top = _top(codes, self.size)
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        at = np.where(self.codes[at] == top, at, len(self.codes))
        ranks = self.ranks[:, at]
        distance = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top)))).sum(axis=1)
        best = int(np.argmin(distance))
        return self.names[best], float(1 - distance[best] / (self.size * len(top)))


def identify(docs: DataFrame, learn_from: Column | None = None, lang: str = "lang", text: str = "text",
             size: int = 300, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The rows of ``docs`` with ``pred`` and ``score`` added (a column of the
    input by either name is replaced).  ``learn_from``: condition on the
    learning rows."""
    learning = docs if learn_from is None else docs.where(learn_from)
    profiles = Profiles(learn_profiles(learning, lang, text, size), size)
    kept = [c for c in docs.columns if c.lower() not in (pred.lower(), score.lower())]
    base = docs.select(*(F.col(f"`{c}`") for c in kept))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields),
                        f"`{pred}` string, `{score}` double"])
    place = kept.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [profiles.predict(v.as_py()) for v in batch.column(place)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                [*batch.schema.names, pred, score])

    return base.mapInArrow(rows, schema)
