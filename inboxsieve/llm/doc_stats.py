"""Statistics of whole texts, as the quality rules and the quality classifier
use them.  One pass of numpy over Arrow batches; a null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import BYTE_BASE, _BYTE_VALUE, Texts, chunks, mix, prefix_hash, WORD_BASE

#: Counts of every text.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars_all", "n_lines",
          "n_upper", "n_digits", "n_letters", "n_stops", "n_exclaims", "n_same_next", "n_distinct", "n_short_words",
          "n_long_words", "max_word", "n_wide"]
#: Shares derived from the counts; they do not depend on a text's length.
SHARES = ["mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "letter_share",
          "stop_share", "exclaim_share", "same_next_share", "distinct_share", "short_share", "long_share", "wide_share",
          "words_per_line"]
FEATURES = [*SHARES, "n_words", "max_word"]

_U = np.uint64


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(chars)] = 1
    return out


SYMBOL = _class(b"#*$%&|<>")
UPPER = _class(bytes(range(0x41, 0x5B)))
DIGIT = _class(b"0123456789")
LETTER = _class(bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0xC3, 0xF5)))
STOP = _class(b".,;:?")
EXCLAIM = _class(b"!")
WIDE = _class(bytes(range(0xC2, 0xF5)))  # first bytes of characters beyond ASCII
POINT = np.ones(256, dtype=np.int64)  # bytes that begin a code point
POINT[0x80:0xC0] = 0


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each document has."""
    _, at = np.unique(hashes ^ mix(doc.astype(np.uint64) + _U(1)), return_index=True)
    return np.bincount(doc[at], minlength=n)


def repeat_words(t: Texts, hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Words of each document that lie in a 3-word window found twice or more."""
    n = len(hashes)
    covered = np.zeros(n, dtype=bool)
    if n >= 3:
        at = np.flatnonzero(doc[2:] == doc[:-2])
        keys = prefix_hash(hashes, WORD_BASE)(at, at + 3) ^ mix(doc[at].astype(np.uint64) + _U(1))
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        at = at[counts[inverse] > 1]
        covered[at] = covered[at + 1] = covered[at + 2] = True
    return np.bincount(doc, weights=covered, minlength=t.n).astype(np.int64)


def dup_lines(t: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and how many of them equal an earlier line."""
    cut = np.zeros(size + 1, dtype=bool)
    cut[t.offsets] = True
    cut[np.flatnonzero(t.data == 0x0A) + 1] = True
    bounds = np.flatnonzero(cut)
    a, b = bounds[:-1], bounds[1:]
    if not len(a):
        none = np.zeros(t.n, dtype=np.int64)
        return none, none
    b = b - (t.data[b - 1] == 0x0A)
    words = np.searchsorted(t.starts, b) - np.searchsorted(t.starts, a)
    a, b = a[words > 0], b[words > 0]
    doc = np.searchsorted(t.offsets, a, side="right") - 1
    lines = np.bincount(doc, minlength=t.n)
    hashes = prefix_hash(_BYTE_VALUE[t.data], BYTE_BASE)(a, b)
    return lines, lines - _distinct(doc, hashes, t.n)


def stats(column: pa.Array) -> dict[str, np.ndarray]:
    t = Texts(column)
    size = len(t.data)
    doc, hashes = t.doc_of_word(), t.word_hashes()
    by_byte = {k: _sums(v[t.data], t.offsets) for k, v in (
        ("n_symbols", SYMBOL), ("n_upper", UPPER), ("n_digits", DIGIT), ("n_letters", LETTER), ("n_stops", STOP),
        ("n_exclaims", EXCLAIM), ("n_wide", WIDE), ("n_chars_all", POINT))}
    points = np.zeros(size + 1, dtype=np.int64)
    np.cumsum(POINT[t.data], out=points[1:])
    word_len = points[t.ends] - points[t.starts]
    lines, dups = dup_lines(t, size)
    longest = np.zeros(t.n, dtype=np.int64)
    if len(doc):
        np.maximum.at(longest, doc, word_len)
    same = np.zeros(len(doc), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    per = lambda v: np.bincount(doc, weights=v, minlength=t.n).astype(np.int64)
    out = by_byte | {
        "n_words": t.n_words, "word_chars": per(word_len), "n_lines": lines, "n_dup_lines": dups,
        "n_repeat_words": repeat_words(t, hashes, doc), "n_same_next": per(same),
        "n_distinct": _distinct(doc, hashes, t.n) if len(doc) else np.zeros(t.n, dtype=np.int64),
        "n_short_words": per(word_len <= 2), "n_long_words": per(word_len >= 12), "max_word": longest}
    words, points, nlines = (np.maximum(out[k], 1) for k in ("n_words", "n_chars_all", "n_lines"))
    out |= {
        "mean_word": out["word_chars"] / words, "symbol_share": out["n_symbols"] / points,
        "dup_line_share": out["n_dup_lines"] / nlines, "repeat_share": out["n_repeat_words"] / words,
        "upper_share": out["n_upper"] / points, "digit_share": out["n_digits"] / points,
        "letter_share": out["n_letters"] / points, "stop_share": out["n_stops"] / words,
        "exclaim_share": out["n_exclaims"] / words, "same_next_share": out["n_same_next"] / words,
        "distinct_share": out["n_distinct"] / words, "short_share": out["n_short_words"] / words,
        "long_share": out["n_long_words"] / words, "wide_share": out["n_wide"] / points,
        "words_per_line": out["n_words"] / nlines}
    return out


def doc_stats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``<doc_id>`` and the statistics of every whole text, one row per input row."""
    narrow = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    kind = narrow.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, " + ", ".join([*(f"{c} bigint" for c in COUNTS), *(f"{c} double" for c in SHARES)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            got = stats(batch.column("_text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *(pa.array(got[c].astype(np.int64)) for c in COUNTS),
                 *(pa.array(got[c].astype(np.float64)) for c in SHARES)], ["_id", *COUNTS, *SHARES])

    return narrow.mapInArrow(rows, schema).withColumnRenamed("_id", doc_id)
