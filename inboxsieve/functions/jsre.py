"""JavaScript-exact text semantics as native Spark Column expressions.

The triage contract is defined in terms of ECMAScript string behaviour
(``String.prototype.trim``, regex ``\\s``/``\\b``, UTF-16 ``length``).  Spark's
``trim`` strips only spaces and Java's ``\\b`` treats accented letters as word
characters, so every operator goes through the helpers below instead.
Everything here returns a ``Column``; nothing runs in Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The ECMAScript whitespace set (WhiteSpace + LineTerminator),
# i.e. what ``trim()`` strips and what regex ``\s`` matches:
# TAB, LF, VT, FF, CR, SPACE, NBSP, OGHAM SPACE MARK, EN QUAD .. HAIR SPACE
# (U+2000-U+200A), LINE SEPARATOR, PARAGRAPH SEPARATOR, NARROW NBSP,
# MEDIUM MATHEMATICAL SPACE, IDEOGRAPHIC SPACE, ZERO WIDTH NO-BREAK SPACE.
# ---------------------------------------------------------------------------
JS_WS_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    + "".join(chr(cp) for cp in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# The same set as the inside of a character class, Java regex spelling.
WS = (
    r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029"
    r"\u202F\u205F\u3000\uFEFF"
)
# ... and RE2 spelling (used only by the DuckDB oracle SQL).
WS_RE2 = (
    r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}\x{FEFF}"
)

# ASCII word boundary as lookarounds: JS (no ``u`` flag) and RE2 treat only
# [0-9A-Za-z_] as word characters, Java's ``\b`` does not.
NB = r"(?<![0-9A-Za-z_])"  # a word boundary before a word character
NA = r"(?![0-9A-Za-z_])"  # a word boundary after a word character


def js_trim(col: Column) -> Column:
    """``String.prototype.trim``."""
    return F.btrim(col, F.lit(JS_WS_CHARS))


def js_trim_end(col: Column) -> Column:
    """``String.prototype.trimEnd``."""
    return F.rtrim(col, F.lit(JS_WS_CHARS))


def utf16_length(col: Column) -> Column:
    """``String.prototype.length`` (UTF-16 code units, not code points)."""
    return (F.octet_length(F.encode(col, "UTF-16BE")) / 2).cast("long")


def js_blank(col: Column) -> Column:
    """True when a string is empty after ``trim()`` (NULL stays NULL)."""
    return js_trim(col) == F.lit("")
