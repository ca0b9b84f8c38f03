"""Redaction, signature stripping, input screening, prescreen.

All of it is chained native expressions (regexp_replace / split / HOFs) that
stay inside one projection; no UDF, no shuffle.  Texts are processed whole.
"""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsre import NA, NB, WS, js_trim, js_trim_end, utf16_length

# ---------------------------------------------------------------------------
# PII patterns, applied in this order, and their replacement
# tokens.  JS ``\s`` is spelled as the explicit whitespace class and ``\b`` as
# ASCII lookarounds so that Java matches what the JavaScript patterns match.
#
# A pattern is tried at every character, so each one tells from that character
# alone that it cannot begin there, and looks behind after it.  A mail address
# begins with its run of local characters, or where the last match ended inside
# that run; classes are written out, as Java looks single characters up in a
# bit set and ranges one by one.
# ---------------------------------------------------------------------------
_DIGITS, _LETTERS = string.digits, string.ascii_letters
_LOCAL = f"{_LETTERS}{_DIGITS}._%+-"
EMAIL_PATTERN = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LETTERS}{_DIGITS}.-]+\.[{_LETTERS}]{{2,}}"
PHONE_PATTERN = rf"(?=[+({_DIGITS}])(?:\+?1[-.{WS}]?)?(?:\(?\d{{3}}\)?[-.{WS}]?)\d{{3}}[-.{WS}]?\d{{4}}"
URL_PATTERN = rf"(?i)h(?<![0-9A-Z_]h)ttps?://[^{WS}]+"
SSN_PATTERN = rf"\d(?<![0-9A-Za-z_]\d)\d{{2}}-\d{{2}}-\d{{4}}{NA}"
CARD_NUMBER_PATTERN = rf"\d(?<![0-9A-Za-z_]\d)[ -]*?(?:\d[ -]*?){{12,15}}{NA}"

PII_RULES = [
    (EMAIL_PATTERN, "[EMAIL]"),
    (PHONE_PATTERN, "[PHONE]"),
    (URL_PATTERN, "[URL]"),
    (SSN_PATTERN, "[SSN]"),
    (CARD_NUMBER_PATTERN, "[CARD_NUMBER]"),
]
PII_NEEDED = {"[EMAIL]": "@", "[URL]": "://"}  # what each match of a rule has

# Signature detection.
SIGNATURE_SEPARATOR_PATTERN = rf"\n--[{WS}]*\n"
SIGNOFF_PATTERN = (
    r"(?i)^(thanks|thank you|best|best regards|regards|kind regards|sincerely|"
    rf"cheers|warmly|respectfully)[,!.{WS}]*\z"
)
SENT_FROM_PATTERN = r"(?i)^sent from my "
SIGNATURE_MARKER = "\n[SIGNATURE_REMOVED]"
SIGNATURE_SCAN_LINES = 10

# Input screening messages.
EVAL_REJECT_REASON = "Expected non-empty subject and body strings"
INBOUND_REJECT_REASON = "Invalid input detected. Please provide an email subject and body"
# ---------------------------------------------------------------------------


def redact_pii_col(col: Column) -> Column:
    """O1 on one column: the five replacements in their fixed order.  A text
    without what every match of a rule has is not searched."""
    out = col
    for pattern, token in PII_RULES:
        needed = PII_NEEDED.get(token)
        out = F.regexp_replace(out, pattern, token) if needed is None else _replace_where(out, needed, pattern, token)
    return out


def _replace_where(col: Column, needed: str, pattern: str, token: str) -> Column:
    # the text is a lambda variable, so that what gives it is evaluated once
    def replaced(x: Column) -> Column:
        return F.when(F.contains(x, F.lit(needed)), F.regexp_replace(x, pattern, token)).otherwise(x)

    return F.element_at(F.transform(F.array(col), replaced), 1)


def strip_signature_col(col: Column) -> Column:
    """O2 on one column.

    CRLF is normalised first.  The first ``\\n--<ws>\\n`` separator wins;
    otherwise the lowest of the last 10 lines whose trimmed text is a sign-off
    or starts with "sent from my " cuts the text.  The kept prefix is
    right-trimmed and the removal marker appended.
    """
    n = F.replace(col, F.lit("\r\n"), F.lit("\n"))
    sep_pos = F.when(F.contains(n, F.lit("\n--")), F.regexp_instr(n, F.lit(SIGNATURE_SEPARATOR_PATTERN)))
    tail = F.split(F.substring_index(n, "\n", -SIGNATURE_SCAN_LINES), "\n", -1)

    def is_signoff(line: Column, i: Column) -> Column:
        t = js_trim(line)
        return F.when(t.rlike(SIGNOFF_PATTERN) | t.rlike(SENT_FROM_PATTERN), i)

    hit = F.array_max(F.transform(tail, is_signoff))  # 0-based in the last lines
    cut = F.array_join(F.slice(tail, hit + 1, SIGNATURE_SCAN_LINES), "\n")
    return (
        F.when(sep_pos > 0,
               F.concat(js_trim_end(n.substr(F.lit(1), sep_pos - 1)), F.lit(SIGNATURE_MARKER)))
        .when(hit.isNotNull(),
              F.concat(js_trim_end(F.left(n, F.length(n) - F.length(cut))), F.lit(SIGNATURE_MARKER)))
        .otherwise(n)
    )


def redact_pii(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """O1: replace personal data in the given string columns."""
    return df.withColumns({c: redact_pii_col(F.col(c)) for c in cols})


def strip_signatures(df: DataFrame, col: str = "body") -> DataFrame:
    """O2: remove the signature block of a text column."""
    return df.withColumn(col, strip_signature_col(F.col(col)))


def sanitize_emails(emails: DataFrame, subject: str = "subject", text: str = "text",
                    keep: Iterable[str] = ("email_id",)) -> DataFrame:
    """O3: the categorizer input of the inbound path.

    ``subject`` is only redacted; ``body`` is ``text`` (NULL -> '') with the
    signature stripped, then redacted.
    """
    body = redact_pii_col(strip_signature_col(F.coalesce(F.col(text), F.lit(""))))
    return emails.select(*keep, redact_pii_col(F.col(subject)).alias("subject"), body.alias("body"))


def screen_flag(subject: Column, body: Column, mode: str) -> Column:
    """The rejection reason of O4, NULL when the row is accepted.

    ``eval``: both must be strings that are non-empty after ``trim()``.
    ``inbound``: both must be non-empty as they are (no trim).
    """
    if mode == "eval":
        bad = subject.isNull() | body.isNull() | (js_trim(subject) == "") | (js_trim(body) == "")
        return F.when(bad, F.lit(EVAL_REJECT_REASON))
    if mode == "inbound":
        bad = subject.isNull() | body.isNull() | (subject == "") | (body == "")
        return F.when(bad, F.lit(INBOUND_REJECT_REASON))
    raise ValueError(f"unknown screening mode: {mode}")


def screen_raw_inbound(emails: DataFrame, subject: str = "subject", text: str = "text",
                       keep: Iterable[str] = ("email_id",)) -> tuple[DataFrame, DataFrame]:
    """O3 + O4 (inbound) with the screen moved in front of the regex work.

    Equivalent to screening the sanitized mail: every replacement token and
    the signature marker are non-empty, so a redacted subject is empty iff
    the raw one is, and a sanitized body is empty iff ``text`` (NULL -> '')
    is.  Screening first keeps the filter on raw columns - it is never
    rewritten into a second evaluation of the regex chain - and rejected
    mail is never sanitized.  Returns (sanitized accepted, rejected).
    """
    keep = list(keep)
    reason = screen_flag(F.col(subject), F.coalesce(F.col(text), F.lit("")), "inbound")
    flagged = emails.withColumn("reject_reason", reason)
    ok = sanitize_emails(flagged.filter(F.col("reject_reason").isNull()), subject, text, keep)
    bad = sanitize_emails(flagged.filter(F.col("reject_reason").isNotNull()), subject, text,
                          keep + ["reject_reason"])
    # rejected mail keeps only the lengths of what the categorizer was handed
    rejected = bad.select(*keep, "reject_reason", utf16_length(F.col("subject")).alias("subject_length"),
                          utf16_length(F.col("body")).alias("body_length"))
    return ok, rejected


def screen_inputs(df: DataFrame, mode: str, subject: str = "subject",
                  body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Split rows into (accepted, rejected with ``reject_reason``)."""
    flagged = df.withColumn("reject_reason", screen_flag(F.col(subject), F.col(body), mode))
    ok = flagged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    rejected = flagged.filter(F.col("reject_reason").isNotNull())
    return ok, rejected


# ---------------------------------------------------------------------------
# O28 prescreen (design note only in the reference: drop obvious spam or
# incomplete mail before any model call).  Rules are data, given by the user.
# ---------------------------------------------------------------------------
DEFAULT_PRESCREEN_RULES: dict[str, str] = {
    # rule name -> Java regex matched against subject + "\n" + body
    "empty_body": r"\A[" + WS + r"]*\z",
    "unsubscribe_footer": r"(?i)" + NB + "unsubscribe" + NA,
}


def prescreen_flag(emails: DataFrame, rules: dict[str, str] | None = None, subject: str = "subject",
                   body: str = "body") -> DataFrame:
    """The mails with ``prescreen_rule`` = first matching rule (NULL: keep).

    A rule whose pattern matches only the whole body is tested on the body;
    its name does not matter."""
    rules = DEFAULT_PRESCREEN_RULES if rules is None else rules
    text = F.concat_ws("\n", F.coalesce(F.col(subject), F.lit("")), F.coalesce(F.col(body), F.lit("")))
    body_only = F.coalesce(F.col(body), F.lit(""))
    rule = F.lit(None).cast("string")
    for name, pattern in reversed(list(rules.items())):
        target = body_only if pattern.startswith("\\A") and pattern.endswith("\\z") else text
        rule = F.when(target.rlike(pattern), F.lit(name)).otherwise(rule)
    return emails.withColumn("prescreen_rule", rule)


def prescreen(emails: DataFrame, rules: dict[str, str] | None = None, subject: str = "subject",
              body: str = "body") -> tuple[DataFrame, DataFrame]:
    """O28 split: (kept, dropped with ``prescreen_rule``)."""
    flagged = prescreen_flag(emails, rules, subject, body)
    return (flagged.filter(F.col("prescreen_rule").isNull()).drop("prescreen_rule"),
            flagged.filter(F.col("prescreen_rule").isNotNull()))
