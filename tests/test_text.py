"""JavaScript-exact trim, lengths, redaction and signature removal."""

from pyspark.sql import functions as F

from inboxsieve.functions.jsre import JS_WS_CHARS, NA, NB, WS, js_trim, utf16_length
from inboxsieve.operators import sanitize


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_js_trim_strips_unicode_whitespace(spark):
    assert one(spark, JS_WS_CHARS + "a b" + JS_WS_CHARS, js_trim) == "a b"
    assert one(spark, "  x　", js_trim) == "x"


def test_utf16_length_counts_surrogates(spark):
    assert one(spark, "a\U0001F600b", utf16_length) == 4
    assert one(spark, "é", utf16_length) == 1


PII_CASES = [
    ("4111111111111111", "[PHONE]111111"),
    ("4111 1111 1111 1111", "[CARD_NUMBER]"),
    ("1234567890123", "[PHONE]23"),
    ("123-45-6789", "[SSN]"),
    ("https://a@b.com/x y", "[URL] y"),
    ("https://x.com/u?p=5551234567", "[URL]"),
    ("éhttp://x.fr é123-45-6789é", "é[URL] é[SSN]é"),
    ("_http://x.fr", "_http://x.fr"),
    ("4111-1111-1111-1111x", "4111-1111-1111-1111x"),
    ("mail jane.doe@example.co.uk now", "mail [EMAIL] now"),
    ("call (555) 123-4567", "call [PHONE]"),
]


def test_redact_pii_examples(spark):
    df = spark.createDataFrame(PII_CASES, "x string, want string")
    got = df.select("want", sanitize.redact_pii_col(F.col("x")).alias("got")).collect()
    assert [(r["got"]) for r in got] == [w for _, w in PII_CASES]


SIG_CASES = [
    ("Hello\n--\nJohn\nCEO", "Hello\n[SIGNATURE_REMOVED]"),
    ("Hello  \n-- \n\nJohn", "Hello\n[SIGNATURE_REMOVED]"),
    ("Please quote.\n\nThanks,\nJane", "Please quote.\n[SIGNATURE_REMOVED]"),
    ("Please quote.\r\nBest regards\r\nJane", "Please quote.\n[SIGNATURE_REMOVED]"),
    ("Quote?\nKind regards!!\n\nSent from my iPhone", "Quote?\nKind regards!!\n[SIGNATURE_REMOVED]"),
    ("Thanks", "\n[SIGNATURE_REMOVED]"),
    ("No sign-off here\r\nat all", "No sign-off here\nat all"),
    ("Thanks for the quote yesterday\nbye", "Thanks for the quote yesterday\nbye"),
    ("\n".join(["Thanks"] + [f"line {i}" for i in range(10)]),
     "\n".join(["Thanks"] + [f"line {i}" for i in range(10)])),
]


def test_strip_signature_examples(spark):
    df = spark.createDataFrame(SIG_CASES, "x string, want string")
    got = [r["got"] for r in df.select(sanitize.strip_signature_col(F.col("x")).alias("got")).collect()]
    assert got == [w for _, w in SIG_CASES]


def test_sanitize_strips_then_redacts_body_only(spark):
    df = spark.createDataFrame([(1, "Call 555-123-4567", "Quote please 555-123-4567\n\nThanks,\nJo 555-000-1111")],
                               "email_id long, subject string, text string")
    r = sanitize.sanitize_emails(df).first()
    assert r["subject"] == "Call [PHONE]"
    assert r["body"] == "Quote please [PHONE]\n[SIGNATURE_REMOVED]"


def test_screen_inputs_modes(spark):
    df = spark.createDataFrame([(1, "s", "b"), (2, "  ", "b"), (3, "s", ""), (4, None, "b")],
                               "id long, subject string, body string")
    ok_eval, bad_eval = sanitize.screen_inputs(df, "eval")
    ok_in, bad_in = sanitize.screen_inputs(df, "inbound")
    assert sorted(r["id"] for r in ok_eval.collect()) == [1]
    assert sorted(r["id"] for r in ok_in.collect()) == [1, 2]
    assert {r["reject_reason"] for r in bad_in.collect()} == {sanitize.INBOUND_REJECT_REASON}
    assert bad_eval.count() == 3


def test_prescreen_rules(spark):
    df = spark.createDataFrame([(1, "Hi", "  \n "), (2, "Deals", "Click to Unsubscribe."), (3, "Quote", "stump")],
                               "id long, subject string, body string")
    kept, dropped = sanitize.prescreen(df)
    assert [r["id"] for r in kept.collect()] == [3]
    assert sorted((r["id"], r["prescreen_rule"]) for r in dropped.collect()) == [
        (1, "empty_body"), (2, "unsubscribe_footer")]


def test_screen_before_sanitize_is_equivalent(spark):
    df = spark.createDataFrame([(1, "x@y.com", "Thanks"), (2, "", "b"), (3, "s", None), (4, "s", "\r\n"),
                                (5, " ", "--\n")], "email_id long, subject string, text string")
    ok1, _ = sanitize.screen_inputs(sanitize.sanitize_emails(df), "inbound")
    ok2, bad2 = sanitize.screen_raw_inbound(df)
    assert sorted(map(tuple, ok1.collect())) == sorted(map(tuple, ok2.collect()))
    assert sorted(r["email_id"] for r in bad2.collect()) == [2, 3]


# the patterns as the reference writes them, with its \s and \b spelled out
PLAIN_RULES = [
    (r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "[EMAIL]"),
    (rf"(?:\+?1[-.{WS}]?)?(?:\(?\d{{3}}\)?[-.{WS}]?)\d{{3}}[-.{WS}]?\d{{4}}", "[PHONE]"),
    (rf"(?i){NB}https?://[^{WS}]+", "[URL]"),
    (rf"{NB}\d{{3}}-\d{{2}}-\d{{4}}{NA}", "[SSN]"),
    (rf"{NB}(?:\d[ -]*?){{13,16}}{NA}", "[CARD_NUMBER]"),
]


def test_redaction_matches_the_plain_patterns(spark):
    import random
    rng = random.Random(5)
    parts = ["a", "b.c", "@", "@x.co", "@é.com", "foo@bar.com", "a@b.co1@c.com", "._%+-", ".", "-", "K", "ſ", "\n", " ",
             "1", "12", "123", "4567", "+1", "(555)", "(", "+", " 555.987.6543", "123-45-6789", "4111 1111 1111 1111",
             "http", "https://", "HTTP://", "h", "_http://y", "://", "[EMAIL]", "\U0001f600", "﻿"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(8000)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.col("t")
    for pattern, token in PLAIN_RULES:
        plain = F.regexp_replace(plain, pattern, token)
    assert df.where(plain != F.col("t")).count() > 4000
    assert df.where(~plain.eqNullSafe(sanitize.redact_pii_col(F.col("t")))).take(1) == []


def test_redaction_is_linear_in_a_long_run(spark):
    """A run of letters is read once, not once from each of its letters."""
    import time
    run = "a" * 300_000
    df = spark.createDataFrame([(f"@ {run} b@c.com",)], "t string").select(sanitize.redact_pii_col(F.col("t")).alias("t"))
    begun = time.monotonic()
    assert df.first().t == f"@ {run} [EMAIL]"
    assert time.monotonic() - begun < 20
