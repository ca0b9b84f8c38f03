import hashlib
import re

from pyspark.sql import functions as F

from inboxsieve.llm import pii_bootstrap as pii
from inboxsieve.llm.queries import op10_pii_bootstrap, table

from .conftest import SF, messy_rows, messy_table

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum((2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) if k % 2 else int(d) for k, d in enumerate(digits[::-1]))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(PLAIN.items())
                  for m in re.finditer(p, text or "") if valid(k, m[0]))


def written(spans):
    return ",".join(f"{k}:{a}:{e}" for a, _, e, k in spans)


HARD = [
    "a@b.c_d@e.f x@y x@y.z. <joe@mail.example.com>, é@ü.de ~j@k.l", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 007.08.09.0255 1..2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 12-3 4", "+1 (972) 555-6416 +49.30.1234567 +1 2 +12345678901234567 +()",
    "😀 +1 (972) 555-6416 中文 a@b.cd", "1" * 30_000 + " " + "a" * 30_000 + "@", "1 " * 20_000 + "x", "a.b" * 10_000, "9.9.9.9" * 500,
    "+1" * 3000, "a@b." * 2000 + "c",
]


def seeds(df):
    return {r.doc_id: written((s.start, s.rank - 1, s.end, s.kind) for s in r.spans if s.seed) for r in df.collect()}


def test_hard_and_messy_texts(spark, messy):
    got = seeds(pii.find_identifiers(messy_table(spark, [(k, t, "en", "a") for k, t in enumerate(HARD)])))
    assert got == {k: written(base(t)) for k, t in enumerate(HARD)}
    assert seeds(pii.find_identifiers(messy)) == {i: written(base(t)) for i, t, _, _ in messy_rows()}


def test_query_on_the_table(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = op10_pii_bootstrap(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(written(spans).encode()).hexdigest()
        assert {k: getattr(r, f"n_{k}") for k in PLAIN} == {k: sum(s[3] == k for s in spans) for k in PLAIN}
        assert set(written(spans).split(",")) <= set(r.spans.split(",")) or not spans


def test_a_text_full_of_identifiers(spark):
    """200,000 identifiers in one text, and 50,000 to be replaced."""
    import time
    many = " ".join(f"u{k}@x.io" for k in range(200_000))
    some = "é中😀 " + " and ".join(f"u{k}@x.io" for k in range(50_000)) + " end"
    docs = messy_table(spark, [(1, many, "en", "a"), (2, some, "en", "a")])
    began = time.time()
    got = {r.doc_id: r.n for r in pii.find_identifiers(docs).select("doc_id", F.size("spans").alias("n")).collect()}
    assert got == {1: 200_000, 2: 50_000}
    clean = pii.redact(docs.where("doc_id = 2")).first().text
    assert clean == "é中😀 " + " and ".join(["[EMAIL]"] * 50_000) + " end"
    assert time.time() - began < 120


def test_short_candidates_may_be_left_out(spark):
    rows = [(k, f"agent id: a{k}@x.io spoke") for k in range(12)] + [(50, "agent id: x7 spoke")]
    docs = messy_table(spark, [(i, t, "en", "a") for i, t in rows])
    found = lambda **how: [(s.start, s.end) for r in pii.find_identifiers(docs, **how).where("doc_id = 50").collect()
                           for s in r.spans]
    assert found() == [(10, 12)] and found(min_length=3) == []


def context_rows():
    rows = [(k, f"hello there, my mailbox: user{k}@example.com is open, see chapter 1{k}00") for k in range(12)]
    return rows + [(50, "my mailbox: joe(at)corp.example thanks"), (51, "chapter 1700, joe(at)corp.example wrote"),
                   (52, "chapter 1800 is new"), (None, "my mailbox: joe(at)corp.example"), (53, None)]


def test_context_discovers_unseen_identifiers(spark):
    docs = messy_table(spark, [(i, t, "en", "a") for i, t in context_rows()], ["kind", "match", "spans"])
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans if not s.seed] for r in pii.find_identifiers(docs).collect()}
    assert got[50] == [(12, 31, "email")] and got[51] == [(14, 33, "email")] and got[None] == [(12, 31, "email")]
    assert all(not v for k, v in got.items() if k not in (50, 51, None))
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[50] == "my mailbox: [EMAIL] thanks" and clean[52] == "chapter 1800 is new" and clean[53] is None
    assert clean[3] == "hello there, my mailbox: [EMAIL] is open, see chapter 1300"


def discovered(spark, seeds, rest):
    """What is found in ``rest`` beside the texts of ``seeds`` (each of 12 addresses)."""
    rows = [(k, s.format(m=f"user{k}.{n}@example.com"), "en", "a") for n, s in enumerate(seeds) for k in range(12)]
    rows += [(1000 + k, t, "en", "a") for k, t in enumerate(rest)]
    found = pii.find_identifiers(messy_table(spark, rows)).where("doc_id >= 1000").orderBy("doc_id").collect()
    return [[rest[r.doc_id - 1000][s.start:s.end] for s in r.spans if not s.seed] for r in found]


def test_context_is_taken_from_the_whole_text(spark):
    long, seeds = "w" * 200, [
        "see user_id: <{m}> here", "line_2 mailbox {m}", "x_1@home.example {m}", "w" * 200 + " " * 200 + "{m}", "at mail:{m};z.{m}"]
    rest = {
        'old user_id: "a(at)corp.example" left': ["a(at)corp.example"], "new chapter.2 begins": [],
        "line_2 mailbox b(at)corp.example": ["b(at)corp.example"], "mailbox full " * 90: [],  # only the two words tell
        "x_1@home.example c(at)corp.example": ["c(at)corp.example"],  # the second of a list
        f"{long} d(at)corp.example": ["d(at)corp.example"], "at e(at)corp.example": ["e(at)corp.example"]}
    assert discovered(spark, seeds, list(rest)) == list(rest.values())
    # seeds that share a word share its place: 12 of 25 places, not 24
    assert discovered(spark, seeds[-1:], ["at e(at)corp.example", "at home " * 12]) == [[], []]


def test_rounds_go_on_to_the_end_of_a_chain(spark):
    steps = 6  # instances of each step are known by the pattern they share with the one before
    rows = [f"w0 user{k}@example.com" for k in range(12)]
    rows += [f"w{n} s{n}k{k}.x" for n in range(steps) for k in range(6)] + [f"w{n + 1} s{n}k{k}.x" for n in range(steps) for k in range(6)]
    docs = messy_table(spark, [(k, t, "en", "a") for k, t in enumerate(rows)])
    found = {r.doc_id for r in pii.find_identifiers(docs, accept=0.4).collect() if r.spans}
    assert found == set(range(len(rows)))


def test_repeated_rows_leave_the_confidence_as_it_is(spark):
    docs = messy_table(spark, [(i, t, "en", "a") for i, t in context_rows()])
    got = {r.doc_id: r.spans for r in pii.find_identifiers(docs.unionByName(docs)).collect()}
    assert got == {r.doc_id: r.spans for r in pii.find_identifiers(docs).collect()} and got[50]


def test_redaction_merges_overlaps_and_keeps_columns(spark, messy, nothing):
    docs = messy_table(spark, [(1, "x +14111111111111111 4111111111111111 y 1.2.3.4@a.b", "en", "a")])
    assert pii.redact(docs).first().text == re.sub("", "", redacted(docs.first().text))
    assert pii.redact(messy).columns == messy.columns and pii.redact(messy).count() == messy.count()
    assert pii.find_identifiers(nothing).count() == 0 and pii.redact(nothing).count() == 0


def redacted(text):
    out, at = "", 0
    for a, _, e, k in base(text):
        if a >= at:
            out += text[at:a] + f"[{k.upper()}]"
        at = max(at, e)
    return out + text[at:]


def test_no_python_on_the_executors(spark):
    plan = op10_pii_bootstrap(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
