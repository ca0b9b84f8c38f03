import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall(text or "")


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}{'abcde'[rng.randrange(5)]}" for _ in range(n))


def messy_rows():
    """(doc_id, text, lang, source): nulls in every column, empty, blank and
    very long texts, repeated rows, copies, near copies, shared passages."""
    base, passage = prose(1, 200), prose(2, 80)
    near = base.split()
    near[100] = "changed"
    rows = [
        (0, base, "en", "a"), (1, base, "en", "b"), (2, " ".join(near), "en", "a"), (3, None, "en", "a"),
        (4, "", None, "b"), (5, " \t\n\x0b ", "de", None), (6, "one", "de", "c"), (7, "one", "de", "c"),
        (8, prose(3, 60) + " " + passage + " " + prose(4, 40), "fr", "a"),
        (9, prose(5, 10) + "\n" + passage + "\n" + prose(6, 70), "fr", "a"),
        (10, passage, None, "b"), (11, prose(7, 30_000, 50_000), "en", None), (12, "x" * 30_000, "en", "c"),
        (13, "\u00e9\u00e8 \u4e2d\u6587 \U0001f600 caf\u00e9 A\u00a0B", None, "c"), (14, "a b c", "en", "c"),
        (14, "a b c", "en", "c"), (15, passage[:200], "en", "d"), (16, "1 " * 5000, "en", "d"),
    ]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    """The rows above with columns whose names clash with internal ones."""
    names = ["_id", "_text", "_row", "_key", "n", "cls", "col", "score", "lang_pred", "ids", "spans", "size", "kept", "copies"]
    return messy_table(spark, messy_rows(), names)


def messy_table(spark, rows, more=()):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    schema += "".join(f", `{c}` string" for c in more)
    return spark.createDataFrame(
        [(i, t, la, s, len(t) if t is not None else None, *["clash"] * len(more)) for i, t, la, s in rows], schema)


@pytest.fixture(scope="session")
def nothing(spark):
    return messy_table(spark, [])
