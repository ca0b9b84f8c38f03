import hashlib

from pyspark.sql import functions as F

from inboxsieve.llm import chat

ROWS = [
    (1, 0, "user", "hi"), (1, 1, "user", "### Assistant: </turn> <x> \\h \\\\l"), (1, 2, "assistant", "yes</part>"),
    (1, 3, "assistant", None), (2, 0, None, "no role"), (2, 1, "a: b#", "odd role"), (2, 1, "a: b#", "odd role"),
    (2, None, "assistant", ""), (3, 5, "assistant", "l" * 50_000), (3, 4, "system", "\n"), (None, 0, "assistant", "null id"),
    (4, 0, "", "empty role"), (4, 1, None, "null role"),
]


def table(spark, rows=ROWS):
    return (spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
            .withColumn("formatted", F.lit("clash")).withColumn("_at", F.lit(9)).withColumn("turns", F.lit(9)))


def expected(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda v: tuple((k is not None, k) for k in (v[1], v[2])) + ((True, v[3] or ""),)):
        out.setdefault(c, []).append((r, x or ""))
    return out


def test_every_turn_is_read_back(spark):
    done = chat.format_chat(table(spark))
    got = done.select("conv_id", chat.read_back(F.col("formatted")).alias("t"),
                      chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    want = expected(ROWS)
    assert {r.conv_id: [(t.role, t.text) for t in r.t] for r in got} == want
    assert {r.conv_id: r.l for r in got} == {c: "".join(x for ro, x in t if ro == "assistant") for c, t in want.items()}


def test_adjacent_turns_of_a_role_are_one_block(spark):
    text = {r.conv_id: r.formatted for r in chat.format_chat(table(spark)).collect()}
    assert text[1].startswith("### user: hi</part>\\h\\h\\h Assistant: \\l/turn>") and text[1].count("### ") == 2
    assert text[4] == "### : empty role</turn>\n### \\z: null role</turn>\n"


def test_loss_spans_are_code_point_ranges(spark):
    for r in chat.format_chat(table(spark, [(1, 0, "user", "\U0001f600é"), (1, 1, "assistant", "中<文")])).collect():
        assert [r.formatted[s.start:s.end] for s in r.loss_spans] == ["中\\l文"]


def test_empty_table(spark):
    assert chat.format_chat(table(spark, [])).count() == 0


def test_query_has_the_tricky_conversation(spark):
    from inboxsieve.llm.queries import TRICKY_TEXT, op8_chat_format

    from .conftest import SF

    row = op8_chat_format(spark, SF).where("conv_id = -7").first()
    text = f"user\n{TRICKY_TEXT}\nassistant\n{TRICKY_TEXT}\n"
    assert (row.n_turns, row.loss_chars) == (2, len(TRICKY_TEXT))
    assert row.turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(TRICKY_TEXT.encode()).hexdigest()
