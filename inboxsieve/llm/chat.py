"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted, and adjacent
turns of one role are merged into one block, which is concatenated as

    ### <role>: <text></turn>          (one turn)
    ### <role>: <text></part><text></turn>   (merged turns)

each block followed by a line feed.  Inside roles and texts the characters
that could form a marker are escaped (``\\`` -> ``\\b``, ``<`` -> ``\\l``,
``#`` -> ``\\h``, in roles also ``:`` -> ``\\c``), so no text can imitate a
marker and every turn can be read back unchanged.  ``loss_spans`` are the
code point ranges of the assistant texts in the formatted string.

Cases: a null text is an empty one; a null role is kept apart from an empty
one (written ``\\z``) and read back as null; turns with equal numbers are
ordered by role, then text, and repeated rows are turns of their own; a null
conversation id is a conversation like any other; an empty table gives an
empty one.  Other columns of the input are ignored, whatever their names.

The window and the aggregation use one shuffle on the conversation.  A row of
the result is a whole conversation, so its turns meet in one task by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, PART, TURN = "### ", "</part>", "</turn>\n"
LOSS_ROLE = "assistant"
ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c")]
NULL_ROLE = "\\z"


def escape(col: Column, escapes=ESCAPES) -> Column:
    for plain, code in escapes:
        col = F.replace(col, F.lit(plain), F.lit(code))
    return col


def unescape(col: Column, escapes=ESCAPES) -> Column:
    # a backslash of an escaped string always begins a code, and the code of
    # the backslash itself is undone last
    for plain, code in reversed(escapes):
        col = F.replace(col, F.lit(code), F.lit(plain))
    return col


def format_chat(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text", loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conversation: ``<conv>, formatted, loss_spans``
    (array of ``start, end``, code points, end exclusive)."""
    rows = conversations.select(
        F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.col(role).alias("_role"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"))
    order = Window.partitionBy("_conv").orderBy("_turn", "_role", "_text")
    at = F.row_number().over(order)
    rows = rows.select("*", at.alias("_at"), F.lag("_role").over(order).alias("_before"),
                       F.lead("_role").over(order).alias("_after"),
                       F.lead(F.lit(True), 1, False).over(order).alias("_more"))
    first = (F.col("_at") == 1) | ~F.col("_role").eqNullSafe(F.col("_before"))
    last = ~F.col("_more") | ~F.col("_role").eqNullSafe(F.col("_after"))
    shown = F.when(F.col("_role").isNull(), F.lit(NULL_ROLE)).otherwise(escape(F.col("_role"), ROLE_ESCAPES))
    rows = rows.select(
        "_conv", "_at", "_role",
        F.when(first, F.concat(F.lit(HEAD), shown, F.lit(": "))).otherwise(F.lit("")).alias("open"),
        escape(F.col("_text")).alias("body"),
        F.when(last, F.lit(TURN)).otherwise(F.lit(PART)).alias("close"))
    size = F.char_length("open") + F.char_length("body") + F.char_length("close")
    begun = F.sum(size).over(Window.partitionBy("_conv").orderBy("_at")) - size
    rows = rows.select("*", (begun + F.char_length("open")).alias("start"))
    turns = F.sort_array(F.collect_list(F.struct("_at", "_role", "open", "body", "close", "start")))
    return (rows.groupBy("_conv").agg(turns.alias("turns"))
            .select(F.col("_conv").alias(conv),
                    F.array_join(F.transform("turns", lambda t: F.concat(t["open"], t["body"], t["close"])), "")
                    .alias("formatted"),
                    F.transform(F.filter("turns", lambda t: t["_role"] == loss_role),
                                lambda t: F.struct(t["start"].alias("start"),
                                                   (t["start"] + F.char_length(t["body"])).alias("end")))
                    .alias("loss_spans")))


def read_back(formatted: Column) -> Column:
    """The turns (array of ``role, text``) of a formatted conversation."""
    blocks = F.filter(F.split(formatted, "</turn>\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        head = F.substring_index(block, ": ", 1)
        role = head.substr(F.lit(len(HEAD) + 1), F.char_length(head))
        rest = block.substr(F.char_length(head) + 3, F.char_length(block))
        role = F.when(role != NULL_ROLE, unescape(role, ROLE_ESCAPES))
        return F.transform(F.split(rest, "</part>"), lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, nothing between the spans."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
