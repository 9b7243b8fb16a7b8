"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example: all turns before it as context, and a loss span over its text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """Text without any "<|": one backslash more after each "<" that backslashes and a "|" follow."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role on one line without "|"."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("|"), F.lit("%7C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%7C"), F.lit("|")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chat(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, example int, n_turns int, formatted string, loss_start int, loss_end int) for each example.

    Examples count from 0 in the order of their assistant turns; loss_start and loss_end are code points of
    formatted (end excluded) around the escaped text of the last turn. Turns after the last assistant turn,
    or a conversation without one, make one more example whose span is empty, so that no turn is lost.
    Null text or role: empty. Turns sort by turn (null first), then role, then text; repeated rows are turns
    of their own. A null conversation id is one conversation. Other columns are dropped. No rows: no examples.
    A conversation's turns meet in one task, since every example holds all that go before it.
    """
    text, role = F.coalesce(text_col, F.lit("")), F.coalesce(role_col, F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    body = escape(text)
    turn = F.struct(
        F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), head.alias("head"), body.alias("body")
    )
    convs = turns.groupBy(F.col(conv_col)).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    replies = F.filter(
        F.transform("turns", lambda t, i: F.when((t["role"] == "assistant") | (i == F.size("turns") - 1), i)), lambda i: i.isNotNull()
    )

    def example(i: Column, n: Column) -> Column:
        before = F.array_join(F.transform(F.slice("turns", F.lit(1), i), lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
        last = F.get("turns", i)
        return let(
            before,
            lambda b: F.struct(
                n.alias("example"),
                (i + 1).alias("n_turns"),
                F.concat(b, last["head"], last["body"], F.lit(END)).alias("formatted"),
                (F.length(b) + F.length(last["head"])).alias("loss_start"),
                (F.length(b) + F.length(last["head"]) + F.when(last["role"] == "assistant", F.length(last["body"])).otherwise(0)).alias("loss_end"),
            ),
        )

    out = convs.select(conv_col, "turns", replies.alias("replies"))
    out = out.select(conv_col, "turns", F.posexplode("replies").alias("n", "i"))
    return out.select(conv_col, example(F.col("i"), F.col("n")).alias("e")).select(conv_col, "e.*")


def read_chat(formatted: Column) -> Column:
    """The turns (role, text) that a formatted example holds."""
    parts = F.split(formatted, r"<\|im_end\|>\n")

    def turn(part: Column) -> Column:
        return let(
            F.substring_index(part, "\n", 1),
            lambda h: F.struct(
                unescape_role(F.substring(h, len(START) + 1, 2147483647)).alias("role"),
                unescape(F.substring(part, F.length(h) + 2, F.lit(2147483647))).alias("text"),
            ),
        )

    return let(parts, lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), turn))
