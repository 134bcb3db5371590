"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, adjacent turns of one role are merged by an array
fold, and everything is concatenated. The template:

    <s>[ROLE]role[TEXT]first text[NEXT]second text of the same role</s>...

Inside roles and texts `\\` becomes `\\\\`, `[` becomes `\\(`, `<` becomes `\\{`: no control string can then occur
in them, and unescaping gives back the exact text. [NEXT] stands between the texts of merged turns, so that
reading back gives every turn of the input. The loss mask lists the spans [start, end) of assistant texts in
the output, in code points; separators are outside of it.

A null text or role counts as empty, a null conv_id is a conversation; turns of one number are ordered by role, then text,
null turn first. Repeated rows stay. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, TEXT, NEXT, CLOSE = "<s>[ROLE]", "[TEXT]", "[NEXT]", "</s>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("["), F.lit("\\(")), F.lit("<"), F.lit("\\{"))


def unescape(text: Column) -> Column:
    """Undo `escape`. Pairs are read from the left: a doubled backslash is set aside before the others."""
    parts = F.split(text, "\\\\\\\\", -1)
    parts = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\("), F.lit("[")), F.lit("\\{"), F.lit("<")))
    return F.array_join(parts, "\\")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_col, formatted, mask (array of start, end) for each conversation."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))
    chats = turns.groupBy(F.col(conv_col).alias("c")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    chats = chats.select("c", F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))).alias("turns"))
    # where a run of one role begins, the turn opens a block; inside a run only a separator stands before the text
    opens = F.transform("turns", lambda t, i: F.struct(t["text"].alias("text"), (t["role"] == ASSISTANT).alias("own"),
        F.when((i > 0) & (F.get("turns", i - 1)["role"] == t["role"]), F.lit(NEXT))
        .otherwise(F.concat(F.when(i > 0, F.lit(CLOSE)).otherwise(F.lit("")), F.lit(OPEN), t["role"], F.lit(TEXT))).alias("lead")))
    chats = chats.select("c", opens.alias("turns"))
    formatted = F.concat(F.array_join(F.transform("turns", lambda t: F.concat(t["lead"], t["text"])), ""), F.lit(CLOSE))
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    step = lambda a, t: F.struct(
        (a["at"] + F.length(t["lead"]) + F.length(t["text"])).cast("long").alias("at"),
        F.when(t["own"], F.concat(a["mask"], F.array(F.struct((a["at"] + F.length(t["lead"])).cast("long").alias("start"), (a["at"] + F.length(t["lead"]) + F.length(t["text"])).cast("long").alias("end"))))).otherwise(a["mask"]).alias("mask"))
    mask = F.aggregate("turns", F.struct(F.lit(0).cast("long").alias("at"), none.alias("mask")), step)["mask"]
    return chats.select(F.col("c").alias(conv_col), formatted.alias("formatted"), mask.alias("mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """chats with `turns` (role, text) and `loss_text`, both taken from the formatted string and its mask alone."""
    body = F.expr(f"substring(formatted, {len(OPEN) + 1}, length(formatted) - {len(OPEN) + len(CLOSE)})")
    blocks = F.split(body, "\\Q" + CLOSE + OPEN + "\\E", -1)
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(F.substring_index(b, TEXT, -1), "\\Q" + NEXT + "\\E", -1),
        lambda t: F.struct(unescape(F.substring_index(b, TEXT, 1)).alias("role"), unescape(t).alias("text")))))
    loss = F.array_join(F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")
    return chats.withColumns({"turns": turns, "loss_text": loss})


def digests(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    read = read_back(chats)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
