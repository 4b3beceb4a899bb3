"""Chat formatting by prefix-target expansion, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(c: Column, newline: bool = False) -> Column:
    """No control string is left: a backslash becomes ``\\b``, ``<|`` becomes ``\\c``, and in roles a line end ``\\n``."""
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("\\c"))
    return F.replace(c, F.lit("\n"), F.lit("\\n")) if newline else c


def unescape(c: Column, newline: bool = False) -> Column:
    """The inverse of ``escape``: each backslash starts a code, so the codes can be put back in turn, the backslash last."""
    c = F.replace(c, F.lit("\\n"), F.lit("\n")) if newline else c
    return F.replace(F.replace(c, F.lit("\\c"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def prefix_targets(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """One example for each assistant turn: ``(conv_id, target, formatted, loss_start, loss_length)``.

    ``formatted`` holds all preceding turns as context and then the reply, each turn as
    ``<|im_start|>role``, line end, escaped text, ``<|im_end|>``, line end. Only the reply's text is
    trainable: ``loss_length`` code points from ``loss_start`` (0-based). ``target`` is
    the turn's 0-based place. A conversation that does not end in an assistant turn has
    one more example, of all its turns, with ``target`` null and an empty mask, so that
    every turn is in the output.

    Turns go by turn number, ties by role and text. A null role or text counts as empty,
    null turn numbers come first, and null conv_ids are one conversation. Rows are
    gathered by conv_id (one exchange); a conversation's own turns, whose formatted
    prefixes the method writes out, are its example's size and stay together. An empty
    table gives no rows; other columns are not looked at.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    gathered = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def shown(t: Column) -> Column:
        return F.concat(F.lit(START), escape(t["role"], True), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))

    place = F.sequence(F.lit(0), F.size("turns") - 1)
    replies = F.filter(place, lambda i: F.get("turns", i)["role"] == target_role)
    ends = F.element_at("turns", -1)["role"] == target_role
    targets = F.when(ends, replies).otherwise(F.concat(replies, F.array(F.lit(None).cast("int"))))
    spread = gathered.select("conv_id", F.transform("turns", shown).alias("shown"), F.transform("turns", lambda t: F.length(escape(t["role"], True))).alias("role_length"), F.explode(targets).alias("target"))
    formatted = F.array_join(F.slice("shown", 1, F.coalesce(F.col("target") + 1, F.size("shown"))), "")
    tail = F.length(F.get("shown", F.col("target")))
    marks = F.get("role_length", F.col("target")) + len(START) + 1
    return spread.select("conv_id", "target", formatted.alias("formatted"), tail.alias("tail"), marks.alias("marks")).select(
        "conv_id",
        "target",
        "formatted",
        F.coalesce(F.length("formatted") - F.col("tail") + F.col("marks"), F.lit(0)).alias("loss_start"),
        F.coalesce(F.col("tail") - F.col("marks") - len(END) - 1, F.lit(0)).alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples hold, by conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns are parsed from the longest example. The loss is the masked text of all
    examples in order, unescaped. formatted_chars is the length of all examples. The
    grouping is by the key that the examples are already dealt by.
    """
    loss = unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length")))
    one = F.struct(F.coalesce("target", F.lit(2147483647)).alias("target"), loss.alias("loss"))
    by = examples.groupBy("conv_id").agg(
        F.max_by("formatted", F.length("formatted")).alias("whole"),
        F.array_sort(F.collect_list(one)).alias("parts"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    split = F.split("whole", r"<\|im_start\|>")
    segments = F.slice(split, F.lit(2), F.size(split) - 1)

    def turn(s: Column) -> Column:
        role = F.substring_index(s, "\n", 1)
        text = F.substring(s, F.length(role) + 2, F.length(s) - F.length(role) - 2 - len(END))
        return F.concat(unescape(role, True), F.lit("\n"), unescape(text), F.lit("\n"))

    loss_text = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return by.select(
        "conv_id",
        F.size(segments).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(segments, turn), ""), 256).alias("turns_sha256"),
        F.length(loss_text).cast("long").alias("loss_chars"),
        F.sha2(loss_text, 256).alias("loss_sha256"),
        "formatted_chars",
    )
