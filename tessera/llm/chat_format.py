"""Chat formatting by prefix-target expansion. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: a turn is TURN + role + "\n" + text + END. Neither mark can occur inside an escaped text.
TURN, END = "<|turn|>", "</s>"
#: Characters that begin a control string of this or other templates, and what stands for them. The escape
#: character comes first here and last when reading, so the two are inverse on every string.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"))


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> one example for each assistant turn: conv_id, example, context, target.

    ``context`` holds all turns before, the reply's own mark and role included; ``target`` is the reply and its end
    mark, the only trainable part. What follows the last reply, or a conversation without replies, gives a final
    example with an empty target, so every turn can be read back and nothing of it is trained.

    A conversation's turns are gathered once (a conversation is the unit that a trainer reads; its examples hold
    the square of its turns by definition) and expanded where they are, without a second exchange.
    Order: turn (nulls first), then role, then text. Null texts and roles are empty; rows with a null conv_id form
    one conversation. A line feed inside a role is escaped as ``~3``. Extra columns are not read.
    """
    seg = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(seg)).alias("turns"))
    head = lambda t: F.concat(F.lit(TURN), F.replace(escaped(t["role"]), F.lit("\n"), F.lit("~3")), F.lit("\n"))
    body = lambda t: F.concat(escaped(t["text"]), F.lit(END))
    convs = convs.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("reply"), head(t).alias("head"), body(t).alias("body"))).alias("turns"),
    )
    n = F.size("turns")
    at = F.transform("turns", lambda t, i: F.when(t["reply"], i + 1))
    last = F.when(F.element_at("turns", -1)["reply"], F.array().cast("array<int>")).otherwise(F.array(n + 1))
    spots = convs.select("conv_id", "turns", F.explode(F.concat(F.filter(at, lambda i: i.isNotNull()), last)).alias("example"))
    before = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("example") - 1), lambda t: F.concat(t["head"], t["body"])), "")
    reply = F.try_element_at("turns", F.col("example"))
    return spots.select(
        "conv_id",
        "example",
        F.concat(before, F.coalesce(reply["head"], F.lit(""))).alias("context"),
        F.coalesce(reply["body"], F.lit("")).alias("target"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """The turns and the trained text of each conversation, from formatted examples alone.

    Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (context and target of all
    its examples) and n_examples.
    """
    whole = F.concat("context", "target")
    per = examples.groupBy("conv_id").agg(
        F.max(F.struct("example", whole.alias("text")))["text"].alias("text"),
        F.array_sort(F.collect_list(F.struct("example", "target"))).alias("targets"),
        F.sum((F.length("context") + F.length("target")).cast("long")).alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    parts = F.filter(F.split("text", r"\Q" + TURN + r"\E"), lambda x: x != "")
    role = lambda x: unescaped(F.replace(F.substring_index(x, "\n", 1), F.lit("~3"), F.lit("\n")))
    text = lambda x: unescaped(F.regexp_replace(F.substr(x, F.instr(x, "\n") + 1), r"\Q" + END + r"\E$", ""))
    said = F.transform(parts, lambda x: F.concat(role(x), F.lit("\n"), text(x), F.lit("\n")))
    loss = F.array_join(F.transform("targets", lambda x: unescaped(F.regexp_replace(x["target"], r"\Q" + END + r"\E$", ""))), "")
    return per.select(
        "conv_id",
        F.size(parts).cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(said, ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
