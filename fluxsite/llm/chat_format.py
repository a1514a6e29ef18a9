r"""Chat formatting by relational operations on collected turn structs.

Turns of a conversation are collected and sorted; an aggregation over the array
merges adjacent turns of one role into a message and carries the length so far, which
places the loss spans; messages are concatenated::

    <s>role\n[INST]text[/INST][INST]text of the same role[/INST]</s>\n

The four control strings never occur inside a role or text: before their last
character a backslash is put (one more where backslashes are already there),
which is undone exactly on reading. The loss mask is the list of character
spans of the assistant texts. DataFrame functions only.

Defined cases: a NULL text or role is an empty string; a NULL conv_id is one
conversation; turns sort by (turn, role, text), NULL first, and repeated rows
are all kept; an empty table gives an empty result; other columns are ignored.
A conversation is one output string, so it has to fit into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

OPEN_MESSAGE, CLOSE_MESSAGE, OPEN_TEXT, CLOSE_TEXT = "<s>", "</s>", "[INST]", "[/INST]"
LOSS_ROLE = "assistant"
PART = 1024  # turns merged at a time
_MESSAGES = "array<struct<role:string,texts:array<string>>>"
_SPANS = "array<struct<start:bigint,length:bigint>>"
_MESSAGE_START = len(OPEN_MESSAGE) + 1  # and its role
_MESSAGE_END = len(CLOSE_MESSAGE) + 1
_STEM = r"(</?s|\[/?INST)(\\*)"


def escape(col: Column) -> Column:
    return F.regexp_replace(col, _STEM + r"([>\]])", r"$1$2\\$3")


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, _STEM + r"\\([>\]])", "$1$2$3")


def _messages(turns: Column) -> Column:
    """Adjacent turns of one role merged: struct<messages, length, spans> of an array of
    turns. ``length`` is that of the output but for the end of its last message,
    ``spans`` the places of the texts under the loss in it."""
    start = F.struct(
        F.lit(None).cast("string").alias("role"), F.array().cast("array<string>").alias("texts"), F.array().cast(_MESSAGES).alias("done"),
        F.lit(0).cast("long").alias("length"), F.array().cast(_SPANS).alias("spans"),
    )

    def step(a: Column, x: Column) -> Column:
        same, first = a["role"].eqNullSafe(x["role"]), a["role"].isNull()
        whole = F.struct(a["role"].alias("role"), a["texts"].alias("texts"))
        between = F.when(same, 0).otherwise(F.when(first, 0).otherwise(_MESSAGE_END) + _MESSAGE_START + F.length(x["role"]))
        at = (a["length"] + between + len(OPEN_TEXT)).cast("long")
        n = F.length(x["text"]).cast("long")
        return F.struct(
            x["role"].alias("role"),
            F.when(same, F.concat(a["texts"], F.array(x["text"]))).otherwise(F.array(x["text"])).alias("texts"),
            F.when(same | first, a["done"]).otherwise(F.concat(a["done"], F.array(whole))).alias("done"),
            (at + n + len(CLOSE_TEXT)).alias("length"),
            F.when(x["loss"], F.concat(a["spans"], F.array(F.struct(at.alias("start"), n.alias("length"))))).otherwise(a["spans"]).alias("spans"),
        )

    last = lambda a: F.struct(a["role"].alias("role"), a["texts"].alias("texts"))
    done = lambda a: F.struct(F.concat(a["done"], F.array(last(a))).alias("messages"), a["length"].alias("length"), a["spans"].alias("spans"))
    return F.aggregate(turns, start, step, done)


def _joined(parts: Column) -> Column:
    """Merged parts of one conversation, put after each other."""
    start = F.struct(F.array().cast(_MESSAGES).alias("messages"), F.lit(0).cast("long").alias("length"), F.array().cast(_SPANS).alias("spans"))

    def step(a: Column, x: Column) -> Column:
        own, more, n = a["messages"], x["messages"], F.size(a["messages"])
        end, head = F.get(own, n - 1), F.get(more, F.lit(0))
        same = (n > 0) & (end["role"] == head["role"])  # one message on both sides of the cut
        one = F.struct(end["role"].alias("role"), F.concat(end["texts"], head["texts"]).alias("texts"))
        shift = F.when(n == 0, 0).when(same, -_MESSAGE_START - F.length(head["role"])).otherwise(_MESSAGE_END)
        at = (a["length"] + shift).cast("long")
        spans = F.transform(x["spans"], lambda s: F.struct((s["start"] + at).alias("start"), s["length"].alias("length")))
        merged = F.concat(F.slice(own, F.lit(1), n - 1), F.array(one), F.slice(more, F.lit(2), F.size(more) - 1))
        return F.struct(
            F.when(same, merged).otherwise(F.concat(own, more)).alias("messages"),
            (at + x["length"]).alias("length"),
            F.concat(a["spans"], spans).alias("spans"),
        )

    return F.aggregate(parts, start, step)


def format_chats(conversations: DataFrame, loss_role: str = LOSS_ROLE, part: int = PART) -> DataFrame:
    """(conv_id, formatted, loss_spans): the string of each conversation and the
    spans array<struct<start, length>> (code points, from 0) under the loss."""
    turn = F.struct("turn", text_or_empty(F.col("role")).alias("role"), text_or_empty(F.col("text")).alias("text"))
    chats = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    safe = lambda x: F.struct(escape(x["role"]).alias("role"), escape(x["text"]).alias("text"), (x["role"] == loss_role).alias("loss"))
    chats = chats.withColumn("turns", F.transform("turns", safe))
    # appending copies an array: turns merge in parts, then the parts, so this stays small
    cuts = F.sequence(F.lit(1), F.size("turns"), F.lit(part))
    parts = F.transform(cuts, lambda at: _messages(F.slice(F.col("turns"), at, F.lit(part))))
    chats = chats.withColumn("parts", parts)
    chats = chats.withColumn("chat", _joined(F.col("parts")))
    string = lambda m: F.concat(
        F.lit(OPEN_MESSAGE), m["role"], F.lit("\n" + OPEN_TEXT), F.array_join(m["texts"], CLOSE_TEXT + OPEN_TEXT),
        F.lit(CLOSE_TEXT + CLOSE_MESSAGE + "\n"),
    )
    return chats.select(
        "conv_id", F.array_join(F.transform("chat.messages", string), "").alias("formatted"), F.col("chat.spans").alias("loss_spans")
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns, read back from the output alone."""
    messages = F.filter(F.split(formatted, r"</s>\n"), lambda m: m != "")

    def turns(m: Column) -> Column:
        role = F.substring_index(m, "\n" + OPEN_TEXT, 1)
        body = F.substr(m, F.length(role) + 2)
        texts = F.filter(F.split(body, r"\[/INST\]"), lambda x: x != "")
        name = unescape(F.substr(role, F.lit(len(OPEN_MESSAGE) + 1)))
        return F.transform(texts, lambda x: F.struct(name.alias("role"), unescape(F.substr(x, F.lit(len(OPEN_TEXT) + 1))).alias("text")))

    return F.flatten(F.transform(messages, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, read back from the output."""
    piece = lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(spans, piece), "")
