"""Chat formatting with a grammar round trip, in built-in functions only.

The grammar::

    chat := turn*
    turn := "<s>[" role "]" NEWLINE text "</s>"

``role`` and ``text`` hold no control string.  Inside them a backslash and a
digit stand for one character (``ESCAPES``), which undoes any escaping.  A
conversation is rendered with its texts as they are and parsed again; if the
turns that come back differ from the source, the conflicting texts, which are
those whose turn alone doesn't come back, are escaped; and if that still differs,
all texts are.  Escaping is a bijection, so the last step always comes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that no unescaped text may hold.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Characters and what stands for them; the backslash first when escaping and last when undoing it.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"), ("]", "\\3"), ("\n", "\\4"))
OPEN, MIDDLE, CLOSE = "<s>[", "]\n", "</s>"


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(MIDDLE))


def render(turns: Column, body) -> Column:
    """Turns as one string; ``body`` gives a turn's text as it is to stand there."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t["role"]), body(t), F.lit(CLOSE))), "")


def pieces(chat: Column) -> Column:
    """The rendered turns, each without its end."""
    return F.transform(F.array(F.split(chat, CLOSE, -1)), lambda p: F.slice(p, 1, F.size(p) - 1))[0]


def parse(chat: Column) -> Column:
    """The turns of a rendered chat; a turn against the grammar has null for its text."""

    def turn(p):
        at = F.call_function("locate", F.lit(MIDDLE), p)
        text = F.substring(p, at + 2, F.length(p))
        bad = ~F.startswith(p, F.lit(OPEN)) | (at == 0)
        for control in CONTROL:
            bad = bad | F.contains(text, F.lit(control))
        return F.struct(unescape(F.substring(p, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"), F.when(~bad, unescape(text)).alias("text"))

    return F.transform(pieces(chat), turn)


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_runs``.

    ``loss_runs`` is the loss mask, one struct a turn: so many code points of
    the turn are skipped, so many are under the mask (an assistant's text), so
    many follow.  Turns stand by turn number, nulls first, and rows that share
    one by role and text.  A null role or text is empty.  Repeated rows are
    turns of their own; rows with a null conversation form one.  Other columns
    are ignored, and an empty table gives an empty result.  A conversation is
    one string and so is held by one task, however many turns it has.
    """
    one = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    chats = rows.select(F.col(conv).cast("long").alias("conv_id"), one.alias("one")).groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("all"))
    chats = chats.select("conv_id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    chats = chats.withColumn("plain", render(F.col("turns"), lambda t: t["text"]))
    chats = chats.withColumn("fits", F.coalesce(parse(F.col("plain")) == F.col("turns"), F.lit(False)))

    def lone(t):
        back = parse(F.concat(_head(t["role"]), t["text"], F.lit(CLOSE)))
        return F.coalesce(back == F.array(t), F.lit(False))

    bodies = F.when(F.col("fits"), F.transform("turns", lambda t: t["text"])).otherwise(
        F.transform("turns", lambda t: F.when(lone(t), t["text"]).otherwise(escape(t["text"])))
    )
    chats = chats.withColumn("bodies", bodies)

    def joined(bodies):
        return F.array_join(F.zip_with("turns", bodies, lambda t, b: F.concat(_head(t["role"]), b, F.lit(CLOSE))), "")

    chats = chats.withColumn("formatted", joined("bodies"))
    same = F.coalesce(parse(F.col("formatted")) == F.col("turns"), F.lit(False))
    everything = F.transform("turns", lambda t: escape(t["text"]))
    chats = chats.withColumn("bodies", F.when(F.col("fits") | same, F.col("bodies")).otherwise(everything))
    chats = chats.withColumn("formatted", joined("bodies"))

    def run(t, b):
        head, body, loss = F.length(_head(t["role"])), F.length(b), t["role"] == "assistant"
        return F.struct(head.alias("skip"), F.when(loss, body).otherwise(0).alias("take"), (F.when(loss, 0).otherwise(body) + len(CLOSE)).alias("rest"))

    return chats.select("conv_id", "formatted", F.zip_with("turns", "bodies", run).alias("loss_runs"))


def under_mask(chat: Column, runs: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.zip_with(pieces(chat), runs, lambda p, r: unescape(F.substring(p, r["skip"] + 1, r["take"]))), "")
