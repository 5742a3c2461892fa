"""Chat formatting of typed content parts.

A message is an ordered list of parts: text, image, audio or document. A visitor flattens the parts of each message:
text is escaped and kept, anything else becomes a placeholder, its reference goes to the conversation's attachment
list and its size is turned into a number of tokens. The template

    <|turn|>role<|body|>content<|end|>\\n

marks turns with ``<|…|>``. In roles and texts a backslash before every ``\\`` and ``|`` keeps these marks from ever
appearing in content, also across the border of two parts, and is taken off again by ``read_back``.

The loss mask is a list of spans (turn, start inside the turn's segment, length, in code points) that covers the
content of assistant turns and nothing else. Only SQL functions are used. A conversation is one row of the result,
so its turns meet in one task by definition; nothing else is gathered.

Defined results: null texts and roles count as empty; a null conversation id is a conversation of its own; turns
are ordered by (turn, role, text), null turns first, and repeated rows are turns each; a conversation needs no
assistant turn (the mask is then empty); an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
LEARNED_ROLE = "assistant"
TOKENS_PER_UNIT = {"image": 1.0, "audio": 25.0, "document": 600.0}
"""Tokens for one unit of a part: an image patch, a second of sound, a page."""
PART = "struct<kind:string,text:string,ref:string,units:double>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def text_part(text: Column) -> Column:
    """A message of one text part."""
    return F.array(
        F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0.0).alias("units"))
    )


def placeholder(part: Column) -> Column:
    known = part["kind"].isin(*TOKENS_PER_UNIT)
    return F.concat(F.lit("<|"), F.when(known, part["kind"]).otherwise(F.lit("attachment")), F.lit("|>"))


def expanded_tokens(part: Column) -> Column:
    rate = F.lit(0.0)
    for kind, per_unit in TOKENS_PER_UNIT.items():
        rate = F.when(part["kind"] == kind, F.lit(per_unit)).otherwise(rate)
    return F.ceil(rate * F.coalesce(part["units"], F.lit(0.0))).cast("long")


def is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def flattened(parts: Column) -> tuple[Column, Column]:
    """The content of a message and its attachments (kind, ref, tokens), in order."""
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    content = F.array_join(
        F.transform(parts, lambda p: F.when(is_text(p), escaped(F.coalesce(p["text"], F.lit("")))).otherwise(placeholder(p))), ""
    )
    attached = F.transform(
        F.filter(parts, lambda p: ~is_text(p)),
        lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")),
    )
    return content, attached


def format_chats(turns: DataFrame, parts: str | None = None) -> DataFrame:
    """conv_id, n_turns, formatted, mask, attachments, expanded_tokens of every conversation.

    ``parts`` names a column of type ``array<struct<kind, text, ref, units>>``; without it, ``text`` is the one part.
    """
    body = F.col(parts) if parts else text_part(F.col("text"))
    content, attached = flattened(body)
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        content.alias("content"),
        attached.alias("attached"),
    )
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(BODY))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    rows = rows.withColumns({"head": head, "place": F.row_number().over(order)})
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "role", "head", "content", "attached"))).alias("turns"))
    all_turns = F.col("turns")
    mask = F.transform(
        F.filter(all_turns, lambda t: t["role"] == LEARNED_ROLE),
        lambda t: F.struct(
            t["place"].alias("turn"), F.length(t["head"]).alias("start"), F.length(t["content"]).alias("length")
        ),
    )
    attachments = F.flatten(
        F.transform(
            all_turns,
            lambda t: F.transform(
                t["attached"], lambda a: F.struct(t["place"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))
            ),
        )
    )
    made = whole.select(
        "conv_id",
        F.size(all_turns).cast("long").alias("n_turns"),
        F.array_join(F.transform(all_turns, lambda t: F.concat(t["head"], t["content"], F.lit(END))), "").alias("formatted"),
        mask.alias("mask"),
        attachments.alias("attachments"),
    )
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return made.withColumn("expanded_tokens", tokens)


def segments(formatted: Column) -> Column:
    """The formatted text cut before each turn mark; no content holds one."""
    return F.split(formatted, r"(?=<\|turn\|>)", -1)


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> from the formatted text alone; placeholders stay in the text."""
    turns = F.filter(segments(formatted), lambda s: s.startswith(TURN))
    return F.transform(
        turns,
        lambda s: F.struct(
            unescaped(F.replace(F.substring_index(s, BODY, 1), F.lit(TURN), F.lit(""))).alias("role"),
            unescaped(F.substring_index(F.substring_index(s, "<|end|>", 1), BODY, -1)).alias("text"),
        ),
    )


def learned_text(cut: Column, mask: Column) -> Column:
    """The text under the mask, unescaped; ``cut`` is the column of segments."""
    return unescaped(F.array_join(F.transform(mask, lambda m: F.substr(F.get(cut, m["turn"] - 1), m["start"] + 1, m["length"])), ""))


def digests(chats: DataFrame) -> DataFrame:
    """What a reader gets from the formatted texts and their masks."""
    cut = chats.withColumn("_cut", F.filter(segments(F.col("formatted")), lambda s: s.startswith(TURN)))
    read = cut.withColumns({"_turns": read_back(F.col("formatted")), "_learned": learned_text(F.col("_cut"), F.col("mask"))})
    told = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("_learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("_learned"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "expanded_tokens",
    )
