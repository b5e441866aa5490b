"""Chat formatting of typed content parts, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Strings that have a meaning for this template or a common other one, and what stands for them inside texts.
CONTROL = {
    "~": "~0",
    "<|": "~1",
    "|>": "~2",
    "</s>": "~3",
    "<s>": "~4",
    "[INST]": "~5",
    "[/INST]": "~6",
    "<<SYS>>": "~7",
    "<</SYS>>": "~8",
}
END = "<|end|>\n"
#: Tokens that one unit of an attachment expands to: an image's tile, an audio's second, a document's page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
PART = "struct<type:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    """No control string remains; every ~ of the result is followed by the digit of what it stands for."""
    return reduce(lambda t, c: F.replace(t, F.lit(c[0]), F.lit(c[1])), CONTROL.items(), text)


def unescape(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c[1]), F.lit(c[0])), reversed(CONTROL.items()), text)


def text_parts(text: Column) -> Column:
    """One text part, for messages that are plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")))


def _placeholder(part: Column) -> Column:
    return F.concat(F.lit("<|"), escape(F.coalesce(part["type"], F.lit("unknown"))), F.lit(" "), escape(F.coalesce(part["ref"], F.lit(""))), F.lit("|>"))


def flatten_parts(parts: Column) -> Column:
    """Visits an array of content parts in order: texts escaped, any other part as the placeholder <|type ref|>."""
    return F.array_join(F.transform(parts, lambda p: F.when(p["type"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(_placeholder(p))), "")


def attachments(parts: Column) -> Column:
    """(place, type, ref, tokens) of the parts that are no texts; tokens is what the placeholder expands to, 0 if unknown."""
    tokens = lambda p: reduce(lambda c, t: c.when(p["type"] == t[0], F.coalesce(p["units"], F.lit(1)) * t[1]), UNIT_TOKENS.items(), F.when(F.lit(False), F.lit(0).cast("bigint"))).otherwise(F.lit(0))
    every = F.transform(parts, lambda p, i: F.struct(i.alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), tokens(p).cast("bigint").alias("tokens")))
    return F.filter(every, lambda a: ~a["type"].eqNullSafe("text"))


def format_conversations(messages: DataFrame) -> DataFrame:
    """From messages (conv_id, turn, role, parts; other columns are ignored) one row a conversation: conv_id, n_turns,
    formatted, loss_mask (start and length, in code points of formatted, of each assistant text), attachments (turn,
    place, type, ref, tokens), expanded_tokens.

    A turn is <|role|>, a line break, its flattened parts, <|end|> and a line break. Rows are ordered by turn (nulls
    first), then role and content, so that ties and repeated rows have one order. Null parts, texts and roles are empty.
    Null conv_ids are one conversation. An empty table gives no rows. A conversation's rows meet in one task, since its
    text is one value; they are sorted there, which can spill."""
    rows = messages.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        flatten_parts(F.coalesce("parts", F.array().cast(f"array<{PART}>"))).alias("body"),
        F.transform(attachments(F.coalesce("parts", F.array().cast(f"array<{PART}>"))), lambda a: F.struct(F.col("turn").alias("turn"), *(a[n].alias(n) for n in ("place", "type", "ref", "tokens")))).alias("files"),
    )
    head = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n"))
    rows = rows.withColumn("piece", F.concat(head, "body", F.lit(END))).withColumn("head", F.length(head).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    rows = rows.withColumn("i", F.row_number().over(order)).withColumn("end", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct((F.col("end") - F.length("piece") + F.col("head")).alias("start"), F.length("body").cast("long").alias("length"))
    each = F.struct("i", "piece", F.when(F.col("role") == "assistant", span).alias("span"), "files")
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(each)).alias("t"))
    return got.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_mask"),
        F.flatten(F.transform("t", lambda x: x["files"])).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: role and text, unescaped. Placeholders of attachments stay in the text."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: p != "")
    at = lambda p: F.instr(p, "|>")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring(p, F.lit(3), at(p) - 3)).alias("role"),
            unescape(F.substring(p, at(p) + 3, F.length(p))).alias("text"),
        ),
    )


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
