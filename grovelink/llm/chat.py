"""Conversations of typed content parts as one training string each, all in SQL functions.

A turn holds parts: text, image, audio or document. A visitor over the parts writes text
as it is (control strings escaped) and every other part as a placeholder, notes the
attachment it stands for, where the placeholder is, and how many tokens it expands to.

Template of a turn:   <|turn|> role <|text|> content <|end|>      (without the blanks)

Defined cases: a null text or role is empty; a null conv_id is a conversation of its own;
turns are ordered by (turn, role, content), nulls first, so ties and repeated rows all
stay, in a fixed order; a turn without parts has empty content; an unknown kind of part
counts as an attachment of one token; a missing size counts as zero. An empty table gives
an empty table. Other columns are ignored.

A conversation is one output row, so its turns meet in one task; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PART = (
    "array<struct<kind:string,text:string,ref:string,width:bigint,height:bigint,"
    "seconds:double,pages:bigint>>"
)

# what follows the first character of a control string; the marks in front count the escapes
_REST = r"(\||/?s>|/?INST\])"
_PLAIN, _ESCAPED = rf"([<\[])(!*){_REST}", rf"([<\[])!(!*){_REST}"


def escape(text: Column) -> Column:
    """Put one more ``!`` after the first character of every (escaped) control string."""
    return F.regexp_replace(text, _PLAIN, "$1!$2$3")


def unescape(text: Column) -> Column:
    """The inverse of ``escape`` for every string."""
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def text_parts(text: Column) -> Column:
    """A plain text as the only part of its turn."""
    part = F.struct(
        F.lit("text").alias("kind"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"),
        *[F.lit(None).cast("bigint").alias(n) for n in ("width", "height")],
        F.lit(None).cast("double").alias("seconds"),
        F.lit(None).cast("bigint").alias("pages"),
    )
    return F.array(part)


def expanded_tokens(
    part: Column, patch: int, audio_rate: float, page_tokens: int
) -> Column:
    """Tokens that a placeholder becomes in the model's input."""

    def or_zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0))

    def tiles(c: Column) -> Column:
        return F.ceil(or_zero(c) / F.lit(patch))

    return (
        F.when(part["kind"] == "image", tiles(part["width"]) * tiles(part["height"]))
        .when(part["kind"] == "audio", F.ceil(or_zero(part["seconds"]) * F.lit(audio_rate)))
        .when(part["kind"] == "document", or_zero(part["pages"]) * F.lit(page_tokens))
        .otherwise(F.lit(1))
        .cast("long")
    )


def _visited(parts: Column, patch: int, audio_rate: float, page_tokens: int) -> Column:
    """parts -> array<struct<string, loss, attachment>> in order."""

    def visit(part: Column) -> Column:
        is_text = F.coalesce(part["kind"], F.lit("text")) == "text"
        named = F.when(part["kind"].isin("image", "audio", "document"), part["kind"])
        placeholder = F.concat(F.lit("<|"), F.coalesce(named, F.lit("attachment")), F.lit("|>"))
        return F.struct(
            F.when(is_text, escape(F.coalesce(part["text"], F.lit(""))))
            .otherwise(placeholder)
            .alias("string"),
            is_text.alias("is_text"),
            F.when(
                ~is_text,
                F.struct(
                    part["kind"].alias("kind"),
                    part["ref"].alias("ref"),
                    expanded_tokens(part, patch, audio_rate, page_tokens).alias("tokens"),
                ),
            ).alias("attachment"),
        )

    return F.transform(F.coalesce(parts, F.array().cast(PART)), visit)


def format_conversations(
    turns: DataFrame,
    parts: str | None = None,
    loss_role: str = "assistant",
    patch: int = 14,
    audio_rate: float = 25.0,
    page_tokens: int = 256,
) -> DataFrame:
    """turns(conv_id, turn, role, text) or, with ``parts`` naming a column of type PART,
    turns(conv_id, turn, role, parts), to one row per conversation:

    formatted STRING, n_turns LONG, loss_spans ARRAY<STRUCT<start, chars>> (0-based, in
    code points: the text parts of ``loss_role``), attachments ARRAY<STRUCT<turn_no, kind,
    ref, tokens, start>> in order, expanded_tokens LONG (sum over attachments).
    """
    source = F.col(parts).cast(PART) if parts else text_parts(F.col("text").cast("string"))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select(
        "conv_id",
        "turn",
        role.alias("role"),
        _visited(source, patch, audio_rate, page_tokens).alias("seen"),
    ).withColumn("content", F.array_join(F.col("seen.string"), ""))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    rows = rows.withColumn("piece", F.concat(head, F.col("content"), F.lit(END))).withColumn(
        "head_chars", F.char_length(head).cast("long")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(
        "start", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)).cast("long")
    ).withColumn("turn_no", F.row_number().over(order).cast("long") - 1)

    # where each part of a turn starts: parts of one turn are few, so an array fold will do
    no_places = F.array().cast("array<bigint>")
    places = F.aggregate(
        "seen",
        F.struct((F.col("start") + F.col("head_chars")).alias("at"), no_places.alias("all")),
        lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x["string"])).alias("at"),
            F.concat(acc["all"], F.array(acc["at"])).alias("all"),
        ),
        lambda acc: acc["all"],
    )
    rows = rows.withColumn("at", places)
    placed = F.arrays_zip("seen", "at")
    spans = F.transform(
        F.filter(placed, lambda x: x["seen"]["is_text"] & (F.col("role") == loss_role)),
        lambda x: F.struct(
            x["at"].alias("start"),
            F.char_length(x["seen"]["string"]).cast("long").alias("chars"),
        ),
    )
    held = F.transform(
        F.filter(placed, lambda x: ~x["seen"]["is_text"]),
        lambda x: F.struct(
            F.col("turn_no").alias("turn_no"),
            x["seen"]["attachment"]["kind"].alias("kind"),
            x["seen"]["attachment"]["ref"].alias("ref"),
            x["seen"]["attachment"]["tokens"].alias("tokens"),
            x["at"].alias("start"),
        ),
    )
    turn = F.struct("start", "piece", spans.alias("spans"), held.alias("held"))
    whole = (
        rows.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        .withColumn("attachments", F.flatten("turns.held"))
    )
    return whole.select(
        "conv_id",
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.size("turns").cast("long").alias("n_turns"),
        F.flatten("turns.spans").alias("loss_spans"),
        "attachments",
        F.aggregate(
            "attachments", F.lit(0).cast("long"), lambda acc, x: acc + x["tokens"]
        ).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """formatted -> array<struct<role, text>>, unescaped; placeholders stay in the text."""
    pieces = F.split(formatted, r"<\|turn\|>")
    shape = r"(?s)^(.*?)<\|text\|>(.*)<\|end\|>$"
    return F.transform(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(
            unescape(F.regexp_extract(p, shape, 1)).alias("role"),
            unescape(F.regexp_extract(p, shape, 2)).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(
        F.transform(
            loss_spans,
            lambda s: unescape(
                formatted.substr(s["start"].cast("int") + 1, s["chars"].cast("int"))
            ),
        ),
        "",
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives."""
    turns = read_turns(F.col("formatted"))
    back = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = formatted.withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    return rows.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(back, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
