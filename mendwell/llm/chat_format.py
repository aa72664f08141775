"""Chat turns with typed content parts as one training string, with its loss mask and attachments.

Every turn becomes ``<|start|>role<|body|>content<|end|>``. Texts and roles may hold
control strings of this or other templates: a word joiner after the bracket takes away their
meaning, and one more is put where there are some already, so that the text can be
restored exactly. Images, audio and documents become placeholders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, BODY, END = "<|start|>", "<|body|>", "<|end|>"
KINDS = ["image", "audio", "document"]
JOINER = "\u2060"
# What follows the opening bracket of a control string: those above, placeholders, and strings that other templates use.
AFTER_BRACKET = r"(\|(?:start|body|end|image|audio|document|im_start|im_end|endoftext)\|>|/?s>|/?INST\]|</?SYS>>)"
LEARNT_ROLE = "assistant"

CONTROL = rf"([<\[]{JOINER}*){AFTER_BRACKET}"

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
# Placeholder tokens: one for each patch of 28 by 28 pixels, each 25th of a second, and 256 for each page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, F.lit(f"$1{JOINER}$2"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[]{JOINER}*){JOINER}{AFTER_BRACKET}", F.lit("$1$2"))


def text_part(text: Column) -> Column:
    """The parts of a turn that is one text."""
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *empty))


def is_text(part: Column) -> Column:
    return ~F.coalesce(part["type"].isin(KINDS), F.lit(False))


def joined_texts(parts: Column) -> Column:
    """``parts`` with neighbouring texts as one, so that no control string arises where two of them meet."""
    empty = F.array().cast(f"array<{PART}>")

    def add(done: Column, part: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        one = F.concat(F.coalesce(last["text"], F.lit("")), F.coalesce(part["text"], F.lit("")))
        goes_on = (F.size(done) > 0) & is_text(last) & is_text(part)
        return F.when(goes_on, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), text_part(one))).otherwise(F.concat(done, F.array(part)))

    # Most turns are one part.
    return F.when(F.size(parts) < 2, parts).otherwise(F.aggregate(parts, empty, add))


def expanded_tokens(part: Column) -> Column:
    """Tokens a placeholder stands for; at least one, also where the size is unknown."""
    size = (
        F.when(part["type"] == "image", F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH))
        .when(part["type"] == "audio", F.ceil(part["seconds"] * AUDIO_RATE))
        .when(part["type"] == "document", part["pages"].cast("long") * PAGE_TOKENS)
    )
    return F.greatest(F.coalesce(size, F.lit(1)), F.lit(1)).cast("long")


def format_chat(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, turn_starts, loss_spans, attachments, expanded_tokens``.

    ``parts`` is an array of ``PART``. Parts of another or no type are texts, and neighbouring texts are one; null parts and texts are
    empty, a null role is the empty role, and null ids make one conversation. Turns are
    ordered by number, null last; turns of one number by role and content, and repeated
    rows all stay. Other columns are ignored. All offsets count code points of
    ``formatted``: ``turn_starts`` has one per turn, ``loss_spans`` (turn, start, length)
    cover each text of the assistant as it stands there, ``attachments`` (turn, start,
    type, ref, tokens) point to placeholders. Running sums over the parts give the
    offsets; they share the one exchange by conversation with the collection. A
    conversation becomes one string, so it has to fit in a task.
    """
    given = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>"))
    whole = F.when(F.size(given) > 0, joined_texts(given)).otherwise(text_part(F.lit(None).cast("string")))
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("_role"),
        whole.alias("_parts"),
        F.monotonically_increasing_id().alias("_row"),
    ).select(
        "conv_id",
        "_turn",
        "_role",
        "_row",
        F.xxhash64("_parts").alias("_hash"),
        F.size("_parts").alias("_n"),
        F.posexplode("_parts").alias("_at", "_part"),
    )
    is_text = ~F.coalesce(F.col("_part.type").isin(KINDS), F.lit(False))
    body = F.when(is_text, escape(F.coalesce(F.col("_part.text"), F.lit("")))).otherwise(F.concat(F.lit("<|"), F.col("_part.type"), F.lit("|>")))
    lead = F.when(F.col("_at") == 0, F.concat(F.lit(START), escape(F.col("_role")), F.lit(BODY))).otherwise("")
    tail = F.when(F.col("_at") == F.col("_n") - 1, F.lit(END)).otherwise("")
    laid = rows.select("*", is_text.alias("_text"), lead.alias("_lead"), body.alias("_body"), tail.alias("_tail"))
    laid = laid.withColumn("_chars", (F.length("_lead") + F.length("_body") + F.length("_tail")).cast("long"))
    order = Window.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_last(), "_role", "_hash", "_row", "_at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    begun = F.sum((F.col("_at") == 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = laid.select(
        "*",
        F.row_number().over(order).alias("_place"),
        (begun - 1).cast("int").alias("_nth"),
        F.coalesce(F.sum("_chars").over(before), F.lit(0)).alias("_start"),
    )
    inner = (F.col("_start") + F.length("_lead")).alias("start")
    learnt = F.col("_text") & (F.col("_role") == LEARNT_ROLE) & (F.length("_body") > 0)
    span = F.when(learnt, F.struct(F.col("_nth").alias("turn"), inner, F.length("_body").alias("length")))
    attached = F.when(
        ~F.col("_text"),
        F.struct(F.col("_nth").alias("turn"), inner, F.col("_part.type").alias("type"), F.col("_part.ref").alias("ref"), expanded_tokens(F.col("_part")).alias("tokens")),
    )
    piece = F.struct(
        F.col("_place").alias("place"),
        F.concat("_lead", "_body", "_tail").alias("text"),
        F.when(F.col("_at") == 0, F.col("_start")).alias("turn_start"),
        span.alias("span"),
        attached.alias("attached"),
    )
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("_pieces"))

    def each(field: str) -> Column:
        return F.filter(F.transform("_pieces", lambda p: p[field]), lambda x: x.isNotNull())

    out = grouped.select(
        "conv_id",
        F.array_join(F.transform("_pieces", lambda p: p["text"]), "").alias("formatted"),
        each("turn_start").alias("turn_starts"),
        each("span").alias("loss_spans"),
        each("attached").alias("attachments"),
    )
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda total, a: total + a["tokens"])
    return out.select("conv_id", F.size("turn_starts").cast("long").alias("n_turns"), "formatted", "turn_starts", "loss_spans", "attachments", tokens.alias("expanded_tokens"))


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted conversation in order: an array of ``role, text``, restored."""

    def parsed(piece: Column) -> Column:
        inner = F.substring(piece, len(START) + 1, 2**31 - 1)
        role = F.substring_index(inner, BODY, 1)
        text = F.substring(inner, F.length(role) + len(BODY) + 1, F.length(inner))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda piece: piece != "")
    return F.transform(pieces, parsed)


def loss_texts(formatted: Column, turn_starts: Column, loss_spans: Column) -> Column:
    """The restored texts under the loss mask, in order. Each span is cut from its own turn."""
    pieces = F.split(formatted, r"<\|end\|>")
    parts = F.transform(F.array(pieces), lambda held: F.transform(
        loss_spans,
        lambda span: unescape(F.substring(F.get(held, span["turn"]), (span["start"] - F.get(turn_starts, span["turn"]) + 1).cast("int"), span["length"])),
    ))
    return F.get(parts, F.lit(0))
