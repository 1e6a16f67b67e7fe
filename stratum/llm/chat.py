"""Chat formatting with typed content parts, by built-in column functions only.

A turn's content is an array of parts: text, image, audio or document. A visitor flattens a conversation's parts
in order: texts are escaped, other parts become placeholders like <|image:2.0|> (turn 2, part 0), their references
are recorded, and their expanded token counts added up. The template marks turns:

    <|im_start|>ROLE\\nCONTENT<|im_end|>\\n

Control strings begin with <|. Inside texts and roles, <| becomes <\\| , and a run of backslashes between < and |
grows by one, so that no text holds <| and reading takes one away again. A line feed in a role becomes <|nl|>, and
<|+|> stands between neighbouring texts, whose ends could make a control string together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, STOP, LINE, NEXT = "<|im_start|>", "<|im_end|>", "<|nl|>", "<|+|>"
PART = "struct<kind:string,text:string,ref:string,units:bigint>"
#: Tokens that a unit of an attachment takes: a tile of an image, a second of audio, a page of a document.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, NEXT.replace("|", r"\|").replace("+", r"\+")), lambda t: F.regexp_replace(t, r"<\\(\\*)\|", "<$1|")), "")


def text_parts(text: Column) -> Column:
    """A text as an array of one part; null is an empty text."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), F.lit(None).alias("ref"), F.lit(None).alias("units"))
    return F.array(part).cast(f"array<{PART}>")


def unit_tokens(part: Column) -> Column:
    """Tokens that a part takes in place of its placeholder: 0 for text; units count 1 if null."""
    out = F.lit(0).cast("long")
    for kind, tokens in UNIT_TOKENS.items():
        out = F.when(part["kind"] == kind, F.coalesce(part["units"], F.lit(1).cast("long")) * tokens).otherwise(out)
    return out


def visit(part: Column, turn: Column, place: Column) -> Column:
    """A part as it stands in the formatted text. A part of an unknown or null kind is text."""
    mark = F.concat(F.lit("<|"), part["kind"], F.lit(":"), turn.cast("string"), F.lit("."), place.cast("string"), F.lit("|>"))
    return F.when(part["kind"].isin(*UNIT_TOKENS), mark).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", trained_role: str = "assistant") -> DataFrame:
    """One row for each conversation: its id, formatted, loss_spans, attachments and expanded_tokens.

    Rows are ordered by turn, null turns first, ties by role and content; repeated rows are turns of their own.
    A null conversation id is a conversation of its own. A null role is empty, null parts are none, no rows give
    none. loss_spans is the loss mask: (start, length) in characters of formatted, one for the content of each of
    the trained role's turns. attachments are (turn, part, kind, ref, tokens) in order. Other columns are not
    read, so their names may be any.
    """
    role = F.coalesce(turns[role_col].cast("string"), F.lit(""))
    row = F.struct(turns[turn_col].alias("turn"), role.alias("role"), F.coalesce(turns[parts_col], F.array().cast(f"array<{PART}>")).alias("parts"))
    grouped = turns.select(turns[conv_col].alias("conv"), row.alias("row")).groupBy("conv").agg(F.array_sort(F.collect_list("row")).alias("rows"))

    def segments(row: Column, turn: Column) -> Column:
        head = F.concat(F.lit(START), F.regexp_replace(escape(row["role"]), "\n", LINE), F.lit("\n"))
        is_text = lambda p: ~F.coalesce(p["kind"].isin(*UNIT_TOKENS), F.lit(False))
        between = lambda p, k: F.when((k > 0) & is_text(p) & is_text(F.get(row["parts"], k - 1)), NEXT).otherwise("")
        content = F.array_join(F.transform(row["parts"], lambda p, k: F.concat(between(p, k), visit(p, turn, k))), "")
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(part(head, F.lit(False)), part(content, row["role"] == trained_role), part(F.lit(f"{STOP}\n"), F.lit(False)))

    def attached(row: Column, turn: Column) -> Column:
        every = F.transform(row["parts"], lambda p, k: F.struct(turn.alias("turn"), k.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), unit_tokens(p).alias("tokens")))
        return F.filter(every, lambda a: a["kind"].isin(*UNIT_TOKENS))

    out = grouped.select("conv", F.flatten(F.transform("rows", segments)).alias("segments"), F.flatten(F.transform("rows", attached)).alias("attachments"))
    # The lengths of the segments, added up, are where they begin. An array of spans grows by one only at a span under the mask.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    span = lambda at, n: F.array(F.struct(at.alias("start"), n.alias("length")))
    step = lambda s, n: F.struct((s["at"] + n["n"]).alias("at"), F.when(n["loss"], F.concat(s["spans"], span(s["at"], n["n"]))).otherwise(s["spans"]).alias("spans"))
    lengths = F.transform("segments", lambda s: F.struct(F.length(s["text"]).alias("n"), s["loss"].alias("loss")))
    return out.select(
        F.col("conv").alias(conv_col), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.aggregate(lengths, start, step, lambda s: s["spans"]).alias("loss_spans"), "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text), unescaped; placeholders stay in the text. Null gives null, a text without turns none."""

    def turn(piece: Column) -> Column:
        at = F.instr(piece, "\n")
        role = F.substring(piece, F.lit(1), at - 1)
        text = F.substring(piece, at + 1, F.length(piece) - at - len(STOP) - 1)
        return F.struct(unescape(F.regexp_replace(role, r"<\|nl\|>", "\n")).alias("role"), unescape(text).alias("text"))

    pieces = F.split(formatted, START.replace("|", r"\|"))
    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces), F.lit(1))), turn)


def trained_text(formatted: Column, loss_spans: Column) -> Column:
    """All of the formatted text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
