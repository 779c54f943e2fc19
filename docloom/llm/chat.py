"""Chat formatting with typed content parts.  DataFrame functions only.

A turn has a role and an ordered list of parts.  A visitor with one handler a kind flattens the parts into the
turn's body: text is escaped, and an image, audio or document part becomes a placeholder, with its reference and
the number of tokens it expands to recorded in order.  Other kinds become a placeholder of no tokens.

The template marks a turn as `<|turn|>role<|text|>body<|end|>`.  All control strings begin with `<|`.  Inside texts
and roles every backslash is doubled and `<|` becomes `<\\|`, also where the two characters stand in neighbouring text
parts, so no text can spell a control string and one replacement undoes it.

Defined cases: a null role or text is empty; a null list of parts has none; turns are ordered by turn (null first),
then role, then unescaped body, so repeated rows and ties stand side by side; a null conversation id is a conversation;
extra columns are not read; an empty table gives an empty table.  The result of a conversation is one string by
contract, so a conversation must fit a row; all its pieces are formatted before they meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
#: Pixels a side of an image token, audio tokens a second, tokens a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _cells(pixels: Column) -> Column:
    return F.ceil(F.greatest(F.coalesce(pixels, F.lit(1)), F.lit(1)) / F.lit(PATCH))


#: kind -> the tokens that a part of it expands to; text is not listed.
ATTACHMENTS: dict[str, Callable[[Column], Column]] = {
    "image": lambda p: _cells(p["width"]) * _cells(p["height"]),
    "audio": lambda p: F.ceil(F.greatest(F.coalesce(p["seconds"], F.lit(0.0)), F.lit(0.0)) * AUDIO_RATE),
    "document": lambda p: F.greatest(F.coalesce(p["pages"], F.lit(1)), F.lit(1)) * PAGE_TOKENS,
}


def _is_text(part: Column) -> Column:
    return part["kind"].eqNullSafe(F.lit("text"))


def _body(part: Column, text: Column) -> Column:
    """What a part looks like in the body; `text` if it is one."""
    out = F.lit("<|other|>")
    for kind in ATTACHMENTS:
        out = F.when(part["kind"] == kind, F.lit(f"<|{kind}|>")).otherwise(out)
    return F.when(_is_text(part), text).otherwise(out)


def _escaped(part: Column, before: Column) -> Column:
    """A text part as it stands behind the part `before` (null for none); no text part is empty."""
    split = _is_text(before) & F.endswith(before["text"], F.lit("<")) & F.startswith(part["text"], F.lit("|"))
    return F.concat(F.when(split, F.lit("\\")).otherwise(F.lit("")), escape(part["text"]))


def _attachment(part: Column) -> Column:
    """The record of a part that isn't text."""
    tokens = F.lit(0).cast("long")
    for kind, count in ATTACHMENTS.items():
        tokens = F.when(part["kind"] == kind, count(part).cast("long")).otherwise(tokens)
    return F.struct(F.coalesce(part["kind"], F.lit("other")).alias("kind"), part["uri"].alias("uri"), tokens.alias("tokens"))


def text_parts(text: str) -> Column:
    """A turn's plain text as its only part."""
    fields = ("kind", "text", "uri", "width", "height", "seconds", "pages")
    given = {"kind": F.lit("text"), "text": F.col(text).cast("string")}
    return F.array(F.struct(*[given.get(f, F.lit(None)).alias(f) for f in fields])).cast(f"array<{PART}>")


def format_chats(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", parts: Column | None = None, trained: str = "assistant") -> DataFrame:
    """One row a conversation: its id, n_turns, segments, attachments and attachment_tokens.

    segments is array<struct<text, loss>>: their texts in order are the formatted conversation, and `loss` marks
    those under the loss mask, which are the bodies of the turns of role `trained`.
    """
    parts = text_parts("text") if parts is None else parts
    listed = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: ~(_is_text(p) & (F.coalesce(p["text"], F.lit("")) == "")))
    raw = F.array_join(F.transform("_ch_parts", lambda p: _body(p, p["text"])), "")
    escaped = F.array_join(F.transform("_ch_parts", lambda p, i: _body(p, _escaped(p, F.get("_ch_parts", i - 1)))), "")
    rows = turns.select(
        F.col(conversation).alias("_ch_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        listed.alias("_ch_parts"),
    ).select(
        "_ch_id",
        F.struct(
            "turn",
            "role",
            raw.alias("raw"),
            F.nullif(escaped, raw).alias("escaped"),
            F.transform(F.filter("_ch_parts", lambda p: ~_is_text(p)), _attachment).alias("attachments"),
        ).alias("t"),
    )
    whole = rows.groupBy("_ch_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    pieces = F.flatten(
        F.transform(
            "t",
            lambda t: F.array(
                segment(F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)), F.lit(False)),
                segment(F.coalesce(t["escaped"], t["raw"]), t["role"] == trained),
                segment(F.lit(END), F.lit(False)),
            ),
        )
    )
    attachments = F.flatten(F.transform("t", lambda t: t["attachments"]))
    return whole.select(
        F.col("_ch_id").alias(conversation),
        F.size("t").cast("long").alias("n_turns"),
        pieces.alias("segments"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("attachment_tokens"),
    )


def formatted(segments: str | Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def under_loss(segments: str | Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def parse(text: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds; placeholders stay as they are."""
    pieces = F.filter(F.split(text, r"<\|turn\|>"), lambda p: p != "")
    halves = F.transform(pieces, lambda p: F.split(p, r"<\|text\|>"))
    body = lambda h: F.regexp_replace(F.get(h, F.lit(1)), r"<\|end\|>\z", "")
    return F.transform(halves, lambda h: F.struct(unescape(F.get(h, F.lit(0))).alias("role"), unescape(body(h)).alias("text")))
