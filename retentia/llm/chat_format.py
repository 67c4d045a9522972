"""Chat formatting with typed content parts, in DataFrame functions only.

A conversation's turns are rendered in order as

    <turn ROLE>CONTENT</turn>\\n

CONTENT is a turn's parts one after another. Text is escaped so that the
template's marks cannot occur in it: ``\\`` becomes ``\\b`` and ``<`` becomes
``\\l`` (in roles also ``>`` as ``\\g``); every backslash of the result starts
such a pair, so undoing them is exact. An image, audio or document part
becomes the placeholder ``<image/>``, ``<audio/>`` or ``<document/>``; the
n-th placeholder of a conversation belongs to its n-th attachment reference,
which also holds the number of tokens the placeholder expands to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<turn ", ">", "</turn>\n"
TEXT = "text"
#: Tokens that one unit of an attachment expands to (unit: image tile, second of audio, page of a document).
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
PARTS_TYPE = "array<struct<kind:string,text:string,ref:string,units:int>>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(">"), F.lit("\\g"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\g"), F.lit(">")))


def text_parts(text: Column) -> Column:
    """A plain text as a turn of one text part."""
    return F.array(
        F.struct(
            F.lit(TEXT).alias("kind"),
            text.alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("units"),
        )
    )


def _visit(part: Column, tokens_per_unit: dict[str, int]) -> Column:
    """One part as a string: text escaped, an attachment as its placeholder."""
    out = escaped(F.coalesce(part["text"], F.lit("")))
    for kind in tokens_per_unit:
        out = F.when(part["kind"] == kind, F.lit(f"<{kind}/>")).otherwise(out)
    return F.when(part.isNull(), F.lit("")).otherwise(out)


def _reference(part: Column, tokens_per_unit: dict[str, int]) -> Column:
    each = F.lit(0)
    for kind, n in tokens_per_unit.items():
        each = F.when(part["kind"] == kind, F.lit(n)).otherwise(each)
    units = F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(0)).cast("long")
    return F.struct(part["kind"].alias("kind"), part["ref"].alias("ref"), (units * each).alias("tokens"))


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts_col: str = "parts",
    loss_roles: tuple[str, ...] = ("assistant",),
    tokens_per_unit: dict[str, int] = TOKENS_PER_UNIT,
) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (array of
    {start, length}, in code points from 0), attachments (array of {kind,
    ref, tokens}, in the order of the placeholders), attachment_tokens.

    ``parts`` has PARTS_TYPE. Turns are ordered by turn number, then role,
    then content; a null number comes first, and repeated rows stay repeated.
    A null role, part list or text counts as empty, a kind that is not listed
    as text, null units as 1, negative ones as 0. A null conversation id is a
    conversation of its own. An empty table gives an empty result. Other
    columns are not looked at. One conversation must fit into one row.
    """
    kinds = list(tokens_per_unit)
    parts = F.coalesce(F.col(f"`{parts_col}`"), F.array().cast(PARTS_TYPE))
    role = F.coalesce(F.col(f"`{role_col}`"), F.lit(""))
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.col(f"`{turn_col}`").alias("turn"),
        role.alias("role"),
        F.concat(F.lit(OPEN), escaped_role(role), F.lit(CLOSE)).alias("head"),
        F.array_join(F.transform(parts, lambda p: _visit(p, tokens_per_unit)), "").alias("content"),
        F.transform(
            F.filter(parts, lambda p: p.isNotNull() & p["kind"].isin(kinds)), lambda p: _reference(p, tokens_per_unit)
        ).alias("refs"),
    )
    # a running sum before the turns are gathered keeps long conversations linear
    before = (
        Window.partitionBy("conv_id")
        .orderBy("turn", "role", "content", "refs")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    length = F.char_length("head") + F.char_length("content") + F.lit(len(END))
    placed = rows.withColumn("start", F.coalesce(F.sum(length.cast("long")).over(before), F.lit(0)))
    gathered = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "role", "head", "content", "refs"))).alias("turns")
    )
    trained = F.filter("turns", lambda t: t["role"].isin(*loss_roles))
    return gathered.select(
        "conv_id",
        F.array_join(
            F.transform("turns", lambda t: F.concat(t["head"], t["content"], F.lit(END))), ""
        ).alias("formatted"),
        F.transform(
            trained,
            lambda t: F.struct(
                (t["start"] + F.char_length(t["head"])).alias("start"),
                F.char_length(t["content"]).cast("long").alias("length"),
            ),
        ).alias("loss_mask"),
        F.flatten(F.transform("turns", lambda t: t["refs"])).alias("attachments"),
    ).withColumn(
        "attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda total, a: total + a["tokens"])
    )


def read_turns(formatted: Column) -> Column:
    """array of {role, content} read back from a formatted conversation;
    content has its placeholders, everything else unescaped."""
    # an escaped text has no "<", so the end mark is always the template's own
    pieces = F.filter(F.split(formatted, END.replace("\n", "\\n")), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped_role(F.substring(F.substring_index(p, CLOSE, 1), len(OPEN) + 1, 2**31 - 1)).alias("role"),
            unescaped(_after(p)).alias("content"),
        ),
    )


def _after(piece: Column) -> Column:
    """What follows a turn's head."""
    return F.substr(piece, F.instr(piece, CLOSE) + F.lit(1))


def masked_texts(formatted: Column, loss_mask: Column) -> Column:
    """array of the unescaped texts under the mask's spans."""
    # fixed-width code points make each span one slice; the character before a
    # span (the head's end) goes along, as a decoder may take a leading U+FEFF
    # for a byte order mark
    wide = F.encode(formatted, "UTF-32")
    return F.transform(
        loss_mask,
        lambda m: unescaped(
            F.substr(
                F.decode(
                    F.substr(wide, (m["start"] * 4 - 3).cast("int"), (m["length"] * 4 + 4).cast("int")), "UTF-32"
                ),
                F.lit(2),
            )
        ),
    )
