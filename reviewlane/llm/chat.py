"""Chat formatting with Spark expressions only.

Turns are collected for each conversation, sorted, and adjacent turns of one role
become one block with one role header. Template::

    <|role:user|>text<|next|>text<|end|><|role:assistant|>text<|end|>

`<|next|>` divides the merged turns of a block. Every control string of the template is
`<|name|>`, and inside roles and texts a backslash follows the first character of each string in
CONTROL; backslashes themselves are doubled first. A single backslash after the first character of such a string
therefore only comes from escaping, and unescape() gives back each text exactly.

Defined results: null text or role is empty; turns are ordered by (turn, role, text)
with null turns first; repeated rows are turns of their own; null conversation ids form
one conversation; a very long text or conversation is formatted whole; an empty table gives
no rows; other columns are ignored, whatever their names.

Limit: a conversation is one array, and so one row of one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlane.llm.common import sums_before

# Strings with which chat templates mark turns.
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

NEXT, END = "<|next|>", "<|end|>"
_HEADER = r"^<\|role:((?s:.*?))\|>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    out = text
    for mark in reversed(CONTROL):
        out = F.replace(out, F.lit(mark[0] + "\\" + mark[1:]), F.lit(mark))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def _escaped_role(role: Column) -> Column:
    """A role that ends in the first character of the mark's end gets a backslash, so that the header is read alike."""
    safe = escape(role)
    return F.when(F.endswith(safe, F.lit("<")), F.concat(safe, F.lit("\\"))).otherwise(safe)


def _read_role(role: Column) -> Column:
    return unescape(F.when(F.endswith(role, F.lit("<\\")), F.left(role, F.length(role) - 1)).otherwise(role))


def _merged(turns: Column) -> Column:
    """Blocks (role, texts) of adjacent turns with one role: cut where the role changes, so each turn is copied once."""
    role = lambda i: F.get(turns, i)["role"]
    every = F.filter(F.transform(turns, lambda _, i: i), lambda i: (i == 0) | (role(i) != role(i - 1)))

    def block(begins):
        end = lambda j: F.coalesce(F.get(begins, j + 1), F.size(turns))
        return F.transform(
            begins,
            lambda i, j: F.struct(role(i).alias("role"), F.transform(F.slice(turns, i + 1, end(j) - i), lambda t: t["text"]).alias("texts")),
        )

    return F.transform(F.array(every), block)[0]


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: its id and `formatted`, the whole formatted string."""
    ordered = turns.groupBy(F.col(conv)).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col(turn).alias("turn"),
                    F.coalesce(F.col(role), F.lit("")).alias("role"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"),
                )
            )
        ).alias("turns")
    )
    safe = F.transform("turns", lambda t: F.struct(_escaped_role(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    blocks = F.transform(
        _merged(F.col("safe")),
        lambda b: F.concat(F.lit("<|role:"), b["role"], F.lit("|>"), F.array_join(b["texts"], NEXT), F.lit(END)),
    )
    escaped = ordered.select(F.col(conv), safe.alias("safe"))
    return escaped.select(F.col(conv), F.array_join(blocks, "").alias("formatted"))


def loss_spans(formatted: Column, role: str = "assistant") -> Column:
    """(start, length, text) of each text of the role's blocks: code points, from 1, text unescaped.

    Blocks and texts are cut once and placed by sums of their lengths (`sums_before`).
    """
    none = F.array().cast("array<struct<start:bigint,length:int,text:string>>")

    def texts(block: Column, at: Column) -> Column:
        name = F.regexp_extract(block, _HEADER, 1)
        head = F.length(name) + len("<|role:|>")
        parts = F.split(F.substring(block, head + 1, F.length(block)), r"<\|next\|>")
        spans = lambda held: F.zip_with(
            held,
            sums_before(F.transform(held, lambda t: F.length(t) + len(NEXT))),
            lambda t, before: F.struct((at + head + before + 1).alias("start"), F.length(t).alias("length"), unescape(t).alias("text")),
        )
        return F.when((block != "") & (_read_role(name) == role), F.transform(F.array(parts), spans)[0]).otherwise(none)

    blocks = F.split(formatted, r"<\|end\|>")
    placed = lambda held: F.zip_with(held, sums_before(F.transform(held, lambda b: F.length(b) + len(END))), texts)
    return F.flatten(F.transform(F.array(blocks), placed)[0])


def loss_text(spans: Column) -> Column:
    """All text under the loss mask, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: s["text"]), "")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, in order."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.regexp_replace(b, _HEADER, ""), r"<\|next\|>"),
                lambda t: F.struct(
                    _read_role(F.regexp_extract(b, _HEADER, 1)).alias("role"), unescape(t).alias("text")
                ),
            ),
        )
    )
