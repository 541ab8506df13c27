"""Chat formatting: a finite-state machine over roles checks the order of the
turns of each conversation, and a declarative template turns them into text
segments with a loss flag each. Built-in SQL functions only.

Defined cases: rows of one conversation are ordered by turn, then role, then
text (nulls first), so ties and repeated rows have one order and all are kept;
a null text is empty, a null role is the empty role; rows with a null
conversation id form one conversation; a role that the template does not name
is written with its own (escaped) name, bears no loss, and makes the
conversation invalid, as does any step the machine lacks. Invalid
conversations are formatted like the others and flagged. An empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Turn markers, the roles whose text is trained on, and the machine.

    ``opening`` is put before a turn with ``{role}`` replaced, ``closing``
    after it. ``moves`` maps a state to the states that may follow; states are
    roles, ``start`` is the state before the first turn and ``final`` lists
    the roles that may end a conversation.
    """

    opening: str = "### {role}: "
    closing: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "^"
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "^": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    final: tuple[str, ...] = ("assistant",)


# Every character that can begin a control string, and the escape character
# itself, is written as backslash and letter. An escaped text therefore holds
# no marker, and decoding in the reverse order restores it.
ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c"), ("\n", "\\n")]


def escape(text: Column, pairs=None) -> Column:
    for raw, coded in pairs or ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column, pairs=None) -> Column:
    for raw, coded in reversed(pairs or ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


CHUNK_TURNS = 256


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: ``conv_id, segments, formatted, valid``.

    ``segments`` is the ordered array of (text, loss); ``formatted`` is their
    concatenation. Each turn is escaped and marked in its own row before
    anything is grouped. Turns are then gathered in two steps, first by
    (conversation, run of 256 turn numbers), so that a very long
    conversation is sorted and joined by many tasks and only its finished
    runs meet in the one row that the result has for it.
    """
    t = template or Template()
    opening, closing = t.opening.split("{role}"), t.closing
    role = F.coalesce(F.col("role"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    turns = rows.select(
        F.col("conv_id"),
        F.floor(F.col("turn") / CHUNK_TURNS).alias("_chunk"),
        F.struct(
            F.col("turn").alias("turn"),
            role.alias("role"),
            escape(text).alias("text"),
        ).alias("_turn"),
    )
    runs = turns.groupBy("conv_id", "_chunk").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))

    def segments_of(x: Column) -> Column:
        head = F.concat(F.lit(opening[0]), escape(x["role"], ROLE_ESCAPES), F.lit(opening[1]))
        seg = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
        return F.array(
            seg(head, F.lit(False)),
            seg(x["text"], x["role"].isin(*t.loss_roles)),
            seg(F.lit(closing), F.lit(False)),
        )

    runs = runs.select(
        "conv_id",
        F.struct(
            F.col("_chunk").alias("chunk"),
            F.flatten(F.transform("_turns", segments_of)).alias("segments"),
            F.transform("_turns", lambda x: x["role"]).alias("roles"),
        ).alias("_run"),
    )
    convs = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list("_run")).alias("_runs")).select(
        "conv_id",
        F.flatten(F.transform("_runs", lambda r: r["segments"])).alias("segments"),
        F.flatten(F.transform("_runs", lambda r: r["roles"])).alias("_roles"),
    )
    return convs.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        valid_order(F.col("_roles"), t).alias("valid"),
    )


def valid_order(roles: Column, t: Template) -> Column:
    """Run the machine: null is the dead state."""

    def step(state: Column, role: Column) -> Column:
        allowed = F.lit(False)
        for at, following in t.moves.items():
            allowed = allowed | ((state == at) & role.isin(*following))
        return F.when(F.coalesce(allowed, F.lit(False)), role)

    return F.coalesce(
        F.aggregate(roles, F.lit(t.start).cast("string"), step).isin(*t.final), F.lit(False)
    )


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Parse the output: ``conv_id, turns`` (array of role and text, from the
    formatted string) and ``loss_text`` (from the segments)."""
    t = template or Template()
    opening = t.opening.split("{role}")
    blocks = F.split(F.col("formatted"), _quoted(t.closing), -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def parse(block: Column) -> Column:
        mark = F.locate(opening[1], block, len(opening[0]) + 1) if opening[1] else F.lit(0)
        return F.struct(
            unescape(F.substring(block, F.lit(len(opening[0]) + 1), mark - F.lit(len(opening[0]) + 1)), ROLE_ESCAPES).alias("role"),
            unescape(F.substring(block, mark + F.lit(len(opening[1])), F.length(block))).alias("text"),
        )

    kept = F.filter("segments", lambda s: s["loss"])
    return formatted.select(
        "*",
        F.transform(blocks, parse).alias("turns"),
        F.array_join(F.transform(kept, lambda s: unescape(s["text"])), "").alias("loss_text"),
    )


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"
