"""Chat formatting by a finite-state machine over roles, in DataFrame operations only.

A declarative template gives the markers, the machine's transitions and the roles that carry loss. Every conversation
becomes a list of segments (text, loss); the formatted text is their concatenation. Control strings inside roles and
texts are escaped reversibly: a backslash doubles, and every place where a control string begins gets a backslash
after its first character, so no control string survives inside a text, overlapping ones included.

Defined cases: null texts and null roles count as empty; rows sort by turn, then role, then text, nulls first, and
repeated rows are turns of their own; a null conversation id is a conversation of its own; an unknown or misplaced
role makes the conversation invalid from that turn on, and it is still formatted in full; an empty table gives an
empty result. Other columns are not read. One conversation is one output text, so its turns meet in one row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Markers around a turn, the roles' machine, loss roles, and further control strings to escape."""

    open: str = "<|turn|>"
    middle: str = "<|text|>"
    close: str = "<|end|>"
    start: str = "start"
    #: (state, role) -> next state
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"}
    )
    #: states in which a conversation is complete
    final: tuple[str, ...] = ("assistant",)
    loss_roles: tuple[str, ...] = ("assistant",)
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.middle, self.close, *self.foreign)

    def __post_init__(self):
        if any(len(c) < 2 or "\\" in c for c in self.controls):
            raise ValueError("a control string needs two characters and no backslash")


def _pattern(text: str) -> str:
    """``text`` as a literal of Java's regular expressions."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def escape(text: Column, template: ChatTemplate) -> Column:
    begins = "|".join(map(_pattern, template.controls))
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"(?s)(?={begins})(.)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, template: ChatTemplate | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_col``, segments array<struct<text, loss>>, formatted, state, valid, complete, bad_turn.

    ``state`` is the machine's state after the last turn ("invalid" after a misplaced role), ``bad_turn`` the index of
    the first misplaced turn or null, ``complete`` whether the machine stopped in a final state.
    """
    t = template or ChatTemplate()
    empty = F.lit("")
    grouped = turns.groupBy(F.col(conv_col).alias("conv")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text")))).alias("turns")
    )
    moves = F.create_map(*[F.lit(x) for (state, role), to in t.transitions.items() for x in (f"{state}\n{role}", to)])

    def step(s: Column, x: Column) -> Column:
        to = F.when(s["bad"].isNull(), F.coalesce(F.element_at(moves, F.concat(s["state"], F.lit("\n"), x["role"])), F.lit("invalid"))).otherwise(F.lit("invalid"))
        return F.struct(to.alias("state"), (s["at"] + 1).alias("at"), F.coalesce(s["bad"], F.when(to == "invalid", s["at"])).alias("bad"))

    machine = F.aggregate("turns", F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad")), step)

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def spell(x: Column) -> Column:
        return F.array(
            segment(F.concat(F.lit(t.open), escape(x["role"], t), F.lit(t.middle)), F.lit(False)),
            segment(escape(x["text"], t), x["role"].isin(*t.loss_roles)),
            segment(F.lit(t.close), F.lit(False)),
        )

    return (
        grouped.select("conv", machine.alias("m"), F.flatten(F.transform("turns", spell)).alias("segments"))
        .select(
            F.col("conv").alias(conv_col),
            "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            F.col("m.state").alias("state"),
            F.col("m.bad").isNull().alias("valid"),
            F.col("m.state").isin(*t.final).alias("complete"),
            F.col("m.bad").alias("bad_turn"),
        )
    )


def parse_chat(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns of a formatted text, array<struct<role, text>> with escapes undone: the inverse of the formatter."""
    t = template or ChatTemplate()
    pieces = F.split(formatted, _pattern(t.close))
    halves = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.split(F.substr(p, F.lit(len(t.open) + 1)), _pattern(t.middle), 2))
    return F.transform(halves, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, escapes undone, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
